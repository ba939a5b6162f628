"""Audit events and the statistics over them. No event carries text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..catalog.risk import ENTITY_TIER
from ..functions.core import column
from ..functions.risk import tier_sql
from .reports import rank_column

EVENT_COLUMNS = [
    "audit", "endpoint", "request_id", "client_ip", "api_key_prefix", "caller_name", "mode", "action",
    "batch_size", "hit_count", "excluded_count", "entity_types", "risk_level", "duration_ms", "policy",
    "subject_id", "destination", "correlation_id",
]


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def audit_events(result: DataFrame, *, endpoint: str, action, by: list[str] | None = None, mode=None, policy=None,
                 caller_name=None, subject_id=None, destination=None, correlation_id=None,
                 request_id: str | None = None, duration_ms: float | None = None) -> DataFrame:
    """One event per run, or per batch if ``by`` names the batch columns.

    ``result`` is what any operator gives: hit_count, entity_types, risk_level and, if it can drop rows, excluded.
    Each row becomes one row of its own and one per type; both are summed before the shuffle, so an event over a huge
    batch moves a row per type and task.
    """
    keys = by or []
    lone = F.struct(F.lit(None).cast("string").alias("t"), F.lit(1).alias("own"))
    named = F.transform(F.array_distinct(F.coalesce("entity_types", F.array().cast("array<string>"))),
                        lambda t: F.struct(t.alias("t"), F.lit(0).alias("own")))
    marks = result.select(*keys, "hit_count", (F.col("excluded") if "excluded" in result.columns else F.lit(False)).alias("excluded"),
                          rank_column("risk_level").cast("int").alias("rank"), F.explode(F.concat(F.array(lone), named)).alias("m"))
    own = F.col("m.own") == 1
    folded = marks.groupBy(*keys, F.col("m.t").alias("_type")).agg(
        F.count_if(own).alias("batch_size"), F.sum(F.when(own, F.col("hit_count"))).alias("hit_count"),
        F.count_if(own & F.col("excluded")).alias("excluded_count"), F.max("rank").alias("risk_rank"))
    folded = folded.groupBy(*keys).agg(
        F.coalesce(F.sum("batch_size"), F.lit(0)).alias("batch_size"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hit_count"),
        F.coalesce(F.sum("excluded_count"), F.lit(0)).alias("excluded_count"), F.array_sort(F.collect_set("_type")).alias("entity_types"),
        F.coalesce(F.max("risk_rank"), F.lit(0)).alias("risk_rank"))
    return _event(folded, keys, endpoint=endpoint, action=action, mode=mode, policy=policy, caller_name=caller_name, subject_id=subject_id,
                  destination=destination, correlation_id=correlation_id, request_id=request_id, duration_ms=duration_ms)


def _event(counts: DataFrame, keys: list[str], *, endpoint, action, mode, policy, caller_name, subject_id, destination, correlation_id,
           request_id, duration_ms) -> DataFrame:
    """Counters with what is known of the run around them."""
    return counts.withColumns({
        "audit": F.lit(True), "endpoint": F.lit(endpoint), "request_id": F.lit(request_id or str(uuid.uuid4())),
        "client_ip": F.lit(None).cast("string"), "api_key_prefix": F.lit(None).cast("string"),
        "caller_name": _c(caller_name), "mode": _c(mode), "action": _c(action),
        "risk_level": column(tier_sql("risk_rank")), "duration_ms": F.round(F.lit(duration_ms).cast("double"), 2),
        "policy": _c(policy), "subject_id": _c(subject_id), "destination": _c(destination),
        "correlation_id": _c(correlation_id),
    }).select(*keys, *EVENT_COLUMNS)


def observed(result: DataFrame, observation: Observation | str = "audit") -> DataFrame:
    """Attach the run's counters to a job that writes ``result`` anyway: no second pass and no second detection.

    Pass an ``Observation``, write the frame by one action, then make the event with ``observed_event``. Entity types
    are counted as a set: as many as the catalog has.
    """
    excluded = F.count_if(F.col("excluded")) if "excluded" in result.columns else F.lit(0)
    known = sorted(ENTITY_TIER)
    types = [F.max(F.array_contains("entity_types", t)).alias(f"has_{t}") for t in known]
    other = F.array_except(F.coalesce("entity_types", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in known]))
    return result.observe(observation, F.count(F.lit(1)).alias("batch_size"), F.sum("hit_count").alias("hit_count"), excluded.alias("excluded_count"),
                          F.max(rank_column("risk_level")).alias("risk_rank"), F.array_distinct(F.flatten(F.collect_set(other))).alias("other_types"), *types)


def observed_event(spark: SparkSession, observation: Observation, *, endpoint: str, action, mode=None, policy=None, caller_name=None,
                   subject_id=None, destination=None, correlation_id=None, request_id: str | None = None, duration_ms: float | None = None) -> DataFrame:
    """The run's audit event from the counters of ``observed``, once its one action is done; columns as ``audit_events``."""
    told = observation.get
    types = sorted({k[4:] for k, v in told.items() if k.startswith("has_") and v} | set(told.get("other_types") or ()))
    row = [(told["batch_size"], told["hit_count"] or 0, told["excluded_count"] or 0, types, int(told["risk_rank"] or 0))]
    counts = spark.createDataFrame(row, "batch_size bigint, hit_count bigint, excluded_count bigint, entity_types array<string>, risk_rank int")
    return _event(counts, [], endpoint=endpoint, action=action, mode=mode, policy=policy, caller_name=caller_name, subject_id=subject_id,
                  destination=destination, correlation_id=correlation_id, request_id=request_id, duration_ms=duration_ms)


def between(events: DataFrame, since, until, ts: str = "ts") -> DataFrame:
    """Statistics are reset by counting from a point in time on."""
    return events.where((F.col(ts) >= F.lit(since)) & (F.col(ts) < F.lit(until)))


def stats_totals(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    return events.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_pii_hits"),
        F.coalesce(F.sum("excluded_count"), F.lit(0)).alias("total_excluded"),
        F.coalesce(F.sum(F.when(F.col("hit_count") == 0, F.col("batch_size"))), F.lit(0)).alias("total_clean"))


def stats_by_type(events: DataFrame) -> DataFrame:
    """Events per entity type: one per event that holds the type, not one per hit."""
    types = events.select(F.explode_outer(F.array_distinct("entity_types")).alias("entity_type"))
    return types.where(F.col("entity_type").isNotNull()).groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("events"))


def stats_by_label(events: DataFrame) -> DataFrame:
    """(dimension, label, events) for mode, risk level and endpoint in one pass; a null mode is skipped."""
    labels = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("label"))
                       for d, c in (("mode", "mode"), ("risk_level", "risk_level"), ("endpoint", "endpoint"))])
    rows = events.select(F.explode_outer(labels).alias("x")).where(F.col("x.label").isNotNull())
    return rows.groupBy(F.col("x.dimension").alias("dimension"), F.col("x.label").alias("label")).agg(
        F.count(F.lit(1)).alias("events"))


def metrics(events: DataFrame) -> DataFrame:
    """(metric, label, value) rows: totals first, then counts per label, sorted. The events are read once."""
    def mark(metric: str, label: Column, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), label.cast("string").alias("label"), value.cast("long").alias("value"))

    none, one = F.lit(""), F.lit(1)
    clean = F.when(F.col("hit_count") == 0, F.col("batch_size")).otherwise(0)
    fixed = F.array(mark("requests_total", none, one), mark("pii_hits_total", none, F.col("hit_count")),
                    mark("excluded_total", none, F.col("excluded_count")), mark("clean_total", none, clean),
                    mark("mode_total", F.col("mode"), one), mark("risk_level_total", F.col("risk_level"), one),
                    mark("endpoint_total", F.col("endpoint"), one))
    types = F.transform(F.array_distinct(F.coalesce("entity_types", F.array().cast("array<string>"))),
                        lambda t: mark("entity_type_total", t, one))
    rows = events.select(F.explode(F.concat(fixed, types)).alias("p")).where(F.col("p.label").isNotNull()).select("p.*")
    counted = rows.groupBy("metric", "label").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    # without any event the four totals are zero
    zero = events.sparkSession.createDataFrame([(m, "", 0) for m in ("requests_total", "pii_hits_total", "excluded_total", "clean_total")],
                                               "metric string, label string, value bigint")
    return counted.unionByName(zero).groupBy("metric", "label").agg(F.sum("value").alias("value")).orderBy("metric", "label")
