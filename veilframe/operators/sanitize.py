"""Rewrite a text column: mask, redact, pseudonymize or exclude."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog.policies import check_mode
from ..catalog.rules import RuleBook
from ..functions.core import column, ident, lit
from ..functions.overlap import resolve_overlaps
from ..functions.pseudonym import Pseudonyms, seed_sql, stand_in_sql
from ..functions.rewrite import sanitize_sql
from .scan import scan, with_hits


def sanitize(df: DataFrame, text: str = "text", mode: str = "mask", book: RuleBook | None = None, *,
             redact_with: str = "", how: Pseudonyms = Pseudonyms(), include_excluded: bool = True,
             out: str = "sanitized_text", **options) -> DataFrame:
    """Add sanitized_text, excluded, mode and the scan summary.

    The text is detected once; summary and rewriting read the same hit array.
    """
    check_mode(mode)
    df = scan(df, text, book, **options)
    df = df.withColumns({
        out: column(sanitize_sql(ident(text), "hits", mode, redact_with, how)),
        "excluded": column("size(hits) > 0") if mode == "exclude" else F.lit(False),
        "mode": column(lit(mode)),
    })
    return df if include_excluded else kept_rows(df)


def kept_rows(df: DataFrame) -> DataFrame:
    """The rows that are not excluded.

    An outer explode of the kept row as an array: a plain filter would be pushed below the rewriting, and the detection
    would run once to filter and again to rewrite.
    """
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns])
    kept = df.select(F.explode_outer(F.filter(F.array(row), lambda r: ~r["excluded"])).alias("r"))
    return kept.where(F.col("r").isNotNull()).select("r.*")


def batch_counts(sanitized: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, excluded_count, clean_count, pii_count, hits; an excluded text is not clean."""
    return sanitized.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("excluded").alias("excluded_count"),
        F.count_if(~F.col("excluded") & ~F.col("pii_found")).alias("clean_count"),
        F.count_if("pii_found").alias("pii_count"),
        F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hit_count"),
    )


def resolved_hits(df: DataFrame, keys: list[str], text: str = "text", book: RuleBook | None = None,
                  **options) -> DataFrame:
    """One row per hit that survives overlap resolution, the spans a rewrite replaces."""
    found = with_hits(df, text, book, **options)
    kept = found.select(*keys, F.explode_outer(column(resolve_overlaps("hits"))).alias("h"))
    return kept.where(F.col("h").isNotNull()).select(
        *keys, F.col("h.entity_type").alias("entity_type"), F.col("h.start").alias("hit_start"),
        F.col("h.end").alias("hit_end"), F.round("h.score", 3).alias("score"))


def pseudonym_map(df: DataFrame, text: str = "text", book: RuleBook | None = None,
                  how: Pseudonyms = Pseudonyms(), **options) -> DataFrame:
    """Distinct (entity_type, seed, stand_in) of a data set with how often each occurs.

    Grouping is by seed, not by the original, so no raw value leaves the row it was found in.
    Occurrences are summed before the shuffle, so a value seen everywhere stays one row per task.
    """
    t = ident(text)
    found = with_hits(df, text, book, **options)
    original = f"substring({t}, m_h.start + 1, m_h.`end` - m_h.start)"
    pairs = column(f"transform({resolve_overlaps('hits')}, m_h -> named_struct('entity_type', m_h.entity_type, "
                   f"'seed', {seed_sql('m_h.entity_type', original, how)}))")
    rows = found.select(F.explode_outer(pairs).alias("p")).where(F.col("p").isNotNull()).select("p.entity_type", "p.seed")
    counted = rows.groupBy("entity_type", "seed").agg(F.count(F.lit(1)).alias("occurrences"))
    return counted.withColumn("stand_in", column(stand_in_sql("entity_type", "seed", how)))


def pseudonym_collisions(mapping: DataFrame) -> DataFrame:
    """Stand-ins shared by several seeds, per entity type."""
    return mapping.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("seeds"),
        F.countDistinct("stand_in").alias("stand_ins"),
        F.sum("occurrences").alias("occurrences"))
