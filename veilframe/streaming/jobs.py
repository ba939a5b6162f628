"""Structured Streaming: the same column code on streams, and windowed audit statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.policy import apply_policy
from ..operators.preflight import preflight_gate
from ..operators.sanitize import sanitize


def checkpoint_root(spark: SparkSession, default: str | None = None) -> str:
    """Folder for streaming state: the cluster's shared checkpoint folder if it names one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and default is None:
        raise ValueError("set spark.checkpoint.dir or pass a folder")
    return found or default


#: Tasks a core that a batch of a stream is dealt to before its texts are treated.
BATCH_WAVES = 8


def dealt(texts: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows of every batch dealt out evenly: a file may be one split, and a batch one file, whatever its rows cost."""
    return texts.repartition(parts or BATCH_WAVES * texts.sparkSession.sparkContext.defaultParallelism)


def sanitize_stream(texts: DataFrame, text: str = "text", mode: str = "mask", policy=None, book=None,
                    parts: int | None = None, **options) -> DataFrame:
    """Stateless: the batch operators applied to a stream, whose batches are dealt to ``parts`` tasks."""
    texts = dealt(texts, parts) if texts.isStreaming else texts
    if policy is not None:
        return apply_policy(texts, policy, text, book, **options)
    return sanitize(texts, text, mode, book, **options)


def gate_stream(texts: DataFrame, text: str = "text", book=None, parts: int | None = None, **options) -> DataFrame:
    texts = dealt(texts, parts) if texts.isStreaming else texts
    return preflight_gate(texts, text, book, **options)


def distinct_events(events: DataFrame, key: str | list[str] = "request_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events delivered more than once count once, if the copies come within the watermark of each other.

    State holds a key until the watermark passes it, so it does not grow with the stream. A batch drops all copies.
    """
    keys = [key] if isinstance(key, str) else key
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def upsert_to_table(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df,
                    available_now: bool = True, timeout: int | None = None):
    """Write every micro-batch of ``work`` exactly once, whatever is replayed after a failure.

    A batch owns one folder of the table, named by its number, and replaces it as a whole; the folder only counts once
    its ledger entry is written, after the data. A batch that the ledger knows is skipped, one that died half way is
    written anew from the same input. Read the table with ``read_ledgered``.
    """
    query = _each_batch(stream, path, work).option("checkpointLocation", checkpoint)
    query = query.trigger(availableNow=True).start() if available_now else query.start()
    if available_now:
        query.awaitTermination(timeout) if timeout else query.awaitTermination()
    return query


def _each_batch(stream: DataFrame, path: str, work):
    return stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, path, work))


def write_batch(batch: DataFrame, number: int, path: str, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> bool:
    """One micro-batch into its folder, unless the ledger says that it is there; true if it was written."""
    spark = batch.sparkSession
    if _exists(spark, f"{path}/ledger/{number}.done"):
        return False
    work(dealt(batch)).write.mode("overwrite").parquet(f"{path}/data/batch={number}")
    _enter(spark, path, number)
    return True


def read_ledgered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that were written whole, with their batch number."""
    # one row per batch: the planner broadcasts it while it is small
    done = spark.read.schema("batch int").option("pathGlobFilter", "*.done").csv(f"{path}/ledger")
    return spark.read.parquet(f"{path}/data").join(done, "batch", "left_semi")


def _place(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    found, store = _place(spark, path)
    return store.exists(found)


def _enter(spark: SparkSession, path: str, number: int) -> None:
    """The entry appears whole or not at all: written beside and renamed."""
    (found, store), (beside, _) = _place(spark, f"{path}/ledger/{number}.done"), _place(spark, f"{path}/ledger/{number}.part")
    out = store.create(beside, True)
    out.writeBytes(f"{number}\n")
    out.close()
    if not store.rename(beside, found):
        raise RuntimeError(f"no ledger entry for batch {number} in {path}")


def windowed_stats(events: DataFrame, ts: str = "ts", window: str = "1 day", slide: str | None = None,
                   late: str = "10 minutes", by: list[str] | None = None, distinct: str | list[str] | None = None) -> DataFrame:
    """Audit counters per tumbling or sliding window; events later than the watermark are dropped.

    Needs hit_count, excluded_count and batch_size. State is one row per open window and label. ``distinct`` names the
    request id of events that may be delivered more than once: see ``distinct_events``, whose watermark is this one.
    """
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    if distinct:
        marked = distinct_events(events, distinct, ts, late)
    else:
        marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(span.alias("w"), *(by or [])).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_pii_hits"),
        F.coalesce(F.sum("excluded_count"), F.lit(0)).alias("total_excluded"),
        F.coalesce(F.sum(F.when(F.col("hit_count") == 0, F.col("batch_size"))), F.lit(0)).alias("total_clean"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(by or []),
             "total_requests", "total_pii_hits", "total_excluded", "total_clean")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append",
                 available_now: bool = True, timeout: int | None = None):
    """Write a stream to parquet; ``available_now`` drains what is there and stops."""
    writer = (stream.writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", checkpoint).outputMode(output_mode))
    query = writer.trigger(availableNow=True).start() if available_now else writer.start()
    if available_now:
        query.awaitTermination(timeout) if timeout else query.awaitTermination()
    return query
