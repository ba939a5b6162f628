"""Shared pieces: staged tables, row keys, text buffers, ranks and connected components."""

from __future__ import annotations

import gc
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a missing id in joins; real ids are told apart by the text's hash as well.
NO_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, else below the warehouse: driver and executors share both."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stage(frame: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a frame as Parquet and read it again: cuts lineage, survives lost executors.

    Plans that are no longer referenced are collected first, so that Spark can delete their shuffle files.
    """
    gc.collect()
    frame.sparkSession.sparkContext._jvm.System.gc()
    path = f"{folder}/{name}"
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later step reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str, text: str) -> list[Column]:
    """Two columns that tell rows apart: the id (nulls too) and a hash of the text, of 64 bits as many rows may share an id.

    Rows with the same id and text share their key, and so their result.
    """
    return [F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("k1"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k2")]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column, and where each row starts and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    step = np.dtype(np.int64 if wide else np.int32)
    offsets = np.frombuffer(offsets, step)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slabs(offsets: np.ndarray, size: int):
    """Cut rows into ranges of about ``size`` bytes; a longer row is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def split_rank(frame: DataFrame, group: list[str], order: list[str], weight: Column | None = None, parts: int = 1024,
               name: str = "rank", deal: Column | None = None) -> DataFrame:
    """Running sum of ``weight`` (1: a rank from 0) before each row of its group, whatever the group's size.

    Rows of a group are dealt by ``deal``, else by the hash of ``order``, into ``parts`` lists; the lists' totals
    are summed first, so no group is ever sorted as a whole. The order within a group is fixed but has no meaning.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    dealt = frame.withColumn("_part", F.pmod(F.xxhash64(*order) if deal is None else deal, F.lit(parts))).withColumn("_w", weight)
    keys = [F.col(c) for c in group]
    totals = dealt.groupBy(*group, "_part").agg(F.sum("_w").alias("_t"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"),
                           F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, F.col("_part")).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_in", F.coalesce(F.sum("_w").over(within), F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return ranked.join(totals, same).withColumn(name, F.col("_base") + F.col("_in")).drop(
        "_part", "_w", "_in", "_p", "_base", *[f"_g{i}" for i in range(len(group))])


def components(edges: DataFrame, folder: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node that it reaches.

    Alternates large-star and small-star steps until the edges stop changing; each round is written to the
    shared folder. A hub's edges meet its one-row minimum in a join, which may be split at any key.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                folder, "edges-0")
    seen = _digest(now)
    for i in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = stage(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), folder, f"edges-{i}")
        found = _digest(now)
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer's file; LLM_TOKENIZERS names another folder."""
    folder = os.environ.get("LLM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
