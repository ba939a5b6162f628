"""The corpus pipeline: five stages over the documents, each written as Parquet and read again as the next one's input.

    quality         documents that the quadratic discriminant rejects go
    near_duplicates one document of each SimHash class stays, the one of least id
    repeats         passages of 200 bytes that occur elsewhere too are cut out of the texts
    mixture         documents are repeated or left out so that each source comes near its target; those without words leave
    packing         the texts' tokens are packed into sequences of 4,096

All but the last return the columns of ``documents``. No stage drops a row for its nulls: a missing text counts as an
empty one, rows without an id are told apart by their text. A document without words (missing, empty, or cut to nothing
by ``repeats``) has nothing to mix and goes no further than the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.common import NO_ID, discard, shared_folder, stage, table
from veilframe.llm.mixing import mix
from veilframe.llm.packing import pack
from veilframe.llm.quality import fit, measured, scored
from veilframe.llm.simhash import near_duplicates
from veilframe.llm.suffixes import repeated_bytes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of predicted quality 1; the model learns from the labelled ones among them, outside of the held-out fold.

    Texts are measured once, written with their statistics, and never shuffled.
    """
    rows = stage(measured(docs.select(*COLUMNS).withColumn("_body", F.col("text"))), shared_folder(spark), "measured")
    judged = scored(rows, fit(rows, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return judged.where("predicted = 1").withColumnRenamed("_body", "text").select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: of the rows with the class's least id the one of least text hash; without an id, by text hash.

    A class is its root, not its id: ids may repeat on texts that have nothing in common.
    """
    rows = near_duplicates(docs.withColumn("_h", F.xxhash64("text")), carry=["_h"], root=True)
    # per class one small row; a hot class is combined before the shuffle
    first = rows.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("m")).select("m.*")
    named = first.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_k"), "_h")
    kept = docs.withColumn("_k", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("_h", F.xxhash64("text")).join(named, ["_k", "_h"])
    # rows that repeat both id and text: one of them; they are already in one place
    order = Window.partitionBy("_k", "_h").orderBy("lang", "source", "n_chars")
    return kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat (whole characters only); n_chars is counted anew."""
    return repeated_bytes(docs, keep_text=True).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: taken / size, rounded by a number drawn from its id.

    Rows that repeat id, text and source each get their mean. Documents without words have size 0 and are not taken.
    """
    taken = mix(docs)
    share = F.try_divide(F.sum("taken"), F.sum("size"))
    draw = F.pmod(F.xxhash64("doc_id", "h", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    times = taken.groupBy("doc_id", "h", "source").agg(share.alias("share")).withColumn("times", F.floor(F.col("share") + draw).cast("int")).where(
        "share > 0 AND times > 0").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("source").alias("_s"), "times")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_s"))
    return docs.join(times, same).withColumn("_i", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates_stage), ("repeats", repeats), ("mixture", mixture), ("packing", packing)]

#: Training, hashing and tokens have no SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, through Parquet in the shared folder."""
    folder = shared_folder(spark)
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), folder, name)
        if before:  # the next stage is written: nothing reads the one before it any more
            discard(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
