"""Readers: files of rows or texts as DataFrames, with their quirks settled.

None of them infers types from a sample: delimited cells are strings, as written.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .layout import gather

CORRUPT = "_corrupt_record"


def _delimited(spark: SparkSession, path, sep: str, multi_line: bool) -> DataFrame:
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line, "encoding": "UTF-8",
               "inferSchema": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
               "emptyValue": "", "columnNameOfCorruptRecord": "_line", "mode": "PERMISSIVE"}
    names = spark.read.options(**options).csv(path).columns
    if not names:
        return spark.read.options(**options).csv(path)
    names[0] = names[0].lstrip("\ufeff")
    fields = [T.StructField(n, T.StringType()) for n in names]
    df = spark.read.options(**options).schema(T.StructType([*fields, T.StructField("_line", T.StringType())])).csv(path)
    # Spark refuses to read the line alone, so another column is asked for, in a form that is always null.
    first = F.col("`" + names[0].replace("`", "``") + "`")
    return df.withColumn(CORRUPT, F.coalesce("_line", F.nullif(first, first))).drop("_line")


def read_csv(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """CSV with a header; quoted fields may hold separators, doubled quotes and line breaks.

    A row with more or fewer cells than the header keeps the cells that have a name; its whole line is in the column
    ``_corrupt_record``, so that no cell is lost: set such rows aside with ``split_rejects``, or treat that column too.
    ``multi_line=False`` lets a single huge file be split between tasks; use it where no quoted field spans lines.
    """
    return _delimited(spark, path, ",", multi_line)


def read_tsv(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    return _delimited(spark, path, "\t", multi_line)


def _object_schema(items: DataFrame) -> T.StructType:
    """The fields of all objects, merged in one aggregation; whole numbers are bigint, others double."""
    found = items.agg(F.schema_of_variant_agg(F.try_parse_json("item")).alias("s")).first()["s"] or "VOID"
    if not found.startswith("OBJECT<"):
        return T.StructType([])
    plain = re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", found).replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    return T._parse_datatype_string(plain)


#: JSON array files beyond this size are read in pieces by many tasks instead of as one string each.
WHOLE_BYTES = 64 << 20


def _whole_items(spark: SparkSession, path, whole_bytes: int) -> DataFrame:
    """(item, is_array) of the files that fit in one string; the larger ones are not opened."""
    text = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_size") <= whole_bytes).withColumn("items", F.from_json("value", "array<string>"))
    items = text.select(F.explode_outer(F.when(F.col("items").isNull(), F.array("value")).otherwise(
        F.transform("items", lambda x: F.coalesce(x, F.lit("null"))))).alias("item"), F.col("items").isNotNull().alias("is_array"))
    return items.where("item IS NOT NULL")


def _pieces(spark: SparkSession, path, whole_bytes: int) -> DataFrame:
    """The larger files cut at every comma, wherever their splits begin: (file, block, n, value), n in order within a split."""
    text = spark.read.option("lineSep", ",").text(path).where(F.col("_metadata.file_size") > whole_bytes)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("n"), "value")


def _split_items(spark: SparkSession, path, whole_bytes: int) -> DataFrame:
    """(item, is_array) of the larger files: no task holds more than a split's pieces in order and one item.

    Whether a piece begins inside a string is the parity of the quotes before it, its depth the sum of brackets outside
    of strings before it. Both are summed within a split; the splits' own totals, one row each, are summed by file. A
    comma at depth one and outside of a string ends an item.
    """
    here = Window.partitionBy("file", "block").orderBy("n")
    earlier, so_far = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = (F.length("plain") - F.length(F.replace("plain", F.lit('"'), F.lit("")))).cast("bigint")

    def depth(odd: int):
        """Brackets opened less closed outside of strings, if the piece begins outside (0) or inside (1) of one."""
        out = F.array_join(F.filter(F.split("plain", '"', -1), lambda x, i: i % 2 == odd), "")
        opened = F.length(out) - F.length(F.translate(out, "[{", ""))
        return (opened - (F.length(out) - F.length(F.translate(out, "]}", "")))).cast("bigint")

    pieces = _pieces(spark, path, whole_bytes).withColumn("plain", plain).withColumns({"q": quotes, "outside": depth(0), "inside": depth(1)}).drop("plain")
    pieces = pieces.withColumn("odd", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2)
    # depth of the piece for either parity at the split's beginning
    pieces = pieces.withColumns({"d0": F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")),
                                 "d1": F.when(F.col("odd") == 0, F.col("inside")).otherwise(F.col("outside"))}).drop("outside", "inside")
    pieces = pieces.withColumns({"s0": F.sum("d0").over(so_far), "s1": F.sum("d1").over(so_far)})
    totals = pieces.groupBy("file", "block").agg(F.sum("q").alias("q"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"),
                                                 F.min_by("value", "n").alias("first"), F.max_by("value", "n").alias("last"))
    totals = totals.withColumn("start_odd", F.coalesce(F.sum("q").over(blocks), F.lit(0)) % 2)
    totals = totals.withColumn("d", F.when(F.col("start_odd") == 0, F.col("d0")).otherwise(F.col("d1")))
    starts = totals.select(F.col("file").alias("f"), F.col("block").alias("b"), "start_odd", F.coalesce(F.sum("d").over(blocks), F.lit(0)).alias("start_depth"))
    files = totals.groupBy("file").agg(F.min_by("first", "block").alias("first"), F.max_by("last", "block").alias("last"), (F.sum("q") % 2).alias("q"), F.sum("d").alias("d"))
    is_array = F.col("first").rlike(r"^\ufeff?\s*\[") & F.col("last").rlike(r"\]\s*$") & (F.col("q") == 0) & (F.col("d") == 0)
    files = files.select(F.col("file").alias("f"), is_array.alias("is_array"))
    known = pieces.join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b")
    after = F.col("start_depth") + F.when(F.col("start_odd") == 0, F.col("s0")).otherwise(F.col("s1"))
    outside = (F.col("start_odd") + F.col("odd") + F.col("q")) % 2 == 0
    ends = F.when(outside & (after == 1), F.col("n"))
    # an item is named by the piece that ended the one before it; the first of a split may have begun in an earlier split
    known = known.withColumn("own", F.max(ends).over(earlier)).withColumn("ends", ends).select("file", "block", "n", "value", "own", "ends")
    last = known.groupBy("file", "block").agg(F.max("ends").alias("ends")).where("ends IS NOT NULL")
    begun = starts.join(last, (F.col("f") == F.col("file")) & (F.col("b") == F.col("block")), "left").select("f", "b", F.last(
        F.when(F.col("ends").isNotNull(), F.struct("b", "ends")), ignorenulls=True).over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    named = known.join(begun, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).withColumn(
        "item", F.coalesce(F.when(F.col("own").isNotNull(), F.struct(F.col("block").alias("b"), F.col("own").alias("ends"))), F.col("before")))
    items = named.groupBy("file", "item").agg(F.sort_array(F.collect_list(F.struct("block", "n", "value"))).alias("parts"),
                                              F.max_by("ends", F.struct("block", "n")).isNull().alias("closing"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), ",")
    items = items.join(files, F.col("file") == F.col("f")).withColumn("text", text)
    opened = F.when(F.col("is_array") & F.col("item").isNull(), F.regexp_replace("text", r"^\ufeff?\s*\[", "")).otherwise(F.col("text"))
    items = items.withColumn("text", opened)
    closed = F.when(F.col("is_array") & F.col("closing"), F.regexp_replace("text", r"\]\s*$", "")).otherwise(F.col("text"))
    items = items.withColumn("text", closed)
    bare = F.regexp_replace("text", r"^\s+|\s+$", "")
    empty = F.col("is_array") & F.col("item").isNull() & F.col("closing") & (bare == "")
    same_form = F.get(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>"), F.lit(0))
    return items.where(~empty).select(F.when(F.col("is_array"), F.coalesce(same_form, bare)).otherwise(F.col("text")).alias("item"), "is_array")


def read_json_array(spark: SparkSession, path, schema: T.StructType | str | None = None, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Files that each hold one array of objects; types as in the file.

    Whatever is no object of that kind comes back as a row with only the corrupt column set: a file that cannot be
    read as an array (broken, or a single object), an element that is null, a number, a string or a list, and an object
    with a value of another type than the schema's. They count in the total and are set aside with ``split_rejects``.
    The schema says which fields are read; without one all are, after a first pass over the files.

    A file of more than ``whole_bytes`` is cut at its commas and read by as many tasks as it has splits, its items put
    together again; strings in it must stand in double quotes. Where such a file is broken, each of its items is a
    reject of its own, as the whole may not fit in one string.
    """
    items = _whole_items(spark, path, whole_bytes).unionByName(_split_items(spark, path, whole_bytes))
    is_object = F.col("is_array") & F.col("item").rlike(r"^\s*\{")
    known = T._parse_datatype_string(schema) if isinstance(schema, str) else schema or _object_schema(items.where(is_object))
    wide = T.StructType([f for f in known.fields if f.name != CORRUPT] + [T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = items.select("item", F.when(is_object, F.from_json("item", wide, options)).alias("r"))
    bad = F.when(F.col("r").isNull(), F.col("item")).otherwise(F.col(f"r.{CORRUPT}"))
    return parsed.select(*[F.when(bad.isNull(), F.col(f"r.`{f.name}`")).alias(f.name) for f in wide.fields[:-1]], bad.alias(CORRUPT))


def split_rejects(df: DataFrame, column: str = CORRUPT) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows)."""
    return df.where(F.col(column).isNull()).drop(column), df.where(F.col(column).isNotNull()).select(column)


def read_jsonl(spark: SparkSession, path, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """One JSON object per line; blank lines are skipped.

    ``strict`` fails the job on a broken line; otherwise broken lines arrive in the corrupt
    column, to be set aside with ``split_rejects``. Splittable at any size.
    """
    if strict:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.option("mode", "FAILFAST").json(path)
    known = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = (known or spark.read.json(path).schema).fields
    wide = T.StructType([f for f in fields if f.name != CORRUPT] + [T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.select(F.from_json("value", wide, options).alias("r")).select("r.*")


#: File names of another form than ``.txt``, the form that no compression codec claims.
_OTHER = "{*[!t],*[!x]t,*[!t]xt,*[!.]txt,t,xt,txt}"


def read_text_files(spark: SparkSession, path) -> DataFrame:
    """(path, text): each file is one text.

    Files named ``.txt`` are read as bytes: the reader of whole texts copies the cluster's settings for every file, five sixths of
    what a small file takes (105 of 125 stack samples). That reader takes all others, if there are any, as their names may ask for unpacking.
    """
    name = F.col("_metadata.file_path").alias("path")
    is_plain = F.col("_metadata.file_name").endswith(".txt")
    files = spark.read.format("binaryFile").load(path)
    texts = files.where(is_plain).select(name, F.col("content").cast("string").alias("text"))
    # the files are listed once; names are compared where the read is planned, and no file is opened for it
    if not files.where(~is_plain).select(name).isEmpty():
        texts = texts.unionByName(spark.read.option("pathGlobFilter", _OTHER).text(path, wholetext=True).select(name, F.col("value").alias("text")))
    return gather(texts)


def normalise_sheet(df: DataFrame, headers=None) -> DataFrame:
    """Rows of a workbook sheet as strings: blank headers become A..Z then col_N, empty cells ''."""
    names = list(headers) if headers is not None else df.columns
    renamed = []
    for k, name in enumerate(names):
        letter = chr(ord("A") + k) if k < 26 else f"col_{k + 1}"
        renamed.append(str(name) if name is not None and str(name) != "" else letter)
    wide = df.toDF(*[f"__{k}" for k in range(len(renamed))])
    return wide.select(*[F.coalesce(F.col(f"__{k}").cast("string"), F.lit("")).alias(n)
                         for k, n in enumerate(renamed)])
