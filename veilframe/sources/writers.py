"""Sinks for sanitized tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sanitize import kept_rows

FORMATS = ("parquet", "json", "csv", "orc")


def write_result(df: DataFrame, path: str, fmt: str = "parquet", *, include_excluded: bool = True,
                 mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Write a sanitized table; hit arrays are dropped, and flat formats get joined lists.

    ``include_excluded=False`` leaves out rows the exclude mode or a policy dropped.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {FORMATS}")
    if not include_excluded:
        if "excluded" not in df.columns:
            raise ValueError("the table does not say which rows are excluded")
        df = kept_rows(df)
    df = df.drop("hits")
    if fmt == "csv":
        for f in df.schema:
            kind = f.dataType.simpleString()
            if kind == "array<string>":
                df = df.withColumn(f.name, F.array_join(f.name, ","))
            elif kind.startswith(("array", "struct", "map")):
                df = df.withColumn(f.name, F.to_json(f.name))
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("quoteAll", True)
    writer.format(fmt).save(path)


def append_audit(events: DataFrame, path: str) -> None:
    """Append audit events to a parquet table."""
    events.write.mode("append").parquet(path)
