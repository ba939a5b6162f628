"""Scan: add hits and their summary to a table; list or explain hits one per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.rules import RuleBook, default_book
from ..functions.core import HITS_TYPE, column, ident, let
from ..functions.decode import decode_sql
from ..functions.overlap import drop_contained
from ..functions.risk import entity_tier_sql, max_rank_sql, tier_sql, types_sql
from ..functions.spans import hits_sql
from .catalogs import rules_table


def with_decoded(df: DataFrame, text: str) -> DataFrame:
    """Replace an encoded text by its decoded form (percent or base64)."""
    return df.withColumn(text, column(decode_sql(ident(text))))


def with_hits(df: DataFrame, text: str = "text", book: RuleBook | None = None, *, entities=None, skip=(),
              hint: str | None = None, boosted: str | None = None, decode: bool = False,
              extra_hits: Column | None = None, out: str = "hits") -> DataFrame:
    """Add the hit array of a text column.

    ``entities``/``skip``  types to look for / to leave out; both drop rules before planning.
    ``hint``               entity type the whole column is known to hold (boosts its detectors).
    ``boosted``            name of an array<string> column with the types to boost per row.
    ``extra_hits``         hits from elsewhere, merged with ours: any column of the hit type, such as ``models.model_hits``.
    """
    book = (book or default_book()).only(entities).without(skip)
    if decode:
        df = with_decoded(df, text)
    df = df.withColumn(out, column(hits_sql(ident(text), book, hint, ident(boosted) if boosted else None)))
    if extra_hits is not None:
        merged = f"sort_array(concat({ident(out)}, coalesce({ident(out + '_more')}, cast(array() as {HITS_TYPE}))))"
        merged = let("mh_a", merged, "filter(mh_a, (mh_h, mh_i) -> mh_i = 0 or mh_h <> get(mh_a, mh_i - 1))")
        df = (df.withColumn(out + "_more", extra_hits.cast(HITS_TYPE))
                .withColumn(out, column(drop_contained(merged))).drop(out + "_more"))
    return df


def with_summary(df: DataFrame, hits: str = "hits") -> DataFrame:
    """pii_found, hit_count, risk_level and entity_types of a hit array."""
    h = ident(hits)
    return df.withColumns({
        "pii_found": column(f"size({h}) > 0"),
        "hit_count": column(f"size({h})"),
        "risk_level": column(tier_sql(max_rank_sql(h))),
        "entity_types": column(types_sql(h)),
    })


def scan(df: DataFrame, text: str = "text", book: RuleBook | None = None, **options) -> DataFrame:
    """Detect without changing the text."""
    return with_summary(with_hits(df, text, book, **options), options.get("out", "hits"))


def hits_table(df: DataFrame, keys: list[str], text: str = "text", book: RuleBook | None = None,
               **options) -> DataFrame:
    """One row per hit: keys, entity type, position, score, tier. Matched text is never carried."""
    found = with_hits(df, text, book, **options).select(*keys, "hits")
    # Outer explode: an inner one would let the planner evaluate the detection a second time
    # in an inferred "array is not empty" filter.
    rows = found.select(*keys, F.explode_outer("hits").alias("h")).where(F.col("h").isNotNull())
    return rows.select(
        *keys,
        F.col("h.entity_type").alias("entity_type"),
        F.col("h.start").alias("hit_start"),
        F.col("h.end").alias("hit_end"),
        F.round("h.score", 3).alias("score"),
        column(entity_tier_sql("h.entity_type")).alias("risk_level"),
        F.col("h.pattern_id").alias("pattern_id"),
    )


def explain(df: DataFrame, keys: list[str], text: str = "text", book: RuleBook | None = None,
            **options) -> DataFrame:
    """Hits with the recognizer and pattern that fired and its context words."""
    book = book or default_book()
    rules = rules_table(df.sparkSession, book).select(
        "pattern_id", "recognizer", "pattern_name", F.col("regex").alias("pattern"), "context_words")
    # The rule table has a fixed size of under a hundred rows.
    return hits_table(df, keys, text, book, **options).join(F.broadcast(rules), "pattern_id", "left")
