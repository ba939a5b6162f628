"""Reports over sanitized tables: files, OCR pages, size limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog.rules import RuleBook
from ..functions.core import blank, column, ident
from ..functions.risk import tier_sql
from ..catalog.risk import TIERS
from .sanitize import sanitize


def rank_column(tier: str):
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col(tier)) - 1


def file_report(sanitized: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total_rows, rows_with_pii, excluded_rows of sanitized records."""
    return sanitized.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("has_pii").alias("rows_with_pii"),
        F.count_if(F.size("excluded_fields") > 0).alias("excluded_rows"))


def scan_pages(df: DataFrame, text: str = "text", mode: str = "mask", book: RuleBook | None = None, *,
               confidence: str | None = "confidence", low_confidence: float = 70.0, **options) -> DataFrame:
    """Sanitize recognised pages and flag those whose recognition confidence is low.

    A page without a confidence counts as fully confident; a blank page gives an empty text.
    """
    score = F.coalesce(F.col(confidence).cast("double"), F.lit(100.0)) if confidence in df.columns else F.lit(100.0)
    done = sanitize(df.withColumn("ocr_confidence", score), text, mode, book, **options)
    return done.withColumns({
        "low_confidence_warning": F.col("ocr_confidence") < low_confidence,
        "sanitized_text": column(f"case when {blank(ident(text))} then '' else sanitized_text end"),
    })


def page_report(pages: DataFrame, by: list[str]) -> DataFrame:
    """page_count, pages_with_pii, low-confidence pages and the highest risk per document."""
    return pages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if("pii_found").alias("pages_with_pii"),
        F.count_if("low_confidence_warning").alias("low_confidence_pages"),
        F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hit_count"),
        F.max(rank_column("risk_level")).cast("int").alias("risk_rank"),
    ).withColumn("highest_risk", column(tier_sql("risk_rank"))).drop("risk_rank")


def explode_pages(df: DataFrame, keys: list[str], pages: str) -> DataFrame:
    """Array of page texts -> one row per page with its 1-based number; blank pages are left out."""
    rows = df.select(*keys, F.posexplode_outer(pages).alias("__pos", "text"))
    return rows.where(~column(blank("text"))).select(*keys, (F.col("__pos") + 1).alias("page_number"), "text")


def split_oversize(df: DataFrame, text: str = "text", *, max_chars: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): texts longer than the limit go to a table of their own, nothing is cut."""
    over = F.coalesce(F.length(text), F.lit(0)) > max_chars
    return df.where(~over), df.where(over).withColumn("reject_reason", F.lit("TEXT_TOO_LONG"))
