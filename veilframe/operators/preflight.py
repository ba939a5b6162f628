"""Preflight: may a text be sent to an outside model, and if not, what could be sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog.risk import ADVICE, TIERS, rank_of
from ..catalog.rules import RuleBook
from ..functions.core import column, ident, lits
from ..functions.risk import max_rank_sql, rank_sql, tier_sql, types_sql
from ..functions.rewrite import sanitize_sql
from .policy import apply_policy
from .scan import with_hits

BLOCK_AT = rank_of("HIGH")
WARN_AT = rank_of("MEDIUM")


def preflight(df: DataFrame, text: str = "text", book: RuleBook | None = None, *, hits: str | None = None,
              **options) -> DataFrame:
    """safe_to_send, risk_level, hit_count, blocking/warning types, advice and a masked suggestion."""
    if hits is None:
        df, hits = with_hits(df, text, book, **options), "hits"
    h = ident(hits)

    def types_where(test: str) -> str:
        return (f"sort_array(array_distinct(transform(filter({h}, pf_h -> {rank_sql('pf_h.entity_type')} {test}), "
                f"pf_x -> pf_x.entity_type)))")

    df = df.withColumn("risk_rank", column(max_rank_sql(h)))
    return df.withColumns({
        "safe_to_send": column(f"risk_rank < {BLOCK_AT}"),
        "risk_level": column(tier_sql("risk_rank")),
        "hit_count": column(f"size({h})"),
        "entity_types": column(types_sql(h)),
        "excluded": F.lit(False),
        "blocking_entities": column(types_where(f">= {BLOCK_AT}")),
        "warning_entities": column(types_where(f"= {WARN_AT}")),
        "recommendation": column(f"get({lits([ADVICE[t] for t in TIERS])}, risk_rank)"),
        "sanitized_suggestion": column(f"case when risk_rank >= {BLOCK_AT} then {sanitize_sql(ident(text), h, 'mask')} end"),
    }).drop("risk_rank")


def preflight_gate(df: DataFrame, text: str = "text", book: RuleBook | None = None, *,
                   policy: str = "ai_prompt", **options) -> DataFrame:
    """Safe rows keep their text; others get the policy's text, null where the policy blocks.

    Adds safe_text, was_sanitized, risk_level and safe_to_send.
    """
    before = df.columns
    checked = preflight(with_hits(df, text, book, **options), text, hits="hits").select(
        *before, "hits", "safe_to_send", F.col("risk_level").alias("original_risk"))
    gated = apply_policy(checked, policy, text, hits="hits")
    return gated.select(
        *before,
        F.when(F.col("safe_to_send"), F.col(text)).otherwise(F.col("sanitized_text")).alias("safe_text"),
        (~F.col("safe_to_send")).alias("was_sanitized"),
        F.col("original_risk").alias("risk_level"),
        "safe_to_send",
        F.size("hits").alias("hit_count"),
        column(types_sql("hits")).alias("entity_types"),
        (~F.col("safe_to_send") & F.col("sanitized_text").isNull()).alias("excluded"))
