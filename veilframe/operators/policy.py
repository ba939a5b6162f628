"""Named policies over a hit array: pass, block or rewrite each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog.policies import ACTION_OF_MODE, POLICIES, Policy, get_policy
from ..catalog.risk import rank_of
from ..catalog.rules import RuleBook
from ..functions.core import column, ident, let, lit, lits, map_of
from ..functions.pseudonym import Pseudonyms
from ..functions.risk import max_rank_sql, tier_sql
from ..functions.rewrite import sanitize_by_sql, sanitize_sql
from .catalogs import policies_table
from .scan import with_hits


def verdict_sql(hits: str, block: str, passes: str, exclude_any: str, mode: str, warn_rank: str) -> str:
    """Struct of what a policy decides about a row, before any rewriting."""
    relevant = f"filter({hits}, po_h -> not array_contains({passes}, po_h.entity_type))"
    types = "sort_array(array_distinct(transform(po_r, po_x -> po_x.entity_type)))"
    fields = let("po_b", f"array_intersect(po_t, {block})", let(
        "po_no", f"size(po_r) > 0 and (size(po_b) > 0 or {exclude_any})",
        f"named_struct('passed', not po_no, "
        f"'action_taken', case when size(po_r) = 0 then 'none' when po_no then 'excluded' "
        f"else try_element_at({map_of(ACTION_OF_MODE)}, {mode}) end, "
        f"'blocked_entities', case when not po_no then cast(array() as array<string>) "
        f"when size(po_b) > 0 then po_b else po_t end, "
        f"'hit_count', size(po_r), 'entity_types', po_t, 'risk_level', {tier_sql('po_k')}, "
        f"'warned', size(po_r) > 0 and po_k >= {warn_rank})"))
    return let("po_r", relevant, let("po_t", types, let("po_k", max_rank_sql("po_r"), fields)))


def _spread(df: DataFrame) -> DataFrame:
    names = ["passed", "action_taken", "blocked_entities", "hit_count", "entity_types", "risk_level", "warned"]
    return df.withColumns({n: F.col(f"verdict.{n}") for n in names})


def apply_policy(df: DataFrame, policy: str | Policy, text: str = "text", book: RuleBook | None = None, *,
                 skip=(), how: Pseudonyms = Pseudonyms(), redact_with: str = "", hits: str | None = None,
                 **options) -> DataFrame:
    """Gate and rewrite a text column under one policy.

    ``skip`` adds pass-through types to the rewrite only; it never weakens the block check.
    ``hits`` names an existing hit array to reuse.
    """
    p = get_policy(policy)
    if hits is None:
        df, hits = with_hits(df, text, book, **options), "hits"
    verdict = verdict_sql(ident(hits), lits(sorted(p.block)), lits(sorted(p.pass_through)),
                           lit(p.exclude_any), lit(p.mode), str(rank_of(p.warn_at)))
    left_alone = lits(sorted({*p.pass_through, *skip}))
    rewritable = f"filter({ident(hits)}, pw_h -> not array_contains({left_alone}, pw_h.entity_type))"
    df = _spread(df.withColumn("verdict", column(verdict)))
    rewritten = sanitize_sql(ident(text), rewritable, p.mode, redact_with, how)
    return df.withColumns({
        "policy": column(lit(p.name)),
        "sanitized_text": column(f"case when not passed then null when hit_count = 0 then {ident(text)} "
                                 f"else {rewritten} end"),
        "excluded": ~F.col("passed"),
    }).drop("verdict")


def apply_policy_by_column(df: DataFrame, policy_col: str = "policy", text: str = "text",
                           book: RuleBook | None = None, *, how: Pseudonyms = Pseudonyms(),
                           hits: str | None = None, policies=None, **options) -> DataFrame:
    """Like apply_policy with the policy named in a column, so each destination has its own gate.

    A name without a policy is rejected: nothing is passed on.
    """
    if hits is None:
        df, hits = with_hits(df, text, book, **options), "hits"
    rules = policies_table(df.sparkSession, policies).select(
        F.col("policy").alias("p_name"), F.col("block").alias("p_block"), F.col("pass_through").alias("p_pass"),
        F.col("mode").alias("p_mode"), F.col("exclude_any").alias("p_any"), F.col("warn_rank").alias("p_warn"))
    # The policy table has one row per named policy: a handful.
    df = df.join(F.broadcast(rules), F.col(policy_col) == F.col("p_name"), "left")
    verdict = verdict_sql(ident(hits), "p_block", "p_pass", "p_any", "p_mode", "p_warn")
    rewritable = f"filter({ident(hits)}, pw_h -> not array_contains(p_pass, pw_h.entity_type))"
    rewritten = sanitize_by_sql(ident(text), rewritable, "p_mode", how=how)
    df = _spread(df.withColumn("verdict", column(f"case when p_name is not null then {verdict} end")))
    return df.withColumns({
        "passed": F.coalesce("passed", F.lit(False)),
        "action_taken": F.coalesce("action_taken", F.lit("rejected")),
        "sanitized_text": column(f"case when passed is null or not passed then null when hit_count = 0 "
                                 f"then {ident(text)} else {rewritten} end"),
        "excluded": ~F.coalesce("passed", F.lit(False)),
        "hit_count": F.coalesce("hit_count", F.lit(0)),
        "entity_types": F.coalesce("entity_types", F.array().cast("array<string>")),
    }).drop("verdict", "p_name", "p_block", "p_pass", "p_mode", "p_any", "p_warn")


def policy_counts(applied: DataFrame, by: list[str] | None = None) -> DataFrame:
    return applied.groupBy(*(by or ["policy"])).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("action_taken") == "excluded").alias("excluded_count"),
        F.count_if(F.col("action_taken") == "none").alias("untouched_count"),
        F.count_if(F.col("warned")).alias("warned_count"),
        F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hit_count"))


def block_rates(df: DataFrame, text: str = "text", book: RuleBook | None = None, policies=None,
                **options) -> DataFrame:
    """The same table under every policy: how many rows each would block.

    Rows are detected once and reduced to the distinct sets of types they hold, which the
    number of types bounds, not the number of rows; only those sets meet the policies.
    """
    found = with_hits(df, text, book, **options)
    sets = found.select(column("transform(hits, x -> x.entity_type)").alias("types")).select(
        F.array_sort(F.array_distinct("types")).alias("types")).groupBy("types").agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(p.name).alias("policy"),
                              F.array(*[F.lit(b) for b in p.block]).cast("array<string>").alias("block"),
                              F.array(*[F.lit(b) for b in p.pass_through]).cast("array<string>").alias("pass"),
                              F.lit(p.exclude_any).alias("any")) for p in (policies or POLICIES.values())])
    per = sets.select("types", "n", F.explode(each).alias("p"))
    left = F.array_except("types", "p.pass")
    blocked = (F.size(left) > 0) & (F.arrays_overlap(left, "p.block") | F.col("p.any"))
    return per.groupBy(F.col("p.policy").alias("policy")).agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(blocked, F.col("n"))), F.lit(0)).alias("blocked"),
        F.coalesce(F.sum(F.when(F.size(left) == 0, F.col("n"))), F.lit(0)).alias("untouched"))
