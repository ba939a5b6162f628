"""Ready-made flows: one entry for texts and records, and the scan-and-sanitize flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog.policies import check_mode, get_policy
from ..catalog.profiles import get_profile
from ..catalog.rules import RuleBook
from ..functions.core import column, lit
from ..functions.pseudonym import Pseudonyms
from ..operators.policy import apply_policy
from ..operators.records import sanitize_nested, sanitize_record
from ..operators.sanitize import kept_rows, sanitize


def resolve_mode(mode: str | None, policy=None, profile=None, custom_profiles: dict | None = None) -> str:
    """Policy, then the caller's mode, then the profile's default mode, then mask."""
    if policy is not None:
        return get_policy(policy).mode
    if mode is not None:
        return check_mode(mode)
    return get_profile(profile, custom_profiles).mode if profile is not None else "mask"


def process_text(df: DataFrame, text: str = "text", mode: str | None = None, policy=None,
                 book: RuleBook | None = None, *, skip=(), how: Pseudonyms = Pseudonyms(),
                 include_excluded: bool = True, profile=None) -> DataFrame:
    """Texts through a policy or a mode, with what was applied and done per row.

    A null text is reported as skipped, the table form of a batch item that is not a string.
    """
    applied = resolve_mode(mode, policy, profile)
    if policy is not None:
        done = apply_policy(df, policy, text, book, skip=skip, how=how)
        acts = (F.when(F.col("action_taken") == "excluded", F.lit("excluded_by_policy"))
                .when(F.col("action_taken") == "none", F.lit("none")).otherwise(F.lit(applied)))
        done = done.withColumns({"pii_found": F.col("hit_count") > 0, "action_taken": acts})
    else:
        done = sanitize(df, text, applied, book, skip=skip, how=how).withColumn("action_taken", F.lit(applied))
    done = done.withColumns({
        "input_type": F.lit("text"),
        "policy_applied": column(lit(get_policy(policy).name)) if policy is not None else F.lit(None).cast("string"),
        "schema_applied": column(lit(profile if isinstance(profile, str) else getattr(profile, "name", None)))
        .cast("string"),
        "mode": F.lit(applied),
        "action_taken": F.when(F.col(text).isNull(), F.lit("skipped")).otherwise(F.col("action_taken")),
    })
    done = done.select(*df.columns, "input_type", "policy_applied", "schema_applied", "mode", "action_taken",
                       "sanitized_text", "excluded", "pii_found", "hit_count", "entity_types", "risk_level")
    return done if include_excluded else kept_rows(done)


def process_record(df: DataFrame, fields=None, mode: str | None = None, policy=None, profile=None,
                   book: RuleBook | None = None, *, recursive: bool = False, skip=(),
                   how: Pseudonyms = Pseudonyms(), include_excluded: bool = True) -> DataFrame:
    """Records through policy, mode and profile; ``recursive`` rewrites every nested string, with the profile's hints.

    Adds the record's own columns (excluded_fields, field_hits, has_pii), those of every result, and input_type,
    policy_applied, schema_applied, mode and action_taken.
    """
    applied = resolve_mode(mode, policy, profile)
    if recursive:
        done = sanitize_nested(df, fields, applied, book, policy=policy, profile=profile, skip=skip, how=how, report=True)
    else:
        done = sanitize_record(df, fields, applied, book, profile=profile, policy=policy, skip=skip, how=how)
    act = (F.when(F.col("excluded"), F.lit("excluded_by_policy" if policy is not None else "exclude"))
           .when(F.col("hit_count") == 0, F.lit("none")).otherwise(F.lit(applied)))
    done = done.withColumns({
        "input_type": F.lit("record"),
        "policy_applied": column(lit(get_policy(policy).name)) if policy is not None else F.lit(None).cast("string"),
        "schema_applied": column(lit(profile if isinstance(profile, str) else getattr(profile, "name", None))).cast("string"),
        "mode": F.lit(applied),
        "action_taken": act,
    })
    return done if include_excluded else kept_rows(done)


def scan_and_sanitize(df: DataFrame, text: str = "text", mode: str = "mask", policy=None,
                      book: RuleBook | None = None, **options) -> DataFrame:
    """Detect, then rewrite; a policy wins over the mode."""
    if policy is not None:
        return apply_policy(df, policy, text, book, **options)
    return sanitize(df, text, mode, book, **options)
