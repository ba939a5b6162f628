"""The catalogs as tables, for joins and listings. All have a fixed, small size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog.policies import POLICIES
from ..catalog.profiles import PROFILES
from ..catalog.risk import rank_of, tier_of
from ..catalog.rules import RuleBook, default_book


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def entities_table(spark: SparkSession, book: RuleBook | None = None) -> DataFrame:
    """(entity_type, detector_group, risk_level); a type with detectors in two groups has two rows."""
    book = book or default_book()
    pairs = list(dict.fromkeys((r.entity, r.group) for r in book.rules))
    both = [("US_SSN", "generic"), ("MEDICAL_LICENSE", "generic")]
    pairs += [p for p in both if p not in pairs and p[0] in book.entities]
    return _table(spark, [(e, g, tier_of(e)) for e, g in pairs],
                  "entity_type string, detector_group string, risk_level string")


def rules_table(spark: SparkSession, book: RuleBook | None = None) -> DataFrame:
    book = book or default_book()
    return _table(spark, [(r.rule_id, r.entity, r.group, r.recognizer, r.pattern, r.regex, r.score, list(r.context))
                          for r in book.rules],
                  "pattern_id int, entity_type string, detector_group string, recognizer string, "
                  "pattern_name string, regex string, base_score double, context_words array<string>")


def policies_table(spark: SparkSession, policies=None) -> DataFrame:
    rows = [(p.name, p.description, sorted(p.block), sorted(p.pass_through), p.mode, p.exclude_any,
             rank_of(p.warn_at)) for p in (policies or POLICIES.values())]
    return _table(spark, rows, "policy string, description string, block array<string>, "
                               "pass_through array<string>, mode string, exclude_any boolean, warn_rank int")


def profiles_table(spark: SparkSession, custom: dict | None = None) -> DataFrame:
    """(profile, field, entity_hint, default_mode); built-in profiles win over custom ones."""
    merged = {**(custom or {}), **PROFILES}
    rows = [(p.name, f, e, p.mode, p.description) for p in merged.values() for f, e in p.hints.items()]
    return _table(spark, rows, "profile string, field string, entity_hint string, default_mode string, "
                               "description string")
