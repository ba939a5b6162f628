"""SQL names for the column functions: usable from spark.sql once registered."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..catalog.policies import MODES
from ..catalog.rules import RuleBook, default_book
from .core import HITS_TYPE, let
from .decode import decode_sql
from .pseudonym import Pseudonyms
from .rewrite import sanitize_sql
from .risk import entity_tier_sql, max_rank_sql, tier_sql, types_sql
from .spans import hits_sql


def register_functions(spark: SparkSession, book: RuleBook | None = None, prefix: str = "pii",
                       how: Pseudonyms = Pseudonyms(), redact_with: str = "") -> list[str]:
    """Create temporary SQL functions whose bodies are the native expressions.

    pii_hits(t), pii_risk(t), pii_types(t), pii_mask(t), pii_redact(t), pii_pseudonymize(t), pii_exclude(t) and
    pii_decode(t); each call detects anew. pii_scan(t) detects once and gives a struct of hits, hit_count, risk_level,
    entity_types and masked. pii_hit_rows(t) is a table function, a row per hit and without the matched text:
    ``SELECT id, h.* FROM t, LATERAL pii_hit_rows(text) h``.

    A body that detects and rewrites nests deeper than the analyzer's default of 100 rounds allows, so the session's
    ``spark.sql.analyzer.maxIterations`` is raised to 400 where it is lower.
    """
    if int(spark.conf.get("spark.sql.analyzer.maxIterations")) < 400:
        spark.conf.set("spark.sql.analyzer.maxIterations", "400")
    book = book or default_book()
    hits = hits_sql("t", book)
    scalar = {
        "hits": (HITS_TYPE, hits),
        "risk": ("string", tier_sql(max_rank_sql(hits))),
        "types": ("array<string>", types_sql(hits)),
        "decode": ("string", decode_sql("t")),
    }
    verbs = {"mask": "mask", "redact": "redact", "pseudonymize": "pseudonymize", "exclude": "exclude"}
    for mode in MODES:
        body = f"get(transform(array({hits}), sq_h -> {sanitize_sql('t', 'sq_h', mode, redact_with, how)}), 0)"
        scalar[verbs[mode]] = ("string", body)
    scalar["scan"] = (f"struct<hits:{HITS_TYPE},hit_count:int,risk_level:string,entity_types:array<string>,masked:string>",
                      let("sq_s", hits, f"named_struct('hits', sq_s, 'hit_count', size(sq_s), 'risk_level', {tier_sql(max_rank_sql('sq_s'))}, "
                                        f"'entity_types', {types_sql('sq_s')}, 'masked', {sanitize_sql('t', 'sq_s', 'mask', redact_with, how)})"))
    made = []
    for name, (kind, body) in scalar.items():
        spark.sql(f"create or replace temporary function {prefix}_{name}(t string) returns {kind} return {body}")
        made.append(f"{prefix}_{name}")
    # the array of hits is bound first, so that its generator is the only place that detects
    spark.sql(f"create or replace temporary function {prefix}_hit_rows(t string) returns table (entity_type string, hit_start int, hit_end int, "
              f"score double, risk_level string, pattern_id int) return select x.h.entity_type, x.h.start, x.h.`end`, round(x.h.score, 3), "
              f"{entity_tier_sql('x.h.entity_type')}, x.h.pattern_id from explode({hits}) as x(h)")
    made.append(f"{prefix}_hit_rows")
    return made
