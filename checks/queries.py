"""The registered queries: each a Spark job and, where SQL can say it, the statement it must agree with."""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timezone

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.catalog.policies import POLICIES
from veilframe.catalog.profiles import PROFILES
from veilframe.catalog.risk import ADVICE, TIERS, rank_of, tier_of
from veilframe.catalog.rules import RuleBook, default_book
from veilframe.functions.core import blank, column
from veilframe.functions import rewrite
from veilframe.functions.pseudonym import Pseudonyms
from veilframe.functions.sqlnames import register_functions
from veilframe.operators import audit, catalogs, dictionary, policy, preflight, records, reports, sanitize, scan
from veilframe.plans import config, flows
from veilframe.sources import readers, writers
from veilframe.sources.layout import TASK_ROWS, spread
from veilframe.streaming import jobs

from . import oracle as o
from .views import MEMOS, NOTES, SOURCES, duck_source

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    table, key, text = SOURCES[name]
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    needed = {"notes": ["c_custkey"], "memos": ["c_custkey"], "proofs": ["c_custkey"], "documents": ["doc_id", "text"],
              "pages": ["page_id", "html"], "conversations": ["conv_id", "turn", "text"]}[name]
    return spread(df.select(*needed), rows={"pages": 1000, "documents": 10_000}.get(name, TASK_ROWS)).selectExpr(f"{key} AS id", f"{text} AS text")


def joined(col: str):
    return F.array_join(col, ",").alias(col)


def hits_text(col: str = "hits"):
    return column(f"array_join(transform({col}, h -> concat(h.entity_type, ':', h.start, ':', h.`end`)), ',')").alias("hits")


# --- scan ---------------------------------------------------------------------------------------

def _scan_query(name):
    def run(spark, sf):
        return scan.scan(source(spark, sf, name)).select(
            "id", "pii_found", "hit_count", "risk_level", joined("entity_types"), hits_text())
    register(f"scan_{name}", run, o.with_(o.hits(duck_source(name)), o.SUMMARY) +
             "SELECT id, pii_found, hit_count, risk_level, entity_types, hits FROM scan")


for _name in SOURCES:
    _scan_query(_name)

HIT_COLUMNS = "id, entity_type, hit_start, hit_end, round(score, 3) AS score"


def _hits_query(query, name, book: RuleBook, hint=None):
    def run(spark, sf):
        return scan.hits_table(source(spark, sf, name), ["id"], book=book, hint=hint).select(
            "id", "entity_type", "hit_start", "hit_end", "score")
    register(query, run, o.with_(o.hits(duck_source(name), book, hint)) + f"SELECT {HIT_COLUMNS} FROM hits")


BOOK = default_book()
_hits_query("hits_table_documents", "documents", BOOK)
_hits_query("hits_table_notes", "notes", BOOK)

register("explain_hits", lambda spark, sf: scan.explain(source(spark, sf, "notes"), ["id"]).select(
    "id", "entity_type", "hit_start", "hit_end", "score", "risk_level", "recognizer", "pattern_name",
    F.size("context_words").alias("context_words")),
    o.with_(o.hits(duck_source("notes"))) + f"""SELECT {HIT_COLUMNS}, {o.tier(o.rank('entity_type'))} AS risk_level,
    recognizer, pattern_name, len(ctx)::INT AS context_words FROM hits""")

ON_MEMOS = {"CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS", "URL", "DATE_TIME", "CRYPTO", "US_BANK_NUMBER", "US_ITIN",
            "US_PASSPORT", "US_DRIVER_LICENSE", "PERSON", "LOCATION", "NRP", "PHONE_NUMBER"}
for _e in BOOK.entities:
    _book = BOOK.only([_e]).at(0.3)
    _hits_query(f"detect_{_e.lower()}", "memos" if _e in ON_MEMOS else "notes", _book)
for _e in ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS"):
    _hits_query(f"detect_{_e.lower()}_documents", "documents", BOOK.only([_e]).at(0.3))

_hits_query("hits_table_proofs", "proofs", BOOK.at(0.25))
_hits_query("threshold_global", "memos", BOOK.at(0.3))
_hits_query("threshold_override", "notes", BOOK.at(STUDENT_ID=0.95, FERPA_MARKER=0.6, COLLEAGUE_ID=0.9))
_hits_query("custom_pattern", "notes", BOOK.plus(
    "EMPLOYEE_ID", [("advisor_code", r"\badvisor[0-9]+", 0.9), ("weak_code", r"\b[0-9]{6}\b", 0.3)], ["colleague", "staff"]))
_hits_query("entity_allow", "notes", BOOK.only(["US_SSN", "EMAIL_ADDRESS", "IMMIGRATION_STATUS"]))
_hits_query("entity_skip", "notes", BOOK.without(["US_SSN", "EMAIL_ADDRESS", "IMMIGRATION_STATUS"]))
_hits_query("context_boost", "memos", BOOK.only(["US_BANK_NUMBER", "US_PASSPORT", "US_DRIVER_LICENSE",
                                                 "FINANCIAL_ACCOUNT", "STUDENT_ID", "MEDICAL_LICENSE"]))
_hits_query("field_hint_boost", "memos", BOOK, "STUDENT_ID")
_hits_query("field_hint_bank", "memos", BOOK, "FINANCIAL_ACCOUNT")


def _resolve_query(name):
    register(f"resolve_overlaps_{name}", lambda spark, sf: sanitize.resolved_hits(source(spark, sf, name), ["id"]),
             o.with_(o.hits(duck_source(name)), o.kept()) + f"SELECT {HIT_COLUMNS} FROM kept")


for _name in ("notes", "memos", "documents"):
    _resolve_query(_name)

# --- rewriting ----------------------------------------------------------------------------------

SANITIZED = ["id", "sanitized_text", "excluded", "pii_found", "hit_count", "risk_level"]


def _sanitize_query(query, name, mode, book=BOOK, include=True, columns=SANITIZED, **options):
    def run(spark, sf):
        how = options.get("how")
        more = {"how": how} if how else {}
        if "redact_with" in options:
            more["redact_with"] = options["redact_with"]
        return sanitize.sanitize(source(spark, sf, name), mode=mode, book=book, include_excluded=include,
                                 **more).select(*columns)
    how = options.get("how")
    extra = {"redact_with": options.get("redact_with", "")} if mode == "redact" else {}
    if how:
        extra = {"salt": how.salt, "secret": how.secret, "first": how.first_names, "last": how.last_names,
                 "cities": how.cities}
    if mode == "exclude":
        body = ("SELECT id, CASE WHEN pii_found THEN NULL ELSE text END AS sanitized_text, pii_found AS excluded, "
                "pii_found, hit_count, risk_level FROM scan" + ("" if include else " WHERE NOT pii_found"))
        sql = o.with_(o.hits(duck_source(name), book), o.SUMMARY) + body
    else:
        sql = o.with_(o.hits(duck_source(name), book), o.SUMMARY, o.kept(), o.rendered(o.token(mode, **extra))) + (
            "SELECT id, out.sanitized_text, false AS excluded, pii_found, hit_count, risk_level FROM scan JOIN out USING (id)")
    if columns != SANITIZED:
        sql = f"SELECT {', '.join(columns)} FROM ({sql})"
    register(query, run, sql)


for _name in ("notes", "memos", "documents", "conversations"):
    _sanitize_query(f"mask_{_name}", _name, "mask")
_sanitize_query("redact_notes", "notes", "redact")
_sanitize_query("redact_documents", "documents", "redact")
_sanitize_query("redact_stars", "notes", "redact", redact_with="***")
_sanitize_query("exclude_notes", "notes", "exclude")
_sanitize_query("exclude_drop", "notes", "exclude", include=False)
_sanitize_query("exclude_documents", "documents", "exclude", columns=["id", "excluded", "hit_count"])
_sanitize_query("sanitize_skip_types", "notes", "mask", BOOK.without(["DATE_TIME", "DATE_OF_BIRTH", "STUDENT_ID"]))
_sanitize_query("pseudonymize_notes", "notes", "pseudonymize")
_sanitize_query("pseudonymize_memos", "memos", "pseudonymize")
_sanitize_query("pseudonymize_documents", "documents", "pseudonymize")
_sanitize_query("pseudonymize_keyed", "notes", "pseudonymize", how=Pseudonyms(secret="a fixed test secret"))
_sanitize_query("pseudonymize_salted", "notes", "pseudonymize", how=Pseudonyms(salt="batch-7|"))
_sanitize_query("pseudonymize_own_pools", "memos", "pseudonymize",
                how=Pseudonyms(first_names=("Ada", "Bo", "Cy"), last_names=("Dee", "Eff"), cities=("Gee", "Aitch")))
for _e in BOOK.entities:
    _sanitize_query(f"pseudonymize_{_e.lower()}", "memos" if _e in ON_MEMOS else "notes", "pseudonymize",
                    BOOK.only([_e]).at(0.3), columns=["id", "sanitized_text"])


def _counts_query(query, mode):
    flag = "pii_found" if mode == "exclude" else "false"
    register(query, lambda spark, sf: sanitize.batch_counts(sanitize.sanitize(source(spark, sf, "notes"), mode=mode)),
             o.with_(o.hits(duck_source("notes")), o.SUMMARY) + f"""SELECT count(*) AS total,
    count(*) FILTER (WHERE {flag}) AS excluded_count, count(*) FILTER (WHERE NOT pii_found AND NOT {flag}) AS clean_count,
    count(*) FILTER (WHERE pii_found) AS pii_count, sum(hit_count)::BIGINT AS hit_count FROM scan""")


_counts_query("sanitize_batch_counts", "mask")
_counts_query("exclude_batch_counts", "exclude")

_MAP = (o.with_(o.hits(duck_source("notes")), o.kept()) +
        f"SELECT entity_type, {o.seed()} AS seed, count(*) AS occurrences, {o.stand_in(o.seed())} AS stand_in FROM kept GROUP BY ALL")
register("pseudonym_map", lambda spark, sf: sanitize.pseudonym_map(source(spark, sf, "notes")), _MAP)
register("pseudonym_collisions", lambda spark, sf: sanitize.pseudonym_collisions(
    sanitize.pseudonym_map(source(spark, sf, "notes"))),
    f"""SELECT entity_type, count(*) AS seeds, count(DISTINCT stand_in) AS stand_ins, sum(occurrences)::BIGINT AS occurrences
    FROM ({_MAP}) GROUP BY entity_type""")

# --- policies -----------------------------------------------------------------------------------

POLICY_COLUMNS = ["id", "passed", "action_taken", "sanitized_text", "blocked_entities", "hit_count", "risk_level", "warned"]


def _policy_frame(df, p):
    return policy.apply_policy(df, p).select(
        "id", "passed", "action_taken", "sanitized_text", joined("blocked_entities"), "hit_count", "risk_level", "warned")


def _policy_query(p, name, suffix=""):
    register(f"policy_{p}{suffix}", lambda spark, sf: _policy_frame(source(spark, sf, name), p),
             o.with_(o.hits(duck_source(name)), o.policy(p)) + f"SELECT {', '.join(POLICY_COLUMNS)} FROM po")


for _p in POLICIES:
    _policy_query(_p, "notes")
    _policy_query(_p, "memos", "_memos")

_NAMES = list(POLICIES)


def _per_row(spark, sf):
    cases = " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_NAMES))
    df = source(spark, sf, "notes").withColumn("policy", column(f"CASE id % 8 {cases} ELSE 'not_a_policy' END"))
    return policy.apply_policy_by_column(df).select("id", "policy", "passed", "action_taken", "sanitized_text")


register("policy_per_row", _per_row, "\nUNION ALL\n".join(
    f"(SELECT id, '{p}' AS policy, passed, action_taken, sanitized_text FROM ("
    + o.with_(o.hits(duck_source("notes") + f" WHERE c_custkey % 8 = {k}"), o.policy(p)) + " SELECT * FROM po))"
    for k, p in enumerate(_NAMES)) + """
UNION ALL (SELECT c_custkey AS id, 'not_a_policy' AS policy, false AS passed, 'rejected' AS action_taken,
    NULL::VARCHAR AS sanitized_text FROM customer WHERE c_custkey % 8 = 7)""")

register("policy_block_rates", lambda spark, sf: policy.block_rates(source(spark, sf, "notes")), "\nUNION ALL\n".join(
    f"(SELECT '{p}' AS policy, count(*) AS total, count(*) FILTER (WHERE NOT passed) AS blocked, "
    f"count(*) FILTER (WHERE hit_count = 0) AS untouched FROM ("
    + o.with_(o.hits(duck_source("notes")), o.policy(p)) + " SELECT * FROM po))" for p in _NAMES))

register("policy_batch_counts", lambda spark, sf: policy.policy_counts(
    policy.apply_policy(source(spark, sf, "notes"), "embedding")),
    o.with_(o.hits(duck_source("notes")), o.policy("embedding")) + """SELECT 'embedding' AS policy, count(*) AS total,
    count(*) FILTER (WHERE action_taken = 'excluded') AS excluded_count, count(*) FILTER (WHERE action_taken = 'none') AS untouched_count,
    count(*) FILTER (WHERE warned) AS warned_count, sum(hit_count)::BIGINT AS hit_count FROM po""")

# --- preflight and flows ------------------------------------------------------------------------

_ADVICE = o.names([ADVICE[t] for t in TIERS])
_PREFLIGHT = f"""pf AS (SELECT s.id, s.text, s.rk < 2 AS safe_to_send, s.risk_level, s.hit_count,
    coalesce((SELECT string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) FROM hits h WHERE h.id = s.id AND {o.rank('entity_type')} >= 2), '') AS blocking_entities,
    coalesce((SELECT string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) FROM hits h WHERE h.id = s.id AND {o.rank('entity_type')} = 1), '') AS warning_entities,
    {_ADVICE}[s.rk + 1] AS recommendation, CASE WHEN s.rk >= 2 THEN out.sanitized_text END AS sanitized_suggestion
    FROM scan s JOIN out USING (id))"""


def _preflight_query(name):
    register(f"preflight_{name}", lambda spark, sf: preflight.preflight(source(spark, sf, name)).select(
        "id", "safe_to_send", "risk_level", "hit_count", joined("blocking_entities"), joined("warning_entities"),
        "recommendation", "sanitized_suggestion"),
        o.with_(o.hits(duck_source(name)), o.SUMMARY, o.kept(), o.rendered(o.MASK), _PREFLIGHT) +
        "SELECT * EXCLUDE (text) FROM pf")


for _name in ("notes", "conversations", "documents"):
    _preflight_query(_name)

register("preflight_gate", lambda spark, sf: preflight.preflight_gate(source(spark, sf, "notes")).select(
    "id", "safe_text", "was_sanitized", "risk_level", "safe_to_send"),
    o.with_(o.hits(duck_source("notes")), o.SUMMARY, o.policy("ai_prompt")) + """SELECT s.id,
    CASE WHEN s.rk < 2 THEN s.text ELSE po.sanitized_text END AS safe_text, s.rk >= 2 AS was_sanitized, s.risk_level,
    s.rk < 2 AS safe_to_send FROM scan s JOIN po USING (id)""")

register("scan_and_sanitize", lambda spark, sf: flows.scan_and_sanitize(
    source(spark, sf, "notes"), mode="mask", policy="log_safe").select("id", "action_taken", "sanitized_text", "hit_count"),
    o.with_(o.hits(duck_source("notes")), o.policy("log_safe")) + "SELECT id, action_taken, sanitized_text, hit_count FROM po")


def _process_query(query, mode, p):
    cols = ["id", "input_type", "policy_applied", "mode", "action_taken", "sanitized_text", "excluded", "hit_count"]
    head = o.with_(o.hits(duck_source("notes")), o.SUMMARY, o.kept(), o.rendered(o.token(mode or "mask")),
                   o.policy(p or "log_safe"))
    if p:
        m = POLICIES[p].mode
        body = (f"SELECT id, 'text' AS input_type, '{p}' AS policy_applied, '{m}' AS mode, CASE WHEN text IS NULL THEN 'skipped' "
                f"WHEN action_taken = 'excluded' THEN 'excluded_by_policy' WHEN action_taken = 'none' THEN 'none' ELSE '{m}' END "
                f"AS action_taken, sanitized_text, NOT passed AS excluded, hit_count FROM po")
    else:
        body = (f"SELECT id, 'text' AS input_type, NULL::VARCHAR AS policy_applied, '{mode}' AS mode, CASE WHEN scan.text IS NULL "
                f"THEN 'skipped' ELSE '{mode}' END AS action_taken, out.sanitized_text, false AS excluded, hit_count "
                f"FROM scan JOIN out USING (id)")
    register(query, lambda spark, sf: flows.process_text(source(spark, sf, "notes"), mode=mode, policy=p).select(*cols),
             head + body)


_process_query("process_text_mode", "redact", None)
_process_query("process_text_policy", "redact", "embedding")

# --- records ------------------------------------------------------------------------------------


def people(spark, sf) -> DataFrame:
    df = spread(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_acctbal"))
    return df.selectExpr("c_custkey AS id", f"{NOTES} AS note", f"{MEMOS} AS memo", "c_acctbal AS balance")


def _two(mode: str) -> str:
    """Sanitized notes and memos side by side."""
    parts = []
    for name in ("notes", "memos"):
        if mode == "exclude":
            body = "SELECT id, CASE WHEN pii_found THEN NULL ELSE text END AS t, pii_found AS x, hit_count AS n FROM scan"
            parts.append(o.with_(o.hits(duck_source(name)), o.SUMMARY) + body)
        else:
            parts.append(o.with_(o.hits(duck_source(name)), o.SUMMARY, o.kept(), o.rendered(o.token(mode))) +
                         "SELECT id, out.sanitized_text AS t, false AS x, hit_count AS n FROM scan JOIN out USING (id)")
    return _pair(*parts)


def _pair(a: str, b: str) -> str:
    return f"""SELECT a.id, a.t AS note, b.t AS memo, c_acctbal AS balance, array_to_string(list_filter(
    [CASE WHEN a.x THEN 'note' END, CASE WHEN b.x THEN 'memo' END], lambda f: f IS NOT NULL), ',') AS excluded_fields,
    a.n + b.n > 0 AS has_pii FROM ({a}) a JOIN ({b}) b USING (id) JOIN customer ON c_custkey = a.id"""


def _record_columns(df):
    return df.select("id", "note", "memo", "balance", joined("excluded_fields"), "has_pii")


for _m in ("mask", "exclude"):
    register(f"sanitize_record_{_m}", lambda spark, sf, m=_m: _record_columns(
        records.sanitize_record(people(spark, sf), None, m)), _two(_m))

register("sanitize_record_policy", lambda spark, sf: _record_columns(
    records.sanitize_record(people(spark, sf), ["note", "memo"], policy="embedding")),
    _pair(*[o.with_(o.hits(duck_source(n)), o.policy("embedding")) +
            "SELECT id, sanitized_text AS t, NOT passed AS x, hit_count AS n FROM po" for n in ("notes", "memos")]))

register("process_record", lambda spark, sf: flows.process_record(
    people(spark, sf), ["note"], policy="ai_prompt").select("id", "note", "input_type", "policy_applied", "mode",
                                                            joined("excluded_fields")),
    o.with_(o.hits(duck_source("notes")), o.policy("ai_prompt")) + """SELECT id, sanitized_text AS note, 'record' AS input_type,
    'ai_prompt' AS policy_applied, 'mask' AS mode, CASE WHEN passed THEN '' ELSE 'note' END AS excluded_fields FROM po""")


def _nested(spark, sf):
    df = people(spark, sf).select("id", F.struct(
        F.col("note").alias("top"), F.array(F.struct(F.col("memo").alias("inner"), F.col("balance").alias("n"))).alias("list"),
        F.create_map(F.lit("k"), F.col("note")).alias("map")).alias("doc"))
    return records.sanitize_nested(df).select(
        "id", F.col("doc.top").alias("top"), F.col("doc.list")[0]["inner"].alias("in_list"),
        F.col("doc.list")[0]["n"].alias("number"), F.element_at("doc.map", "k").alias("in_map"))


register("sanitize_nested", _nested, f"SELECT id, note AS top, memo AS in_list, balance AS number, note AS in_map FROM ({_two('mask')})")

register("sanitize_json", lambda spark, sf: records.sanitize_json(
    source(spark, sf, "notes").where("text IS NOT NULL").select("id", F.to_json(F.struct(
        F.col("text").alias("note"), F.col("id").alias("n"))).alias("props")), "props").select("id", "props"),
    o.with_(o.hits(duck_source("notes")), o.kept(), o.rendered(o.MASK)) +
    """SELECT id, '{"note":"' || sanitized_text || '","n":' || id || '}' AS props FROM out WHERE sanitized_text IS NOT NULL""")


def _event_props(spark, sf):
    df = spread(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "props"))
    wide = df.select("event_id", F.to_json(F.struct(
        F.concat(F.lit("mail user"), F.col("user_id"), F.lit("@example.com")).alias("from"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("props"))
    return records.sanitize_json(wide, "props").select("event_id", "props")


register("sanitize_json_events", _event_props,
         """SELECT event_id, '{"from":"mail [EMAIL_ADDRESS]","k":' || (props->>'$.k') || '}' AS props FROM events""")


def _fields_sql(parts: dict[str, tuple[str, str | None]]) -> str:
    """(id, field, pii_found, hit_count, entity_types, risk_level) over several sources."""
    return "\nUNION ALL\n".join(
        f"(SELECT id, '{f}' AS field, text IS NULL AS skipped, pii_found, hit_count, entity_types, risk_level FROM ("
        + o.with_(o.hits(src, None, hint), o.SUMMARY) + " SELECT * FROM scan))" for f, (src, hint) in parts.items())


def _field_columns(scanned):
    return records.field_rows(scanned, ["id"]).select(
        "id", "field", "skipped", "pii_found", "hit_count", joined("entity_types"), "risk_level")


_SCANNED = _fields_sql({"note": (duck_source("notes"), None), "memo": (duck_source("memos"), None)})
register("scan_structured", lambda spark, sf: _field_columns(
    records.scan_record(people(spark, sf), ["note", "memo", "balance"])), _SCANNED + """
UNION ALL (SELECT c_custkey AS id, 'balance' AS field, true AS skipped, false AS pii_found, 0 AS hit_count, '' AS entity_types,
    'LOW' AS risk_level FROM customer)""")
_RANK = f"list_position({o.names(TIERS)}, risk_level) - 1"
register("scan_structured_summary", lambda spark, sf: records.scan_record(people(spark, sf)).select(
    "id", "total_hits", "highest_risk", joined("flagged_fields")), f"""SELECT id, sum(hit_count)::INT AS total_hits,
    {o.names(TIERS)}[max({_RANK}) + 1] AS highest_risk,
    coalesce(string_agg(field, ',' ORDER BY field DESC) FILTER (WHERE pii_found), '') AS flagged_fields FROM ({_SCANNED}) GROUP BY id""")
register("column_profile", lambda spark, sf: records.column_profile(people(spark, sf), ["note", "memo"]), f"""WITH f AS ({_SCANNED}),
ty AS (SELECT field, unnest(string_split(entity_types, ',')) AS e FROM f WHERE entity_types <> ''),
tc AS (SELECT field, e, count(*) AS n FROM ty GROUP BY ALL),
tt AS (SELECT field, e AS top_entity FROM tc QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, e) = 1)
SELECT f.field, count(*) FILTER (WHERE NOT skipped) AS scanned_rows, count(*) FILTER (WHERE pii_found) AS rows_with_pii,
    sum(hit_count)::BIGINT AS hit_count, any_value(top_entity) AS top_entity,
    round(count(*) FILTER (WHERE pii_found) / greatest(count(*) FILTER (WHERE NOT skipped), 1), 6) AS hit_rate,
    {o.names(TIERS)}[max({_RANK}) + 1] AS highest_risk FROM f LEFT JOIN tt USING (field) GROUP BY f.field""")


# Profiles: every field holds, row by row, bare numbers, notes or memos, so that hints decide hits.
def _profile_value(k: int) -> str:
    return (f"CASE (c_custkey + {k}) % 6 WHEN 0 THEN cast(1000000 + c_custkey AS string) "
            f"WHEN 1 THEN cast(200000000 + c_custkey AS string) WHEN 2 THEN cast(3000000000 + c_custkey AS string) "
            f"WHEN 3 THEN cast(400000 + c_custkey AS string) WHEN 4 THEN concat('reach me at u', cast(c_custkey AS string), '@example.com') "
            f"ELSE 'nothing here' END")


def _profile_frame(spark, sf, profile) -> DataFrame:
    """Customer rows in the profile's shape; dotted fields become nested structs."""
    tree: dict = {}
    for k, f in enumerate(profile.hints):
        node = tree
        *path, last = f.split(".")
        for p in path:
            node = node.setdefault(p, {})
        node[last] = _profile_value(k)

    def build(node):
        return "named_struct(" + ", ".join(
            f"'{n}', {build(v) if isinstance(v, dict) else v}" for n, v in node.items()) + ")"

    df = spread(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey"), rows=10_000)
    return df.selectExpr("c_custkey AS row_id", *[f"{build(v) if isinstance(v, dict) else v} AS `{n}`"
                                                  for n, v in tree.items()])


def _long(profile) -> str:
    """Profile fields as (id, text, boosted) rows; id is row * 100 + field number."""
    return "\nUNION ALL\n".join(
        f"SELECT c_custkey * 100 + {k} AS id, {_profile_value(k)} AS text, {o.names(sorted(o.hinted_entities(e, BOOK)))} AS boosted FROM customer"
        for k, e in enumerate(profile.hints.values()))


def _profile_query(profile):
    fields = list(profile.hints)
    register(f"profile_{profile.name}", lambda spark, sf: records.field_rows(records.scan_record(
        _profile_frame(spark, sf, profile), fields, profile=profile), ["row_id"]).select(
        "row_id", "field", "hit_count", joined("entity_types"), "risk_level"),
        o.with_(o.hits(_long(profile)), o.SUMMARY) + f"SELECT id // 100 AS row_id, {o.names(fields)}[(id % 100)::INT + 1] AS field, "
        "hit_count, entity_types, risk_level FROM scan")


for _profile in PROFILES.values():
    _profile_query(_profile)

register("profile_sanitize", lambda spark, sf: flows.process_record(
    _profile_frame(spark, sf, PROFILES["servicenow_itsm"]), list(PROFILES["servicenow_itsm"].hints),
    profile="servicenow_itsm").select("row_id", "mode", F.col("caller_id.name").alias("caller_name"),
                                      F.col("location.name").alias("place"), "comments"),
    o.with_(o.hits(_long(PROFILES["servicenow_itsm"])), o.kept(), o.rendered("''")) + """SELECT id // 100 AS row_id, 'redact' AS mode,
    any_value(sanitized_text) FILTER (WHERE id % 100 = 0) AS caller_name, any_value(sanitized_text) FILTER (WHERE id % 100 = 13) AS place,
    any_value(sanitized_text) FILTER (WHERE id % 100 = 6) AS comments FROM out GROUP BY id // 100""")


def _by_profile(spark, sf):
    df = spread(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey"))
    long = df.selectExpr("c_custkey AS id", "CASE c_custkey % 3 WHEN 0 THEN 'n8n_generic' WHEN 1 THEN 'slate_crm' ELSE 'none' END AS profile",
                         "CASE c_custkey % 4 WHEN 0 THEN 'ssn' WHEN 1 THEN 'email' WHEN 2 THEN 'student_id' ELSE 'notes' END AS field",
                         f"{_profile_value(0)} AS value")
    return records.scan_by_profile(long).select("id", F.size("hits").alias("hit_count"), hits_text())


def _hint_case() -> str:
    rows = []
    for p in ("n8n_generic", "slate_crm"):
        for f in ("ssn", "email", "student_id", "notes"):
            e = PROFILES[p].hints.get(f)
            rows.append(f"WHEN {0 if p == 'n8n_generic' else 1} * 4 + {['ssn', 'email', 'student_id', 'notes'].index(f)} "
                        f"THEN {o.names(sorted(o.hinted_entities(e, BOOK)))}")
    return f"CASE (c_custkey % 3) * 4 + c_custkey % 4 {' '.join(rows)} ELSE []::VARCHAR[] END"


register("field_hint_by_row", _by_profile, o.with_(o.hits(
    f"SELECT c_custkey AS id, {_profile_value(0)} AS text, {_hint_case()} AS boosted FROM customer"), o.SUMMARY) +
    "SELECT id, hit_count, hits FROM scan")

def _both_sides(df):
    """Accepted and quarantined texts are scanned alike; the reason stays with the latter."""
    good, long = reports.split_oversize(df, max_chars=5000)
    both = good.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(long)
    return scan.scan(both).select("id", "hit_count", "risk_level", "reject_reason")


# --- decoding, limits, pages --------------------------------------------------------------------

_PLAIN = o.with_(o.hits(duck_source("notes")), o.SUMMARY) + "SELECT id, text, hit_count, hits FROM scan"
register("decode_url", lambda spark, sf: scan.scan(
    source(spark, sf, "notes").withColumn("text", F.replace("text", F.lit(" "), F.lit("%20"))), decode=True).select(
    "id", "text", "hit_count", hits_text()), _PLAIN)
register("decode_base64", lambda spark, sf: scan.scan(
    source(spark, sf, "notes").withColumn("text", F.base64(F.encode("text", "UTF-8"))), decode=True).select(
    "id", "text", "hit_count", hits_text()), _PLAIN)

register("accept_and_quarantine", lambda spark, sf: _both_sides(source(spark, sf, "documents")),
         o.with_(o.hits(duck_source("documents")), o.SUMMARY) + """SELECT id, hit_count, risk_level,
    CASE WHEN length(text) > 5000 THEN 'TEXT_TOO_LONG' END AS reject_reason FROM scan""")
register("quarantine_oversize", lambda spark, sf: reports.split_oversize(
    source(spark, sf, "documents"), max_chars=5000)[1].select("id", F.length("text").alias("n_chars"), "reject_reason"),
    "SELECT doc_id AS id, length(text)::INT AS n_chars, 'TEXT_TOO_LONG' AS reject_reason FROM documents WHERE length(text) > 5000")


def _paged(spark, sf):
    df = source(spark, sf, "notes").withColumns({
        "doc": F.col("id") % 97, "page_number": F.col("id"),
        "confidence": F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise((F.col("id") % 100).cast("double"))})
    return reports.scan_pages(df)


_PAGES = (o.with_(o.hits(duck_source("notes")), o.SUMMARY, o.kept(), o.rendered(o.MASK)) +
          f"""SELECT id, id % 97 AS doc, CASE WHEN id % 5 = 0 THEN 100.0::DOUBLE ELSE (id % 100)::DOUBLE END AS ocr_confidence,
    coalesce(out.sanitized_text, '') AS sanitized_text, pii_found, hit_count, risk_level, rk FROM scan JOIN out USING (id)""")
register("ocr_pages", lambda spark, sf: _paged(spark, sf).select(
    "id", "ocr_confidence", "low_confidence_warning", "sanitized_text", "pii_found", "hit_count", "risk_level"),
    f"SELECT id, ocr_confidence, ocr_confidence < 70 AS low_confidence_warning, sanitized_text, pii_found, hit_count, risk_level FROM ({_PAGES})")
register("report_ocr", lambda spark, sf: reports.page_report(_paged(spark, sf), ["doc"]),
         f"""SELECT doc, count(*) AS page_count, count(*) FILTER (WHERE pii_found) AS pages_with_pii,
    count(*) FILTER (WHERE ocr_confidence < 70) AS low_confidence_pages, sum(hit_count)::BIGINT AS hit_count,
    {o.tier('max(rk)')} AS highest_risk FROM ({_PAGES}) GROUP BY doc""")
register("report_file", lambda spark, sf: reports.file_report(
    records.sanitize_record(people(spark, sf), None, "exclude")),
    f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE has_pii) AS rows_with_pii,
    count(*) FILTER (WHERE excluded_fields <> '') AS excluded_rows FROM ({_two('exclude')})""")


def _conversation_pages(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    order = Window.partitionBy("conv_id").orderBy("turn")
    pages = df.where(~column(blank("text"))).withColumn("page_number", F.row_number().over(order))
    return scan.scan(pages).select("conv_id", "page_number", "pii_found", "hit_count")


register("scan_paged_conversations", _conversation_pages, o.with_(o.hits(duck_source("conversations")), o.SUMMARY) +
         """SELECT id // 1000 AS conv_id, row_number() OVER (PARTITION BY id // 1000 ORDER BY id)::INT AS page_number, pii_found, hit_count
    FROM scan WHERE regexp_matches(text, '\\S') """)

# --- audit and statistics -----------------------------------------------------------------------


def _events(spark, sf, mode="exclude"):
    """One audit event per batch of notes; odd batches come from another endpoint."""
    done = sanitize.sanitize(source(spark, sf, "notes"), mode=mode).withColumn("batch", F.col("id") % 20)
    return audit.audit_events(
        done, by=["batch"], endpoint="/sanitize", mode=F.when(F.col("batch") % 4 != 0, F.lit(mode)), action=mode,
        caller_name="nightly", destination="warehouse", request_id="r-1", correlation_id=F.concat(F.lit("c"), "batch"))


_EVENTS = (o.with_(o.hits(duck_source("notes")), o.SUMMARY) +
           f"""SELECT batch, count(*) AS batch_size, sum(hit_count)::BIGINT AS hit_count, count(*) FILTER (WHERE pii_found) AS excluded_count,
    coalesce(string_agg(DISTINCT e, ',' ORDER BY e), '') AS entity_types, {o.tier('max(rk)')} AS risk_level,
    CASE WHEN batch % 4 <> 0 THEN 'exclude' END AS mode, 'c' || batch AS correlation_id FROM (
    SELECT id % 20 AS batch, hit_count * (rn = 1)::INT AS hit_count, pii_found, rk, e, rn FROM (SELECT *, unnest(CASE WHEN entity_types = ''
    THEN [NULL] ELSE string_split(entity_types, ',') END) AS e, generate_subscripts(CASE WHEN entity_types = '' THEN [NULL] ELSE string_split(entity_types, ',') END, 1) AS rn FROM scan))
    GROUP BY batch""").replace("count(*) AS batch_size", "count(*) FILTER (WHERE rn = 1) AS batch_size").replace(
    "count(*) FILTER (WHERE pii_found)", "count(*) FILTER (WHERE pii_found AND rn = 1)")
register("audit_events", lambda spark, sf: _events(spark, sf).select(
    "batch", "batch_size", "hit_count", "excluded_count", joined("entity_types"), "risk_level", "mode", "correlation_id"), _EVENTS)
register("stats_totals", lambda spark, sf: audit.stats_totals(_events(spark, sf)),
         f"""SELECT count(*) AS total_requests, sum(hit_count)::BIGINT AS total_pii_hits, sum(excluded_count)::BIGINT AS total_excluded,
    coalesce(sum(batch_size) FILTER (WHERE hit_count = 0), 0)::BIGINT AS total_clean FROM ({_EVENTS})""")
_TYPES = f"SELECT e AS entity_type, count(*) AS events FROM (SELECT unnest(string_split(entity_types, ',')) AS e FROM ({_EVENTS}) WHERE entity_types <> '') GROUP BY e"
register("stats_by_type", lambda spark, sf: audit.stats_by_type(_events(spark, sf)), _TYPES)
_LABELS = f"""SELECT 'mode' AS dimension, mode AS label, count(*) AS events FROM ({_EVENTS}) WHERE mode IS NOT NULL GROUP BY mode
UNION ALL SELECT 'risk_level', risk_level, count(*) FROM ({_EVENTS}) GROUP BY risk_level
UNION ALL SELECT 'endpoint', '/sanitize', count(*) FROM ({_EVENTS})"""
register("stats_by_label", lambda spark, sf: audit.stats_by_label(_events(spark, sf)), _LABELS)
register("metrics", lambda spark, sf: audit.metrics(_events(spark, sf)),
         f"""WITH e AS ({_EVENTS}) SELECT 'requests_total' AS metric, '' AS label, count(*) AS value FROM e
UNION ALL SELECT 'pii_hits_total', '', sum(hit_count)::BIGINT FROM e UNION ALL SELECT 'excluded_total', '', sum(excluded_count)::BIGINT FROM e
UNION ALL SELECT 'clean_total', '', coalesce(sum(batch_size) FILTER (WHERE hit_count = 0), 0)::BIGINT FROM e
UNION ALL SELECT 'entity_type_total', entity_type, events FROM ({_TYPES}) UNION ALL SELECT dimension || '_total', label, events FROM ({_LABELS})""")

# The events table as an audit log: every event is one request with a batch and its hits.
# Its clock has no zone; it is read as UTC whatever the session's zone is.
_UTC = "to_timestamp(concat(cast(ts AS string), 'Z')) AS ts"
_LOG = [_UTC, "event_type AS endpoint", "cast(event_id % 3 AS bigint) AS hit_count", "cast(event_id % 2 AS bigint) AS excluded_count",
        "cast(1 + event_id % 5 AS bigint) AS batch_size"]
_STATS = """count(*) AS total_requests, sum(event_id % 3)::BIGINT AS total_pii_hits, sum(event_id % 2)::BIGINT AS total_excluded,
    coalesce(sum(1 + event_id % 5) FILTER (WHERE event_id % 3 = 0), 0)::BIGINT AS total_clean"""


def _at(day: str) -> datetime:
    return datetime.fromisoformat(day).replace(tzinfo=timezone.utc)


def utc_text(col: str, fmt: str):
    return F.date_format(F.to_utc_timestamp(col, F.current_timezone()), fmt).alias(col)


register("stats_since", lambda spark, sf: audit.stats_totals(audit.between(
    spark.read.parquet(f"{sf}/events.parquet").selectExpr(*_LOG), _at("2024-01-10"), _at("2024-01-20")), ["endpoint"]),
    f"SELECT event_type AS endpoint, {_STATS} FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY event_type")
register("stats_windowed", lambda spark, sf: jobs.windowed_stats(
    spark.read.parquet(f"{sf}/events.parquet").selectExpr(*_LOG), window="1 day", by=["endpoint"]).select(
    utc_text("window_start", "yyyy-MM-dd").alias("day"), "endpoint", "total_requests", "total_pii_hits",
    "total_excluded", "total_clean"),
    f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS endpoint, {_STATS} FROM events GROUP BY ALL")

# --- catalogs joined with what was found --------------------------------------------------------


def _found(spark, sf):
    return scan.hits_table(source(spark, sf, "notes"), ["id"]).groupBy("entity_type", "pattern_id").agg(
        F.count(F.lit(1)).alias("n"))


_PAIRS = list(dict.fromkeys([(r.entity, r.group) for r in BOOK.rules])) + [("US_SSN", "generic"), ("MEDICAL_LICENSE", "generic")]
_NOTE_HITS = o.with_(o.hits(duck_source("notes"))) + "SELECT * FROM hits"
register("catalog_entities", lambda spark, sf: catalogs.entities_table(spark).join(
    _found(spark, sf).groupBy("entity_type").agg(F.sum("n").alias("n")), "entity_type", "left").select(
    "entity_type", "detector_group", "risk_level", F.coalesce("n", F.lit(0)).alias("hits")),
    "SELECT c.*, coalesce(n, 0)::BIGINT AS hits FROM (VALUES " + ", ".join(
        f"('{e}', '{g}', '{tier_of(e)}')" for e, g in _PAIRS) +
    f") c(entity_type, detector_group, risk_level) LEFT JOIN (SELECT entity_type, count(*) AS n FROM ({_NOTE_HITS}) GROUP BY ALL) USING (entity_type)")
register("catalog_patterns", lambda spark, sf: catalogs.rules_table(spark).join(
    _found(spark, sf).groupBy("pattern_id").agg(F.sum("n").alias("n")), "pattern_id", "left").select(
    "pattern_id", "entity_type", "pattern_name", "base_score", F.coalesce("n", F.lit(0)).alias("hits")),
    "SELECT c.*, coalesce(n, 0)::BIGINT AS hits FROM (VALUES " + ", ".join(
        f"({r.rule_id}, '{r.entity}', '{r.pattern}', {r.score!r}::DOUBLE)" for r in BOOK.rules) +
    f") c(pattern_id, entity_type, pattern_name, base_score) LEFT JOIN (SELECT pattern_id, count(*) AS n FROM ({_NOTE_HITS}) GROUP BY ALL) USING (pattern_id)")
register("catalog_policies", lambda spark, sf: catalogs.policies_table(spark).select(
    "policy", "mode", "exclude_any", joined("block"), joined("pass_through"), F.explode_outer("block").alias("entity_type")).join(
    _found(spark, sf).groupBy("entity_type").agg(F.sum("n").alias("n")), "entity_type", "left").groupBy(
    "policy", "mode", "exclude_any", "block", "pass_through").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("blocked_hits")),
    "SELECT policy, mode, exclude_any, block, pass_through, coalesce(sum(n), 0)::BIGINT AS blocked_hits FROM (VALUES " + ", ".join(
        f"('{p.name}', '{p.mode}', {str(p.exclude_any).lower()}, '{','.join(sorted(p.block))}', '{','.join(sorted(p.pass_through))}')"
        for p in POLICIES.values()) + f""") c(policy, mode, exclude_any, block, pass_through) LEFT JOIN
    (SELECT entity_type, count(*) AS n FROM ({_NOTE_HITS}) GROUP BY ALL) h ON list_contains(string_split(c.block, ','), h.entity_type) GROUP BY ALL""")
register("catalog_profiles", lambda spark, sf: catalogs.profiles_table(spark).join(
    _found(spark, sf).groupBy(F.col("entity_type").alias("entity_hint")).agg(F.sum("n").alias("n")), "entity_hint", "left").groupBy(
    "profile", "default_mode").agg(F.count(F.lit(1)).alias("fields"), F.count_if(F.col("entity_hint").isNull()).alias("unhinted"),
                                   F.coalesce(F.sum("n"), F.lit(0)).alias("hits_of_hinted_types")),
    "SELECT profile, default_mode, count(*) AS fields, count(*) FILTER (WHERE hint IS NULL) AS unhinted, coalesce(sum(n), 0)::BIGINT "
    "AS hits_of_hinted_types FROM (VALUES " + ", ".join(
        f"('{p.name}', '{p.mode}', {o.s(e) if e else 'NULL'})" for p in PROFILES.values() for e in p.hints.values()) +
    f") c(profile, default_mode, hint) LEFT JOIN (SELECT entity_type, count(*) AS n FROM ({_NOTE_HITS}) GROUP BY ALL) h ON h.entity_type = c.hint GROUP BY ALL")

# --- SQL names, dictionaries, config ------------------------------------------------------------


def _sql_names(spark, sf):
    register_functions(spark)
    source(spark, sf, "notes").createOrReplaceTempView("veil_notes")
    return spark.sql("SELECT id, s.masked, s.risk_level, s.hit_count FROM (SELECT id, pii_scan(text) AS s FROM veil_notes)")


register("sql_functions", _sql_names, o.with_(o.hits(duck_source("notes")), o.SUMMARY, o.kept(), o.rendered(o.MASK)) +
         "SELECT id, out.sanitized_text AS masked, risk_level, hit_count FROM scan JOIN out USING (id)")


def _sql_table(spark, sf):
    register_functions(spark)
    source(spark, sf, "notes").createOrReplaceTempView("veil_notes")
    return spark.sql("SELECT id, h.entity_type, h.start AS hit_start, h.`end` AS hit_end FROM (SELECT id, pii_hits(text) AS hs FROM veil_notes) "
                     "LATERAL VIEW OUTER explode(hs) x AS h WHERE h IS NOT NULL")


register("sql_table_function", _sql_table, o.with_(o.hits(duck_source("notes"))) +
         "SELECT id, entity_type, hit_start, hit_end FROM hits")


def _terms(spark, sf):
    words = spark.read.parquet(f"{sf}/part.parquet").select(
        F.explode_outer(F.split("p_name", " ")).alias("term"), F.lit("LOCATION").alias("entity_type"))
    text = spread(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_type")).select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("text"))
    return dictionary.term_hits(text, ["id"], "text", words).select("id", "entity_type", "hit_start", "hit_end")


register("term_dictionary", _terms, """WITH t AS (SELECT p_partkey AS id, p_type || ' ' || p_name AS text FROM part),
d AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS word FROM part),
w AS (SELECT id, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws, string_split_regex(text, '[A-Za-z0-9]+') AS gs FROM t),
k AS (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM w),
p AS (SELECT id, ws[k] AS word, (list_sum(list_transform(gs[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ws[1:k-1], lambda g: length(g))), 0))::INT AS st FROM k)
SELECT id, 'LOCATION' AS entity_type, st AS hit_start, (st + length(p.word))::INT AS hit_end FROM p JOIN d ON lower(p.word) = d.word""")

_CONFIG = {"entity_thresholds": {"STUDENT_ID": 0.95}, "pseudo_pools": {"first_names": ["Ada", "Bo"]},
           "custom_patterns": [{"entity_type": "COURSE_DAY", "context": ["course"],
                                "patterns": [{"name": "day", "regex": r"\bMonday\b", "score": 0.4}]}]}
_CONFIGURED = config.parse_config(_CONFIG)
_sanitize_query("config_file", "notes", "pseudonymize", _CONFIGURED.book, how=_CONFIGURED.pseudonyms)

# --- files --------------------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder, else below the warehouse; executors share both."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(root, f"run-{uuid.uuid4().hex}")


_MASKED = o.with_(o.hits(duck_source("notes")), o.kept(), o.rendered(o.MASK))


def _csv(sep, reader):
    def run(spark, sf):
        path = scratch(spark)
        source(spark, sf, "notes").where("text IS NOT NULL").select(
            F.col("id").cast("string"), F.concat(F.lit('say "hi", '), "text", F.lit("\nbye")).alias("text")).write.option(
            "header", True).option("sep", sep).option("escape", '"').option("quoteAll", True).csv(path)
        return records.sanitize_record(reader(spark, path), ["text"]).select("id", "text", "has_pii")
    return run


_FILE = (o.with_(o.hits("SELECT c_custkey AS id, 'say \"hi\", ' || (" + NOTES + ") || chr(10) || 'bye' AS text FROM customer"), o.SUMMARY, o.kept(),
                 o.rendered(o.MASK)) + "SELECT id::VARCHAR AS id, out.sanitized_text AS text, pii_found AS has_pii FROM scan JOIN out USING (id) WHERE scan.text IS NOT NULL")
register("read_csv", _csv(",", readers.read_csv), _FILE)
register("read_tsv", _csv("\t", readers.read_tsv), _FILE)


#: Rows of an array file.
FILE_ROWS = 200


def _file_each(rows: DataFrame, path: str) -> None:
    """A file per row, written by several tasks a core, as Spark writes lines of text.

    Below a folder that tasks can open they write the files themselves: Spark's writer starts two processes a file there, to set permissions.
    A task's rows are in order, and a file appears whole, so a task that runs again writes the same files. Elsewhere each task
    of Spark's writer moves its own files, as the driver would one after the other; its first range is never empty, as Spark
    writes a file without rows for an empty first partition.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(4 * spark.sparkContext.defaultParallelism, "value")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = store.makeQualified(place).toUri()
    if uri.getScheme() != "file":
        dealt.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
        return
    store.mkdirs(place)
    folder = uri.getPath()

    def written(batches):
        task, n = TaskContext.get(), 0
        # files are made in a folder of the attempt's own, as tasks wait for each other in a shared one
        own = os.path.join(folder, f".{task.partitionId()}-{task.taskAttemptId()}")
        os.makedirs(own)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                name = f"part-{task.partitionId():05d}-{n:09d}.txt"
                with open(os.path.join(own, name), "wb") as out:
                    out.write((value or b"") + b"\n")
                os.replace(os.path.join(own, name), os.path.join(folder, name))
                n += 1
            yield batch.slice(0, 0)
        os.rmdir(own)

    lines = dealt.sortWithinPartitions("value").select(F.col("value").cast("binary").alias("value"))
    lines.mapInArrow(written, lines.schema).write.format("noop").mode("overwrite").save()


def _read_once(spark, path):
    """Good rows and rejects of array files, each file opened once for both."""
    readers.read_json_array(spark, f"{path}/in", "id bigint, text string").write.parquet(f"{path}/read")
    return readers.split_rejects(spark.read.parquet(f"{path}/read"))


def _json_array(spark, sf):
    """A file per 200 customers: an array of their notes, each followed by a number. The number of files follows the table."""
    path = scratch(spark)
    rows = source(spark, sf, "notes").where("text IS NOT NULL").select(
        F.concat(F.to_json(F.struct("id", "text")), F.lit(", 7")).alias("j"), F.floor(F.col("id") / FILE_ROWS).alias("f"))
    _file_each(rows.groupBy("f").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ", "), F.lit("]")).alias("value")).select("value"), f"{path}/in")
    good, bad = _read_once(spark, path)
    masked = records.sanitize_record(good, ["text"]).select("id", "text")
    return masked.unionByName(bad.groupBy().agg((-F.count(F.lit(1))).alias("id")).select("id", F.lit("rejected").alias("text")))


register("read_json_array", _json_array, _MASKED + """SELECT id, sanitized_text AS text FROM out WHERE sanitized_text IS NOT NULL
UNION ALL SELECT -count(*), 'rejected' FROM customer WHERE c_custkey % 22 <> 21""")


def _jsonl(spark, sf):
    path = scratch(spark)
    source(spark, sf, "notes").where("text IS NOT NULL").select(F.to_json(F.struct("id", "text")).alias("value")).write.text(path)
    return records.sanitize_record(readers.read_jsonl(spark, path, "id bigint, text string"), ["text"]).select("id", "text")


register("read_jsonl", _jsonl, _MASKED + "SELECT id, sanitized_text AS text FROM out WHERE sanitized_text IS NOT NULL")


def _text_files(spark, sf):
    """A file per note, of three lines; each file is one text."""
    path = scratch(spark)
    rows = source(spark, sf, "notes").where("text IS NOT NULL").select(F.format_string("%d\n%s\nbye", "id", "text").alias("value"))
    _file_each(rows, path)
    done = sanitize.sanitize(readers.read_text_files(spark, path))
    return done.select(F.regexp_extract("text", "^([0-9]+)", 1).cast("bigint").alias("id"), "hit_count", "sanitized_text")


register("read_text", _text_files, o.with_(o.hits(
    "SELECT id, id || chr(10) || text || chr(10) || 'bye' || chr(10) AS text FROM (" + duck_source("notes") + ") WHERE text IS NOT NULL"), o.SUMMARY, o.kept(),
    o.rendered(o.MASK)) + "SELECT id, hit_count, out.sanitized_text FROM scan JOIN out USING (id)")


def _sheet(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_acctbal", "c_name")
    return readers.normalise_sheet(df.withColumn("c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))),
                                   ["key", "", "name"]).select("key", "B", "name")


register("normalise_sheet", _sheet, """SELECT c_custkey::VARCHAR AS key, c_acctbal::VARCHAR AS "B",
    CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE '' END AS name FROM customer""")


def _written(fmt):
    def run(spark, sf):
        path = scratch(spark)
        writers.write_result(sanitize.sanitize(source(spark, sf, "notes"), mode="exclude"), path, fmt, include_excluded=False)
        if fmt == "csv":
            return readers.read_csv(spark, path).select(F.col("id").cast("bigint").alias("id"), F.nullif("sanitized_text", F.lit("")).alias("sanitized_text"))
        back = spark.read.parquet(path) if fmt == "parquet" else spark.read.schema("id bigint, sanitized_text string").json(path)
        return back.select("id", "sanitized_text")
    return run


for _f in ("parquet", "json", "csv"):
    register(f"write_result_{_f}", _written(_f), o.with_(o.hits(duck_source("notes")), o.SUMMARY) +
             "SELECT id, text AS sanitized_text FROM scan WHERE NOT pii_found")

# --- nothing gets lost --------------------------------------------------------------------------

# A caller's skip never weakens a policy: every note that ai_prompt blocks stays blocked.
register("nested_policy_skip", lambda spark, sf: records.sanitize_nested(
    people(spark, sf).select("id", F.struct(F.array("note").alias("a")).alias("doc")), policy="ai_prompt",
    skip=["US_SSN", "STUDENT_ID"], report=True).select("id", F.col("doc.a")[0].isNull().alias("gone"), joined("excluded_fields"), "hit_count"),
    o.with_(o.hits(duck_source("notes")), o.policy("ai_prompt")) + """SELECT id, sanitized_text IS NULL AS gone,
    CASE WHEN passed THEN '' ELSE 'doc.a' END AS excluded_fields,
    hit_count - (SELECT count(*) FROM rel WHERE rel.id = po.id AND entity_type IN ('US_SSN', 'STUDENT_ID'))::INT AS hit_count FROM po""")

_IT = PROFILES["servicenow_itsm"]
register("profile_nested_default", lambda spark, sf: records.sanitize_record(
    _profile_frame(spark, sf, _IT), profile=_IT).select("row_id", F.col("caller_id.name").alias("caller_name"),
                                                        F.col("location.name").alias("place"), "comments", "has_pii"),
    o.with_(o.hits(_long(_IT)), o.kept(), o.rendered("''")) + """SELECT id // 100 AS row_id,
    any_value(sanitized_text) FILTER (WHERE id % 100 = 0) AS caller_name, any_value(sanitized_text) FILTER (WHERE id % 100 = 13) AS place,
    any_value(sanitized_text) FILTER (WHERE id % 100 = 6) AS comments, any_value(n) > 0 AS has_pii FROM out
    JOIN (SELECT id // 100 AS r, (SELECT count(*) FROM hits WHERE hits.id // 100 = src.id // 100) AS n FROM src GROUP BY ALL) ON r = id // 100 GROUP BY id // 100""")

register("process_record_recursive", lambda spark, sf: flows.process_record(
    _profile_frame(spark, sf, _IT), profile=_IT, mode="exclude", recursive=True).select(
    "row_id", "schema_applied", "action_taken", F.array_join(F.array_sort("excluded_fields"), ",").alias("excluded_fields"), "hit_count", joined("entity_types")),
    o.with_(o.hits(_long(_IT))) + f"""SELECT s.row_id, 'servicenow_itsm' AS schema_applied, CASE WHEN n > 0 THEN 'exclude' ELSE 'none' END AS action_taken,
    coalesce(fs, '') AS excluded_fields, coalesce(n, 0)::INT AS hit_count, coalesce(ty, '') AS entity_types
    FROM (SELECT DISTINCT id // 100 AS row_id FROM src) s LEFT JOIN (SELECT id // 100 AS row_id, count(*) AS n,
    string_agg(DISTINCT {o.names(list(_IT.hints))}[(id % 100)::INT + 1], ',' ORDER BY {o.names(list(_IT.hints))}[(id % 100)::INT + 1]) AS fs,
    string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS ty FROM hits GROUP BY id // 100) h USING (row_id)""")

# Context words that stand behind words of any length, and one that is only part of a long word.
_LONG_WORDS = """CASE c_custkey % 3 WHEN 0 THEN concat('ssn ', repeat('x', 205 + cast(c_custkey % 50 AS int)), ' 123456789')
    WHEN 1 THEN concat(repeat('y', 195), ' ', repeat('q', 300), 'ssn 123456789') ELSE concat('passport number ', repeat('z', 300), ' a b ', cast(100000000 + c_custkey AS string)) END"""
register("context_long_words", lambda spark, sf: scan.hits_table(spread(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey")).selectExpr(
    "c_custkey AS id", f"{_LONG_WORDS} AS text"), ["id"]).select("id", "entity_type", "hit_start", "hit_end", "score"),
    o.with_(o.hits(f"SELECT c_custkey AS id, {_LONG_WORDS.replace('AS int', 'AS BIGINT')} AS text FROM customer")) + f"SELECT {HIT_COLUMNS} FROM hits")
_LONG_MAIL = "concat('to ', repeat('a', cast(60 + c_custkey % 40 AS {int})), '@', repeat('b', 70), '.', repeat('c', 30), ' now')"
register("email_long_local", lambda spark, sf: sanitize.sanitize(spread(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey")).selectExpr(
    "c_custkey AS id", f"{_LONG_MAIL.format(int='int')} AS text")).select("id", "sanitized_text"),
    "SELECT c_custkey AS id, 'to [EMAIL_ADDRESS] now' AS sanitized_text FROM customer")


def _mixed_json(spark, sf):
    df = source(spark, sf, "notes").where("text IS NOT NULL").withColumn("props", F.when(F.col("id") % 5 != 0, F.concat(
        F.lit('{"a": 1, "more": {"note": '), F.substring(F.to_json(F.array("text")), F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit("}}"))).otherwise(
        F.concat(F.lit('{"note": "'), "text")))
    return records.sanitize_json(df.select("id", "props"), "props")


register("sanitize_json_unknown_keys", _mixed_json, _MASKED + """SELECT id, CASE WHEN id % 5 <> 0 THEN '{"a": 1, "more": {"note": "' || sanitized_text || '"}}' END AS props,
    CASE WHEN id % 5 = 0 THEN '{"note": "' || src.text END AS _corrupt_record FROM out JOIN src USING (id) WHERE sanitized_text IS NOT NULL""")


def _all_array_rejects(spark, sf):
    """Arrays with an object, a null, a number and an object of another type of every customer, 200 customers to a file; each tenth customer
    has a file of their own, which is cut off. The good rows and the number of rejects."""
    path = scratch(spark)
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "concat('{\"id\": ', c_custkey, ', \"text\": \"t\"}, null, 7, {\"id\": \"x\", \"text\": \"u\"}') AS j",
        f"if(c_custkey % 10 = 0, c_custkey, floor(c_custkey / {FILE_ROWS})) AS f", "c_custkey % 10 = 0 AS cut")
    _file_each(rows.groupBy("f", "cut").agg(F.array_join(F.collect_list("j"), ", ").alias("js")).select(
        F.concat(F.lit("["), "js", F.when(F.col("cut"), "").otherwise("]")).alias("value")), f"{path}/in")
    good, bad = _read_once(spark, path)
    return good.select("id", "text").unionByName(bad.groupBy().agg((-F.count(F.lit(1))).alias("id")).select("id", F.lit("rejected").alias("text")))


register("read_json_array_rejects_all", _all_array_rejects, """SELECT c_custkey AS id, 't' AS text FROM customer WHERE c_custkey % 10 <> 0
    UNION ALL SELECT -(3 * count(*) FILTER (WHERE c_custkey % 10 <> 0) + count(*) FILTER (WHERE c_custkey % 10 = 0)), 'rejected' FROM customer""")


def _ragged(spark, sf):
    """Every third line has one cell more than the header; the cell stays in the reject."""
    path = scratch(spark)
    spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").repartition(8).selectExpr(
        "concat('a,b\n', c_custkey, ',x', if(c_custkey % 3 = 0, ',123-45-6789', '')) AS value").write.option("lineSep", "\n\n").text(path)
    df = readers.read_csv(spark, path).where("coalesce(a, '') <> 'a'")
    return records.sanitize_record(df, ["_corrupt_record"]).select(F.col("a").cast("bigint").alias("id"), F.regexp_replace("_corrupt_record", "^.*,", "").alias("more"))


register("read_csv_ragged", _ragged, "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '[US_SSN]' END AS more FROM customer")

# One contract of results: audit and sink work on what any operator gives.


def _audited(result, action):
    return audit.audit_events(result, endpoint="/x", action=action, caller_name="nightly", subject_id="s-1", destination="warehouse",
                              request_id="r").select("batch_size", "hit_count", "excluded_count", joined("entity_types"), "risk_level",
                                                     "caller_name", "subject_id", "destination")


_WHO = "'nightly' AS caller_name, 's-1' AS subject_id, 'warehouse' AS destination"
register("audit_policy", lambda spark, sf: _audited(policy.apply_policy(source(spark, sf, "documents"), "ai_prompt"), "policy"),
         o.with_(o.hits(duck_source("documents")), o.policy("ai_prompt")) + f"""SELECT count(*) AS batch_size, sum(po.hit_count)::BIGINT AS hit_count,
    count(*) FILTER (WHERE NOT passed) AS excluded_count, (SELECT coalesce(string_agg(DISTINCT entity_type, ',' ORDER BY entity_type), '') FROM rel) AS entity_types,
    {o.tier('max(list_position(' + o.names(TIERS) + ', risk_level) - 1)')} AS risk_level, {_WHO} FROM po""")
register("audit_preflight", lambda spark, sf: _audited(preflight.preflight(source(spark, sf, "pages")), "preflight"),
         o.with_(o.hits(duck_source("pages")), o.SUMMARY) + f"""SELECT count(*) AS batch_size, sum(hit_count)::BIGINT AS hit_count, 0::BIGINT AS excluded_count,
    (SELECT coalesce(string_agg(DISTINCT entity_type, ',' ORDER BY entity_type), '') FROM hits) AS entity_types, {o.tier('max(rk)')} AS risk_level, {_WHO} FROM scan""")
register("audit_record", lambda spark, sf: _audited(records.sanitize_record(source(spark, sf, "notes"), ["text"], "exclude"), "record"),
         o.with_(o.hits(duck_source("notes")), o.SUMMARY) + f"""SELECT count(*) AS batch_size, sum(hit_count)::BIGINT AS hit_count, count(*) FILTER (WHERE pii_found) AS excluded_count,
    (SELECT coalesce(string_agg(DISTINCT entity_type, ',' ORDER BY entity_type), '') FROM hits) AS entity_types, {o.tier('max(rk)')} AS risk_level, {_WHO} FROM scan""")


def _policy_written(spark, sf):
    path = scratch(spark)
    writers.write_result(policy.apply_policy(source(spark, sf, "notes"), "ai_prompt"), path, include_excluded=False)
    return spark.read.parquet(path).select("id", "sanitized_text")


register("write_policy_result", _policy_written, o.with_(o.hits(duck_source("notes")), o.policy("ai_prompt")) + "SELECT id, sanitized_text FROM po WHERE passed")

# Policies, audit and the pseudonym map meet the real texts too.
for _n in ("documents", "pages"):
    _policy_query("log_safe", _n, f"_{_n}")
register("pseudonym_map_documents", lambda spark, sf: sanitize.pseudonym_map(source(spark, sf, "documents")), o.with_(
    o.hits(duck_source("documents")), o.kept()) + f"SELECT entity_type, {o.seed()} AS seed, count(*) AS occurrences, {o.stand_in(o.seed())} AS stand_in FROM kept GROUP BY ALL")


def _dictionary(spark, sf, kind):
    """Names of parts as a dictionary of one- and two-word terms, in another case than the texts have."""
    words = spark.read.parquet(f"{sf}/part.parquet").select("p_name")
    terms = words.select(F.upper(F.element_at(F.split("p_name", " "), 1)).alias("term")).unionByName(
        words.select(F.initcap(F.array_join(F.slice(F.split("p_name", " "), 1, 2), " ")).alias("term"))).where("term <> ''").distinct()
    text = spread(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_type")).select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("text"))
    return text, terms.withColumn("entity_type", F.lit(kind))


_TERM_HITS = """t AS (SELECT p_partkey AS id, p_type || ' ' || p_name AS text FROM part),
d AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS run FROM part UNION SELECT DISTINCT lower(array_to_string(string_split(p_name, ' ')[1:2], ' ')) FROM part),
w AS (SELECT id, text, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws, string_split_regex(text, '[A-Za-z0-9]+') AS gs FROM t),
k AS (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM w),
p AS (SELECT id, text, ws, k, (list_sum(list_transform(gs[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ws[1:k-1], lambda g: length(g))), 0))::INT AS st FROM k),
r AS (SELECT id, st, (st + length(ws[k]))::INT AS en, lower(ws[k]) AS run FROM p UNION ALL
  SELECT a.id, a.st, (b.st + length(b.ws[b.k]))::INT, lower(a.ws[a.k]) || ' ' || lower(b.ws[b.k]) FROM p a JOIN p b ON a.id = b.id AND b.k = a.k + 1),
th AS (SELECT DISTINCT id, st AS hit_start, en AS hit_end FROM r JOIN d USING (run))"""


def _term_query(name, kind):
    def run(spark, sf):
        text, terms = _dictionary(spark, sf, kind)
        return dictionary.term_hits(text, ["id"], "text", terms).select("id", "entity_type", "hit_start", "hit_end")
    register(name, run, f"WITH {_TERM_HITS} SELECT id, '{kind}' AS entity_type, hit_start, hit_end FROM th")


_term_query("person_dictionary", "PERSON")
_term_query("location_dictionary", "LOCATION")


def _masked_terms(spark, sf):
    text, terms = _dictionary(spark, sf, "PERSON")
    found = dictionary.with_terms(text, terms, book=BOOK.only(["US_SSN"]))
    return found.select("id", column(rewrite.sanitize_sql("text", "hits", "mask")).alias("sanitized_text"))


register("mask_with_dictionary", _masked_terms, f"""WITH RECURSIVE {_TERM_HITS}, src AS (SELECT id, text FROM t),
hits AS (SELECT id, text, 'PERSON' AS entity_type, hit_start, hit_end, 0.6::DOUBLE AS score, substring(text, hit_start + 1, hit_end - hit_start) AS v FROM th JOIN t USING (id)),
{{}}, {{}} SELECT id, sanitized_text FROM out""".format(o.kept(), o.rendered(o.MASK)))

# --- streams ------------------------------------------------------------------------------------


def _stream(spark, sf, table):
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)


def _stream_sanitize(spark, sf):
    root = scratch(spark)
    texts = _stream(spark, sf, "customer").selectExpr("c_custkey AS id", f"{NOTES} AS text")
    done = jobs.sanitize_stream(texts).select("id", "sanitized_text", "hit_count")
    jobs.run_to_table(done, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


register("stream_sanitize", _stream_sanitize, o.with_(o.hits(duck_source("notes")), o.SUMMARY, o.kept(), o.rendered(o.MASK)) +
         "SELECT id, out.sanitized_text, hit_count FROM scan JOIN out USING (id)")


def _stream_gate(spark, sf):
    root = scratch(spark)
    texts = _stream(spark, sf, "customer").selectExpr("c_custkey AS id", f"{NOTES} AS text")
    jobs.run_to_table(jobs.gate_stream(texts).select("id", "safe_text", "was_sanitized"), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


register("stream_gate", _stream_gate, f"SELECT id, safe_text, was_sanitized FROM ({ORACLES['preflight_gate']})")


def _stream_stats(slide):
    def run(spark, sf):
        root = scratch(spark)
        log = _stream(spark, sf, "events").selectExpr(*_LOG)
        stats = jobs.windowed_stats(log, window="1 day", slide=slide)
        jobs.run_to_table(stats, f"{root}/out", f"{root}/state")
        return spark.read.parquet(f"{root}/out").select(
            utc_text("window_start", "yyyy-MM-dd HH:mm"),
            "total_requests", "total_pii_hits", "total_excluded", "total_clean")
    return run


# Append mode emits a window once the watermark, ten minutes behind the newest event, has passed its end.
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
register("stream_stats_tumbling", _stream_stats(None), f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS window_start, {_STATS}
    FROM events GROUP BY date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED}""")
register("stream_stats_sliding", _stream_stats("12 hours"), f"""SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, {_STATS}
    FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events)
    GROUP BY w HAVING w + INTERVAL 1 DAY <= {_CLOSED}""")


def _stream_late(spark, sf):
    """Two batches; the second repeats the first five days, all later than the watermark, and adds nothing."""
    root = scratch(spark)
    log = spark.read.parquet(f"{sf}/events.parquet").selectExpr(*_LOG)
    folder = f"{root}/in"
    state = f"{root}/state"

    def drain():
        stream = spark.readStream.schema(log.schema).parquet(folder)
        jobs.run_to_table(jobs.windowed_stats(stream, window="1 day"), f"{root}/out", state)

    log.write.parquet(folder)
    drain()
    log.where(F.col("ts") < F.lit(_at("2024-01-06"))).write.mode("append").parquet(folder)
    drain()
    return spark.read.parquet(f"{root}/out").select(
        utc_text("window_start", "yyyy-MM-dd HH:mm"),
        "total_requests", "total_pii_hits", "total_excluded", "total_clean")


register("stream_late_drop", _stream_late, ORACLES["stream_stats_tumbling"])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Mask the e-mail, phone, card and address numbers of the documents."""
    book = BOOK.only(["EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS"])
    return sanitize.sanitize(source(spark, sf, "documents"), book=book).select(
        F.col("id").alias("doc_id"), "sanitized_text", "hit_count", joined("entity_types"), "risk_level")


register("flagship_mask", flagship, o.with_(o.hits(duck_source("documents"), BOOK.only(
    ["EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS"])), o.SUMMARY, o.kept(), o.rendered(o.MASK)) +
    "SELECT id AS doc_id, out.sanitized_text, hit_count, entity_types, risk_level FROM scan JOIN out USING (id)")

from . import deep  # noqa: E402, F401  (registers its own queries)
