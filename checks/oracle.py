"""DuckDB statements that answer the registered queries in plain relational SQL.

Detection is written as joins of texts with a rule list, overlap resolution as a
recursive query, rewriting as an ordered aggregate: another route than the Spark
expressions take. Patterns with look-aheads, which DuckDB's engine lacks, are
matched by shape and then tested on their parts.
"""

from __future__ import annotations

from veilframe.catalog import pools
from veilframe.catalog.policies import POLICIES
from veilframe.catalog.risk import ENTITY_TIER, TIERS, tier_of
from veilframe.catalog.rules import RuleBook, default_book, normal_words
from veilframe.functions.spans import hinted_entities

SHAPES = {
    "ssn_dashed": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn_barred"),
    "ssn_spaced": (r"[0-9]{3} [0-9]{2} [0-9]{4}", "ssn_parts"),
    "ssn_dotted": (r"[0-9]{3}\.[0-9]{2}\.[0-9]{4}", "ssn_barred"),
    "ssn_nodash": (r"[0-9]{9,}", "ssn_tail"),
}


def s(value) -> str:
    return "'" + value.replace("'", "''") + "'"


def names(values) -> str:
    return "(CAST([" + ", ".join(s(v) for v in values) + "] AS VARCHAR[]))"


def _rules(book: RuleBook) -> str:
    rows = []
    for r in book.rules:
        rx, kind = SHAPES.get(r.pattern, (r.regex, r.validator or ""))
        rows.append(f"({r.rule_id}, {s(r.entity)}, {s('(?i)' + rx)}, {r.score!r}::DOUBLE, "
                    f"{float(book.threshold_of(r.entity))!r}::DOUBLE, {s(kind)}, {names(normal_words(r.context))}, "
                    f"{s(r.pattern)}, {s(r.recognizer)})")
    return ("rules(pattern_id, entity_type, rx, base, lim, kind, ctx, pattern_name, recognizer) AS (VALUES "
            + ",\n".join(rows) + ")")


def hits(source: str, book: RuleBook | None = None, hint: str | None = None) -> str:
    """CTEs up to hits(id, entity_type, hit_start, hit_end, score, pattern_id); source gives id, text
    and, if hints vary per row, a list ``boosted``."""
    book = book or default_book()
    fixed = names(sorted(hinted_entities(hint, book)))
    boosted = "boosted" if "AS boosted" in source else fixed
    b, f, w = book.boost, book.boost_floor, book.context_words
    # Constant patterns are compiled once; a pattern read from a column would be compiled per row.
    matched = "\nUNION ALL\n".join(
        f"SELECT id, text, bl, {r.rule_id} AS pattern_id, regexp_extract_all(text, {s(rx)}) AS ms, "
        f"string_split_regex(text, {s(rx)}) AS gs FROM src WHERE regexp_matches(text, {s(rx)})"
        for r in book.rules for rx in ["(?i)" + SHAPES.get(r.pattern, (r.regex, ""))[0]])
    return f"""src AS MATERIALIZED (SELECT *, {boosted} AS bl FROM ({source})),
{_rules(book)},
mm AS MATERIALIZED ({matched}),
m AS (SELECT * FROM mm JOIN rules USING (pattern_id)),
ks AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM m),
raw AS (SELECT *, ms[k] AS v, list_sum(list_transform(gs[1:k], lambda g: length(g)))
        + coalesce(list_sum(list_transform(ms[1:k-1], lambda g: length(g))), 0) AS st FROM ks),
sp AS (SELECT * EXCLUDE (v, st), CASE WHEN kind = 'ssn_tail' THEN right(v, 9) ELSE v END AS v,
       (CASE WHEN kind = 'ssn_tail' THEN st + length(v) - 9 ELSE st END)::INT AS st FROM raw),
dg AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d, upper(replace(v, ' ', '')) AS a FROM sp),
ok AS (SELECT * FROM dg WHERE CASE
    WHEN kind = 'luhn' THEN list_sum(list_transform(range(1, length(d) + 1), lambda i:
        CASE WHEN d[-i]::INT * (1 + (i - 1) % 2) > 9 THEN d[-i]::INT * (1 + (i - 1) % 2) - 9
             ELSE d[-i]::INT * (1 + (i - 1) % 2) END)) % 10 = 0
    WHEN kind = 'mod97' THEN list_reduce(list_prepend(0, list_transform(string_split(a[5:] || a[1:4], ''), lambda x: ascii(x)::INT)),
        lambda p, x: CASE WHEN x <= 57 THEN (p * 10 + x - 48) % 97 ELSE (p * 100 + x - 55) % 97 END) = 1
    WHEN kind LIKE 'ssn%' THEN d[1:3] NOT IN ('000', '666') AND d[1] <> '9'
        AND (kind = 'ssn_parts' OR d NOT IN ('219099999', '078051120'))
        AND (kind = 'ssn_tail' OR (d[4:5] <> '00' AND d[6:9] <> '0000'))
    ELSE true END),
cx AS (SELECT *, ' ' || regexp_replace(lower(array_to_string(list_filter(string_split_regex(
        substring(text, 1, st), '\\s+'), lambda w: w <> '')[-{w}:], ' ')),
        '[^\\p{{L}}\\p{{N}}#]+', ' ', 'g') || ' ' AS pre FROM ok),
sc AS (SELECT id, text, entity_type, st AS hit_start, (st + length(v))::INT AS hit_end, lim, pattern_id, pattern_name, recognizer, ctx, v,
       CASE WHEN len(ctx) > 0 AND (list_contains(bl, entity_type) OR len(list_filter(ctx, lambda w: contains(pre, w))) > 0)
            THEN least(1.0::DOUBLE, greatest(base + {b!r}::DOUBLE, {f!r}::DOUBLE)) ELSE base END AS score FROM cx),
en AS MATERIALIZED (SELECT * FROM sc WHERE score >= lim),
hits AS (SELECT h.* FROM en h WHERE NOT EXISTS (SELECT 1 FROM en o WHERE o.id = h.id AND o.entity_type = h.entity_type
    AND o.hit_start <= h.hit_start AND o.hit_end >= h.hit_end AND (o.score > h.score OR (o.score = h.score
    AND (o.hit_start < h.hit_start OR o.hit_end > h.hit_end OR o.pattern_id < h.pattern_id)))))"""


def rank(entity: str) -> str:
    whens = " ".join(f"WHEN {s(e)} THEN {TIERS.index(t)}" for e, t in ENTITY_TIER.items())
    return f"(CASE {entity} {whens} ELSE 1 END)"


def tier(rank_sql: str) -> str:
    return f"{names(TIERS)}[{rank_sql} + 1]"


def types(where: str = "WHERE true") -> str:
    return f"coalesce(string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) FILTER ({where}), '')"


SUMMARY = f"""su AS (SELECT id, count(*) AS n, max({rank('entity_type')}) AS rk,
    string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS ty,
    string_agg(entity_type || ':' || hit_start || ':' || hit_end, ',' ORDER BY hit_start, hit_end, entity_type) AS hs
    FROM hits GROUP BY id),
scan AS (SELECT s.id, s.text, coalesce(n, 0) > 0 AS pii_found, coalesce(n, 0)::INT AS hit_count,
    {tier('coalesce(rk, 0)')} AS risk_level, coalesce(rk, 0) AS rk, coalesce(ty, '') AS entity_types, coalesce(hs, '') AS hits
    FROM src s LEFT JOIN su USING (id))"""


def kept(table: str = "hits", name: str = "kept") -> str:
    """CTEs for greedy resolution of the hits in ``table``."""
    r, g = f"{name}_r", f"{name}_g"
    return f"""{r} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, hit_start - hit_end, hit_start, entity_type) AS rn FROM {table}),
{g}(id, rn, got) AS (SELECT DISTINCT id, 0::BIGINT, []::STRUCT(b INT, e INT, n BIGINT)[] FROM {table}
    UNION ALL SELECT g.id, r.rn, CASE WHEN len(list_filter(g.got, lambda x: x.b < r.hit_end AND r.hit_start < x.e)) > 0 THEN g.got
        ELSE list_append(g.got, {{'b': r.hit_start, 'e': r.hit_end, 'n': r.rn}}) END
    FROM {g} g JOIN {r} r ON r.id = g.id AND r.rn = g.rn + 1),
{name}_f AS (SELECT id, arg_max(got, rn) AS got FROM {g} GROUP BY id),
{name} AS (SELECT h.* FROM {r} h JOIN {name}_f f USING (id) WHERE len(list_filter(f.got, lambda x: x.n = h.rn)) > 0)"""


def rendered(token: str, table: str = "kept", name: str = "out") -> str:
    """CTE name(id, sanitized_text) from disjoint hits; token is over entity_type and v."""
    return f"""{name}_p AS (SELECT id, hit_start, hit_end, substring(text, coalesce(lag(hit_end) OVER w, 0) + 1,
    hit_start - coalesce(lag(hit_end) OVER w, 0)) || {token} AS piece FROM {table} WINDOW w AS (PARTITION BY id ORDER BY hit_start)),
{name}_b AS (SELECT id, string_agg(piece, '' ORDER BY hit_start) AS body, max(hit_end) AS stop FROM {name}_p GROUP BY id),
{name} AS (SELECT s.id, CASE WHEN b.id IS NULL THEN s.text ELSE b.body || substring(s.text, b.stop + 1) END AS sanitized_text
    FROM src s LEFT JOIN {name}_b b USING (id))"""


MASK = "'[' || entity_type || ']'"


def seed(salt: str = "", secret: str = "") -> str:
    text = f"{s(salt)} || v" if salt else "v"
    if not secret:
        return f"md5({text})"
    key = secret.encode().ljust(64, b"\0")
    def blob(x):
        return "'" + "".join(f"\\x{(k ^ x):02X}" for k in key) + "'::BLOB"
    inner = f"sha256({blob(0x36)} || (entity_type || '::' || {text})::BLOB)"
    return f"sha256({blob(0x5C)} || unhex({inner}))[1:32]"


def stand_in(d: str, first=pools.FIRST_NAMES, last=pools.LAST_NAMES, cities=pools.CITIES) -> str:
    """Every blank of a type's format from eight hexadecimal digits of its own."""
    def bits(k: int) -> str:
        return f"('0x' || ({d})[{8 * k + 1}:{8 * k + 8}])::BIGINT"

    def word(values, k: int) -> str:
        return f"{names(values)}[({bits(k)} % {len(values)})::INT + 1]"

    def number(low: int, high: int, k: int, width: int = 0) -> str:
        value = f"({bits(k)} % {high - low + 1} + {low})::VARCHAR"
        return f"lpad({value}, {width}, '0')" if width else value

    mail = f"{word([n.lower().replace(' ', '') for n in first], 0)} || '.test@' || {word(pools.MAIL_DOMAINS, 1)}"
    date = f"{number(1, 12, 0, 2)} || '/' || {number(1, 28, 1, 2)} || '/' || {number(1970, 2004, 2)}"
    student, account = f"'D' || {number(10**6, 10**7 - 1, 0)}", f"{number(10**4, 10**5 - 1, 0)} || {number(0, 10**5 - 1, 1, 5)}"
    text = {
        "PERSON": f"{word(first, 0)} || ' ' || {word(last, 1)}", "EMAIL_ADDRESS": mail, "INSTITUTION_EMAIL": mail,
        "PHONE_NUMBER": f"'(555) ' || {number(2 * 10**6, 10**7 - 1, 0)}",
        "US_SSN": f"{number(100, 899, 0)} || '-' || {number(10, 99, 1)} || '-' || {number(1000, 9999, 2)}",
        "CREDIT_CARD": "'4111-1111-1111-1111'", "DATE_TIME": date, "DATE_OF_BIRTH": date, "LOCATION": word(cities, 0),
        "STUDENT_ID": student, "BANNER_ID": student, "COLLEAGUE_ID": student,
        "FAFSA_ID": f"'NE-' || {number(10**5, 10**6 - 1, 0)}", "IP_ADDRESS": f"'192.0.2.' || {number(1, 254, 0)}",
        "URL": "'https://example.com/redacted'", "IBAN_CODE": "'GB00FAKE00000000000000'",
        "MEDICAL_LICENSE": f"'ML' || {number(0, 10**6 - 1, 0, 6)}", "FINANCIAL_ACCOUNT": account, "US_BANK_NUMBER": account,
        "US_PASSPORT": f"chr((65 + {bits(0)} % 26)::INT) || {number(10**7, 10**8 - 1, 1)}",
        "US_DRIVER_LICENSE": f"'DL' || {number(10**6, 10**7 - 1, 0)}", "IMMIGRATION_STATUS": word(pools.RESIDENCE_PERMITS, 0),
        "DISABILITY_ACCOMMODATION": word(pools.ACCOMMODATIONS, 0), "VETERAN_STATUS": word(pools.SERVICE_RECORDS, 0),
        "NRP": "'[SENSITIVE_ATTRIBUTE]'", "TITLE_IX_CASE_ID": f"'TIX-' || {number(2020, 2025, 0)} || '-' || {number(1000, 9999, 1)}",
        "IRB_PROTOCOL": f"'IRB-' || {number(2020, 2025, 0)} || '-' || {number(100, 999, 1)}",
        "FINANCIAL_AID_AWARD": f"'Pell Grant $' || {number(1, 9, 0)} || ',' || {number(0, 9, 1)} || '00.00'",
        "STUDENT_ACCOUNT_ID": f"'TN-' || {number(10**8, 10**9 - 1, 0)}",
        "LICENSE_PLATE": " || ".join(word(list(pools.PLATE_LETTERS), k) for k in range(3)) + f" || ' ' || {number(1000, 9999, 3)}",
    }
    whens = " ".join(f"WHEN {s(e)} THEN {x}" for e, x in text.items())
    return f"(CASE entity_type {whens} ELSE '[' || entity_type || ']' END)"


def token(mode: str, redact_with: str = "", **how) -> str:
    if mode == "mask":
        return MASK
    if mode == "redact":
        return s(redact_with)
    return stand_in(seed(how.pop("salt", ""), how.pop("secret", "")), **how)


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


ACTION = {"mask": "masked", "redact": "redacted", "pseudonymize": "pseudonymized", "exclude": "excluded"}


def policy(name: str) -> str:
    """CTE po(id, text, passed, action_taken, blocked_entities, hit_count, risk_level, warned, sanitized_text)."""
    p = POLICIES[name]
    blocked = f"list_contains({names(p.block)}, entity_type)"
    return f"""rel AS (SELECT * FROM hits WHERE NOT list_contains({names(p.pass_through)}, entity_type)),
{kept('rel', 'keptp')},
{rendered(token(p.mode), 'keptp', 'outp') if p.mode != 'exclude' else 'outp AS (SELECT id, text AS sanitized_text FROM src)'},
pv AS (SELECT id, count(*) AS n, max({rank('entity_type')}) AS rk, {types(f'WHERE {blocked}')} AS bt, {types('WHERE true')} AS ty FROM rel GROUP BY id),
pd AS (SELECT s.id, s.text, coalesce(n, 0)::INT AS n, coalesce(rk, 0) AS rk, coalesce(bt, '') AS bt, coalesce(ty, '') AS ty,
    coalesce(n, 0) > 0 AND (bt <> '' OR {str(p.exclude_any).lower()}) AS no FROM src s LEFT JOIN pv USING (id)),
po AS (SELECT d.id, d.text, NOT no AS passed, CASE WHEN n = 0 THEN 'none' WHEN no THEN 'excluded' ELSE {s(ACTION[p.mode])} END AS action_taken,
    CASE WHEN NOT no THEN '' WHEN bt <> '' THEN bt ELSE ty END AS blocked_entities, n AS hit_count, {tier('rk')} AS risk_level,
    n > 0 AND rk >= {TIERS.index(p.warn_at)} AS warned, CASE WHEN no THEN NULL WHEN n = 0 THEN d.text ELSE o.sanitized_text END AS sanitized_text
    FROM pd d JOIN outp o USING (id))"""
