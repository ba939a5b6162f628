"""Queries on VARIANT values, dictionaries, models, text without blanks, piles of hits, counters and exactly-once sinks."""

from __future__ import annotations

import re

from pyspark.sql import Observation
from pyspark.sql import functions as F

from veilframe.functions import rewrite
from veilframe.functions.core import column
from veilframe.functions.sqlnames import register_functions
from veilframe.operators import audit, dictionary, models, records, sanitize, scan
from veilframe.sources import readers, writers
from veilframe.sources.layout import spread
from veilframe.streaming import jobs

from . import oracle as o
from .queries import _CLOSED, _LOG, _MASKED, _STATS, _TERM_HITS, BOOK, HIT_COLUMNS, TIERS, _dictionary, _stream, joined, register, scratch, source, utc_text
from .views import NOTES, duck_source

# --- VARIANT ------------------------------------------------------------------------------------

_RING = "concat('ring (402) 555-01', lpad(cast(user_id % 100 AS string), 2, '0'))"


def _event_variants(spark, sf):
    """Two variants an event: one parsed from JSON around its props, one of typed leaves that JSON lacks."""
    df = spread(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "props"))
    return df.selectExpr("event_id", f"""parse_json(concat('{{"k": ', get_json_object(props, '$.k'), ', "who": {{"mail": "mail user', user_id,
        '@example.com", "tags": ["plain", "', {_RING}, '"], "n": null}}}}')) AS props""",
        "array(to_variant_object(named_struct('day', date_add(DATE'2024-01-01', cast(event_id % 300 AS int)), 'note', concat('mail user', user_id, '@example.com'), "
        "'raw', cast('a@b.org' AS binary), 'part', cast(event_id AS float)))) AS typed")


def _sanitize_variant(spark, sf):
    done = records.sanitize_nested(_event_variants(spark, sf))
    return done.selectExpr("event_id", "to_json(props) AS props", "schema_of_variant(typed[0]) AS kinds", "variant_get(typed[0], '$.note', 'string') AS note",
                           "cast(variant_get(typed[0], '$.day', 'date') AS string) AS day", "variant_get(typed[0], '$.part', 'double') AS part")


register("sanitize_variant", _sanitize_variant, """SELECT event_id, '{"k":' || (props->>'$.k') || ',"who":{"mail":"mail [EMAIL_ADDRESS]","n":null,"tags":["plain","ring [PHONE_NUMBER]"]}}' AS props,
    'OBJECT<day: DATE, note: STRING, part: FLOAT, raw: BINARY>' AS kinds, 'mail [EMAIL_ADDRESS]' AS note,
    (DATE '2024-01-01' + (event_id % 300)::INT)::VARCHAR AS day, event_id::FLOAT::DOUBLE AS part FROM events""")

_EVENT_TEXT = """CASE event_id % 4 WHEN 0 THEN concat('SSN ', cast(100 + user_id % 500 AS {s}), '-45-', lpad(cast(1 + event_id % 9999 AS {s}), 4, '0'))
    WHEN 1 THEN concat('mail user', cast(user_id AS {s}), '@example.com') WHEN 2 THEN 'due 2021-03-04' ELSE cast(props AS {s}) END"""


def _variant_policy(spark, sf):
    """A blocked string becomes null in its place, at whatever depth; the report names its path."""
    df = spread(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "props")).selectExpr(
        "event_id", f"parse_json(to_json(array(named_struct('t', {_EVENT_TEXT.format(s='string')}, 'n', event_id)))) AS doc")
    done = records.sanitize_nested(df, policy="ai_prompt", report=True)
    return done.select("event_id", column("variant_get(doc, '$[0].t', 'string')").alias("text"), column("variant_get(doc, '$[0].n', 'bigint')").alias("n"),
                       joined("excluded_fields"), "hit_count", "risk_level", "excluded")


register("variant_policy", _variant_policy, o.with_(o.hits(f"SELECT event_id AS id, {_EVENT_TEXT.format(s='VARCHAR')} AS text FROM events"), o.policy("ai_prompt")) +
         """SELECT id AS event_id, sanitized_text AS text, id AS n, CASE WHEN passed THEN '' ELSE 'doc.t' END AS excluded_fields, hit_count, risk_level,
    NOT passed AS excluded FROM po""")

# --- dictionaries and models --------------------------------------------------------------------


def _repeated_keys(spark, sf):
    """Rows that share a key, or have none, keep their own hits."""
    text, terms = _dictionary(spark, sf, "PERSON")
    text = text.withColumn("id", F.when(F.col("id") % 7 != 0, F.col("id") % 10))
    found = dictionary.with_terms(text, terms, book=BOOK.only(["US_SSN"]))
    return found.select("id", column(rewrite.sanitize_sql("text", "hits", "mask")).alias("sanitized_text"))


register("mask_with_dictionary_repeated_keys", _repeated_keys, f"""WITH RECURSIVE {_TERM_HITS}, src AS (SELECT id, text FROM t),
hits AS (SELECT id, text, 'PERSON' AS entity_type, hit_start, hit_end, 0.6::DOUBLE AS score, substring(text, hit_start + 1, hit_end - hit_start) AS v FROM th JOIN t USING (id)),
{o.kept()}, {o.rendered(o.MASK)} SELECT CASE WHEN id % 7 <> 0 THEN id % 10 END AS id, sanitized_text FROM out""")


def _benchmark_terms(spark, sf):
    """The first word, and the first two, of every benchmark item: frequent words among them."""
    words = F.regexp_extract_all("text", F.lit(dictionary.WORDS), F.lit(0))
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").select(words.alias("ws")).where(F.size("ws") > 1)
    return rows.select(F.upper(F.col("ws")[0]).alias("term"), F.lit("NRP").alias("entity_type")).unionByName(
        rows.select(F.array_join(F.slice("ws", 1, 2), "-").alias("term"), F.lit("LOCATION").alias("entity_type")))


_DOCUMENT_TERMS = r"""b AS (SELECT regexp_extract_all(text, '[\p{L}\p{N}]+') AS ws FROM benchmark),
d AS (SELECT DISTINCT lower(ws[1]) AS run, 'NRP' AS entity_type FROM b WHERE len(ws) > 1 UNION ALL SELECT DISTINCT lower(ws[1]) || ' ' || lower(ws[2]), 'LOCATION' FROM b WHERE len(ws) > 1),
w AS (SELECT doc_id AS id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS ws, string_split_regex(text, '[\p{L}\p{N}]+') AS gs FROM documents),
k AS (SELECT id, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS g, generate_subscripts(ws, 1) AS k FROM w),
p AS (SELECT id, k, lower(w) AS w, (sum(length(g) + length(w)) OVER (PARTITION BY id ORDER BY k))::INT AS en, length(w)::INT AS n, lead(lower(w)) OVER (PARTITION BY id ORDER BY k) AS w2,
    (lead(length(g) + length(w)) OVER (PARTITION BY id ORDER BY k))::INT AS more FROM k),
r AS (SELECT id, en - n AS hit_start, en AS hit_end, w AS run FROM p UNION ALL SELECT id, en - n, en + more, w || ' ' || w2 FROM p WHERE w2 IS NOT NULL)
SELECT id, entity_type, hit_start, hit_end FROM r JOIN d USING (run)"""


def _documents_looked_up(held_bytes):
    def run(spark, sf):
        found = dictionary.term_hits(source(spark, sf, "documents"), ["id"], "text", _benchmark_terms(spark, sf), held_bytes=held_bytes)
        return found.select("id", "entity_type", "hit_start", "hit_end")
    return run


register("dictionary_documents", _documents_looked_up(dictionary.HELD_BYTES), "WITH " + _DOCUMENT_TERMS)
register("dictionary_documents_joined", _documents_looked_up(0), "WITH " + _DOCUMENT_TERMS)

_CODES = r"\bqu[a-z]{2,}|[0-9]{3,}x"


def _load_codes():
    """A stand-in for a name model: it marks words that begin with qu."""
    pattern = re.compile(_CODES, re.IGNORECASE | re.ASCII)
    return lambda texts: [[(m.start(), m.end(), "CODE_NAME", 0.8) for m in pattern.finditer(t)] for t in texts]


def _with_model(spark, sf):
    few = BOOK.only(["EMAIL_ADDRESS", "PHONE_NUMBER"])
    found = scan.hits_table(source(spark, sf, "documents"), ["id"], book=few, extra_hits=models.model_hits("text", _load_codes))
    return found.select("id", "entity_type", "hit_start", "hit_end", "score")


register("detect_with_model", _with_model, o.with_(o.hits(duck_source("documents"), BOOK.only(["EMAIL_ADDRESS", "PHONE_NUMBER"]).plus(
    "CODE_NAME", [("code", _CODES, 0.8)]))) + f"SELECT {HIT_COLUMNS} FROM hits")


def _table_function(spark, sf):
    register_functions(spark)
    source(spark, sf, "notes").createOrReplaceTempView("veil_rows")
    return spark.sql("SELECT id, h.entity_type, h.hit_start, h.hit_end, h.score FROM veil_rows, LATERAL pii_hit_rows(text) h")


register("sql_udtf", _table_function, o.with_(o.hits(duck_source("notes"))) + f"SELECT {HIT_COLUMNS} FROM hits")

# --- context and overlaps where texts are unusual -------------------------------------------------

# Words of the context far before the hit, in the same endless word; split by long runs of marks; as a part of another
# word; cut by the hit; and outside of the last five words.
_NO_BLANKS = """CASE c_custkey % 7 WHEN 0 THEN concat('ssn', repeat('/x', 150 + cast(c_custkey % 40 AS {i})), '/123456789,', repeat('1234567.', 20), '123456788')
    WHEN 1 THEN concat(repeat('(', 250), 'passport(number)', repeat('=', 220), cast(100000000 + c_custkey AS {s}))
    WHEN 2 THEN concat('social', repeat('-', 300), 'security;', repeat('ab;', 80), '123456789')
    WHEN 3 THEN concat(repeat('ab;', 100), 'assn:', repeat('ssnx;', 50), '123456789')
    WHEN 4 THEN concat(repeat('y', 300), '-ssn123456789')
    WHEN 5 THEN concat('ssn ', repeat('b', 100), ' c ', repeat('d,', 60), ' e ', repeat('f', 90), ' 123456789 ', repeat('g', 200), ' 123456789')
    ELSE concat('student,id:', repeat(concat(cast(1000000 + c_custkey AS {s}), ';'), 60)) END"""


def _no_blanks(spark, sf):
    df = spread(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey"), rows=10_000).selectExpr("c_custkey AS id", f"{_NO_BLANKS.format(i='int', s='string')} AS text")
    return scan.hits_table(df, ["id"], book=BOOK.at(0.35)).select("id", "entity_type", "hit_start", "hit_end", "score")


register("context_without_blanks", _no_blanks, o.with_(o.hits(
    f"SELECT c_custkey AS id, {_NO_BLANKS.format(i='BIGINT', s='VARCHAR')} AS text FROM customer", BOOK.at(0.35))) + f"SELECT {HIT_COLUMNS} FROM hits")

# One address over a hundred hits: mails, hosts and days that lie in it, and each in the next.
_PILE = """concat('see https://host', cast(c_custkey AS {s}), '.example.com/?', repeat(concat('m=u', cast(c_custkey AS {s}), '@example.com&ip=10.0.0.', cast(c_custkey % 250 AS {s}),
    '&day=2021-03-04&t=10:15&'), 20), ' end')"""


def _pile(spark, sf):
    df = spread(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey"), rows=2000).selectExpr("c_custkey AS id", f"{_PILE.format(s='string')} AS text")
    return sanitize.resolved_hits(df, ["id"])


register("resolve_pile", _pile, o.with_(o.hits(f"SELECT c_custkey AS id, {_PILE.format(s='VARCHAR')} AS text FROM customer"), o.kept()) +
         f"SELECT {HIT_COLUMNS} FROM kept")

# --- large array files ----------------------------------------------------------------------------


def _array_pieces(spark, sf):
    """Eight files, each one array of a table's rows, cut at commas and put together again."""
    path = scratch(spark)
    rows = source(spark, sf, "notes").where("text IS NOT NULL").select(F.to_json(F.struct("id", "text", F.array("text", F.col("id").cast("string")).alias("more"))).alias("j"), (F.col("id") % 8).alias("f"))
    rows.groupBy("f").agg(F.concat(F.lit("[ "), F.array_join(F.collect_list("j"), " ,\n"), F.lit(", null, 7]")).alias("value")).select("value").write.option(
        "maxRecordsPerFile", 1).text(path)
    good, bad = readers.split_rejects(readers.read_json_array(spark, path, "id bigint, text string", whole_bytes=0))
    return sanitize.sanitize(good).select("id", F.col("sanitized_text").alias("text")).unionByName(
        bad.groupBy(F.col("_corrupt_record").alias("text")).agg(F.count(F.lit(1)).alias("id")))


register("read_json_array_pieces", _array_pieces, _MASKED + """SELECT id, sanitized_text AS text FROM out WHERE sanitized_text IS NOT NULL
    UNION ALL SELECT count(DISTINCT c_custkey % 8), unnest(['null', '7']) FROM customer""")

# --- counters, sinks and doubles ------------------------------------------------------------------


def _audit_observed(spark, sf):
    """The event comes from the counters of the write."""
    seen = Observation("audit")
    result = audit.observed(sanitize.sanitize(source(spark, sf, "notes"), mode="exclude"), seen)
    writers.write_result(result, scratch(spark))
    return audit.observed_event(spark, seen, endpoint="/x", action="exclude", mode="exclude").select(
        "batch_size", "hit_count", "excluded_count", joined("entity_types"), "risk_level", "mode")


register("audit_observed", _audit_observed, o.with_(o.hits(duck_source("notes")), o.SUMMARY) + f"""SELECT count(*) AS batch_size, sum(hit_count)::BIGINT AS hit_count,
    count(*) FILTER (WHERE pii_found) AS excluded_count, (SELECT coalesce(string_agg(DISTINCT entity_type, ',' ORDER BY entity_type), '') FROM hits) AS entity_types,
    {o.tier('max(rk)')} AS risk_level, 'exclude' AS mode FROM scan""")


def _stream_upsert(spark, sf):
    root = scratch(spark)
    texts = _stream(spark, sf, "customer").selectExpr("c_custkey AS id", f"{NOTES} AS text")
    jobs.upsert_to_table(texts, f"{root}/out", f"{root}/state", lambda batch: sanitize.sanitize(batch).select("id", "sanitized_text"))
    return jobs.read_ledgered(spark, f"{root}/out").select("id", "sanitized_text")


register("stream_upsert", _stream_upsert, _MASKED + "SELECT id, sanitized_text FROM out")


def _stream_doubles(spark, sf):
    """Every event is delivered twice, a third of them in another order."""
    root = scratch(spark)
    log = spark.read.parquet(f"{sf}/events.parquet").selectExpr(*_LOG, "cast(event_id AS string) AS request_id")
    log.unionByName(log.where("hash(request_id) % 3 = 0")).unionByName(log.where("hash(request_id) % 3 <> 0")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{root}/in")
    jobs.run_to_table(jobs.windowed_stats(stream, window="1 day", distinct="request_id"), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").select(utc_text("window_start", "yyyy-MM-dd HH:mm"), "total_requests", "total_pii_hits", "total_excluded", "total_clean")


register("stream_stats_distinct", _stream_doubles, f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS window_start, {_STATS}
    FROM events GROUP BY date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED}""")
