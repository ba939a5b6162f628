"""VARIANT values, dictionaries, models, context and overlaps in unusual texts, counters and exactly-once sinks."""

import json
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import VariantVal

from veilframe.catalog.rules import RuleBook, default_book
from veilframe.functions import overlap, variants
from veilframe.functions.core import HITS_TYPE, column
from veilframe.functions.variants import replaced, strings
from veilframe.operators import audit, dictionary, models, records, scan
from veilframe.operators.sanitize import sanitize
from veilframe.streaming import jobs

SSN = "SSN 123-45-6789"

# --- VARIANT ------------------------------------------------------------------------------------


def test_no_string_of_a_variant_stays_in_clear(spark):
    df = spark.sql(f"""select 1 as id, parse_json('{{"n":"{SSN}","a":[1,"a@b.org",{{"deep":[["c@d.org"]]}},null,true,1.50],"k@b.org":2}}') as v""")
    r = records.sanitize_nested(df, report=True).selectExpr("to_json(v) as v", "*").first()
    assert json.loads(r[0]) == {"n": "SSN [US_SSN]", "a": [1, "[EMAIL_ADDRESS]", {"deep": [["[EMAIL_ADDRESS]"]]}, None, True, 1.5], "k@b.org": 2}
    assert r.has_pii and r.hit_count == 3 and [(f.field, f.hit_count) for f in r.field_hits] == [("v.a", 1), ("v.a.deep", 1), ("v.n", 1)]
    r = records.sanitize_nested(df, policy="ai_prompt", skip=["US_SSN"], report=True).selectExpr("to_json(v) as v", "*").first()
    assert json.loads(r[0])["n"] is None and "v.n" in r.excluded_fields
    r = records.sanitize_nested(df, mode="exclude", report=True).selectExpr("to_json(v) as v", "*").first()
    assert json.loads(r[0])["a"] == [1, None, {"deep": [[None]]}, None, True, 1.5] and r.excluded


def test_variants_at_any_depth_of_a_row(spark):
    df = spark.sql(f"""select named_struct('list', array(named_struct('v', parse_json('"{SSN}"'), 't', 'a@b.org'), null,
        named_struct('v', cast(null as variant), 't', 'plain')), 'm', map('x', parse_json('{{"q":"c@d.org"}}'), 'y', parse_json('7'))) as doc,
        parse_json('["{SSN}", "plain"]') as w, 'e@f.org' as s""")
    r = records.sanitize_nested(df).selectExpr("to_json(doc.list[0].v) as a", "doc.list[0].t as b", "doc.list[1] as c", "doc.list[2].v is null as d",
                                               "to_json(doc.m['x']) as e", "to_json(doc.m['y']) as f", "to_json(w) as g", "s").first()
    assert tuple(r) == ('"SSN [US_SSN]"', "[EMAIL_ADDRESS]", None, True, '{"q":"[EMAIL_ADDRESS]"}', "7", '["SSN [US_SSN]","plain"]', "[EMAIL_ADDRESS]")


def test_variant_types_stay(spark):
    df = spark.sql("""select to_variant_object(named_struct('d', date'2024-01-02', 't', timestamp'2024-01-02 03:04:05', 'b', cast('a@b.org' as binary),
        'f', cast(1.5 as float), 'e', 1e3D, 'n', 1.50BD, 'l', 3L, 's', 'a@b.org', 'z', cast(null as string), 'o', array('x', 'c@d.org'))) as v""")
    done = records.sanitize_nested(df)
    assert done.selectExpr("schema_of_variant(v)").first()[0] == df.selectExpr("schema_of_variant(v)").first()[0]
    before, after = (x.select("v").first()[0].toPython() for x in (df, done))
    assert after == {**before, "s": "[EMAIL_ADDRESS]", "o": ["x", "[EMAIL_ADDRESS]"]}
    assert [r.v.value for r in records.sanitize_nested(df.where("false")).collect()] == []


def test_variant_encoding():
    rng = random.Random(3)

    def made(depth):
        pick = rng.random()
        if depth and pick < .4:
            return {f"k{rng.randrange(400)}": made(depth - 1) for _ in range(rng.choice([0, 3, 300 if depth == 3 else 2]))}
        if depth and pick < .7:
            return [made(depth - 1) for _ in range(rng.choice([0, 2, 300 if depth == 3 else 1]))]
        return rng.choice([None, True, 7, -1.25, "", "é" * rng.choice([1, 31, 32, 200]), "x" * rng.choice([63, 64, 70_000])])

    def changed(x):
        if isinstance(x, dict):
            return {k: changed(v) for k, v in x.items()}
        return [changed(v) for v in x] if isinstance(x, list) else new(x) if isinstance(x, str) else x

    def new(t):
        return None if len(t) == 31 else t[::-1] + "!" * (len(t) % 90)

    for doc in [*(made(3) for _ in range(60)), "top", {}, [], json.loads("[" * 200 + '"deep"' + "]" * 200)]:
        v = VariantVal.parseJson(json.dumps(doc))
        told = strings(v.value, v.metadata)
        assert VariantVal(replaced(v.value, [s["text"] for s in told]), v.metadata).toPython() == v.toPython()
        assert VariantVal(replaced(v.value, [new(s["text"]) for s in told]), v.metadata).toPython() == changed(v.toPython())
    with pytest.raises(ValueError):
        strings(bytes([31 << 2]), b"\x01\x00\x00")


@pytest.mark.parametrize("block", [1, 200, 1 << 22])
def test_variants_of_a_batch_are_walked_together(monkeypatch, block):
    """However the values are cut into blocks, a batch gives what its values give one by one."""
    monkeypatch.setattr(variants, "BLOCK", block)
    docs = [VariantVal.parseJson(d) for d in ('{"b":["x",{"a":"é"}],"a":"y"}', "7", '"top"', "[]", '["' + "z" * 300 + '",null,"w"]', '{"n":{"b":"q"}}')]
    value, metadata = (pa.array([b"cut off", *(getattr(d, k) for d in docs)], pa.binary())[1:] for k in ("value", "metadata"))
    there = np.array([True, True, True, True, True, False])
    counts, paths, texts = variants.strings_of(value, metadata, there)
    told = [strings(d.value, d.metadata) if t else [] for d, t in zip(docs, there)]
    assert counts.tolist() == [3, 0, 1, 0, 2, 0] == [len(t) for t in told]
    assert list(zip(paths.to_pylist(), texts.to_pylist())) == [(s["path"], s["text"]) for t in told for s in t]
    assert paths.to_pylist()[:3] == ["a", "b", "b.a"] and variants.strings_of(value, metadata, there, False)[1].null_count == 6
    new = [["1", None, "2" * 70], [], ["é"], [], ["", "3" * 64], []]
    rows = np.array([0, 2, 4])
    got = variants.replaced_in(value, rows, pa.array([t for k in rows for t in new[k]], pa.string()))
    assert got.to_pylist() == [replaced(docs[k].value, new[k]) for k in rows]
    assert VariantVal(got[0].as_py(), docs[0].metadata).toPython() == {"a": "1", "b": [None, {"a": "2" * 70}]}
    with pytest.raises(ValueError, match="not as many"):
        variants.replaced_in(value, rows, pa.array(["1"] * 7))
    with pytest.raises(ValueError, match="malformed"):
        strings(docs[0].value[:-2], docs[0].metadata)


def test_rows_without_hits_keep_their_variants(spark):
    """Rows with hits and without, null rows and null variants in one batch; repeated strings in one variant."""
    df = spark.sql("""select * from values (1, '{"a":"a@b.org","b":["a@b.org","plain"]}'), (2, '{"a":"plain"}'), (3, cast(null as string)), (4, '"c@d.org"'), (5, '5') as t(id, j)""")
    done = records.sanitize_nested(df.coalesce(1).selectExpr("id", "case when id <> 2 then array(parse_json(j), null) when j is not null then array(parse_json(j)) end as v",
                                                             "case when id <> 5 then parse_json(j) end as w"))
    rows = done.selectExpr("id", "to_json(w) w", "to_json(v[0]) a", "size(v) n", "get(v, 1) is null as e").orderBy("id").collect()
    masked = '{"a":"[EMAIL_ADDRESS]","b":["[EMAIL_ADDRESS]","plain"]}'
    assert [(r.w, r.a, r.n, r.e) for r in rows] == [(masked, masked, 2, True), ('{"a":"plain"}', '{"a":"plain"}', 1, True), (None, None, 2, True),
                                                    ('"[EMAIL_ADDRESS]"', '"[EMAIL_ADDRESS]"', 2, True), (None, "5", 2, True)]


def test_fields_that_hide_text_are_refused(spark):
    df = spark.sql("select parse_json('\"a@b.org\"') as v, named_struct('t', 'a@b.org') as s, 5 as n")
    for field in ("v", "s"):
        with pytest.raises(ValueError, match="at depth"):
            records.sanitize_record(df, [field])
    assert records.sanitize_record(df, ["n"]).first().n == 5
    assert {f.field: f.skipped for f in records.scan_record(df).first().field_report} == {"v": True, "s": True, "n": True}


# --- dictionaries and models --------------------------------------------------------------------


def test_dictionary_hits_belong_to_their_row(spark):
    df = spark.createDataFrame([(1, "nothing here"), (1, "Ada sings"), (None, "for ada"), (None, None), (1, "")], "id int, text string")
    terms = spark.createDataFrame([("ADA", "PERSON"), ("sings", "PERSON"), (" ", "PERSON"), (None, "PERSON"), ("here", None)], "term string, entity_type string")
    for held in (1 << 20, 0):
        found = dictionary.with_terms(df, terms, book=default_book().only(["US_SSN"]), held_bytes=held)
        masked = found.select("text", "hits").collect()
        assert sorted((r.text or "", [(h.start, h.end) for h in r.hits]) for r in masked) == [("", []), ("", []), ("Ada sings", [(0, 3), (4, 9)]), ("for ada", [(4, 7)]), ("nothing here", [])]


def test_both_dictionaries_agree(spark):
    rng = random.Random(1)
    words = ["New", "haven", "é", "Straße", "日本", "a1", "x_y", "İ", "ada", "the"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", "--", "'s"]) for _ in range(rng.choice([0, 1, 9, 60]))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate([*texts, *texts[:9], None])), "id int, text string")
    terms = spark.createDataFrame([(t, k) for t in ("new haven", "haven", "NEW", "the é the", "straße", "日本", "x y", "y", "ada ada") for k in ("PERSON", "LOCATION")], "term string, entity_type string")
    got = [sorted(map(tuple, dictionary.term_hits(df, ["id"], "text", terms, held_bytes=held).collect())) for held in (1 << 20, 0)]
    assert got[0] == got[1] and len(got[0]) > 100
    assert not {r[2:4] for r in dictionary.term_hits(df, ["id"], "text", terms, longest=1).collect()} - {r[2:4] for r in got[0]}


def test_joined_dictionary_of_a_long_text(spark):
    """No row of a word carries the text: 40,000 copies of it would not fit in any executor."""
    text = " ".join(f"w{k % 977} ada, lee" for k in range(14000))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    terms = spark.createDataFrame([("ada lee", "PERSON"), ("w5 ada lee w6 ada", "PERSON"), ("LEE", "LOCATION")], "term string, entity_type string")
    got = [sorted(map(tuple, dictionary.term_hits(df, ["id"], "text", terms, held_bytes=held).collect())) for held in (1 << 20, 0)]
    assert got[0] == got[1] and len(got[0]) == 28000 + 15


def test_terms_in_capitals_match_sharp_s(spark):
    df = spark.createDataFrame([(1, "Erßie und Strasse, 3 \u212a")], "id int, text string")
    terms = spark.createDataFrame([("ERSSIE", "PERSON"), ("straße", "LOCATION"), ("k", "NRP")], "term string, entity_type string")
    for held in (1 << 20, 0):
        assert sorted(r[1:4] for r in dictionary.term_hits(df, ["id"], "text", terms, held_bytes=held).collect()) == [("LOCATION", 10, 17), ("NRP", 21, 22), ("PERSON", 0, 5)]


def test_texts_made_by_expressions(spark):
    """A text may come from nested expressions, and variants from nested arrays: the Python functions stay in the plan."""
    made = "array_join(transform(array('Ada', 'b'), x -> array_join(transform(array(' sings'), y -> concat(x, y)), '')), ' ')"
    df = spark.range(1).repartition(1).selectExpr(f"{made} as text")
    terms = spark.createDataFrame([("ADA", "PERSON")], "term string, entity_type string")
    assert [(h.start, h.end) for h in dictionary.with_terms(df, terms).first().hits] == [(0, 3)]
    assert sanitize(df, extra_hits=models.model_hits("text", lambda: lambda part: [[(0, 3, "PERSON", .9)] for _ in part])).first().sanitized_text == "[PERSON] sings b sings"
    deep = spark.range(1).repartition(1).selectExpr("array(array(parse_json('\"a@b.org\"')), array(parse_json('1'), parse_json('[\"c@d.org\"]'))) as v")
    assert records.sanitize_nested(deep).selectExpr("to_json(v[0][0]) a", "to_json(v[1][0]) b", "to_json(v[1][1]) c").first() == ('"[EMAIL_ADDRESS]"', "1", '["[EMAIL_ADDRESS]"]')


def test_small_dictionary_shuffles_no_text(spark, texts):
    terms = spark.createDataFrame([("ada", "PERSON")], "term string, entity_type string")
    plan = dictionary.with_terms(texts(["Ada"]), terms)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_model_is_loaded_once_per_task(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return lambda part: [[(i, i + 3, "PERSON", 0.9) for i in range(len(t)) if t.startswith("Ada", i)] for t in part]

    df = spark.range(0, 40_000, 1, 3).selectExpr("id", "case when id % 4 = 0 then null else concat('so Ada and ', id, ' a@b.org') end as text")
    found = sanitize(df, extra_hits=models.model_hits("text", load, batch=7)).groupBy("sanitized_text").count().collect()
    assert sum(r["count"] for r in found if r.sanitized_text and r.sanitized_text.startswith("so [PERSON] and ") and r.sanitized_text.endswith(" [EMAIL_ADDRESS]")) == 30_000
    assert len(list(tmp_path.iterdir())) == 3
    for bad in ([(0, 99, "PERSON", 1.0)], [(2, 2, "PERSON", 1.0)]):
        with pytest.raises(Exception, match="outside"):
            scan.with_hits(spark.sql("select 'abc' as text"), extra_hits=models.model_hits("text", lambda bad=bad: lambda part: [bad for _ in part])).collect()


# --- context and overlaps -------------------------------------------------------------------------


def test_context_does_not_depend_on_how_it_is_found(spark):
    """Looking at 200 characters first, or at one only and then into the index, gives the same scores."""
    rng = random.Random(4)
    bits = ["ssn", "SSN", "social", "security", "passport", "number", "student", "id", "#", "_", "bank", "account", "x", "y" * 40, "é", "ſ", "123456789", "1234567", "A1234567",
            "100000001", "1234567890", "12345678901"]
    gaps = ["", " ", "  ", "\n", ",", "-", ";", ".", "/", " - ", "-" * 30, " "]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(gaps if i % 2 else gaps[4:9]) for _ in range(rng.choice([5, 40, 200])))) for i in range(250)]
    df = spark.createDataFrame(rows, "id int, text string")
    one = scan.hits_table(df, ["id"], book=RuleBook(context_look=1).at(0.3))
    two = scan.hits_table(df, ["id"], book=RuleBook(context_look=10_000).at(0.3))
    a, b = (sorted(map(tuple, x.collect())) for x in (one, two))
    assert a == b and len(a) > 500 and len({r[4] for r in a}) > 4


def test_context_of_text_without_blanks_is_found_in_time(spark):
    text = "ssn," + ("123456789," + "abcdefghi," * 4) * 2000
    df = spark.createDataFrame([(1, text)], "id int, text string")
    book = default_book().only(["US_SSN"])
    scan.scan(df.limit(0), book=book).collect()
    start = time.time()
    assert scan.scan(df, book=book).first().hit_count == 2000
    assert time.time() - start < 15


def _hits(spark, rows):
    frame = spark.createDataFrame([(i, [(s, e, t, float(x), p) for s, e, t, x, p in hits]) for i, hits in enumerate(rows)],
                                  "id int, hits array<struct<start:int,end:int,entity_type:string,score:double,pattern_id:int>>")
    return frame.withColumn("hits", F.sort_array("hits"))


def test_sweeps_equal_pairs(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for n in (1, 2, 5, 30, 90) * 8:
        hits = {}
        for p in range(n):
            s = rng.randrange(60)
            hits[s, p] = (s, s + rng.choice([1, 2, 5, 40]), rng.choice("AB"), rng.choice([.3, .5, .85, rng.random()]), p)
        rows.append(list(hits.values()))
    df = _hits(spark, rows)
    got = []
    for limit in (10_000, 0):
        monkeypatch.setattr(overlap, "PAIRWISE", limit)
        got.append([(r.a, r.b) for r in df.orderBy("id").select(column(overlap.drop_contained("hits")).alias("a"), column(overlap.resolve_overlaps("hits")).alias("b")).collect()])
    assert got[0] == got[1]
    assert any(len(a) < len(r) for (a, _), r in zip(got[0], rows))


def test_pile_of_hits_is_resolved_in_time(spark):
    """An address around 20,000 hits, and a chain in which each hit touches the next."""
    inside = [(0, 200_000, "URL", .6, 0)] + [(10 * k, 10 * k + 8, "EMAIL_ADDRESS", .85 if k % 2 else .5, 1) for k in range(20_000)]
    chain = [(10 * k, 10 * k + 15, "A" if k % 3 else "B", .5 + (k % 7) / 100, 2) for k in range(20_000)]
    df = _hits(spark, [inside, chain]).repartition(2)
    start = time.time()
    rows = df.select("id", column(f"size({overlap.drop_contained('hits')})").alias("a"), column(overlap.resolve_overlaps("hits")).alias("b")).collect()
    assert time.time() - start < 60
    kept = {r.id: r for r in rows}
    assert kept[0].a == 20_001 and sum(h.entity_type == "EMAIL_ADDRESS" for h in kept[0].b) == 20_000
    ends = [(h.start, h.end) for h in kept[1].b]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:])) and len(ends) > 6_000


# --- counters, sinks and doubles ------------------------------------------------------------------


def test_observed_counters_equal_the_event(spark, texts, tmp_path):
    result = sanitize(texts([SSN, "clean", "a@b.org", None]), mode="exclude")
    want = audit.audit_events(result, endpoint="/x", action="a", request_id="r").first()
    seen = Observation()
    watched = audit.observed(result, seen)
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    assert watched._jdf.queryExecution().optimizedPlan().toString().count(r"(?iU)\bHS[-_]\d{4}[-_]\d{3,6}\b, 0)") == 1
    watched.write.parquet(str(tmp_path / "out"))
    got = audit.observed_event(spark, seen, endpoint="/x", action="a", request_id="r")
    assert got.columns == audit.EVENT_COLUMNS and got.first() == want
    seen = Observation()
    audit.observed(result.where("false"), seen).write.parquet(str(tmp_path / "none"))
    none = audit.observed_event(spark, seen, endpoint="/x", action="a").first()
    assert (none.batch_size, none.hit_count, none.excluded_count, none.entity_types, none.risk_level) == (0, 0, 0, [], "LOW")


def test_a_replayed_batch_changes_nothing(spark, texts, tmp_path):
    path = str(tmp_path / "t")
    batch = texts([SSN, "clean"])
    assert jobs.write_batch(batch, 0, path, sanitize) and not jobs.write_batch(batch, 0, path, sanitize)
    # a batch that died after its data and before its ledger entry does not count, and is written anew
    sanitize(batch).write.parquet(f"{path}/data/batch=1")
    assert jobs.read_ledgered(spark, path).count() == 2
    assert jobs.write_batch(batch, 1, path, sanitize)
    assert sorted(r.batch for r in jobs.read_ledgered(spark, path).collect()) == [0, 0, 1, 1]


def test_doubles_count_once(spark, tmp_path):
    rows = [(f"r{k % 50}", 60 * (k % 50), k % 50 % 3) for k in range(150)]
    log = spark.createDataFrame(rows, "request_id string, s int, hit_count int").selectExpr("request_id", "timestamp_seconds(1704067200 + s) as ts", "cast(hit_count as bigint) hit_count",
                                                                                           "0L as excluded_count", "1L as batch_size")
    assert jobs.distinct_events(log).count() == 50
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    jobs.run_to_table(jobs.distinct_events(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_table_function(spark, texts):
    from veilframe.functions.sqlnames import register_functions
    register_functions(spark)
    texts([f"{SSN} a@b.org", "clean", None]).createOrReplaceTempView("some_texts")
    rows = spark.sql("select id, h.* from some_texts, lateral pii_hit_rows(text) h order by hit_start").collect()
    assert [(r.id, r.entity_type, r.hit_start, r.risk_level) for r in rows] == [(0, "US_SSN", 4, "CRITICAL"), (0, "EMAIL_ADDRESS", 16, "HIGH")]


def test_merged_hits_hold_no_hit_twice(texts):
    own = column(f"cast(array(named_struct('start', 0, 'end', 3, 'entity_type', 'PERSON', 'score', 0.9D, 'pattern_id', -1), "
                 f"named_struct('start', 0, 'end', 3, 'entity_type', 'PERSON', 'score', 0.9D, 'pattern_id', -1)) as {HITS_TYPE})")
    assert scan.scan(texts(["Bob"]), extra_hits=own).first().hit_count == 1
