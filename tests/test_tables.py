"""Records, reports, audit, files and streams."""

import json

import pytest

from pyspark.sql import functions as F

from veilframe.catalog.profiles import PROFILES
from veilframe.operators import audit, catalogs, records, reports
from veilframe.operators.sanitize import sanitize
from veilframe.sources import readers, writers
from veilframe.streaming import jobs

SSN = "SSN: 123-45-6789"


def test_record_fields(spark):
    df = spark.createDataFrame([("John Smith", "SSN is 123-45-6789", "3.5", 42, True)],
                               "name string, note string, gpa string, count int, flag boolean")
    r = records.sanitize_record(df, ["note", "count", "flag"]).first()
    assert r.note == "SSN is [US_SSN]" and r.gpa == "3.5" and r["count"] == 42 and r.flag is True and r.name == "John Smith"
    r = records.sanitize_record(df, ["note", "gpa"], "exclude").first()
    assert r.excluded_fields == ["note"] and r.note is None and r.gpa == "3.5" and r.has_pii
    r = records.sanitize_record(df, ["note", "gpa"], policy="log_safe").first()
    assert r.note == "SSN is " and r.excluded_fields == []


def test_profile_hints_and_dotted_fields(spark):
    df = spark.sql("select named_struct('id', '1234567', 'content', named_struct('id', 'x')) as resource, '1234567' as notes")
    with pytest.raises(ValueError):
        records.sanitize_record(df, ["notes", "resource.idd"])
    for r in (records.sanitize_nested(df, profile="conductor_ethos").first(), records.sanitize_record(df, profile="conductor_ethos").first()):
        assert r.resource.id in ("[COLLEAGUE_ID]", "[STUDENT_ID]") and r.notes == "1234567" and r.resource.content.id == "x"


def test_nested(spark):
    df = spark.sql("select named_struct('a', array(named_struct('t', 'SSN: 123-45-6789', 'n', 1)), 'm', map('k', 'a@b.org'), "
                   "'z', cast(null as struct<t:string>)) as doc, 5 as n")
    r = records.sanitize_nested(df).first()
    assert r.doc.a[0].t == "SSN: [US_SSN]" and r.doc.a[0].n == 1 and r.doc.m == {"k": "[EMAIL_ADDRESS]"} and r.doc.z is None
    assert records.sanitize_nested(df, policy="ai_prompt").first().doc.a[0].t is None
    assert records.sanitize_nested(df, mode="exclude").first().doc.m == {"k": None}
    for d in (records.sanitize_nested(df, policy="ai_prompt", skip=["US_SSN", "EMAIL_ADDRESS"]).first().doc,):
        assert d.a[0].t is None  # a caller's skip does not let blocked data through
    r = records.sanitize_nested(df, mode="exclude", report=True).first()
    assert r.excluded_fields == ["doc.a.t", "doc.m"] and r.excluded and r.hit_count == 2 and r.entity_types == ["EMAIL_ADDRESS", "US_SSN"]
    with pytest.raises(ValueError):
        records.sanitize_nested(df, ["dok"])


def test_nested_positions(spark):
    """Strings come back to their places, whatever the depth and the lengths."""
    df = spark.sql("""select array(named_struct('a', array('p', 'q'), 'b', map('x', 'r', 'y', null), 'c', 's'),
        named_struct('a', cast(array() as array<string>), 'b', cast(null as map<string,string>), 'c', null), null,
        named_struct('a', array('t', 'a@b.org'), 'b', map('z', 'u'), 'c', 'v')) as deep, array(array('w'), null, array('x', 'y')) as two, 'end' as last""")
    r = records.sanitize_nested(df).first()
    deep = [x.asDict(True) if x else None for x in r.deep]
    assert deep == [{"a": ["p", "q"], "b": {"x": "r", "y": None}, "c": "s"}, {"a": [], "b": None, "c": None}, None,
                    {"a": ["t", "[EMAIL_ADDRESS]"], "b": {"z": "u"}, "c": "v"}]
    assert r.two == [["w"], None, ["x", "y"]] and r["last"] == "end"


def test_json_text(spark):
    texts = ['{"t":"a@b.org","n":7, "more": {"k@b.org": [1, null, "c@d.org", true]}}', "[1,2]", '{"t": "broken', "plain", None, '"a@b.org"',
             '{"q":"say \\"hi\\" to a@b.org"}', '{"empty":""}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, p string")
    rows = {r.id: (r.p, r[records.CORRUPT]) for r in records.sanitize_json(df, "p").collect()}
    assert rows[0] == ('{"t":"[EMAIL_ADDRESS]","n":7, "more": {"k@b.org": [1, null, "[EMAIL_ADDRESS]", true]}}', None)
    assert rows[1] == ("[1,2]", None) and rows[2] == (None, texts[2]) and rows[3] == (None, "plain") and rows[4] == (None, None)
    assert rows[5] == ('"[EMAIL_ADDRESS]"', None) and json.loads(rows[6][0]) == {"q": 'say "hi" to [EMAIL_ADDRESS]'} and rows[7] == (texts[7], None)
    big = json.dumps({"a": "line\n\"é\" " * 20000 + "a@b.org", "b\\": "\\", "c": 1.50})
    done = records.sanitize_json(spark.createDataFrame([(1, big)], "id int, p string"), "p").first().p
    assert json.loads(done) == {**json.loads(big), "a": "line\n\"é\" " * 20000 + "[EMAIL_ADDRESS]"}
    gone = {r.id: r.p for r in records.sanitize_json(df, "p", policy="ai_prompt", skip=["EMAIL_ADDRESS"]).collect()}
    assert json.loads(gone[0])["n"] == 7


def test_scan_record(spark):
    df = spark.createDataFrame([("John Smith", "123-45-6789", 42)], "name string, ssn string, count int")
    r = records.scan_record(df).first()
    by = {f.field: f for f in r.field_report}
    assert by["ssn"].pii_found and r.highest_risk == "CRITICAL" and "ssn" in r.flagged_fields and by["count"].skipped
    assert records.scan_record(df, []).first().total_hits == 0
    prof = {p.field: p for p in records.column_profile(df).collect()}
    assert prof["ssn"].top_entity == "US_SSN" and prof["count"].scanned_rows == 0


def test_row_hints_equal_profile_hints(spark):
    rows = [(p, f, "1234567") for p in ("n8n_generic", "slate_crm") for f in PROFILES[p].hints]
    long = spark.createDataFrame(rows, "profile string, field string, value string")
    for r in records.scan_by_profile(long).collect():
        one = spark.createDataFrame([("1234567",)], f"`{r.field}` string")
        alone = records.scan_record(one, [r.field], profile=r.profile).first()
        assert alone.total_hits == len(r.hits), (r.profile, r.field)
        break


def test_pages(spark):
    df = spark.createDataFrame([(1, 1, SSN, 95.0), (1, 2, "clean", 40.0), (1, 3, "  ", None)],
                               "doc int, page_number int, text string, confidence double")
    pages = reports.scan_pages(df)
    rows = {r.page_number: r for r in pages.collect()}
    assert [rows[k].low_confidence_warning for k in (1, 2, 3)] == [False, True, False]
    assert rows[3].sanitized_text == "" and rows[1].sanitized_text == "SSN: [US_SSN]"
    rep = reports.page_report(pages, ["doc"]).first()
    assert (rep.page_count, rep.pages_with_pii, rep.highest_risk) == (3, 1, "CRITICAL")
    ok, big = reports.split_oversize(df, max_chars=6)
    assert ok.count() == 2 and big.first().reject_reason == "TEXT_TOO_LONG"


def test_audit_counts_add_up(spark, texts):
    done = sanitize(texts([SSN, "clean", "a@b.org b@c.org", "clean"]), mode="exclude").withColumn("batch", F.col("id") % 2)
    events = audit.audit_events(done, by=["batch"], endpoint="/x", action="exclude", mode="exclude", subject_id="s")
    assert set(audit.EVENT_COLUMNS) <= set(events.columns)
    assert "123-45-6789" not in str(events.collect())
    t = audit.stats_totals(events).first()
    assert (t.total_requests, t.total_pii_hits, t.total_excluded, t.total_clean) == (2, 3, 2, 2)
    assert {(r.entity_type, r.events) for r in audit.stats_by_type(events).collect()} == {("US_SSN", 1), ("EMAIL_ADDRESS", 1)}
    metrics = [(r.metric, r.label, r.value) for r in audit.metrics(events).collect()]
    assert ("requests_total", "", 2) in metrics and ("endpoint_total", "/x", 2) in metrics


def test_catalogs(spark):
    assert catalogs.entities_table(spark).count() == 35
    assert catalogs.policies_table(spark).count() == 7
    fields = {r.profile: r.n for r in catalogs.profiles_table(spark).groupBy("profile").agg(F.count("*").alias("n")).collect()}
    assert fields == {"banner_student": 13, "colleague_person": 15, "salesforce_contact": 13, "ethos_person": 14,
                      "n8n_generic": 16, "conductor_ethos": 4, "workday_hr": 19, "servicenow_itsm": 14, "slate_crm": 21,
                      "starfish_early_alert": 12, "canvas_lms": 12, "microsoft_graph": 15}
    education = catalogs.rules_table(spark).where("detector_group = 'education'")
    assert education.count() == 42 and education.select("entity_type").distinct().count() == 18


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿name,ssn,gpa\r\n"Doe, J","123-45-6789",3.50\r\n"x\ny",,"say ""hi"""\r\n'.encode())
    rows = readers.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert rows[0].name == "Doe, J" and rows[0].gpa == "3.50" and rows[1].name == "x\ny" and rows[1].gpa == 'say "hi"'
    (tmp_path / "a.tsv").write_text("name\tssn\nJ\t123-45-6789\n")
    assert readers.read_tsv(spark, str(tmp_path / "a.tsv")).first().ssn == "123-45-6789"
    (tmp_path / "a.json").write_text('[{"note": "a@b.org", "n": 1}, 7, {"note": "x", "n": 2}]')
    (tmp_path / "odd").mkdir()
    for k, body in enumerate(['[{"note": "x", "n": 1}, null, [1], {"note": "y", "n": "two"}]', '{"note": "alone", "n": 1}', '[{"note": "cut']):
        (tmp_path / "odd" / f"{k}.json").write_text(body)
    good, bad = readers.split_rejects(readers.read_json_array(spark, str(tmp_path / "odd"), "note string, n bigint"))
    assert [tuple(r) for r in good.collect()] == [("x", 1)] and bad.count() == 5
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n3,4,123-45-6789\n5\n")
    good, bad = readers.split_rejects(readers.read_csv(spark, str(tmp_path / "ragged.csv")))
    assert good.count() == 1 and sorted(r[0] for r in bad.collect()) == ["3,4,123-45-6789", "5"]
    df = readers.read_json_array(spark, str(tmp_path / "a.json"))
    good, bad = readers.split_rejects(df)
    assert df.count() == 3 and good.count() == 2 and bad.count() == 1 and dict(good.dtypes)["n"] == "bigint"
    (tmp_path / "a.jsonl").write_text('{"t": "a"}\n\n{"t": "b"}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "b.jsonl").write_text('{"t": "a"}\nnot json\n')
    _, rejects = readers.split_rejects(readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "t string", strict=False))
    assert rejects.count() == 1
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert readers.read_text_files(spark, str(tmp_path / "a.txt")).first().text == "one\ntwo"
    sheet = readers.normalise_sheet(spark.createDataFrame([(1, None)], "a int, b string"), ["key", None])
    assert sheet.columns == ["key", "B"] and tuple(sheet.first()) == ("1", "")


def test_write_result(spark, texts, tmp_path):
    done = sanitize(texts([SSN, "clean"]), mode="exclude")
    for fmt in ("parquet", "json", "csv", "orc"):
        writers.write_result(done, str(tmp_path / fmt), fmt, include_excluded=False)
        assert spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt)).count() == 1


def test_stream_equals_batch_and_drops_late(spark, texts, tmp_path):
    df = texts([SSN, "clean", "mail a@b.org"])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.run_to_table(jobs.sanitize_stream(stream, policy="log_safe").select("id", "sanitized_text"), str(tmp_path / "out"),
                      jobs.checkpoint_root(spark) + "/stream-test")
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, jobs.sanitize_stream(df, policy="log_safe").select("id", "sanitized_text").collect()))
    assert got == want


def test_tasks_hold_a_bounded_number_of_rows(spark, tmp_path):
    from veilframe.sources.layout import spread
    assert spread(spark.range(0, 1000, 1, 8), rows=50).rdd.getNumPartitions() == 20
    assert spread(spark.range(0, 1000, 1, 40), rows=50).rdd.getNumPartitions() == 40
    assert spread(spark.range(0, 1000, 1, 1), rows=5000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_batch_of_one_file_is_dealt_out(spark, tmp_path):
    spark.range(0, 400, 1, 1).selectExpr("id", "concat('mail u', id, '@example.com') AS text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, text string").parquet(str(tmp_path / "in"))
    places = "spark_partition_id() AS place"
    jobs.run_to_table(jobs.sanitize_stream(stream).selectExpr("id", "sanitized_text", places), str(tmp_path / "a"), str(tmp_path / "sa"))
    jobs.run_to_table(jobs.gate_stream(stream).selectExpr("id", "safe_text", places), str(tmp_path / "b"), str(tmp_path / "sb"))
    jobs.upsert_to_table(stream, str(tmp_path / "c"), str(tmp_path / "sc"), lambda batch: batch.selectExpr("id", places))
    for done in (spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b")), jobs.read_ledgered(spark, str(tmp_path / "c"))):
        assert done.count() == done.select("id").distinct().count() == 400 and done.select("place").distinct().count() > 8
