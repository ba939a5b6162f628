"""Patterns, spans, context and overlap handling."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.catalog.rules import DEFAULT_THRESHOLD, RuleBook, default_book
from veilframe.functions.core import HITS_TYPE, column
from veilframe.functions.overlap import drop_contained, resolve_overlaps
from veilframe.functions.rewrite import MASK_TOKEN, render_sql
from veilframe.functions.spans import hits_sql
from veilframe.operators.dictionary import term_hits, with_terms
from veilframe.operators.scan import explain, hits_table, scan, with_hits

# (pattern, text, expected): pinned behaviour of the patterns.
TRUTH = [
    ("d_prefix", "D1234567", True), ("d_prefix", "Student D9876543 enrolled", True), ("d_prefix", "D123456", False),
    ("d_prefix", "X1234567", False), ("colleague_at", "@01234567", True), ("colleague_at", "user@campus.edu", False),
    ("institution_mail", "jsmith@campus.edu", True), ("institution_mail", "jsmith+filter@campus.edu", True),
    ("institution_mail", "jsmith@cs.campus.edu", False), ("institution_mail", "prof@other.edu", False),
    ("visa_types", "Student is on F-1 visa", True), ("visa_types", "enrolled in DACA program", True),
    ("visa_types", "SEVIS record must be updated", True), ("visa_types", "I-20 expires next semester", True),
    ("visa_types", "green card holder applying for aid", True), ("visa_types", "US citizen enrolled full-time", False),
    ("visa_types", "a TN holder", True), ("visa_expiry", "I-20 expires: 2025", True),
    ("ferpa_phrase", "official transcript requested", True), ("ferpa_phrase", "Student GPA is 3.45", True),
    ("ferpa_phrase", "financial aid hold on account", True), ("ferpa_phrase", "placed on academic probation", True),
    ("ferpa_phrase", "SAP status review required", True),
    ("ferpa_phrase", "Introduction to Computer Science meets Monday", False),
    ("accommodation_phrases", "student has a disability accommodation", True),
    ("accommodation_phrases", "approved for extended time on tests", True),
    ("accommodation_phrases", "ADA accommodation request received", True),
    ("accommodation_phrases", "student has an IEP from high school", True),
    ("accommodation_phrases", "people with any disability deserve equal access", False),
    ("accommodation_phrases", "assistive technology", False),
    ("fafsa_number", "NE-123456", True), ("fafsa_number", "NE-12345", False),
    ("isir_reference", "ISIR 20241234", True), ("isir_reference", "20241234 record", False),
    ("tix_case_id", "TIX-2024-001234", True), ("tix_case_id", "TIX_2023_5678", True),
    ("tix_case_id", "TIX-2024-123", False), ("tix_case_id", "20241234", False),
    ("tix_case_phrase", "Title IX case 20240001 is pending", True),
    ("tix_case_phrase", "Title IX complaint #1234 received", True),
    ("irb_number", "IRB-2024-001", True), ("irb_number", "IRB#2024-001", True), ("irb_number", "IRB 2024-001", True),
    ("irb_number", "12345678", False), ("hs_protocol", "HS-2024-001", True),
    ("named_award", "Pell Grant of $7,395.00", True), ("named_award", "Subsidized Loan $3,500", True),
    ("named_award", "PLUS Loan $10,000", True), ("named_award", "Pell Grant eligibility determined", False),
    ("plate_explicit", "plate number ABC1234", True), ("plate_explicit", "plate ABC1234", False),
    ("ssn_dashed", "123-45-6789", True), ("ssn_dashed", "987-65-4321", False), ("ssn_dashed", "000-45-6789", False),
    ("ssn_dashed", "666-45-6789", False), ("ssn_dashed", "219-09-9999", False), ("ssn_dashed", "123-00-6789", False),
    ("ssn_nodash", "123456789", True), ("ssn_nodash", "0123456789012", True), ("npi_10digit", "NPI 1234567890", True),
    ("veteran_phrases", "Post-9/11 benefits", True), ("veteran_phrases", "Chapter 33", True),
    ("health_phrases", "mental health referral", True), ("health_phrases", "suicidal", False),
    ("card_number", "4111111111111111", True), ("card_number", "4111111111111112", False),
    ("iban_spaced", "GB82 WEST 1234 5698 7654 32", True), ("iban_compact", "DE89370400440532013000", True),
    ("iban_compact", "DE88370400440532013000", False), ("ipv4", "10.0.0.256", False), ("ipv4", "10.0.0.25", True),
]


def wide_open(rules=None):
    book = default_book() if rules is None else RuleBook(rules=tuple(rules))
    return book.at(0.0)


def test_pattern_truth_table(spark):
    by_name = {r.pattern: r for r in default_book().rules}
    names = sorted({p for p, _, _ in TRUTH})
    df = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(TRUTH)], "id int, pattern string, text string")
    cases = df.select("id", F.col("pattern"), *[
        column(hits_sql("text", wide_open([by_name[n]]))).alias(n) for n in names])
    found = {r.id: len(r[r.pattern]) > 0 for r in cases.collect()}
    wrong = [TRUTH[k] for k, ok in found.items() if ok != TRUTH[k][2]]
    assert not wrong


EDGES = [
    "", "   ", "a", "SSN 123-45-6789 é 123-45-6789", "😀 D1234567 😀D7654321", "éD1234567", "D1234567é", "x@campus.edu",
    "mail a.b+c@x-y.example.org,b@c.de;d@e.fr", "call +1 (402) 555-0123 or 402.555.0199\n(402)555-0000",
    "4111 1111 1111 1111 4111111111111111 3782 822463 10005", "on 01/31/1990 and 1990-01-31 and January 5, 1990",
    "IBAN DE89370400440532013000 GB82 WEST 1234 5698 7654 32", "TN-12345678 TN TNT tn", "NE-123456NE-123456",
    "ABC 1234 XY plate number ABC1234 AB-12", "1 22 333 4444 55555 666666 7777777 88888888 999999999 0000000000",
    "GPA gpa GpA ſAP status SAP statuſ", "Title  IX\tcase #123 TIX-2024-1234", "ſEVIS mılıtary mİlitary",
    "::1 fe80::1 2001:db8::8a2e:370:7334 12:30:45", "https://a.b/c?d=e. www.x.org/y) ftp://h", "bc1qxyz0123 0x" + "ab" * 20,
    "Dr. Jane Doe, Mr Smith and Maria Garcia in New York", "12 Oak Hill Road, NE 68508-1234", "٣٣٣-٣٣-٣٣٣٣ ١٢٣٤٥٦٧",
    "1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "account#12345678 routing: 012345678", "219-09-9999 219 09 9999 078051120",
]


def test_spans_equal_python_re(spark, texts):
    """Every pattern's spans agree with Python's engine, offsets included."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    values = EDGES + docs
    rules = [r for r in default_book().rules if not r.validator]
    df = texts(values).repartition(8)
    # One rule per entity label, so that nothing is dropped as a duplicate.
    alone = [r.__class__(r.rule_id, f"E{r.rule_id}", r.recognizer, r.pattern, r.regex, r.score, (), None, r.group, r.needs)
             for r in rules]
    rows = df.select("id", column(hits_sql("text", wide_open(alone))).alias("h")).collect()
    for row in rows:
        got = {}
        for h in row.h:
            got.setdefault(h.pattern_id, []).append((h.start, h.end))
        for r in rules:
            want = [m.span() for m in re.finditer(r.regex, values[row.id], re.IGNORECASE)]
            assert got.get(r.rule_id, []) == want, (r.pattern, values[row.id][:200])


def brute_contained(hits):
    def beaten(h, o):
        return (o[2] == h[2] and o[0] <= h[0] and o[1] >= h[1] and o != h and
                (o[3] > h[3] or (o[3] == h[3] and (o[0] < h[0] or o[1] > h[1] or o[4] < h[4]))))
    return [h for h in hits if not any(beaten(h, o) for o in hits)]


def brute_resolve(hits):
    kept = []
    for h in sorted(hits, key=lambda h: (-h[3], h[0] - h[1], h[0], h[2])):
        if all(k[1] <= h[0] or h[1] <= k[0] for k in kept):
            kept.append(h)
    return sorted(kept)


def test_overlap_against_brute_force(spark):
    rng = random.Random(7)
    cases = []
    for n in [0, 1, 2, 3] + [rng.randint(4, 40) for _ in range(150)]:
        hits = set()
        while len(hits) < n:
            a = rng.randint(0, 80)
            hits.add((a, a + rng.randint(1, 9), rng.choice("ABC"), rng.choice([0.5, 0.75, 0.9]), rng.randint(0, 5)))
        cases.append(sorted(hits))
    df = spark.createDataFrame(list(enumerate(cases)), f"id int, hits {HITS_TYPE}").select(
        "id", column(drop_contained("hits")).alias("d")).withColumn("k", column(resolve_overlaps("d")))
    for row in df.collect():
        want = brute_contained(cases[row.id])
        assert [tuple(h) for h in row.d] == want
        kept = [tuple(h) for h in row.k]
        assert [h[:4] for h in kept] == [h[:4] for h in brute_resolve(want)]
        assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:]))


def test_many_hits_in_one_text(spark, texts):
    """One text with thousands of hits keeps all of them, whole."""
    n = 4000
    row = scan(texts(["id D1234567 " * n])).select("hit_count", F.size("hits").alias("n")).first()
    assert row.hit_count >= n


def test_render(spark):
    df = spark.sql("select 'héllo 😀 wörld' as t, cast(array(named_struct('start', 0, 'end', 5, 'entity_type', 'A', "
                   "'score', 1D, 'pattern_id', 0), named_struct('start', 6, 'end', 7, 'entity_type', 'B', 'score', 1D, "
                   f"'pattern_id', 0)) as {HITS_TYPE}) as k")
    assert df.select(column(render_sql("t", "k", MASK_TOKEN)).alias("x")).first().x == "[A] [B] wörld"


def test_scan_summary(texts):
    rows = {r.id: r for r in scan(texts(["SSN 123-45-6789", "The quick brown fox jumped over the lazy dog.", None, "  ",
                                        "CSCI 301 meets MWF at 10am in SC 204. 24 students enrolled."])).collect()}
    assert rows[0].risk_level == "CRITICAL" and rows[0].entity_types == ["US_SSN"] and rows[0].hits[0].start == 4
    for k in (1, 2, 3):
        assert not rows[k].pii_found and rows[k].risk_level == "LOW" and rows[k].hits == []
    assert "US_SSN" not in rows[4].entity_types


def test_context_raises_weak_patterns(texts):
    book = default_book()
    rows = hits_table(texts(["student 1234567", "number 1234567", "SSN: 123456789", "ref 123456789",
                             "student one two three four five 1234567"]), ["id"], book=book).collect()
    found = {(r.id, r.entity_type): r.score for r in rows}
    assert found[(0, "STUDENT_ID")] == pytest.approx(0.7)
    assert (1, "STUDENT_ID") not in found and (3, "US_SSN") not in found
    assert found[(2, "US_SSN")] == pytest.approx(0.65)
    assert (4, "STUDENT_ID") not in found


def test_hint_and_row_hints(texts):
    df = texts(["1234567"])
    assert scan(df).first().hit_count == 0
    assert "STUDENT_ID" in scan(df, hint="STUDENT_ID").first().entity_types
    per_row = df.withColumn("b", F.array(F.lit("STUDENT_ID")))
    assert scan(per_row, boosted="b").first().entity_types == ["STUDENT_ID"]


def test_thresholds_and_selection(texts):
    df = texts(["SSN 123-45-6789 mail a@b.com"])
    assert RuleBook(threshold=1.7).threshold == DEFAULT_THRESHOLD
    assert scan(df, entities=["EMAIL_ADDRESS"]).first().entity_types == ["EMAIL_ADDRESS"]
    assert scan(df, skip=["EMAIL_ADDRESS"]).first().entity_types == ["US_SSN"]
    high = default_book().at(EMAIL_ADDRESS=1.01, US_SSN=0.9)
    assert scan(df, book=high).first().entity_types == ["US_SSN"]
    own = default_book().plus("COURSE", [("code", r"\bCSCI\d+\b", 0.9)])
    assert scan(texts(["CSCI301"]), book=own).first().entity_types == ["COURSE"]


def test_extra_hits_of_own_model(texts):
    model = column(f"cast(array(named_struct('start', 0, 'end', 3, 'entity_type', 'PERSON', 'score', 0.9D, "
                   f"'pattern_id', -1)) as {HITS_TYPE})")
    row = with_hits(texts(["Bob mail a@b.com"]), extra_hits=model).first()
    assert [h.entity_type for h in row.hits] == ["PERSON", "EMAIL_ADDRESS"]


def test_explain_names_the_pattern(texts):
    rows = explain(texts(["Student D1234567 has SSN 123-45-6789"]), ["id"]).orderBy("hit_start").collect()
    assert [(r.recognizer, r.pattern_name) for r in rows] == [("StudentIdRecognizer", "d_prefix"),
                                                              ("UsSsnRecognizer", "ssn_dashed")]
    assert "student" in rows[0].context_words


def test_no_raw_text_in_hit_table(texts):
    df = hits_table(texts(["SSN 123-45-6789"]), ["id"])
    assert "text" not in df.columns and "123-45-6789" not in str(df.collect())


def test_term_dictionary(spark, texts):
    terms = spark.createDataFrame([("Omaha", "LOCATION"), ("tobias", "PERSON")], "term string, entity_type string")
    df = texts(["Tobias lives in Omaha, éOmaha no", None])
    for limit in (None, 1, 3):
        rows = sorted((r.entity_type, r.hit_start, r.hit_end) for r in
                      term_hits(df, ["id"], "text", terms, longest=limit).collect())
        assert rows == [("LOCATION", 16, 21), ("PERSON", 0, 6)]


def test_custom_patterns_are_checked_by_java(spark):
    for bad in ("(?P<a>x)", "(", "[a"):
        with pytest.raises(ValueError):
            RuleBook().plus("X", [("p", bad, 0.5)])
    assert RuleBook().plus("X", [("p", "(?<a>x)++", 0.5)]).rules[-1].regex == "(?<a>x)++"


def test_dictionary_of_phrases_in_long_texts(spark, texts):
    terms = spark.createDataFrame([("New Haven", "LOCATION"), ("haven", "LOCATION"), ("ADA", "PERSON"), ("", "PERSON"), (None, "PERSON")], "term string, entity_type string")
    long = "the and " * 100_000 + "ada of new haven"
    df = texts(["Ada lives in NEW HAVEN.", "", None, "nothing", "heaven", long])
    got = {(r.id, r.entity_type, r.hit_start, r.hit_end) for r in term_hits(df, ["id"], "text", terms).collect()}
    n = len("the and " * 100_000)
    assert got == {(0, "PERSON", 0, 3), (0, "LOCATION", 13, 22), (0, "LOCATION", 17, 22), (5, "PERSON", n, n + 3), (5, "LOCATION", n + 7, n + 16), (5, "LOCATION", n + 11, n + 16)}
    found = with_terms(df, terms, book=default_book().only(["US_SSN"]))
    assert {r.id: len(r.hits) for r in found.collect()} == {0: 2, 1: 0, 2: 0, 3: 0, 4: 0, 5: 2}
