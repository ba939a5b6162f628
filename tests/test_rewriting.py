"""Modes, pseudonyms, policies, preflight, flows."""

import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F

from veilframe.catalog.policies import POLICIES
from veilframe.catalog.rules import default_book
from veilframe.functions.core import column
from veilframe.functions.decode import decode_sql
from veilframe.functions.pseudonym import Pseudonyms, seed_sql, stand_in_sql
from veilframe.functions.sqlnames import register_functions
from veilframe.operators.policy import apply_policy, apply_policy_by_column, block_rates
from veilframe.operators.preflight import preflight, preflight_gate
from veilframe.operators.sanitize import batch_counts, pseudonym_map, sanitize
from veilframe.plans.config import load_config, parse_config
from veilframe.plans.flows import process_text, resolve_mode

SSN = "SSN: 123-45-6789"


def one(df, col="sanitized_text"):
    return [r[col] for r in df.orderBy("id").collect()]


def test_modes(texts):
    df = texts([SSN, "clean text", "", None, "   "])
    assert one(sanitize(df, mode="mask")) == ["SSN: [US_SSN]", "clean text", "", None, "   "]
    assert one(sanitize(df, mode="redact"))[0] == "SSN: "
    assert one(sanitize(df, mode="redact", redact_with="***"))[0] == "SSN: ***"
    assert one(sanitize(df, mode="exclude")) == [None, "clean text", "", None, "   "]
    assert re.fullmatch(r"SSN: \d{3}-\d{2}-\d{4}", one(sanitize(df, mode="pseudonymize"))[0])
    assert sanitize(df, mode="exclude", include_excluded=False).count() == 4
    with pytest.raises(ValueError):
        sanitize(df, mode="shred")


def test_batch_counts(texts):
    row = batch_counts(sanitize(texts(["Clean text", SSN, "Another clean"]), mode="exclude")).first()
    assert (row.total, row.excluded_count, row.clean_count) == (3, 1, 2)


def test_skip_types(texts):
    df = texts(["Born on 01/15/1990, " + SSN])
    assert one(sanitize(df, skip=["DATE_TIME", "DATE_OF_BIRTH"])) == ["Born on 01/15/1990, SSN: [US_SSN]"]


FORMATS = {
    "PERSON": r"\w+ \w+", "EMAIL_ADDRESS": r"[a-z]+\.test@example\.(com|org|net|edu)", "PHONE_NUMBER": r"\(555\) \d{7}",
    "US_SSN": r"\d{3}-\d{2}-\d{4}", "CREDIT_CARD": r"4111-1111-1111-1111", "DATE_OF_BIRTH": r"\d{2}/\d{2}/(19[7-9]\d|200[0-4])",
    "STUDENT_ID": r"D\d{7}", "FAFSA_ID": r"NE-\d{6}", "IP_ADDRESS": r"192\.0\.2\.\d{1,3}", "MEDICAL_LICENSE": r"ML\d{6}",
    "FINANCIAL_ACCOUNT": r"\d{10}", "US_PASSPORT": r"[A-Z]\d{8}", "US_DRIVER_LICENSE": r"DL\d{7}",
    "TITLE_IX_CASE_ID": r"TIX-202[0-5]-\d{4}", "IRB_PROTOCOL": r"IRB-202[0-5]-\d{3}",
    "FINANCIAL_AID_AWARD": r"Pell Grant \$\d{1,3}(,\d{3})+\.00", "STUDENT_ACCOUNT_ID": r"TN-\d{9}",
    "LICENSE_PLATE": r"[A-HJ-NP-Z]{3} \d{4}", "FERPA_MARKER": r"\[FERPA_MARKER\]",
}


def test_stand_in_formats(spark):
    seeds = ["0" * 32, "f" * 32, *(hashlib.md5(str(i).encode()).hexdigest() for i in range(40))]
    df = spark.createDataFrame([(s,) for s in seeds], "r string")
    for row in df.select(*[column(stand_in_sql(f"'{e}'", "r")).alias(e) for e in FORMATS]).collect():
        for e, shape in FORMATS.items():
            assert re.fullmatch(shape, row[e]), (e, row[e])


def test_seeds_equal_python(spark):
    values = ["123-45-6789", "José", "a" * 200]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for secret in ("", "short", "k" * 100):
        rows = df.select("v", column(seed_sql("'US_SSN'", "v", Pseudonyms(secret=secret))).alias("s")).collect()
        for r in rows:
            digest = (hmac.new(secret.encode(), f"US_SSN::{r.v}".encode(), "sha256") if secret
                      else hashlib.md5(r.v.encode())).hexdigest()
            assert r.s == digest[:32]


def test_pseudonyms_are_pure_and_salted(texts):
    df = texts([SSN, SSN, "SSN: 321-45-6789"])
    a, b, c = one(sanitize(df, mode="pseudonymize"))
    assert a == b != c
    salted = one(sanitize(df, mode="pseudonymize", how=Pseudonyms(salt="x")))
    assert salted[0] == salted[1] != a
    mapping = pseudonym_map(df).collect()
    assert sorted(r.occurrences for r in mapping) == [1, 2]


def test_overlapping_types_do_not_garble(texts):
    out = one(sanitize(texts(["mail jsmith@campus.edu now"]), mode="pseudonymize"))[0]
    assert re.fullmatch(r"mail [a-z]+\.test@example\.\w+ now", out)


def test_decode(spark):
    values = ["a%20b", "50% off", "a+b", "a%2Bb", "%zz%41", "U1NOIDEyMy00NS02Nzg5", "SSN 1", "abcd", "////////", "  dGVzdHRlc3Q=  ", None]
    want = ["a b", "50% off", "a+b", "a+b", "%zzA", "SSN 123-45-6789", "SSN 1", "abcd", "////////", "testtest", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, t string")
    got = [r.d for r in df.select("id", column(decode_sql("t")).alias("d")).orderBy("id").collect()]
    assert got == want


CLEAN = "CSCI 301 meets MWF at 10am. 24 seats available."


@pytest.mark.parametrize("name", sorted(POLICIES))
def test_clean_text_passes_every_policy(texts, name):
    r = apply_policy(texts([CLEAN]), name).first()
    assert r.passed and r.action_taken == "none" and r.sanitized_text == CLEAN and r.risk_level == "LOW"


def test_policies(texts):
    df = texts([SSN, "Student D1234567", "mail a@campus.edu", "updated 10:45"])
    ai = {r.id: r for r in apply_policy(df, "ai_prompt").collect()}
    assert not ai[0].passed and ai[0].blocked_entities == ["US_SSN"] and ai[0].sanitized_text is None
    assert ai[1].action_taken == "masked" and ai[1].sanitized_text == "Student [STUDENT_ID]" and ai[1].warned
    assert ai[3].passed and ai[3].action_taken == "none"
    strict = {r.id: r for r in apply_policy(df, "ferpa_strict").collect()}
    assert all(not r.passed and r.sanitized_text is None for r in strict.values())
    assert strict[2].blocked_entities == ["EMAIL_ADDRESS", "INSTITUTION_EMAIL"]
    out = {r.id: r for r in apply_policy(df, "export_external").collect()}
    assert not out[2].passed
    with pytest.raises(ValueError):
        apply_policy(df, "nope")


def test_callers_pass_through_never_weakens_the_block(texts):
    r = apply_policy(texts([SSN + " D1234567"]), "ai_prompt", skip=["US_SSN"]).first()
    assert not r.passed
    r = apply_policy(texts(["SSN" + " D1234567 a@b.org"]), "ai_prompt", skip=["EMAIL_ADDRESS"]).first()
    assert r.sanitized_text == "SSN [STUDENT_ID] a@b.org"


def test_policy_by_column_equals_single(texts):
    names = sorted(POLICIES)
    values = [SSN, "Student D1234567", "veteran with a@b.org", CLEAN, None]
    rows = [(i * 10 + k, v, n) for i, n in enumerate(names) for k, v in enumerate(values)]
    df = texts([]).sparkSession.createDataFrame(rows, "id int, text string, policy string")
    mixed = {r.id: (r.passed, r.action_taken, r.sanitized_text, r.blocked_entities) for r in apply_policy_by_column(df).collect()}
    for n in names:
        for r in apply_policy(df.where(F.col("policy") == n).drop("policy"), n).collect():
            assert mixed[r.id] == (r.passed, r.action_taken, r.sanitized_text, r.blocked_entities)


def test_block_rates(texts):
    rates = {r.policy: (r.total, r.blocked) for r in block_rates(texts([SSN, "a@b.org", CLEAN])).collect()}
    assert rates["ferpa_strict"] == (3, 2) and rates["ai_prompt"] == (3, 1) and rates["log_safe"] == (3, 0)


def test_preflight(texts):
    rows = {r.id: r for r in preflight(texts([CLEAN, "Student SSN is 123-45-6789", "met Dr. Jane Doe"])).collect()}
    assert rows[0].safe_to_send and rows[0].sanitized_suggestion is None
    assert not rows[1].safe_to_send and rows[1].blocking_entities == ["US_SSN"]
    assert rows[1].sanitized_suggestion == "Student SSN is [US_SSN]" and len(rows[1].recommendation) > 10
    assert rows[2].safe_to_send and rows[2].warning_entities == ["PERSON"] and rows[2].risk_level == "MEDIUM"


def test_gate(texts):
    rows = {r.id: r for r in preflight_gate(texts([CLEAN, SSN, "mail a@b.org"])).collect()}
    assert (rows[0].safe_text, rows[0].was_sanitized) == (CLEAN, False)
    assert (rows[1].safe_text, rows[1].was_sanitized) == (None, True)
    assert rows[2].safe_text == "mail [EMAIL_ADDRESS]"


def test_process_precedence(texts):
    assert resolve_mode("redact", "embedding", "servicenow_itsm") == "pseudonymize"
    assert resolve_mode("mask", None, "servicenow_itsm") == "mask"
    assert resolve_mode(None, None, "servicenow_itsm") == "redact"
    assert resolve_mode(None) == "mask"
    rows = {r.id: r for r in process_text(texts([SSN, None, CLEAN]), policy="ai_prompt").collect()}
    assert [rows[k].action_taken for k in range(3)] == ["excluded_by_policy", "skipped", "none"]


def test_sql_names(spark, texts):
    register_functions(spark)
    texts([SSN]).createOrReplaceTempView("t_sql")
    row = spark.sql("select pii_mask(text) m, pii_exclude(text) x, pii_risk(text) r, pii_types(text) t from t_sql").first()
    assert (row.m, row.x, row.r, row.t) == ("SSN: [US_SSN]", None, "CRITICAL", ["US_SSN"])


def test_config(tmp_path, texts):
    path = tmp_path / "c.json"
    path.write_text('{"entity_thresholds": {"EMAIL_ADDRESS": 0.99}, "custom_patterns": [{"entity_type": "EMPLOYEE_ID", '
                    '"patterns": [{"name": "emp", "regex": "\\\\bEMP-\\\\d{5}\\\\b", "score": 0.9}], "context": ["staff"]}], '
                    '"schema_profiles": {"mine": {"field_hints": {"x": "US_SSN"}}}, "pseudo_pools": {"cities": ["Omaha"]}}')
    c = load_config(str(path))
    assert one(sanitize(texts(["EMP-12345 a@b.org"]), book=c.book)) == ["[EMPLOYEE_ID] a@b.org"]
    assert c.profiles["mine"].hints == {"x": "US_SSN"} and c.pseudonyms.cities == ("Omaha",)
    assert load_config(None).book == default_book() and parse_config({}).profiles == {}
