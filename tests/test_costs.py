"""What a text costs: rules behind shut gates, steps of a bisection, short folds, rules without a context word in the text."""

import pytest
from pyspark.sql import functions as F

from veilframe.catalog.rules import RuleBook, default_book
from veilframe.functions import core, spans
from veilframe.operators import records, scan

ADDRESS = "see https://host7.example.com/?" + "m=u7@example.com&nr=10.0.0.7&d=2021-03-04&t=10:15&" * 20


@pytest.mark.parametrize("text,most", [("nothing here", 0), ("1000123", 14), ("400123", 14), ("reach me at u7@example.com", 40)])
def test_rules_tried(spark, text, most):
    rules = default_book().reachable().rules
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.expr(f"size({spans._tried('t', rules)})")).first()[0] <= most


@pytest.mark.parametrize("text,most", [("mail user12345@example.com", 6), ("ring (402) 555-0123", 14), ("10 items", 4)])
def test_rules_that_wait_for_other_marks_cost_nothing(spark, text, most):
    """No struct is made for the rules that ask for longer runs of digits or another mark than the text has."""
    rules = default_book().reachable().rules
    assert spark.createDataFrame([(text,)], "t string").select(F.expr(f"size({spans._tried('t', rules)})")).first()[0] <= most


def test_equal_strings_of_a_row_are_detected_once(spark):
    rows = [["a@b.org", "x", "a@b.org"], ["a@b.org", None, "a@b.org"], [], ["a@b.org"] * (records.APART + 1), None]
    df = spark.createDataFrame([(r,) for r in rows], "v array<string>")
    assert [n[0] for n in df.select(F.expr(f"size({records._told_apart('v')})")).collect()] == [2, 3, 0, records.APART + 1, None]
    for mode, mail in (("mask", "[EMAIL_ADDRESS]"), ("exclude", None)):
        done = records.sanitize_nested(df, mode=mode, report=True).collect()
        assert [r.v for r in done] == [r and [mail if x == "a@b.org" else x for x in r] for r in rows]
        assert [r.hit_count for r in done] == [2, 2, 0, records.APART + 1, 0]


def test_bisection_takes_as_many_steps_as_its_length_has_digits(spark):
    sizes = [0, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 100, 1023, 1024, 1025, (1 << 20) - 1, 1 << 20, (1 << 27) - 1]
    rows = [(n, k) for n in sizes for k in {0, 1, n // 2, max(n - 1, 0), n} if k <= n]
    df = spark.createDataFrame(rows, "n int, k int")
    got = df.select("n", "k", F.expr(core.leading("n", lambda i: f"{i} < k")).alias("c"), F.expr(f"size({core._steps('n')})").alias("s")).collect()
    assert all(r.c == r.k for r in got)
    assert all(r.s <= max(r.n, 1).bit_length() + 1 for r in got)


def test_running_of_any_length(spark):
    sizes = [0, 1, 2, 15, 16, 17, 63, 64, 65, 256, 1023, 1024, 1025, 5000]
    df = spark.createDataFrame([(n,) for n in sizes], "n int").withColumn("v", F.expr("transform(case when n = 0 then cast(array() as array<int>) else sequence(1, n) end, x -> x * 7 % 11)"))
    for r in df.select("v", F.expr(core.running("v", "0", lambda a, x: f"{a} + {x}")).alias("p")).collect():
        assert r.p == [sum(r.v[:k]) for k in range(len(r.v))]


def test_rules_without_context_words_in_the_text_are_not_looked_at_closer(spark):
    """The words before a hit are cut out for those rules only that have a context word somewhere in the text."""
    for text, wanted in (("ssn,123456789 x", True), ("assn 123456789 x", False), ("123456789 after ssn", True), ("ΟΔΟΣ 123456789", True)):
        df = spark.createDataFrame([(text,)], "t string")
        said = core.let("sp_t", "t", core.let("sp_q", "named_struct('words', array(' ssn '))", core.let(
            "sp_low", f"concat(' ', regexp_replace(lower(sp_t), {core.lit(spans._MARKS)}, ' '))", spans._said_at_all())))
        assert df.select(F.expr(said)).first()[0] is wanted


def test_context_words_cut_by_the_hit_or_ended_by_a_sigma(texts):
    book = RuleBook(rules=()).plus("CODE", [("code", r"[0-9]{4}", 0.3)], ["tag", "ΟΔΟΣ"]).at(0.5)
    values = ["tag 1234", "tag1234", "-tag1234", "tagged 1234", "ΟΔΟΣ 1234", "οδος 1234", "tag " + "x " * 5 + "1234", "tag " + "x " * 4 + "1234",
              "tag/" + "y/" * 150 + "1234", "tag/" + "y/" * 150 + "1234 1234", "z" * 300 + "tag1234", "z" * 300 + "/tag1234"]
    hits = {r.id for r in scan.hits_table(texts(values), ["id"], book=book).collect()}
    assert hits == {0, 1, 2, 4, 5, 7, 8, 9, 11}


def test_pile_of_hits(texts):
    """One address over eighty hits, none of which has a context word before it but those of its own."""
    hits = scan.hits_table(texts([ADDRESS]), ["id"]).collect()
    assert sum(h.entity_type == "EMAIL_ADDRESS" for h in hits) == 20
    assert {h.hit_end - h.hit_start for h in hits if h.entity_type == "IP_ADDRESS"} == {8}


def test_long_texts_are_dealt_to_more_tasks(spark, tmp_path):
    from checks import deep
    spark.range(100_000).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert deep._pile(spark, str(tmp_path)).rdd.getNumPartitions() == 50
    assert deep._no_blanks(spark, str(tmp_path)).rdd.getNumPartitions() == 10
