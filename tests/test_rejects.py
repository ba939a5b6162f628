"""Rejects of JSON arrays over the whole table, the good rows compared as well."""

import pytest

import __spark_entry__ as entry
from checks import queries
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"


def test_rejects_of_every_customer(spark):
    name = "read_json_array_rejects_all"
    ok, n, m, note = compare(spark, duck(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note
    assert n == m == spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey % 10 <> 0").count() + 1 > 51


@pytest.mark.parametrize("name,most", [("read_json_array", 1), ("read_json_array_rejects_all", 1 + 15)])
def test_array_files_hold_many_rows(spark, tmp_path, monkeypatch, name, most):
    """150 customers: one file of whole arrays, and one per customer cut off."""
    monkeypatch.setattr(queries, "scratch", lambda _: str(tmp_path / "run"))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 100
    assert len(list((tmp_path / "run" / "in").glob("part-*"))) == most
