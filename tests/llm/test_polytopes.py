"""Approximate neighbours: recall and exact scores against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import polytopes
from veilframe.llm.polytopes import Hashes, hadamard, nearest_neighbours, plan, unit
from veilframe.llm.queries import QUERIES


def expected(rows, k, every):
    fine = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, [*v, *[0.0] * (width - len(v))]) for i, v in fine]
    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    out = {}
    for i in sorted({i for i, _ in fine if i % every == 0}):
        q = min(v for j, v in fine if j == i)
        out[i] = sorted((-round(cosine(q, v), 9), j) for j, v in fine if j != i)[:k]
    return out


def got(spark, rows, every=3, **how):
    frame = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], "vec_id bigint, embedding array<double>, v int, score int, name string, id int")
    found, out = nearest_neighbours(frame, F.col("vec_id") % every == 0, **how), {}
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    for r in sorted(found.collect()):
        out.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(want, have):
    return sum(len({i for _, i in want[q]} & {i for _, i in have[q]}) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("rows_of_block", [4096, 7])
def test_recall_and_scores(spark, monkeypatch, rows_of_block):
    monkeypatch.setattr(polytopes, "ROWS", rows_of_block)
    monkeypatch.setattr(polytopes, "QUERIES", rows_of_block)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(600)]
    want, have = expected(rows, 5, 6), got(spark, rows, 6)
    assert want.keys() == have.keys() and all(len(v) == 5 for v in have.values())
    assert recall(want, have) >= 0.93
    true = {(q, i): s for q, v in expected(rows, 600, 6).items() for s, i in v}
    assert all(true[q, i] == s for q, v in have.items() for s, i in v)


def test_whole_recall_is_exact(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randint(-9, 9)) for _ in range(5)]) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(6, rows[7][1])] * 3 + [(7, rows[7][1])] * 2  # copies, repeated rows, an id of two vectors
    rows += [(300, None), (303, [1.0, None]), (306, [math.nan] * 5), (309, [math.inf] * 5), (None, [1.0] * 5), (312, [0.0] * 5), (315, []), (318, [-0.0, 2.0])]
    want = expected(rows, 5, 3)
    have = got(spark, rows, 3, recall=1.0, sample=10_000)
    assert want.keys() == have.keys()
    # sums of another order may swap neighbours whose cosines are equal but for the last bits
    assert [[s for s, _ in want[q]] for q in want] == [[s for s, _ in have[q]] for q in want]


def test_own_id_many_times(spark):
    rng = random.Random(2)
    rows = [(3, [1.0 + i / 100, 1.0]) for i in range(12)] + [(100 + i, [rng.random(), rng.random()]) for i in range(39)]
    assert len(got(spark, rows)[3]) == 5


def test_few_rows(spark):
    assert got(spark, []) == {} and got(spark, [(1, [1.0, 2.0])]) == {} and got(spark, [(3, [1.0, 2.0])]) == {}
    assert got(spark, [(3, [1.0, 0.0]), (4, [-1.0]), (6, [0.0, 2.0])]) == {3: [(0.0, 6), (1.0, 4)], 6: [(0.0, 3), (0.0, 4)]}


def test_very_large_and_small_components(spark):
    rows = [(3, [1e200, 1e200]), (4, [1e-200, 1e-200]), (5, [1e300, 0.0])]
    assert got(spark, rows) == {3: [(-1.0, 4), (round(-math.sqrt(.5), 9), 5)]}


def test_transform_and_probes():
    x = np.random.default_rng(0).normal(size=(20, 8))
    assert np.allclose(hadamard(hadamard(x)), x)
    made = Hashes(8, [8, 2], 2)
    order = made.probes(unit(x), 1, made.buckets)
    assert (order[:, 0] == made.codes(unit(x), 1)).all()
    assert (np.sort(order, axis=1) == np.arange(64)).all()
    assert (made.probes(unit(x), 1, 9) == order[:, :9]).all()


def test_plan_widens_the_search():
    """Neighbours in far buckets need more probes than neighbours in the query's own."""
    rng = np.random.default_rng(1)
    asked = unit(rng.normal(size=(50, 16)))
    close = [q + 0.01 * unit(rng.normal(size=(5, 16))) for q in asked]
    far = [unit(rng.normal(size=(5, 16))) for _ in asked]
    assert plan(16, 1000, asked, close)[1] < plan(16, 1000, asked, far)[1]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op13_approximate_neighbours"](spark, sf).collect()
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    have = {}
    for r in found:
        have.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["vec_id"]))
    want = expected(rows, 5, 50)
    assert want.keys() == have.keys() and recall(want, have) >= 0.9
