"""Top products against all products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from checks.compare import compare, duck
from veilframe.llm.knn import top_products
from veilframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def expected(rows, k, every=3):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in fine if i % every == 0}):
        q = min(v for j, v in fine if j == i)
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


def got(spark, rows, k, **how):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, v int, score int")
    return sorted(tuple(r) for r in top_products(frame, F.col("vec_id") % 3 == 0, k=k, **how).collect())


def made(rng, n, dims):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, [rng.choice((0.03, 1)) * x for x in ([c + rng.gauss(0, .05) for c in rng.choice(centres)])]) for i in range(n)]


@pytest.mark.parametrize("pivots,groups", [(64, 16), (5, 2), (1, 1)])
def test_against_all_products(spark, pivots, groups):
    rng = random.Random(pivots)
    rows = [(i, [float(int(x * 64)) / 64 for x in v]) for i, v in made(rng, 150, 5)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(300, None), (303, [1.0, None]), (306, [math.nan] * 5), (309, [math.inf] * 5), (None, rows[3][1])]
    assert got(spark, rows, 4, pivots=pivots, groups=groups) == expected(rows, 4)


def test_few_rows(spark):
    assert got(spark, [(3, [1.0, 2.0])], 10) == []
    assert got(spark, [(3, [1.0, 2.0]), (4, [-1.0]), (6, [])], 10) == expected([(3, [1.0, 2.0]), (4, [-1.0]), (6, [])], 10)
    assert got(spark, [], 10) == [] and got(spark, [(1, [1.0])], 10) == []


def test_repeated_rows(spark):
    rows = [(3, [1.0, 0.5]), (3, [0.5, 9.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [0.5, 0.5])]
    assert got(spark, rows, 3) == expected(rows, 3)


@pytest.mark.parametrize("pivots", [64, 3])
def test_query_id_of_many_rows(spark, pivots):
    rng = random.Random(pivots)
    rows = [(3, [1.0 + i / 64, i / 8]) for i in range(12)] + [(100 + i, [rng.randrange(64) / 64, rng.randrange(64) / 64]) for i in range(39)]
    assert got(spark, rows, 10, pivots=pivots) == expected(rows, 10)


def test_products_beyond_doubles(spark):
    rng = random.Random(8)
    # odd numbers of 24 bits, which floats hold exactly; 64 products of two pass 2^53
    rows = [(i, [(2 * rng.randrange(2 ** 22, 2 ** 23) + 1) / 1024 for _ in range(63)] + [1 / 512]) for i in range(200)]
    want = expected(rows, 10)
    assert max(s for *_, s in want) > 2 ** 53 and any(s % 2 for *_, s in want)
    assert got(spark, rows, 10) == want
    with pytest.raises(OverflowError):
        got(spark, [(3, [4e6]), (4, [4e6])], 10)


def test_query(spark):
    ok, n, m, note = compare(spark, duck(SF), SF, QUERIES["op1_exact_top_k"], ORACLES["op1_exact_top_k"])
    assert ok and n > 0, note
