"""Centroid clustering against plain integer k-means."""

import hashlib
import math
import random

import numpy as np
import pytest

from checks.compare import compare, duck
from veilframe.llm.centroids import clustered, nearest
from veilframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def expected(rows, k, rounds, width, scale=256):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    def name(row):
        return (row[0] is None, hashlib.sha256(f"2:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])
    centres = [v for _, v in sorted(fine, key=name)[:k]]
    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in fine]
    for _ in range(rounds):
        of = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(fine, of) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    of = assign()
    sums = {j: sum(d for d, c in of if c == j) for j in range(len(centres))}
    return sorted((i is None, i or 0, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
                  for (i, _), (d, c) in zip(fine, of))


def got(spark, rows, **how):
    frame = spark.createDataFrame([(i, v, 1, "x", 2.0, 3) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, v string, lead double, h int")
    found = clustered(frame, **how)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in found.collect())


@pytest.mark.parametrize("leading", [1, 3, 6])
def test_against_plain_clustering(spark, leading):
    rng = random.Random(leading)
    centres = [[rng.gauss(0, 2) for _ in range(6)] for _ in range(7)]
    rows = [(i, [c + rng.gauss(0, .3) for c in rng.choice(centres)]) for i in range(150)]
    # ties, copies, repeated ids, no id, and rows that take no part
    rows += [(500 + i, [1.0] * 6) for i in range(40)] + [(3, [0.5] * 6), (3, [-0.5] * 6), (None, [9.0] * 6), (600, None), (601, [1.0] * 5), (602, [None] + [1.0] * 5),
             (603, [math.nan] * 6), (604, [math.inf] * 6), (605, [])]
    assert got(spark, rows, k=9, rounds=4, width=6, leading=leading) == expected(rows, 9, 4, 6)


def test_few_and_no_rows(spark):
    assert got(spark, [], k=3, width=2) == [] and got(spark, [(1, None)], k=3, width=2) == []
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-3.0, 8.0])]
    assert got(spark, rows, k=40, width=2) == expected(rows, 40, 5, 2)


def test_negative_means_are_floored(spark):
    rows = [(1, [-1 / 256]), (2, [-2 / 256]), (3, [-4 / 256])]
    assert got(spark, rows, k=1, rounds=1, width=1) == expected(rows, 1, 1, 1)


def test_large_components(spark):
    rows = [(1, [500_000.0, -500_000.0]), (2, [-500_000.0, 499_999.5]), (3, [500_000.0, 500_000.0])]
    assert got(spark, rows, k=2, width=2) == expected(rows, 2, 5, 2)
    with pytest.raises(Exception, match="would not fit"):
        got(spark, [(1, [1e6, 0.0])], k=2, width=2)


def test_bounds_spare_centroids():
    """Vectors near their centroid are verified against few others."""
    rng = np.random.default_rng(1)
    centre = rng.integers(-1000, 1000, (40, 8))
    v = np.repeat(centre, 20, axis=0) + rng.integers(-5, 6, (800, 8))
    number, distance, verified = nearest(v, v[:, :6].astype(float), np.sqrt((v[:, 6:] ** 2).sum(1)), centre, centre[:, :6].astype(float),
                                         np.sqrt((centre[:, 6:] ** 2).sum(1)))
    full = ((v[:, None] - centre) ** 2).sum(2)
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all() and verified < 1000


def test_query(spark):
    ok, n, m, note = compare(spark, duck(SF), SF, QUERIES["op11_centroid_clustering"], ORACLES["op11_centroid_clustering"])
    assert ok and n == m > 0, note
