"""SimHash near-duplicates against all pairs."""

import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilframe.llm import simhash
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints, radius=4):
    """fp -> set of linked fps, by comparing all pairs."""
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def expected(rows):
    prints = [plain(t) for _, t in rows]
    joined = classes(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[joined[p]] = min(i, least.get(joined[p], i))
    return sorted(((i, p, least.get(joined[p])) for (i, _), p in zip(rows, prints)), key=str)


def got(frame):
    return sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in frame.collect()), key=str)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d e f g"), (7, "A B C D E F G"), (7, "a b c"),
            (None, "a b c d e f g"), (None, "lonely words without an id here"), (9, "é è " * 4000), (10, "x y z"), (6, "a b c d e f g")]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id bigint, text string, fp int, component string")
    assert got(simhash.near_duplicates(docs)) == expected(rows)


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in QUERIES["op5_simhash_near_dedup"](spark, SF).collect()), key=str)
    assert found == expected(rows)


@pytest.mark.parametrize("block", [5, 4096])
@pytest.mark.parametrize("parts", [None, 1, 2, 3])
def test_links_of_clusters(spark, block, parts):
    rng = random.Random(7)
    values = []
    for _ in range(40):
        centre = rng.getrandbits(64)
        values += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(12)]
    values += [rng.getrandbits(64) for _ in range(300)]
    frame = spark.createDataFrame([(int(np.array(v, np.uint64).view(np.int64)),) for v in set(values)], "fp bigint")
    split = None
    if parts:
        groups = [list(range(64))[i::parts] for i in range(parts)]
        limits = {1: [4], 2: [1, 2], 3: [1, 1, 0]}[parts]
        if parts == 1:
            groups, limits = [list(range(16)), list(range(16, 64))], [0, 3]
            limits = [1, 2]
        split = list(zip(groups, limits))
    edges = simhash.links(frame, 4, block, split)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for r in edges.collect():
        x, y = find(r["a"] & (2**64 - 1)), find(r["b"] & (2**64 - 1))
        root[max(x, y)] = min(x, y)
    assert {v: find(v) for v in values} == classes(values)


def test_thresholds_cover_the_radius(spark):
    prints = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    parts = simhash.plan(prints, 4)
    assert sum(t + 1 for _, t in parts) == 5
    assert len({b for bits, _ in parts for b in bits}) == sum(len(bits) for bits, _ in parts)


def test_carried_columns_named_like_results_give_way(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 5), (2, "a b c d e", 6)], "doc_id bigint, text string, fp int")
    assert simhash.near_duplicates(docs, carry=["fp", "text"], root=True).columns == ["doc_id", "text", "fp", "component_id", "root"]
