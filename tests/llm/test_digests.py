"""Digests against a slow version that counts bytes window by window."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from veilframe.llm import digests as d
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_bins(data):
    out = []
    for k in range(len(data) - 63):
        total = sum(sum(round((c * math.log2(c) - (c - 1) * math.log2(max(c - 1, 1))) * 4096) for c in range(1, n + 1))
                    for n in Counter(data[k:k + 64]).values())
        out.append(total * 1000 // d._MOST)
    return out


def slow_features(data, ranks):
    if not data:
        return []
    if len(data) < 64:
        return [data]
    order = [(ranks[b], k) for k, b in enumerate(slow_bins(data))]
    score = Counter(min(order[k:k + 64])[1] for k in range(len(order) - 63))
    at = sorted(k for k, n in score.items() if n >= 16) or [min(order)[1]]
    return list(dict.fromkeys(data[k:k + 64] for k in at))


def text(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_features_against_slow_version():
    rng = random.Random(1)
    texts = [text(rng, n).encode() for n in (0, 1, 5, 12, 20, 22, 40, 300)] + [b"a" * 500, b"ab" * 40, b"q" * 64, b"", b"x" * 63]
    ranks = np.random.default_rng(0).permutation(d.BINS).astype(np.int64)
    made = d.digests(texts, ranks)
    for data, (count, filters) in zip(texts, made):
        assert d.entropy_bins(np.frombuffer(data, np.uint8)).tolist() == slow_bins(data)
        features = slow_features(data, ranks)
        assert count == len(features) and len(filters) == -(-count // 160)
        assert np.array_equal(filters, d.digests([data], ranks)[0][1])  # alone as in company
        assert np.unpackbits(filters).sum() <= 5 * count


def test_likeness():
    rng = random.Random(2)
    ranks = np.arange(d.BINS)
    a, b = text(rng, 900), text(rng, 900)
    x, y, z, e, f = d.digests([t.encode() for t in (a, b, a[:len(a) // 2] + b[:len(a) // 2], "", "")], ranks)
    assert d.likeness(x, x) == 1 and d.likeness(e, f) == 1 and d.likeness(x, e) == 0
    assert d.likeness(x, z) > 0.2 > 0.05 > d.likeness(x, y)
    back = d.from_text(d.as_text(x))
    assert back[0] == x[0] and np.array_equal(back[1], x[1])


def expected(rows):
    def signed(t):
        return (xxhash.xxh64_intdigest(t.encode(), seed=42) ^ 1 << 63) - (1 << 63)
    order = sorted(((i is not None, i, t or "") for i, t in rows), key=lambda r: (r[0], r[1] or 0, signed(r[2]), r[2].encode()))
    out = []
    for k, (_, i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_neighbours(spark, buckets):
    rng = random.Random(4)
    rows = [(rng.randint(0, 40) * 10, text(rng, rng.randint(0, 30))) for _ in range(60)]
    rows += [(5, None), (6, ""), (None, "no id"), (None, None), rows[3], rows[3], (7, "é" * 9001), (2**40, "far")]
    docs = spark.createDataFrame([(i, t, "f", 2) for i, t in rows], "doc_id bigint, text string, fingerprint string, _bucket int")
    got = d.edited_pairs(docs, buckets=buckets).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == expected(rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


@pytest.mark.parametrize("buckets", [2, 16])
def test_hot_ids(spark, buckets):
    """A third of the rows without an id, a third of one id: neither stays in one range, and the order holds."""
    rng = random.Random(buckets)
    rows = [((None, 7, i)[i % 3], text(rng, rng.randint(1, 12))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = d.edited_pairs(docs, buckets=buckets).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == expected(rows)
    sizes = [r["count"] for r in d.neighbours(docs, "doc_id", "text", buckets).where("_guest = 0").groupBy("_bucket").count().collect()]
    assert sum(sizes) == 300 and (buckets == 2 or max(sizes) < 50)


def test_ranges_keep_the_order():
    rng = np.random.default_rng(3)
    ids, h = rng.integers(-3, 4, 4000), rng.integers(-2**63, 2**63 - 1, 4000)
    none = rng.random(4000) < .2
    bounds = np.sort(np.concatenate([rng.integers(-3, 4, 5), [2] * 6]))
    number = d.ranges(ids, none, h, bounds, 3)
    order = np.lexsort((h, np.where(none, 0, ids), ~none))
    assert (np.diff(number[order]) >= 0).all() and len(np.unique(number[none])) == 3 and len(np.unique(number[~none & (ids == 2)])) >= 6


def test_one_row_and_none(spark):
    one = d.edited_pairs(spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one[0]["near_next"] == 1
    assert d.edited_pairs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op10_document_fingerprints"](spark, SF).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == expected(rows)
    texts, prints = dict(rows), {}
    for r in got:
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert r["near_next"] == pytest.approx(d.likeness(d.from_text(r["fingerprint"]), d.from_text(
            next(o["fingerprint"] for o in got if o["doc_id"] == min((i for i, _ in rows if i > r["doc_id"]), default=min(i for i, _ in rows))))))
    assert np.mean([r["near_edited"] for r in got]) > 3 * np.mean([r["near_next"] for r in got])
