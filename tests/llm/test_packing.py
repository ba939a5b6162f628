"""Packing: ids against the tokenizer, sequences gapless, plans against exhaustive search."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from veilframe.llm import packing
from veilframe.llm.common import vocabulary_path
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


def ids_of(coder, text):
    return coder.encode(text or "", add_special_tokens=False).ids + [1]


def expected(coder, rows, capacity):
    out = []
    for i, t in rows:
        ids = ids_of(coder, t)
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            out.append((i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check(got, want, capacity, slack=1.02):
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    counts = np.bincount([w[3] for w in want], minlength=capacity + 1)
    assert len(bins) <= max(packing.lower_bound(counts, capacity) * slack, packing.lower_bound(counts, capacity) + 1)


def test_ids_of_words(coder):
    words = packing.WordIds(vocabulary_path("word_bpe_49k.json"), room=50)
    for text in ["It's the 3rd; don't, can't. U.S.A. x,y", "Straße ÉTÉ ño…, “q” éa  ", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b",
                 "a b c\u0085d \x1c e\x0bf", "ΑΣ ΟΔΟΣ İstanbul", "", " \n", "word.. word., .,. 5. é. 'S 'LL", "x" * 3000, "日本語 テキスト。"]:
        assert list(np.frombuffer(words.of(text), "<u4")) == coder.encode(text, add_special_tokens=False).ids, text


def fewest(items, capacity):
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in sorted(set(bins)):
            if b + items[k] <= capacity:
                rest = list(bins)
                rest[rest.index(b)] += items[k]
                place(k + 1, rest)
        place(k + 1, bins + [items[k]])
    place(0, [])
    return best


def test_plans_against_exhaustive_search():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([10, 17, 30])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 10))), reverse=True)
        counts = np.bincount(items, minlength=capacity + 1)
        plan = packing.complete(counts, capacity)
        used = np.zeros(capacity + 1, np.int64)
        for times, filling in plan:
            assert sum(filling) <= capacity
            for length in filling:
                used[length] += times
        assert (used == counts).all()
        best = fewest(items, capacity)
        assert packing.lower_bound(counts, capacity) <= best <= sum(n for n, _ in plan) <= best + (len(items) > 8)
        assert sum(n for n, _ in packing.best_fit(counts, capacity)) >= best
    assert packing.complete(np.zeros(11, np.int64), 10) == []


def test_search_improves_on_its_start():
    rng = np.random.default_rng(1)
    for low, high, n in ((200, 901, 20_000), (1200, 1500, 5_000)):
        counts = np.bincount(rng.integers(low, high, n), minlength=4097)
        plan = packing.complete(counts, 4096)
        start, found = (sum(n for n, _ in p) for p in (packing.best_fit(counts, 4096), plan))
        bound = packing.lower_bound(counts, 4096)
        assert bound <= found < start and found - bound < (start - bound) / 3


def test_fillings_are_undominated():
    rng = random.Random(2)
    for _ in range(40):
        capacity = rng.choice([20, 40])
        counts = np.bincount([rng.randint(1, capacity) for _ in range(rng.randint(2, 12))], minlength=capacity + 1)
        present = np.flatnonzero(counts)
        largest = int(present[-1])
        found = packing.fillings(present, counts, largest, capacity, 50)
        rest = [x for x in range(1, capacity + 1) for _ in range(int(counts[x]) - (x == largest))]
        sets = {tuple(sorted((x for i, x in enumerate(rest) if m >> i & 1), reverse=True)) for m in range(1 << len(rest))}
        fits = {s for s in sets if sum(s) <= capacity - largest}
        assert set(found) <= fits and sum(found[0]) == max(map(sum, fits))
        assert not any(packing.dominates(a, b) for i, b in enumerate(found) for a in found[:i])
        assert all(any(packing.dominates(a, s) for a in found) for s in fits) or len(found) == 50


def test_made_rows(spark, coder):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "Gamma.", "d'été", "42"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(500, None), (501, ""), (None, "no id"), (None, None), rows[5], rows[5], (5, "other"), (502, "long " * 3000)]
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id bigint, text string, length int, places string")
    check(packing.pack(docs, capacity=64).collect(), expected(coder, rows, 64), 64)


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query(spark, coder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(QUERIES["op7_best_fit_packing"](spark, SF).collect(), expected(coder, rows, 4096), 4096)
