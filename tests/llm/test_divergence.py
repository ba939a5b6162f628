"""Source divergence against sums over every pair of groups and every term."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from checks.compare import compare, duck
from veilframe.llm import divergence
from veilframe.llm.divergence import Tree, shares, source_divergence, walk
from veilframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def expected(docs):
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= 10)
        def share(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}
        own = {s: c for (g, s), c in groups.items() if g == lang}
        whole, p = share(sum(own.values(), Counter())), {s: share(c) for s, c in own.items()}
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(-((p[s][t] - whole[t]) ** 2 // (p[s][t] + whole[t])), t) for t in kept if own[s][t] > 0 and p[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, item) in enumerate(found)]
    return sorted(out)


def got(spark, docs):
    frame = spark.createDataFrame([(*d, 1, "a", 7, 8) for d in docs], "text string, lang string, source string, n bigint, term string, tile int, rank int")
    found = source_divergence(frame)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def made(rng, n, sources, words):
    out = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "de", None])
        out.append((" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30]))), lang, rng.choice(sources)))
    return out


@pytest.mark.parametrize("terms,band", [(1024, 1024), (3, 4), (7, 1)])
def test_against_all_pairs(spark, monkeypatch, terms, band):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "BAND", band)
    monkeypatch.setattr(divergence, "WALKED", 16 if band == 4 else 1 << 18)
    rng = random.Random(terms)
    words = ["The", "the", "été", "Été", "a", "b2c", "x-y", "zß", "日本", "don't", *(f"w{chr(97 + i)}" for i in range(20))]
    docs = made(rng, 260, ["s1", "s10", "s2", "", None, "Ä", "s3"], words)
    # a source of empty texts only, a language of one source, one without kept terms, repeated rows, control characters
    docs += [(None, "en", "silent"), ("", "de", "silent")] + [("one two two", "fr", "only")] * 12 + [("rare words", "es", "a"), ("seldom", "es", "b")]
    docs += [("A\x00b\x7fc\x1f[d]`e`{f}", "en", "s1")] * 11
    assert got(spark, docs) == expected(docs)


def test_no_and_empty_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, None, None)]) == []
    assert got(spark, [(None, None, None), ("", "", "b")]) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 64)
    monkeypatch.setattr(divergence, "HELD", 3)
    docs = [("alpha beta " * 5000 + "gamma", "en", s) for s in "ab"] + [("alpha", "en", "b")] * 9
    assert got(spark, docs) == expected(docs)


def test_ties_go_by_utf8(spark):
    docs = [("é z a", "en", s) for s in ("é", "z", "Z", "a", "😀")] * 3
    assert got(spark, docs) == expected(docs)


def test_shares_beyond_64_bits():
    count, total = np.array([3 * 10**12, 10**13 - 2, 0]), np.array([10**13, 10**13, 10**15])
    assert shares(count, total).tolist() == [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(count, total)]


def test_empty_quadrants_are_not_opened():
    """Two blocks of rows with counts in one corner only: the rest is priced from above."""
    row, col = np.array([0, 1, 4]), np.array([0, 1, 0])
    tree = Tree(row, col, np.array([5, 6, 7]), 3)
    leaves, priced = [], []
    walk(tree, 3, 0, 64, (8, 8), lambda a, b, c, *_: leaves.extend(zip(a, b, c)), lambda level, a, b, width: priced.extend(zip([level] * len(a), width)))
    assert {c for _, _, c in leaves} == {0, 1}
    assert sum(1 for level, _ in priced if level == 3) == 7  # columns 8 to 63, eight at a time


def test_query(spark):
    ok, n, m, note = compare(spark, duck(SF), SF, QUERIES["op12_source_divergence"], ORACLES["op12_source_divergence"])
    assert ok and n > 0, note
