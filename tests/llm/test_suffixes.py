"""Repeated bytes against a dictionary of all strings of 200 bytes."""

import hashlib
import random
from collections import Counter

import numpy as np

from veilframe.llm import suffixes
from veilframe.llm.queries import QUERIES
from veilframe.llm.suffixes import repeated_bytes

SF = "/root/testdata/sf0.001"


def expected(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in frame.collect()), key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def made():
    rng = random.Random(3)
    passages = [words(rng, n) for n in (30, 36, 40, 45, 60, 120)] + ["x" * 250, "ab" * 140, "z" * 199, "abc" * 130, "0123456789" * 40]
    rows = []
    for i in range(60):
        text = words(rng, rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            text = text[:at] + p[a:len(p) - rng.randint(0, 20)] + text[at:]
        rows.append((i, text))
    rows += [(100, rows[3][1]), (3, rows[3][1]), (3, "other text"), (101, None), (102, ""), (None, None), (None, rows[4][1]),
             (103, "y" * 5000), (104, words(rng, 30000)), (105, "q" * 200), (106, "q" * 199), (107, "w" * 201), (108, "é" * 150),
             (109, "mno" * 70), (110, "p" * 203 + "unlike anything else"), (111, "uvwxyz" * 40 + "!"), (112, words(rng, 10) + "k" * 400 + words(rng, 40)),
             (113, "klmnopqrstuvwxyzKLMNOPQRSTUVWXYZ-+" * 30), (114, "7" * 100 + "8" * 100 + "7" * 100 + "8" * 100)]
    return rows


def test_against_all_strings(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "a", 5) for i, t in rows], "doc_id bigint, text string, spans string, n_bytes int")
    assert got(repeated_bytes(docs.select("doc_id", "text"))) == expected(rows)
    for batches, group in ((1, 0), (5, 2)):
        assert got(repeated_bytes(docs.select("doc_id", "text"), batches=batches, group=group)) == expected(rows)


def test_runs_have_few_anchors():
    slab = suffixes.Slab(np.frombuffer(b"a" * 20000 + b"xy" * 5000, np.uint8), np.array([0, 20000, 30000]), 200)
    anchor, first, last, doc, tied = slab.spans()
    assert len(anchor) < 600 and tied.all() and (last - first + 1).sum() == 19801 + 9801


def test_clashing_names_are_kept(spark):
    docs = spark.createDataFrame([(1, "t" * 300, "k", 2, "n")], "doc_id bigint, text string, k1 string, marks int, n_bytes string")
    assert repeated_bytes(docs).select("k1", "marks", "n_removed", "n_bytes").collect()[0] == ("k", 2, 300, 300)


def test_no_rows(spark):
    assert repeated_bytes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_kept_text_has_whole_characters(spark):
    rng = random.Random(5)
    shared = words(rng, 80)
    rows = [(1, "é" + shared + "ü"), (2, "è" + shared + "ö"), (3, "a clean text")]
    kept = {r["doc_id"]: r["text"] for r in repeated_bytes(spark.createDataFrame(rows, "doc_id int, text string"), keep_text=True).collect()}
    assert kept == {1: "éü", 2: "èö", 3: "a clean text"}


def test_query_against_all_strings(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op4_suffix_dedup"](spark, SF)) == expected(rows)


def test_texts_of_one_32_bit_hash_without_ids(spark):
    from pyspark.sql import functions as F
    passage = " ".join(f"passage {k}" for k in range(30))
    rows = [(None, f"{passage} row 19260"), (None, "row 269669 " + "269669" * 60 + passage), (1, passage)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert docs.where("doc_id IS NULL").select(F.hash("text").alias("h")).distinct().count() == 1
    assert got(repeated_bytes(docs)) == expected(rows)


def test_copies_share_their_runs(spark, monkeypatch):
    from pyspark.sql import functions as F
    rows = [(7, words(random.Random(5), 100))] * 40
    most, write = [], suffixes.SuffixLevels.write

    def seen(self, frame, kind):
        out = write(self, frame, kind)
        if kind == "runs":
            most.append(out[1].agg(F.max(F.size("runs"))).first()[0])
        return out
    monkeypatch.setattr(suffixes.SuffixLevels, "write", seen)
    assert got(repeated_bytes(spark.createDataFrame(rows, "doc_id bigint, text string"))) == expected(rows)
    assert 0 < most[0] < 40
