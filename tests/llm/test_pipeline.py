"""Every stage of the pipeline against a plain version of it on its own input."""

import zlib
from collections import Counter

import numpy as np
import pytest
from .test_packing import expected as packed_pieces
from .test_simhash import classes, plain
from .test_suffixes import expected as cut_texts

import corpus_pipeline as pipeline
from veilframe.llm import mixing, quality
from veilframe.llm.common import vocabulary_path

SF = "/root/testdata/sf0.001"
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(9001, None, "en", None, 0), (9002, "", None, "src1", 0), (None, "a text without an id", "en", "src1", 20), (None, None, None, None, None),
       (9003, "twice the same row", "en", "src2", 18), (9003, "twice the same row", "en", "src2", 18), (9004, "long " * 20000, "en", "src3", 100000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(ODD, KIND)).cache()


def rows_of(frame):
    assert frame.columns == pipeline.COLUMNS
    return frame.collect()


def test_stages_are_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mixture", "packing"]


def test_quality(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    moments = {0: [], 1: []}
    for r in docs.collect():
        if r["doc_id"] is not None and labels.get(r["doc_id"]) is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            moments[labels[r["doc_id"]]].append(np.rint(np.array(quality.statistics(r["text"])) * 1000) / 1000)
    model = quality.Discriminant({c: (len(x), np.sum(x, axis=0), np.transpose(x) @ np.array(x)) for c, x in moments.items() if x})
    want = Counter(tuple(r) for r in docs.collect() if model.scores(np.rint(np.array([quality.statistics(r["text"])]) * 1000) / 1000)[0] >= 0.3)
    got = Counter(map(tuple, rows_of(pipeline.quality(spark, docs, SF))))
    assert got == want and 0.5 < sum(got.values()) / docs.count() < 1


def test_near_duplicates(spark, docs):
    rows = docs.collect()
    joined = classes([plain(r["text"]) for r in rows])
    ids = {}
    for r in rows:
        ids.setdefault(joined[plain(r["text"])], []).append(r["doc_id"])
    got = rows_of(pipeline.near_duplicates_stage(spark, docs, SF))
    assert sorted(str(min((i for i in own if i is not None), default=None)) for own in ids.values()) == sorted(str(r["doc_id"]) for r in got)
    assert set(map(tuple, got)) <= set(map(tuple, rows))


def test_repeats(spark, docs):
    rows = docs.collect()
    want = sorted((str(i), n - gone) for i, n, gone, _, _ in cut_texts([(r["doc_id"], r["text"]) for r in rows]))
    got = sorted((str(r["doc_id"]), len(r["text"].encode())) for r in rows_of(pipeline.repeats(spark, docs, SF)))
    assert len(got) == len(want) and all(a[0] == b[0] and 0 <= a[1] - b[1] <= 6 * 60 for a, b in zip(got, want))


def test_mixture(spark, docs):
    taken = {}
    for r in mixing.mix(docs).collect():
        taken.setdefault(r["doc_id"], []).append(r["taken"] / r["size"] if r["size"] else 0)
    times = Counter(r["doc_id"] for r in rows_of(pipeline.mixture(spark, docs, SF)))
    for i, shares in taken.items():
        if i not in (None, 9003):
            assert np.floor(shares[0]) <= times[i] <= np.ceil(shares[0])
    assert sum(times.values()) == pytest.approx(sum(map(sum, taken.values())), rel=0.1)


def test_packing(spark, docs):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    got = pipeline.packing(spark, docs, SF).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == packed_pieces(
        coder, [(r["doc_id"], r["text"]) for r in docs.collect()], 4096)


def test_run_and_no_rows(spark, docs):
    assert pipeline.run(spark, SF).count() > 50
    none = docs.limit(0)
    for _, step in pipeline.STAGES:
        assert step(spark, none, SF).count() == 0


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    def prose(seed, n=400):
        rng = np.random.default_rng(seed)
        return [f"w{k}" for k in rng.integers(0, 5000, n)]
    close, other = prose(3), prose(3)
    other[200] = "another"
    assert 0 < (plain(" ".join(close)) ^ plain(" ".join(other))).bit_count() <= 4
    texts = [(7, prose(1)), (7, prose(2)), (None, close), (None, other), (None, prose(4))]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "src1", 1) for i, t in texts], KIND)
    got = Counter((r["doc_id"], r["text"]) for r in rows_of(pipeline.near_duplicates_stage(spark, docs, SF)))
    assert sum(got.values()) == 4 and got[(7, " ".join(prose(1)))] == got[(7, " ".join(prose(2)))] == got[(None, " ".join(prose(4)))] == 1
    assert got[(None, " ".join(close))] + got[(None, " ".join(other))] == 1


def test_mixture_of_repeated_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(5, "ten words", "en", "src1", 9)] * 4 + [(6, None, "en", "src1", 0)], KIND)
    key = docs.selectExpr("doc_id", "xxhash64(text) AS h", "source").where("doc_id = 5").limit(1)
    made = key.selectExpr("*", "10L AS size", "explode(array(0L, 0L, 0L, 40L)) AS taken")
    monkeypatch.setattr(pipeline, "mix", lambda _: made)
    assert [r["doc_id"] for r in rows_of(pipeline.mixture(spark, docs, SF))] == [5] * 4
