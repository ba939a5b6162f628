"""Toxicity and quality: formulas against slow ones, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest

from veilframe.llm import quality, toxicity
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "x " * 30000), (4, "x " * 30000), (None, "no id"), (5, "ONE!! | two\nONE!! | two"), (6, "é 日本 ß")]


def frames(spark, labels):
    docs = spark.createDataFrame([(i, t, "z", 1, 0.5) for i, t in ODD], "doc_id bigint, text string, lang string, predicted int, _x double")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_risk_gradient():
    """A step of the trainer goes down the risk as it is defined, on either side of zero."""
    rng = np.random.default_rng(0)
    rows = [[np.sort(rng.choice(12, rng.integers(0, 6), replace=False)) for _ in range(n)] for n in (20, 50)]
    pos, unl = (toxicity.Sparse(r, 12) for r in rows)

    def risk(w, b, prior):
        s_p, s_u = pos.times(w) + b, unl.times(w) + b
        return prior * np.logaddexp(0, -s_p).mean() + max(0.0, np.logaddexp(0, s_u).mean() - prior * np.logaddexp(0, s_p).mean())
    # the gradient against differences: of the whole risk, or of the negated estimate where that is below zero
    for prior, shift in ((0.1, 0.0), (0.5, 1.0), (0.9, -2.0), (0.9, 4.0)):
        w, b = rng.normal(size=12), shift
        rest, grad = toxicity.risk_gradient(w, b, pos, unl, prior)

        def goal(t):
            s_p, s_u = pos.times(t[:12]) + t[12], unl.times(t[:12]) + t[12]
            left = np.logaddexp(0, s_u).mean() - prior * np.logaddexp(0, s_p).mean()
            return prior * np.logaddexp(0, -s_p).mean() + left if rest >= 0 else -left
        at = np.append(w, b)
        plain = [(goal(at + e) - goal(at - e)) / 2e-6 for e in np.eye(13) * 1e-6]
        assert np.allclose(grad, plain, atol=1e-6)
    assert rest < 0 or toxicity.risk_gradient(w, -9.0, pos, unl, 0.99)[0] < 0
    for prior in (0.1, 0.5):
        w, b = toxicity.train_nnpu(pos, unl, prior)
        assert risk(w, b, prior) < risk(np.zeros(12), np.log(prior / (1 - prior)), prior)


def test_prior_correction_finds_the_positives_of_the_unlabelled():
    """A tenth of the unlabelled rows are positives too; the model still calls them so."""
    rng = np.random.default_rng(1)
    toxic = lambda: np.unique(np.append(rng.integers(1, 60, 12), 0))
    clean = lambda: np.unique(rng.integers(1, 60, 12))
    pos = toxicity.Sparse([toxic() for _ in range(1500)], 60)
    unl = toxicity.Sparse([toxic() for _ in range(300)] + [clean() for _ in range(2700)], 60)
    w, b = toxicity.train_nnpu(pos, unl, 0.1)
    s = unl.times(w) + b
    assert (s[:300] > 0).mean() > 0.9 and (s[300:] > 0).mean() < 0.05


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(2)
    width, parts, moments = len(quality.NAMES), {}, {}
    for c, n in ((0, 80), (1, 300)):
        x = rng.normal(c, 1 + c, (n, width)) @ rng.normal(0, 1, (width, width))
        parts[c] = x
        moments[c] = (n, x.sum(axis=0), x.T @ x)
    model, total = quality.Discriminant(moments), 380
    spread = {c: np.cov(x.T, bias=True) for c, x in parts.items()}
    pooled = (80 * spread[0] + 300 * spread[1]) / total
    probe, logs = rng.normal(0, 2, (20, width)), {}
    for c, x in parts.items():
        own = (1 - quality.POOLED) * spread[c] + quality.POOLED * pooled
        own = (1 - quality.DIAGONAL) * own + quality.DIAGONAL * np.diag(np.diag(own)) + quality.RIDGE * np.eye(width)
        away = probe - x.mean(axis=0)
        logs[c] = np.log(len(x) / total) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(own), away)
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    assert np.allclose(model.scores(probe), want)


def test_odd_rows(spark):
    docs, labels = frames(spark, [(1, 0, 1), (3, 1, 0), (4, 1, None), (5, None, 1), (6, 1, 0), (None, 1, 1), (99, 0, 0), (6, 0, 0)])
    for got in (toxicity.score_documents(docs, toxicity.fit(docs, labels)), quality.score_quality(docs, labels)):
        rows = got.collect()
        assert len(rows) == len(ODD)
        for r in rows:
            assert r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1
        twins = [r["score"] for r in rows if r["doc_id"] == 4]
        assert twins[0] == twins[1]
    assert quality.score_quality(docs.drop("_x"), labels).columns == ["doc_id", "lang", "held_out", "score", "predicted"]


def test_no_labels_and_no_rows(spark):
    docs, labels = frames(spark, [(99, None, None)])
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels)).count() == len(ODD)
    assert {r["score"] for r in quality.score_quality(docs.select("doc_id", "text"), labels).collect()} == {0.5}
    assert quality.score_quality(docs.select("doc_id", "text").limit(0), labels).count() == 0
    assert toxicity.score_documents(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


@pytest.mark.parametrize("name,label,threshold,least", [("op3_toxicity", "toxic", 0.5, 0.8), ("op6_quality_classifier", "quality", 0.3, 0.95)])
def test_held_out_accuracy(spark, name, label, threshold, least):
    got = {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == fold(i) and r["predicted"] == int(r["score"] >= threshold) for i, r in got.items())
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(truth[i], got[i]["score"]) for i in truth if i in got and fold(i)]
    ones, zeros = [s for t, s in held if t == 1], [s for t, s in held if t == 0]
    assert len(ones) > 3 and len(zeros) > 3
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) > least


def test_scores_against_the_plain_formula(spark):
    """Each feature of a text counts once, whatever the number of words that have it."""
    texts = ["bad bad badly", "good", "", None, "the bad and the good", "x " * 5000 + "bad"]
    features = sorted({f for t in texts for w in toxicity.words_of(t) for f in toxicity.features_of(w)})
    rng = np.random.default_rng(5)
    model = toxicity.Model({f: float(x) for f, x in zip(features, rng.normal(size=len(features)))}, -0.3)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(frame, model).collect()}
    for i, t in enumerate(texts):
        found = {f for w in toxicity.words_of(t) for f in toxicity.features_of(w)}
        assert abs(got[i] - 1 / (1 + np.exp(0.3 - sum(model.weights[f] for f in found)))) < 1e-12


def test_hot_ids_do_not_grow_the_sample(spark):
    """An id of many rows brings no more texts to the driver than the parameters say."""
    docs = spark.createDataFrame([(3 if i % 2 else None, f"bad word{i}" if i % 2 else f"fine thing{i}") for i in range(3000)] + [(2, "fine words")] * 500 + [(i, "other") for i in range(100, 200)],
                                 "doc_id bigint, text string")
    labels = spark.createDataFrame([(3, 1), (2, 0), (100, 0), (101, 0)], "doc_id bigint, toxic int")
    seen = []
    real, toxicity.train_nnpu = toxicity.train_nnpu, lambda p, u, prior: seen.append((len(p.sizes), len(u.sizes))) or real(p, u, prior, rounds=5)
    try:
        toxicity.fit(docs, labels, positives=40, unlabelled=60)
    finally:
        toxicity.train_nnpu = real
    assert seen and seen[0][0] <= 40 and seen[0][1] <= 60


def test_quality_of_tables_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 9 + 1), 1, 2, 3) for i in range(1, 40)], "doc_id bigint, text string, y int, mark_id int, _id int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id bigint, quality int")
    got = quality.score_quality(docs, labels)
    assert got.count() == 39 and {"y", "mark_id", "_id"} <= set(got.columns)
