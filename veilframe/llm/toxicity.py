"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled, not clean. A linear model over word
features is trained by the non-negative risk: with class prior p and logistic loss,
p * E+[loss(s)] + max(0, Eu[loss(-s)] - p * E+[loss(-s)]). Where the bracket of a batch turns negative, its gradient is
taken back, which keeps the model from fitting the unlabelled sample's own positives.

Features are lower-case words and their beginnings, as presence in the whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, stage

#: Bounds of the training sample; beyond them the documents of least hash are taken.
POSITIVES, UNLABELLED = 6_000, 18_000
#: Features kept: those whose share differs most between the two samples, by so many standard errors or more, and of at
#: least so many rows.
FEATURES, ERRORS, LEAST = 5_000, 4.0, 5
#: Beginnings of words that count as features.
STEMS = (4, 5)
#: Distinct words whose features a task remembers.
WORDS = 300_000
_TOKEN = re.compile(r"[^\W\d_]+")


def in_training(doc_id: str = "doc_id") -> Column:
    """Rows from which labels may be learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def features_of(word: str) -> list[str]:
    """The word itself, marked as whole, and its beginnings."""
    return [f"{word}$", *(word[:k] for k in STEMS if len(word) >= k)]


def words_of(text: str | None) -> set[str]:
    return set(_TOKEN.findall(text.lower())) if text else set()


def presence(texts: DataFrame) -> DataFrame:
    """(kind, feature), each feature of a text once."""
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                some = batch.slice(k, 100)
                found = [{f for w in words_of(t) for f in features_of(w)} for t in some.column("text").to_pylist()]
                kinds = np.repeat(np.asarray(some.column("kind")), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([f for own in found for f in own], pa.string())], names=["kind", "feature"])
    return texts.select("kind", "text").mapInArrow(run, "kind int, feature string")


class Sparse:
    """Rows of feature numbers, with the two products that training needs."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.sizes = np.array([len(r) for r in rows])
        self.columns = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.width = width

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.columns], minlength=len(self.sizes))

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, values[self.row], minlength=self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def risk_gradient(w: np.ndarray, b: float, positive: Sparse, unlabelled: Sparse, prior: float) -> tuple[float, np.ndarray]:
    """Risk of the negatives, estimated as that of unlabelled text less the prior's share of positives, and the step's gradient.

    While that estimate is not negative the gradient is that of the whole risk; else of the negated estimate, which
    brings it back above zero (the non-negative correction). The last entry belongs to the bias.
    """
    n_p, n_u = max(len(positive.sizes), 1), max(len(unlabelled.sizes), 1)
    s_p, s_u = positive.times(w) + b, unlabelled.times(w) + b
    rest = float(np.logaddexp(0, s_u).sum() / n_u - prior * np.logaddexp(0, s_p).sum() / n_p)
    up_u, up_p = sigmoid(s_u) / n_u, -prior * sigmoid(s_p) / n_p
    if rest >= 0:
        g_p, g_u = up_p - prior * sigmoid(-s_p) / n_p, up_u
    else:
        g_p, g_u = -up_p, -up_u
    return rest, np.append(positive.back(g_p) + unlabelled.back(g_u), g_p.sum() + g_u.sum())


def train_nnpu(positive: Sparse, unlabelled: Sparse, prior: float, rounds: int = 300, rate: float = 0.05,
               decay: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk, by Adam with a falling rate over the whole sample.

    The weights' penalty is ``decay`` over the number of positives, so few positives give a cautious model.
    """
    width = positive.width
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    theta[width] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    for step in range(1, rounds + 1):
        _, grad = risk_gradient(theta[:width], theta[width], positive, unlabelled, prior)
        grad[:width] += decay / max(len(positive.sizes), 1) * theta[:width]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (1 - (step - 1) / rounds) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:width], float(theta[width])


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self, room: int = WORDS):
        """A function from texts to scores; a word's weight is looked up once."""
        known: dict[str, float] = {}
        get = self.weights.get

        def weigh(word: str) -> float:
            if word not in known:
                if len(known) >= room:
                    known.clear()
                known[word] = sum(get(f, 0.0) for f in features_of(word))
            return known[word]

        def score(text: str | None) -> float:
            words = words_of(text)
            # each feature once, though several words may begin alike
            total, seen = self.bias, set()
            for word in words:
                if weigh(word):
                    for f in features_of(word):
                        if f not in seen:
                            seen.add(f)
                            total += get(f, 0.0)
            return float(sigmoid(np.float64(total)))
        return score


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", positives: int = POSITIVES,
        unlabelled: int = UNLABELLED) -> Model:
    """Train on the toxic rows of ``labels`` and unlabelled text, both outside of the held-out fold.

    The class prior is the share of toxic rows among all labelled rows of the fold. Without a positive row the
    model is flat.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    order = F.xxhash64("id")
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).where(in_training("id"))
    marks = labels.select(F.col("doc_id").cast("bigint").alias("mark_id"), "toxic").where(in_training("mark_id"))
    counts = marks.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.count("toxic")).first()
    prior = (counts[0] or 0) / max(counts[1] or 0, 1)
    if not counts[0]:
        return Model({}, 0.0 if not counts[1] else float(np.log(1e-3)))
    toxic = marks.where("toxic = 1").select("mark_id").distinct().orderBy(F.xxhash64("mark_id")).limit(positives)
    texts = texts.withColumn("h", F.xxhash64("text"))

    def drawn(rows: DataFrame, most: int, kind: int) -> DataFrame:
        """Whole texts of at most ``most`` rows: ids may repeat, so rows are counted, equal ones once."""
        keys = rows.select("id", "h").distinct().orderBy(order, "id", "h").limit(most).select(F.col("id").alias("k_id"), F.col("h").alias("k_h"))
        # bounded by the parameter, so broadcast: no text is shuffled before it is drawn
        found = texts.join(F.broadcast(keys), (F.col("id") == F.col("k_id")) & (F.col("h") == F.col("k_h")), "left_semi")
        return found.dropDuplicates(["id", "h"]).select("id", "text", F.lit(kind).alias("kind"))

    some = drawn(texts.join(F.broadcast(toxic), texts.id == toxic.mark_id, "left_semi"), positives, 1)
    sample = stage(some.unionByName(drawn(texts, unlabelled, 0)), folder, "sample")
    sizes = {r["kind"]: r["n"] for r in sample.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0) + 1, sizes.get(0, 0) + 1
    found = presence(sample).groupBy("feature").agg(F.sum("kind").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    both = F.col("n") / (n1 + n0)
    apart = F.abs(F.col("a") / n1 - (F.col("n") - F.col("a")) / n0) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
    names = [r["feature"] for r in found.withColumn("z", apart).where(F.col("z") >= ERRORS).orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").collect()]
    number = {f: i for i, f in enumerate(names)}

    def columns(batches):
        for batch in batches:
            rows = [np.unique(np.array([number[f] for w in words_of(t) for f in features_of(w) if f in number], np.int32)).tobytes()
                    for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("id"), pa.array(rows, pa.binary())], names=["kind", "id", "row"])

    rows = sample.mapInArrow(columns, "kind int, id bigint, row binary").orderBy("kind", "id", "row").collect()  # the bounded sample
    by = {k: Sparse([np.frombuffer(r["row"], np.int32).astype(np.int64) for r in rows if r["kind"] == k], len(names)) for k in (0, 1)}
    weights, bias = train_nnpu(by[1], by[0], prior)
    return Model({f: float(w) for f, w in zip(names, weights) if w}, bias)


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. A null text scores as an empty one; the score reads the text
    alone, so repeated rows score alike; a null id is not held out. No rows: no rows."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
                       F.col(f"`{text}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # at most FEATURES weights

    def run(batches):
        score = Model(*shared.value).scorer()
        for batch in batches:
            made = np.array([score(t) for t in batch.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(made),
                                              pa.array((made >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
