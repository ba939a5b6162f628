"""Quality by a regularised quadratic discriminant over document statistics.

Every text becomes a short vector of transformed statistics (logs of counts and shares). The labelled rows give each
class a mean and a covariance, shrunk towards its diagonal and towards the pooled one; the Cholesky factors are kept,
and a text's score is the logistic of the difference of its Mahalanobis log-densities plus that of the class shares.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, stage
from .toxicity import in_training, sigmoid

#: Statistics are kept in thousandths, so that their sums are exact in any order.
UNIT = 1000
NAMES = ("words", "word_length", "length_spread", "distinct", "repeats", "top_word", "symbols", "capitals", "digits", "stops",
         "odd_ends", "short_words", "line_words", "repeated_lines", "bars")
DIAGONAL, POOLED, RIDGE = 0.1, 0.05, 5e-2
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-"]] = True
_CAPITALS, _DIGITS, _STOPS = (np.zeros(256, bool) for _ in range(3))
_CAPITALS[65:91] = True
_DIGITS[48:58] = True
_STOPS[list(b".,;:!?")] = True
_ODD = re.compile(rb"[^A-Za-z0-9\x80-\xff.,;:?)'\"]$")


def _share(part: float, whole: float) -> float:
    """Log odds of a share, half a unit added to either side."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(len(raw), 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    known: dict[bytes, int] = {}
    for w in words:
        known[w] = known.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    most = max(known.values(), default=0)
    odd = sum(c for w, c in known.items() if _ODD.search(w))
    return [np.log1p(n), np.log1p(lengths.mean()) if n else 0.0, np.log1p(lengths.std()) if n else 0.0,
            _share(len(known), max(n, 1)), _share(same, max(n - 1, 1)), _share(most, max(n, 1)),
            _share(int(counts[_SYMBOLS].sum()), size), _share(int(counts[_CAPITALS].sum()), size),
            _share(int(counts[_DIGITS].sum()), size), _share(int(counts[_STOPS].sum()), size), _share(odd, max(n, 1)),
            _share(int((lengths <= 3).sum()), max(n, 1)), np.log1p(n / max(len(lines), 1)),
            _share(len(lines) - len(set(lines)), max(len(lines), 1)), _share(words.count(b"|"), max(n, 1))]


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns but the text, and ``_x``: the statistics in thousandths."""
    keep = [c for c in docs.columns if c != text]
    names = [f"_c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("_text"))

    def run(batches):
        for batch in batches:
            made = [np.rint(np.array(statistics(t)) * UNIT).astype(np.int32) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(made, pa.list_(pa.int32()))], names=[*names, "_x"])

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(run, own + "_x array<int>").toDF(*keep, "_x")


class Discriminant:
    """Means, inverse Cholesky factors and constants of both classes."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]]):
        width = len(NAMES)
        total = sum(n for n, _, _ in moments.values())
        spread = {c: (second - np.outer(first, first) / n) / n for c, (n, first, second) in moments.items()}
        pooled = sum(n * spread[c] for c, (n, _, _) in moments.items()) / max(total, 1)
        self.parts = {}
        for c, (n, first, _) in moments.items():
            own = (1 - POOLED) * spread[c] + POOLED * pooled
            own = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(own)) + RIDGE * np.eye(width)
            root = np.linalg.cholesky(own)
            self.parts[c] = (first / n, np.linalg.inv(root), np.log(n / total) - np.log(np.diag(root)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; a class without labelled rows has probability 0, and without any the score is 0.5."""
        if len(self.parts) < 2:
            return np.full(len(x), 0.5 if not self.parts else float(next(iter(self.parts))))
        density = {c: const - 0.5 * (((x - mean) @ back.T) ** 2).sum(axis=1) for c, (mean, back, const) in self.parts.items()}
        return sigmoid(density[1] - density[0])


def fit(measured_docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Discriminant:
    """Class moments over every labelled row outside of the held-out fold; a few hundred sums reach the driver."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("mark_id"), F.col(label).cast("int").alias("y")).where("y IN (0, 1)").where(in_training("mark_id"))
    # only the id and the statistics of a document: its other columns may have any name
    known = measured_docs.select(F.col(f"`{doc_id}`").alias("_id"), "_x")
    rows = known.join(marks, F.col("_id") == F.col("mark_id")).select("y", "_x")
    width = len(NAMES)

    def run(batches):
        sums = np.zeros((2, width + 1, width + 1), np.int64)
        for batch in batches:
            y = np.asarray(batch.column("y"))
            x = batch.column("_x").flatten().to_numpy().reshape(len(y), width).astype(np.int64)
            x = np.concatenate([np.ones((len(y), 1), np.int64), x], axis=1)
            for c in (0, 1):
                sums[c] += x[y == c].T @ x[y == c]
        flat = sums.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "v"])

    flat = np.zeros(2 * (width + 1) ** 2)
    for r in rows.mapInArrow(run, "cell bigint, v bigint").groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        flat[r["cell"]] = float(r["v"])
    moments = {}
    for c, square in enumerate(flat.reshape(2, width + 1, width + 1)):
        if square[0, 0]:
            moments[c] = (int(square[0, 0]), square[0, 1:] / UNIT, square[1:, 1:] / UNIT ** 2)
    return Discriminant(moments)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns but the text (``keep`` it in a join of your own), with held_out, score and predicted.

    The texts are read once; training and scoring share the staged statistics. A null text counts as an empty one, a null
    id is not held out and never labelled, repeated rows score alike. Input columns named like a result give way.
    No rows: no rows.
    """
    keep = [c for c in docs.columns if c not in ("_x", "held_out", "score", "predicted")]
    rows = stage(measured(docs.select(*[F.col(f"`{c}`") for c in keep]), doc_id, text), shared_folder(docs.sparkSession), "measured")
    return scored(rows, fit(rows, labels, doc_id), doc_id, threshold)


def scored(rows: DataFrame, model: Discriminant, doc_id: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    keep = [c for c in rows.columns if c != "_x"]
    held = F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    plain = rows.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], held.alias("held_out"), "_x")
    names = [f.name for f in plain.schema if f.name != "_x"]

    def run(batches):
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, len(NAMES)) / UNIT
            made = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(made), pa.array((made >= threshold).astype(np.int32))],
                                             names=[*names, "score", "predicted"])

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema if f.name != "_x")
    return plain.mapInArrow(run, own + "score double, predicted int").toDF(*keep, "held_out", "score", "predicted")
