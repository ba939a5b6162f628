"""Similarity digests from improbable features.

Every 64-byte window has an entropy; how often each entropy occurs in the corpus tells how improbable a window is.
In every 64 consecutive windows the most improbable one (the first of equals) scores, and windows that score often
are features. Features are hashed into a chain of Bloom filters of 2,048 bits with 160 features each.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slabs, utf8
from .suffixes import Slab

WINDOW = 64
NEIGHBOURS = 64
SCORE = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
BINS = 1001
SLAB = 1 << 18
_PLOGP = np.append(0.0, np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1)))
#: What the n-th equal byte adds to the sum of c log c, in 1/4096.
_STEP = np.append(0, np.rint(np.diff(_PLOGP) * 4096)).astype(np.int64)
_MOST = int(_STEP.sum())


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """Bin 0 (all bytes differ) to 1000 (all equal) of the window that starts at each byte."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    before, after = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    gained = np.cumsum(_STEP[before])
    lost = np.append(0, np.cumsum(_STEP[after]))
    return ((gained[WINDOW - 1:] - lost[:n - WINDOW + 1]) * (BINS - 1) // _MOST).astype(np.int16)


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy bin, rarest first, by its windows in all documents: 1,001 counts, whatever the input."""
    def run(batches):
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in slabs(offsets, SLAB):
                part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                bins = entropy_bins(part)
                counts += np.bincount(bins[_inside(at, len(bins))], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(counts)], names=["bin", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BINS, np.int64)
    for row in rows:
        counts[row["bin"]] = row["n"]
    ranks = np.empty(BINS, np.int64)
    ranks[np.lexsort((np.arange(BINS), counts))] = np.arange(BINS)
    return ranks


def _inside(offsets: np.ndarray, many: int) -> np.ndarray:
    """Which of the windows lie in one document."""
    ends = np.repeat(offsets[1:], np.diff(offsets))[:many]
    return np.arange(many) + WINDOW <= ends


def digests(texts: list[bytes], ranks: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(number of features, filters as rows of bytes) of every text."""
    offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = []
    for a, b in slabs(offsets, SLAB):
        out += _slab_digests(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], ranks)
    return out


def _slab_digests(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[tuple[int, np.ndarray]]:
    many, sizes = len(offsets) - 1, np.diff(offsets)
    bins = entropy_bins(data)
    first = offsets[:-1]
    docs, starts, ends = [], [], []
    if len(bins):
        owner = np.repeat(np.arange(many), sizes)[:len(bins)]
        inside = _inside(offsets, len(bins))
        order = np.where(inside, ranks[bins] << 32, 1 << 62) | np.arange(len(bins))
        low, have = order, 1
        while have < NEIGHBOURS and len(low) > have:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        # a run of NEIGHBOURS windows counts if all of them lie in its document
        scored = np.zeros(0, np.int64)
        if have == NEIGHBOURS:
            whole = np.arange(len(low)) + NEIGHBOURS + WINDOW - 1 <= offsets[1:][owner[:len(low)]]
            scored = np.bincount(low[whole] & 0xFFFFFFFF, minlength=len(bins))
            at = np.flatnonzero(scored >= SCORE)
            docs.append(owner[at])
            starts.append(at)
            ends.append(at + WINDOW)
        have_some = np.zeros(many, bool)
        for d in docs:
            have_some[d] = True
        # too short for a run: the most improbable window of all
        alone = np.flatnonzero(~have_some & (sizes >= WINDOW))
        if len(alone):
            best = np.array([int(order[first[i]:first[i] + sizes[i] - WINDOW + 1].min() & 0xFFFFFFFF) for i in alone])
            docs.append(alone)
            starts.append(best)
            ends.append(best + WINDOW)
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    docs.append(short)
    starts.append(first[short])
    ends.append(offsets[1:][short])
    docs, starts, ends = (np.concatenate(v).astype(np.int64) for v in (docs, starts, ends))
    hashes = Slab(data, offsets, WINDOW).hashes(starts, ends) if len(data) else np.zeros(0, np.uint64)
    # each feature of a document once, in the order of its first place
    order = np.lexsort((starts, hashes, docs))
    docs, starts, hashes = docs[order], starts[order], hashes[order]
    new = np.append(True, (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])) if len(docs) else np.zeros(0, bool)
    docs, starts, hashes = docs[new], starts[new], hashes[new]
    order = np.lexsort((starts, docs))
    docs, hashes = docs[order], hashes[order]
    counts = np.bincount(docs, minlength=many)
    begin = np.cumsum(counts) - counts
    filters = -(-counts // FILTER_FEATURES)
    base = np.append(0, np.cumsum(filters))
    bits = np.zeros((int(base[-1]), FILTER_BITS), np.uint8)
    row = base[docs] + (np.arange(len(docs)) - begin[docs]) // FILTER_FEATURES
    for k in range(HASHES):
        bits[row, (hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)] = 1
    packed = np.packbits(bits, axis=1)
    return [(int(counts[i]), packed[base[i]:base[i + 1]]) for i in range(many)]


def as_text(digest: tuple[int, np.ndarray]) -> str:
    return f"{digest[0]}:{base64.b64encode(digest[1].tobytes()).decode()}"


def from_text(text: str) -> tuple[int, np.ndarray]:
    count, _, body = text.partition(":")
    return int(count), np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, FILTER_BITS // 8)


def likeness(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> float:
    """0 to 1: the shared bits of the best matching filters beyond what chance gives, weighed by features.

    1 for equal digests, two empty ones included; 0 if only one is empty.
    """
    if x[0] == y[0] and np.array_equal(x[1], y[1]):
        return 1.0
    if not x[0] or not y[0]:
        return 0.0
    if y[0] < x[0]:
        x, y = y, x
    a, b = x[1].view(np.uint64), y[1].view(np.uint64)
    ones_a, ones_b = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = 0.0
    for i in range(len(a)):
        shared = np.bitwise_count(a[i] & b).sum(axis=1, dtype=np.int64)
        most = np.minimum(ones_a[i], ones_b)
        chance = ones_a[i] * ones_b / FILTER_BITS
        floor = chance + 0.3 * (most - chance)
        score = np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1)
        total += float(score.max()) * min(FILTER_FEATURES, x[0] - i * FILTER_FEATURES)
    return total / x[0]


def _spread(h: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which of so many equal ranges of 64-bit hashes each hash lies in, in the order of the signed hashes."""
    high = (h.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
    return ((high * parts.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def ranges(ids: np.ndarray, none: np.ndarray, h: np.ndarray, bounds: np.ndarray, nulls: int) -> np.ndarray:
    """Number of each row's range by id, then hash: an id that fills several ranges, or no id at all, is split by the hash."""
    values, times = np.unique(bounds, return_counts=True)
    # per value: ranges of its own if it is more than one bound, and one from it (or from behind it) to the next value
    own = np.where(times > 1, times, 0)
    first = nulls + np.append(0, 1 + np.append(0, np.cumsum(own + 1)[:-1])) if len(values) else np.array([nulls])
    at = np.searchsorted(values, ids, "right")
    wide, last = np.append(0, own)[at], np.append(np.iinfo(np.int64).min, values)[at]
    same = (wide > 0) & (ids == last)
    number = first[at] + np.where(same, _spread(h, np.maximum(wide, 1)), wide)
    return np.where(none, _spread(h, np.full(len(h), max(nulls, 1))), number)


def neighbours(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """(_bucket, _guest, _id, _h, _text) of all rows, ranges of ids in buckets; the first rows of a range also are
    guests at the end of the range before (of the last one: at the first). Null ids come before all others.

    Rows of one id follow one another by the hash of their text, so an id of many rows, or none, fills many ranges.
    """
    ids = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("_id"), F.coalesce(f"`{text}`", F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    shares = [k / buckets for k in range(1, buckets)]
    facts = ids.agg(F.count(F.lit(1)), F.count("_id"), F.percentile_approx("_id", shares, 10000) if shares else F.lit(None)).first()
    bounds = np.array(facts[2] or [], np.int64)
    nulls = -(-buckets * (facts[0] - facts[1]) // max(facts[0], 1))

    def numbers(s: pd.Series, h: pd.Series) -> np.ndarray:
        none = s.isna().to_numpy()
        return ranges(s.fillna(0).to_numpy(np.int64), none, h.to_numpy(np.int64), bounds, nulls)

    @F.pandas_udf("int")
    def bucket(s: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(numbers(s, h).astype(np.int32))

    rows = ids.select("_id", "_h").withColumn("b", bucket("_id", "_h")).groupBy("b").agg(
        F.min(F.struct(F.col("_id").isNotNull().alias("some"), "_id", "_h")).alias("m")).collect()
    least = {r["b"]: (r["m"]["_id"], r["m"]["_h"]) for r in rows}  # a row for each of a bounded number of ranges
    order = sorted(least)
    before = {b: order[k - 1] for k, b in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(s: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for i, x, b in zip(s.astype("object").where(s.notna(), None), h.tolist(), numbers(s, h).tolist()):
            out.append([b, before[b]] if (None if i is None else int(i), x) == least[b] else [b])
        return pd.Series(out)

    return ids.select(F.posexplode(places("_id", "_h")).alias("_guest", "_bucket"), "_id", "_h", "_text")


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Digest of every text and of its edited text, with their likeness, and the likeness to the next document's.

    Edited: the last half of the characters (rounded down) gives way to as many of the next document's first ones.
    Documents follow one another by id, then the hash of their text, then text; a null id comes first, and the last is
    followed by the first.
    A null text counts as empty; an empty text has no features. Other columns are not carried. No rows: no rows.
    """
    spark = docs.sparkSession
    buckets = buckets or min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranks = rarity(docs, text)
    rows = neighbours(docs, doc_id, text, buckets).repartition("_bucket").sortWithinPartitions("_bucket", "_guest", "_id", "_h", "_text")

    def run(batches):
        held = []  # the last row, whose next one is yet to come: bucket, guest, id, text, digest
        for batch in batches:
            own, guest, ids, texts = (batch.column(n).to_pylist() for n in ("_bucket", "_guest", "_id", "_text"))
            made = digests([t.encode() for t in texts], ranks)
            line = held + list(zip(own, guest, ids, texts, made))
            held = [line[-1]]
            yield from results(line)

    def results(line):
        pairs = [(a, b) for a, b in zip(line, line[1:]) if a[0] == b[0] and not a[1]]
        if not pairs:
            return
        edits = []
        for a, b in pairs:
            half = len(a[3]) // 2
            edits.append((a[3][:len(a[3]) - half] + b[3][:half]).encode())
        for k in range(0, len(pairs), 2000):
            some, changed = pairs[k:k + 2000], edits[k:k + 2000]
            other = digests(changed, ranks)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([a[2] for a, _ in some], pa.int64()),
                "n_chars": pa.array([len(a[3]) for a, _ in some], pa.int64()),
                "edited_sha256": [hashlib.sha256(e).hexdigest() for e in changed],
                "fingerprint": [as_text(a[4]) for a, _ in some],
                "edited_fingerprint": [as_text(o) for o in other],
                "near_edited": [likeness(a[4], o) for (a, _), o in zip(some, other)],
                "near_next": [likeness(a[4], b[4]) for a, b in some]})

    return rows.select("_bucket", "_guest", "_id", "_text").mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
