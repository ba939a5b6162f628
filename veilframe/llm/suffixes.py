"""Repeated passages by a logarithmic family of sparse suffix arrays.

A suffix array of every byte of a corpus is many times its size. A repeat of ``length`` bytes needs only the
suffixes at *anchors*: the position of the least hash of a 32-byte gram among all grams of a window. The least gram
depends on the window's bytes alone, so equal windows have equal suffixes, and every window has one. Where the least gram
occurs more than once in a window (runs of one character, short periods) a place is chosen that many windows share, and
the suffix counts as one that occurs twice.
A suffix array here is the table of the anchors' suffixes in their order (first eight bytes, then a fingerprint of
the first 32), one row per distinct suffix. Each batch of documents gets one, is merged in one scan with every
existing level, and levels of equal rank are merged into the next, so a suffix is rewritten log2(batches) times.

Suffixes that occur twice are then settled exactly: consecutive windows with one anchor form a *span*; spans that
are equal as a whole repeat as a whole, and of the rest (the edges of repeats) every window is compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, row_key, shared_folder, slabs, stage, utf8

GRAM = 32
#: Columns that the result adds; input columns of these names give way to them.
RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
#: Bytes that are hashed at once; a longer document is a slab of its own.
SLAB = 1 << 20
#: Places of a block in which the windows of a periodic run share an anchor.
BLOCK = 128
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


#: One odd-looking 64-bit value per byte.
_BYTE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:len(values) - (width - have)], values[width - have:]) if have < width else values


class Slab:
    """Rolling hashes over some whole documents laid end to end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data, self.offsets, self.length, n = data, offsets, length, len(data)
        power = np.full(n + 1, _ODD, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        unit = np.uint64(pow(int(_ODD), -1, 1 << 64))
        self.back = np.full(n + 1, unit, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        self.value = _BYTE[data]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value * power[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from start to end, by content alone."""
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def spans(self):
        """(anchor, first window, last window, document, tied) of all spans, in the slab's positions.

        ``tied``: the least gram occurs again in one of the span's windows, so windows of one span may be equal.
        """
        n, length = len(self.data), self.length
        sizes = np.diff(self.offsets)
        empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
        if n < length or sizes.max() < length:
            return empty
        gram = self.value.copy()
        step, factor = 1, int(_ODD)
        while step < GRAM:
            gram = gram[:-step] * np.uint64(factor) + gram[step:]
            factor = factor * factor % (1 << 64)
            step *= 2
        gram = _mixed(gram)
        shift = np.uint64(max(20, int(n).bit_length()))
        places = (np.uint64(1) << shift) - np.uint64(1)
        place = np.arange(len(gram), dtype=np.uint64)
        high = gram & ~places
        at = (_least(high | place, length - GRAM + 1) & places).astype(np.int64)  # anchor of the window that starts here
        end = (places - (_least(high | (places - place), length - GRAM + 1) & places)).astype(np.int64)
        several = at != end
        # Where the least gram stands in several places: the first of them in the block of the last one, if it is there.
        row = np.flatnonzero(several)
        block = np.maximum(row, end[row] // BLOCK * BLOCK)
        other = at[np.minimum(block, len(at) - 1)]
        fits = (high[other] == high[at[row]]) & (other >= block) & (other <= end[row])
        at[row[fits]] = other[fits]
        doc = np.repeat(np.arange(len(sizes)), sizes)[:len(at)]
        inside = np.arange(len(at)) + length <= self.offsets[doc + 1]
        key = np.where(inside, at, -1)
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        ends = np.append(starts[1:], len(key)) - 1
        real = key[starts] >= 0
        tied = np.logical_or.reduceat(several, starts)[real]
        first, last = starts[real], ends[real]
        return key[first], first, last, doc[first], tied

    def suffix(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of suffixes: first eight bytes as a signed number, then a fingerprint of the first 32."""
        head = np.zeros(len(anchor), np.uint64)
        for k in range(8):
            head = (head << np.uint64(8)) | self.data[anchor + k].astype(np.uint64)
        return (head ^ np.uint64(1 << 63)).view(np.int64), self.hashes(anchor, anchor + GRAM).view(np.int64)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """One row per span of the documents (k1, k2, text)."""
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            k1, k2 = np.asarray(batch.column("k1")), np.asarray(batch.column("k2"))
            for a, b in slabs(offsets, SLAB):
                slab = Slab(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], length)
                anchor, first, last, doc, tied = slab.spans()
                if len(anchor):
                    head, tail = slab.suffix(anchor)
                    span = slab.hashes(first, last + length).view(np.int64)
                    base = slab.offsets[doc]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v) for v in (head, tail, span, k1[a + doc], k2[a + doc], (first - base).astype(np.int32),
                                               (last - base).astype(np.int32), tied)],
                        names=["head", "tail", "span", "k1", "k2", "p1", "p2", "tied"])

    return docs.select("k1", "k2", "text").mapInArrow(
        run, "head bigint, tail bigint, span bigint, k1 bigint, k2 bigint, p1 int, p2 int, tied boolean")


class SuffixLevels:
    """The index family. ``append`` takes a batch; ``repeated`` has every span whose suffix was seen twice so far.

    A level is a sorted array of distinct suffixes: head, tail, n (occurrences) and how many of them were new in the
    batch that made it.
    """

    def __init__(self, spark, folder: str | None = None, length: int = 200):
        self.spark, self.length = spark, length
        self.folder = folder or shared_folder(spark)
        self.levels: list[tuple[int, str, DataFrame]] = []
        self.anchors: list[tuple[str, DataFrame]] = []
        self.hits: list[DataFrame] = []
        self._names = 0

    def write(self, frame: DataFrame, kind: str) -> tuple[str, DataFrame]:
        self._names += 1
        name = f"{kind}-{self._names}"
        return f"{self.folder}/{name}", stage(frame, self.folder, name)

    def append(self, docs: DataFrame) -> None:
        """Index a batch (k1, k2, text): merge it with the levels of its rank, and scan the larger ones."""
        anchors = self.write(_anchors(docs, self.length), "anchors")
        self.anchors.append(anchors)
        rows, rank, old = anchors[1].select("head", "tail", F.when(F.col("tied"), 2).otherwise(1).alias("n"), F.lit(1).alias("fresh")), 0, []
        while self.levels and self.levels[-1][0] == rank:
            _, path, level = self.levels.pop()
            old.append(path)
            rows = rows.unionByName(level.select("head", "tail", "n", F.lit(0).alias("fresh")))
            rank += 1
        path, array = self.write(rows.groupBy("head", "tail").agg(F.sum("n").alias("n"), F.sum("fresh").alias("fresh"))
                                 .sortWithinPartitions("head", "tail"), "level")
        hits = array.where("fresh > 0 AND n > 1").select("tail")
        for _, _, level in self.levels:
            hits = hits.unionByName(array.where("fresh > 0").join(level.select("head", "tail"), ["head", "tail"]).select("tail"))
        self.hits.append(self.write(hits, "hits")[1])
        for path_ in old:
            discard(self.spark, path_)
        self.levels.append((rank, path, array))

    def repeated(self) -> DataFrame:
        """(tail, span, k1, k2, p1, p2, tied) of all spans whose suffix occurs more than once."""
        keys = union_all(self.hits).distinct()
        return union_all([a for _, a in self.anchors]).drop("head").join(keys, "tail", "left_semi")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def repeated_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 200, batches: int = 4,
                   keep_text: bool = False, group: int = 4096) -> DataFrame:
    """Every input row with n_bytes, n_removed, n_spans, kept_sha256 and ``spans`` (start, end of each removed run).

    A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too, in the same document or
    another (repeated rows are documents of their own). Null texts count as empty. ``keep_text`` replaces the
    text by what is left, in whole characters: one that is cut by a run's end stays. Suffixes with more than ``group``
    different spans are settled window by window in a shuffle of their own. No rows: no rows.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in (text, *RESULT)]
    names = [f"_c{i}" for i in range(len(others))]
    rows = docs.select(*row_key(f"`{doc_id}`", f"`{text}`"), F.coalesce(f"`{text}`", F.lit("")).alias("text"),
                       *[F.col(f"`{c}`").alias(n) for c, n in zip(others, names)])
    index = SuffixLevels(spark, length=length)
    for i in range(batches):
        index.append(rows.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(batches)) == i))

    spans = index.write(index.repeated(), "repeated")[1]
    for path, _ in index.anchors:
        discard(spark, path)
    counted = index.write(spans.groupBy("tail", "span").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("k1", "k2", "p1", "p2", "tied")]), "counted")[1]
    whole = spans.join(counted.where("n > 1").select("tail", "span"), ["tail", "span"], "left_semi").select(
        "k1", "k2", "p1", (F.col("p2") + length).alias("p2"))

    several = counted.groupBy("tail").agg(F.count(F.lit(1)).alias("s"), F.min("n").alias("least"),
                                          F.max("tied").alias("tied")).where("least = 1 AND (s > 1 OR tied)")
    edges = counted.join(several.select("tail", (F.col("s") > group).alias("hot")), "tail")
    marks = edges.groupBy(F.col("k1").alias("m1"), F.col("k2").alias("m2")).agg(
        F.collect_list(F.struct("p1", "p2", "tail", (F.col("n") == 1).alias("single"), "hot")).alias("marks"))
    same = (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2"))
    packed = _packed(rows.select("k1", "k2", "text"), ["k1", "k2"])
    pieces = index.write(packed.join(marks, same).drop("m1", "m2").mapInArrow(_pieces(length), PIECES), "pieces")[1]
    close = pieces.where("body IS NOT NULL").select("tail", "k1", "k2", "p1", "single", "body").repartition("tail").sortWithinPartitions(
        "tail").mapInArrow(_windows(length), "k1 bigint, k2 bigint, p1 int, p2 int")
    windows = pieces.where("body IS NULL").select("tail", "hash", "k1", "k2", "p1", "single")
    twice = windows.groupBy("tail", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tail", "hash")
    far = windows.where("single").join(twice, ["tail", "hash"], "left_semi").select("k1", "k2", "p1", (F.col("p1") + length).alias("p2"))
    runs = union_all([whole, close, far]).groupBy(F.col("k1").alias("m1"), F.col("k2").alias("m2")).agg(
        F.collect_set(F.struct("p1", "p2")).alias("runs"))  # rows of one key have the same runs: each is kept once
    runs = index.write(runs, "runs")[1]
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in names)
    done = _packed(rows, ["k1", "k2", *names]).join(runs, same, "left").drop("m1", "m2").mapInArrow(_finish(names, keep_text), own + ENDS)
    out = [F.col(n).alias(c) for c, n in zip(others, names)]
    return done.select(*out, *([F.col("kept").alias(text)] if keep_text else []), *RESULT)


ENDS = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,end:int>>, kept string"
PIECES = "tail bigint, hash bigint, k1 bigint, k2 bigint, p1 int, single boolean, body binary"
_ENDS = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _packed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The rows with their text compressed, for the shuffle."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            small = [pack.compress(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(small, pa.binary())], names=[*keep, "packed"])

    rows = rows.select(*keep, "text")
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, own + "packed binary")


def _pieces(length: int):
    """The bytes of every open span, or the hash of each of its windows if its suffix is a hot one."""
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k1, k2, packed, marks in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(),
                                             batch.column("packed").to_pylist(), batch.column("marks")):
                text, marks = unpack.decompress(packed), marks.values
                p1, p2, tail, single, hot = (marks.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                if not hot.all():
                    cold = ~hot
                    body = [text[a:b + length] for a, b in zip(p1[cold].tolist(), p2[cold].tolist())]
                    yield piece(k1, k2, tail[cold], np.zeros(len(body), np.int64), p1[cold], single[cold], body)
                if hot.any():
                    many = (p2 - p1 + 1)[hot].astype(np.int64)
                    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(p1[hot].astype(np.int64), many)
                    slab = Slab(np.frombuffer(text, np.uint8), np.array([0, len(text)]), length)
                    yield piece(k1, k2, np.repeat(tail[hot], many), slab.hashes(at, at + length).view(np.int64),
                                at.astype(np.int32), np.repeat(single[hot], many), [None] * len(at))

    def piece(k1, k2, tail, hash_, p1, single, body):
        n = len(tail)
        return pa.RecordBatch.from_arrays(
            [pa.array(tail), pa.array(hash_), pa.array(np.full(n, k1, np.int64)), pa.array(np.full(n, k2, np.int64)),
             pa.array(p1), pa.array(single.astype(bool)), pa.array(body, pa.binary())],
            names=["tail", "hash", "k1", "k2", "p1", "single", "body"])
    return run


def _windows(length: int):
    """Runs of windows of the single spans that another span of the same suffix has too. Rows come by suffix."""
    def run(batches):
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0]
            tail = np.asarray(now.column("tail"))
            changes = np.flatnonzero(tail[1:] != tail[:-1])
            cut_ = int(changes[-1]) + 1 if len(changes) else 0
            rest = now.slice(cut_)
            if cut_:
                yield from made(now.slice(0, cut_))
        if rest is not None and rest.num_rows:
            yield from made(rest)

    def made(rows):
        tail, k1, k2, p1 = (np.asarray(rows.column(n)) for n in ("tail", "k1", "k2", "p1"))
        single = rows.column("single").to_numpy(zero_copy_only=False)
        data, offsets = utf8(rows.column("body"))
        many = np.diff(offsets) - length + 1
        owner = np.repeat(np.arange(len(many)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        where = offsets[owner] + at
        hashes = Slab(data, offsets, length).hashes(where, where + length)
        group = np.cumsum(np.append(0, tail[1:] != tail[:-1]))[owner]
        order = np.lexsort((hashes, group))
        same = (hashes[order][1:] == hashes[order][:-1]) & (group[order][1:] == group[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[order] = np.append(same, False) | np.append(False, same)
        twice &= single[owner]
        owner, at = owner[twice], at[twice]
        if not len(at):
            return
        start = np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1))
        first, last = np.flatnonzero(start), np.append(np.flatnonzero(start)[1:] - 1, len(at) - 1)
        row = owner[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(k1[row]), pa.array(k2[row]), pa.array((p1[row] + at[first]).astype(np.int32)),
             pa.array((p1[row] + at[last] + length).astype(np.int32))], names=["k1", "k2", "p1", "p2"])
    return run


def union_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sorted disjoint runs that cover the given ones; touching runs become one."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return np.stack([start[new], np.append(end[np.flatnonzero(new)[1:] - 1], end[-1])], axis=1)


def cut(text: bytes, runs: np.ndarray, keep_text: bool) -> tuple:
    """n_bytes, n_removed, n_spans, digest, runs and, if wanted, the text that is left."""
    left, at = [], 0
    for a, b in runs.tolist():
        left.append(text[at:a])
        at = b
    left.append(text[at:])
    kept = b"".join(left)
    words = None
    if keep_text:
        left, at = [], 0
        for a, b in runs.tolist():
            while a < b and text[a] & 0xC0 == 0x80:  # the run begins inside a character: it stays whole
                a += 1
            while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                b -= 1
            left.append(text[at:a])
            at = b
        left.append(text[at:])
        words = b"".join(left).decode()
    return (len(text), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(kept).hexdigest(),
            [{"start": a, "end": b} for a, b in runs.tolist()], words)


def _ends(made: list) -> list[pa.Array]:
    columns = list(zip(*made)) if made else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(_ENDS), pa.string())
    return [pa.array(list(c), k) for c, k in zip(columns, kinds)]


def _finish(names: list[str], keep_text: bool):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        none = np.zeros(0, np.int64)
        for batch in batches:
            made = []
            for packed, runs in zip(batch.column("packed").to_pylist(), batch.column("runs")):
                start, end = (runs.values.field(i).to_numpy().astype(np.int64) for i in (0, 1)) if runs.is_valid else (none, none)
                made.append(cut(unpack.decompress(packed), union_of(start, end), keep_text))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + _ends(made),
                                             names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
    return run
