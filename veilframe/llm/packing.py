"""Packing documents into sequences of fixed capacity by bin completion.

Pieces have whole lengths up to the capacity, so the problem is a histogram of at most ``capacity`` counts, however
many documents there are. The driver solves the histogram: a plan is a list of fillings with multiplicities. Bin
completion takes the largest length left, enumerates undominated fillings around it and searches depth first; a
branch ends when its waste leaves no room for fewer bins than the incumbent, which best-fit decreasing gives first.
Executors then deal the pieces: the r-th piece of a length goes to the r-th place that the plan has for it.
"""

from __future__ import annotations

import bisect
import itertools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, shared_folder, split_rank, stage, vocabulary_path

CAPACITY = 4096
#: Words whose ids a task keeps; the table starts again when it is full.
WORDS = 1_000_000
#: Nodes of the search. Each filling takes as many bins as the counts allow, so a plan has few nodes.
NODES = 6_000
#: Fillings tried at a node before the next one.
BREADTH = 6


# --- tokens -----------------------------------------------------------------------------------------


#: ASCII and the precomposed letters of Latin-1 and Latin Extended: there lower case, NFC and letters are plain.
_LATIN = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: The tokenizer's own split, fixed by its file, for such words.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u024f]+|[0-9]|[^a-z0-9\u00c0-\u024f]+")


def byte_letters() -> dict[int, int]:
    """Byte-level BPE writes every byte as a printable character: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


class WordIds(dict):
    """Ids of a word as bytes (unsigned little-endian 32 bits), computed once.

    The tokenizer drops white space and never joins text across it, so a text's ids are those of its words. Latin words
    go straight to its merges, part by part; all others through the whole tokenizer.
    """

    def __init__(self, path: str, room: int = WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.coder, self.room, self.letters = Tokenizer.from_file(path), room, byte_letters()
        self.merge = self.coder.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.room:
            self.clear()
        if word[-1:] in (b".", b",") and word[-2:-1].isalpha():  # ASCII letter before it: two tokens apart
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            text = word.decode()
            if _LATIN.fullmatch(text) and "<|" not in text:
                text = text.lower()
                ids = self._merged(text) if text.isalpha() else b"".join(map(self._merged, _SPLIT.findall(text)))
            else:
                ids = np.array(self.coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def _merged(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        made = [t.id for t in self.merge(part)]
        return struct.pack(f"<{len(made)}I", *made)

    def of(self, text: str) -> bytes:
        raw = text.encode()
        if b"<|" not in raw:  # the names of special tokens are told apart by case
            raw = raw.lower()
        return b"".join(map(self.__getitem__, raw.split()))


def pieces(docs: DataFrame, doc_id: str, text: str, path: str, capacity: int, end: int) -> DataFrame:
    """(k1, k2, doc_id, piece, start, length, ids_crc32): documents longer than the capacity are cut into full pieces."""
    width = 4 * capacity

    def run(batches):
        ids = WordIds(path)
        stop = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column("t").to_pylist()):
                body = (ids.of(t) if t else b"") + stop
                for k in range(0, len(body), width):
                    part = body[k:k + width]
                    rows.append(i)
                    piece.append(k // width)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).take(at) for n in ("k1", "k2", "doc_id")]
                + [pa.array(piece, pa.int32())] + [pa.array(v, pa.int64()) for v in (start, length, crc)],
                names=["k1", "k2", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(*row_key(f"`{doc_id}`", f"`{text}`"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"k1 bigint, k2 bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# --- the plan ---------------------------------------------------------------------------------------


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over the histogram: (multiplicity, lengths) of bins with equal fillings."""
    rooms: list[int] = []  # sorted rooms that some bin has left
    bins_of: dict[int, list[list]] = {}  # room left -> [bins, filling]

    def put(room: int, bins: int, filling: tuple) -> None:
        if room not in bins_of:
            bisect.insort(rooms, room)
            bins_of[room] = []
        bins_of[room].append([bins, filling])

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = min(capacity // length, left)
                put(capacity - each * length, left // each, (length,) * each)
                left %= each
                continue
            room = rooms[k]
            group = bins_of[room][-1]
            each = min(room // length, left)
            bins = min(group[0], left // each)
            left -= bins * each
            group[0] -= bins
            filling = group[1] + (length,) * each
            if not group[0]:
                bins_of[room].pop()
                if not bins_of[room]:
                    del bins_of[room]
                    rooms.pop(k)
            put(room - each * length, bins, filling)
    return [(bins, filling) for groups in bins_of.values() for bins, filling in groups]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by volume, and by the lengths that cannot share a bin."""
    lengths = np.arange(capacity + 1)
    best = -(-int((lengths * counts).sum()) // capacity)
    number, volume = np.cumsum(counts[::-1])[::-1], np.append(np.cumsum((lengths * counts)[::-1])[::-1], 0)
    for small in range(0, capacity // 2 + 1):
        large = int(number[capacity - small + 1]) if small else 0
        half = int(number[capacity // 2 + 1]) - large
        free = half * capacity - int(volume[capacity // 2 + 1] - volume[capacity - small + 1 if small else capacity + 1])
        rest = int(volume[small] - volume[capacity // 2 + 1]) - free
        best = max(best, large + half + max(0, -(-rest // capacity)))
    return best


def _sums(present: np.ndarray, counts: np.ndarray, largest: int, room: int) -> tuple[list[tuple[int, int, int]], int]:
    """Which sums up to ``room`` the pieces left can make, as the bits of a number; and before each length's turn, those of the shorter ones."""
    steps, sums, mask = [], 1, (1 << (room + 1)) - 1
    for length in present[present <= room].tolist():
        most = min(int(counts[length]) - (length == largest), room // length)
        if most > 0:
            steps.append((length, most, sums))
            twice, left = 1, most
            while left:
                take = min(twice, left)
                sums |= (sums << (length * take)) & mask
                twice, left = 2 * twice, left - take
    return steps, sums


def _exact(steps: list[tuple[int, int, int]], i: int, total: int):
    """All sets of parts that add up to ``total``, those with larger parts first; every branch taken ends in one."""
    if not total:
        yield ()
        return
    while i >= 0:
        length, most, before = steps[i]
        for n in range(min(most, total // length), 0, -1):
            if before >> (total - n * length) & 1:
                for rest in _exact(steps, i - 1, total - n * length):
                    yield (length,) * n + rest
        if not before >> total & 1:
            return
        i -= 1


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the parts of ``b`` fit into the parts of ``a``, tried by best fit: then whatever ``b`` leaves is no easier to pack."""
    rooms = sorted(a)
    for part in b:
        k = bisect.bisect_left(rooms, part)
        if k == len(rooms):
            return False
        bisect.insort(rooms, rooms.pop(k) - part)
    return True


def fillings(present: np.ndarray, counts: np.ndarray, largest: int, capacity: int, breadth: int) -> list[tuple[int, ...]]:
    """Undominated completions of a bin that holds the largest length, of any number of parts, least waste first.

    The sums that the pieces left can make are known before any set is built, so only sets that reach a wanted sum are
    visited: of the fullest bin first, those with larger parts first, then of the next fuller one.
    """
    room = capacity - largest
    steps, sums = _sums(present, counts, largest, room)
    found: list[tuple[int, ...]] = []
    tried = 0
    while sums and len(found) < breadth and tried < 8 * breadth:
        total = sums.bit_length() - 1
        sums ^= 1 << total
        for parts in itertools.islice(_exact(steps, len(steps) - 1, total), 4 * breadth):
            tried += 1
            if not any(dominates(f, parts) for f in found):
                found.append(parts)
                if len(found) == breadth:
                    break
    return found


def complete(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES, breadth: int = BREADTH) -> list[tuple[int, tuple[int, ...]]]:
    """Fillings with multiplicities that hold every piece, in as few bins as the search finds."""
    counts = counts.astype(np.int64).copy()
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(n for n, _ in best)
    total = int((np.arange(capacity + 1) * counts).sum())
    stack: list[tuple[list, np.ndarray, int, int]] = [([], counts, 0, 0)]  # choices yet to try at each depth
    chosen: list[tuple[int, tuple[int, ...]]] = []
    seen = 0
    frames: list[list] = []

    def options(state: np.ndarray) -> list[tuple[int, ...]]:
        present = np.flatnonzero(state)
        largest = int(present[-1])
        return [(largest, *f) for f in fillings(present, state, largest, capacity, breadth)]

    state, waste, bins = stack[0][1], 0, 0
    while fewest > bound and seen < nodes:
        seen += 1
        if not state.any():
            if bins < fewest:
                best, fewest = list(chosen), bins
            back = True
        else:
            # a bin saved must come from waste: total + waste so far must fit one bin less than the incumbent has
            back = -(-(total + waste) // capacity) >= fewest
            if not back:
                frames.append([state, waste, bins, options(state), 0])
        while frames:
            frame = frames[-1]
            if frame[4] < len(frame[3]):
                break
            frames.pop()
            del chosen[len(frames):]
        if not frames:
            break
        frame = frames[-1]
        del chosen[len(frames) - 1:]
        filling = frame[3][frame[4]]
        frame[4] += 1
        parts, need = np.unique(np.array(filling), return_counts=True)
        times = int((frame[0][parts] // need).min())
        state = frame[0].copy()
        state[parts] -= times * need
        waste = frame[1] + times * (capacity - sum(filling))
        bins = frame[2] + times
        chosen.append((times, filling))
    return best


# --- dealing the pieces -----------------------------------------------------------------------------


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY,
         end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A row's ids are its text's, then ``end``; a null or empty text is the end id alone. Repeated rows are packed each.
    Other columns are not carried. No rows: no rows. The tokenizer's file is read on every executor from ``path``.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    made = stage(pieces(docs, doc_id, text, path or vocabulary_path("word_bpe_49k.json"), capacity, end), folder, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    places, first, used = [], 0, np.zeros(capacity + 1, np.int64)
    for times, filling in complete(counts, capacity):
        at = 0
        parts, need = np.unique(np.array(filling), return_counts=True)
        for length, each in zip(parts.tolist(), need.tolist()):
            # ranks from ``rank`` on: ``each`` of every sequence of this filling
            places.append((length, int(used[length]), int(used[length]) + times * each, each, first, at))
            used[length] += times * each
            at += length * each
        first += times
    if (used != counts).any():
        raise RuntimeError("the plan does not hold every piece once")
    plan = spark.createDataFrame(places or [], "length bigint, low bigint, high bigint, each bigint, first bigint, at bigint")
    plan = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "each", "first", "at"))).alias("places"))
    ranked = split_rank(made, ["length"], ["k1", "k2", "piece"])
    found = F.expr("element_at(filter(places, p -> p.low <= rank AND rank < p.high), 1)")
    # at most ``capacity`` lengths, and places bounded by the plan's nodes: the plan is small whatever the input
    placed = ranked.join(F.broadcast(plan), "length").withColumn("p", found).withColumn("r", F.col("rank") - F.col("p.low"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("p.first") + F.expr("r DIV p.each")).alias("sequence_id"),
                         (F.col("p.at") + F.expr("r % p.each") * F.col("length")).alias("offset"))
