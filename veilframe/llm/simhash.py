"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints have 64 bits. The bits are grouped into parts, correlated bits together, and each part gets
its own threshold t_i >= -1 with sum(t_i + 1) = radius + 1: two fingerprints within the radius then differ
by at most t_i bits in at least one part. A dynamic program picks the thresholds, and the number of parts,
by the estimated work. Each fingerprint is indexed once by a part and probes its neighbours within t_i.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, shared_folder, stage

BITS = 64
#: Rows of one bucket that a task compares at once; larger buckets are compared block by block.
BLOCK = 4096
#: Fingerprints from which pair distances are estimated; only the plan depends on them, never the result.
SAMPLE = 2000
PAIRS_AT_ONCE = 2_000_000


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Majority of the XXH64 bits of all word shingles; no words: 0."""
    found = text.lower().split()  # bytes: A-Z only, and blanks are 20, 09-0D
    if not found:
        return 0
    line, starts, at = b" ".join(found), [], 0
    for word in found:
        starts.append(at)
        at += len(word) + 1
    ends = [s - 1 for s in starts[words:]] + [len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends)]
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.array(hashes[k:k + 65536], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, name: str = "fp") -> DataFrame:
    """All columns but the text, and the fingerprint as a signed bigint. Null text: as empty."""
    keep = [c for c in docs.columns if c != text]
    names = [f"_c{i}" for i in range(len(keep))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("_text"))

    def run(batches):
        for batch in batches:
            made = [fingerprint(t.encode() if t else b"", words) for t in batch.column("_text").to_pylist()]
            made = pa.array(np.array(made, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [made], names=[*names, "_fp"])

    from pyspark.sql.types import LongType, StructField, StructType
    schema = StructType([plain.schema[n] for n in names] + [StructField("_fp", LongType())])
    return plain.mapInArrow(run, schema).toDF(*keep, name)


# --- the plan ---------------------------------------------------------------------------------------


def bit_statistics(prints: DataFrame, fp: str = "fp") -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have both bit i and bit j: 4,096 sums, whatever the input."""
    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            n += len(values)
            for k in range(0, len(values), 65536):
                bits = np.unpackbits(values[k:k + 65536].copy().view(np.uint8).reshape(-1, 8), axis=1,
                                     bitorder="little").astype(np.float32)
                both += bits.T @ bits
        cells = np.append(both.astype(np.int64).ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    rows = prints.select(fp).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for row in rows:
        cells[row["cell"]] = row["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(both: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Equal parts; each grows from a seed by the bit most correlated with those it has."""
    share = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    tied = np.abs((both / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread))
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (tied[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def allocate(groups: list[list[int]], share: np.ndarray, sample: np.ndarray, total: int, radius: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = radius + 1 of least estimated work, by a dynamic program over the parts."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    work = []
    for group in groups:
        own = bits[:, group]
        apart = own @ (1 - own).T
        apart = np.rint(apart + apart.T)[np.triu_indices(len(own), 1)]
        differ = 2 * share[group] * (1 - share[group])
        exact = np.array([1.0])  # distribution of the distance, bits taken as independent
        for p in differ:
            exact = np.convolve(exact, [1 - p, p])
        costs = [0.0]
        for t in range(min(radius, 3) + 1):
            likely = max(exact[:t + 1].sum(), (apart <= t).mean() if len(apart) else 0.0)
            costs.append(40.0 * total * (ball(len(group), t) + 1) + likely * total * total / 2 * (1 if t == 0 else 2))
        work.append(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in work:
        best = {s: min(((best[s - k][0] + c, best[s - k][1] + [k - 1]) for k, c in enumerate(costs) if s - k in best),
                       default=(math.inf, [])) for s in range(radius + 2)}
    return best[radius + 1]


def plan(prints: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is used; a few thousand numbers reach the driver."""
    total, both = bit_statistics(prints)
    if not total:
        return []
    rows = prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
    share = np.diag(both) / total
    options = []
    for parts in range(1, radius + 2):
        groups = group_bits(both, total, parts)
        cost, limits = allocate(groups, share, sample, total, radius)
        if cost < math.inf:
            options.append((cost, [(g, t) for g, t in zip(groups, limits) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


# --- probing ----------------------------------------------------------------------------------------


def probes(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, probe): a row of probe 0 under its own key, rows of probe 1 under the keys nearby."""
    tables = []
    for bits, limit in parts:
        flips = [0]
        for k in range(1, limit + 1):
            flips += [sum(1 << b for b in some) for some in itertools.combinations(bits, k)]
        tables.append((np.uint64(sum(1 << b for b in bits)), np.array(flips, np.uint64)))

    def run(batches):
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            for i, (mask, flips) in enumerate(tables):
                step = max(1, 500_000 // len(flips))
                for k in range(0, len(values), step):
                    some = values[k:k + step]
                    keys = ((some & mask)[:, None] ^ flips[None, :]).ravel()
                    probe = np.broadcast_to(np.arange(len(flips)) > 0, (len(some), len(flips))).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)),
                         pa.array(np.repeat(some, len(flips)).view(np.int64)), pa.array(probe.astype(np.int8))],
                        names=["part", "key", "fp", "probe"])

    return prints.select("fp").mapInArrow(run, "part int, key bigint, fp bigint, probe tinyint")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reached) with the same components as the links a-b."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = index[:len(a)], index[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(keys: np.ndarray, fps: np.ndarray, probe: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int):
    """Star edges of the links within runs of equal keys. Rows of probe 0 come first in a run."""
    n = len(fps)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    base = np.flatnonzero((probe == 0) & (ends - np.arange(n) > 1))
    many = ends[base] - base - 1
    out_a, out_b, held = [], [], 0
    first = 0
    while first < len(base):
        sums = np.cumsum(many[first:first + PAIRS_AT_ONCE])
        last = first + max(1, int(np.searchsorted(sums, PAIRS_AT_ONCE, "right")))
        rows, counts = base[first:last], many[first:last]
        i = np.repeat(rows, counts)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        near = (np.bitwise_count(fps[i] ^ fps[j]) <= radius) & (fps[i] != fps[j])
        near &= (left[i] == right[j]) | (left[j] == right[i])  # blocks that meet here
        out_a.append(fps[i[near]])
        out_b.append(fps[j[near]])
        held += int(near.sum())
        if held > PAIRS_AT_ONCE:
            a, b = stars(np.concatenate(out_a), np.concatenate(out_b))
            out_a, out_b, held = [a], [b], len(a)
        first = last
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return stars(np.concatenate(out_a), np.concatenate(out_b))


def links(prints: DataFrame, radius: int = 4, block: int = BLOCK, parts: list | None = None) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints within the radius into the same components.

    A bucket of more than ``block`` rows is dealt into blocks and every two blocks meet in a task of their own;
    no pair is left out. A bucket gives fewer edges than it has members.
    """
    parts = plan(prints, radius) if parts is None else parts
    rows = probes(prints, parts)
    large = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(
        "part", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = rows.join(large, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A plain row meets the probes of every block and, once, the plain rows of every block.
    rows = rows.select("part", "key", "fp", "probe", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")
    rows = rows.repartition("part", "key", "x", "y").sortWithinPartitions("part", "key", "x", "y", "probe", "fp")

    def run(batches):
        rest: list[np.ndarray] | None = None
        for batch in batches:
            part, key, fp, probe, x, y, own = (np.asarray(batch.column(i)) for i in range(7))
            run_id = np.stack([part.astype(np.int64), key, x.astype(np.int64), y.astype(np.int64)], axis=1)
            other = np.where(own == x, y, x)
            now = [run_id, fp.view(np.uint64), probe, own, other]
            if rest is not None:
                now = [np.concatenate([p, q]) for p, q in zip(rest, now)]
            changes = np.flatnonzero((now[0][1:] != now[0][:-1]).any(axis=1))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            rest = [v[cut:] for v in now]
            if cut:
                yield from made([v[:cut] for v in now])
        if rest is not None and len(rest[0]):
            yield from made(rest)

    def made(now):
        run_id, fps, probe, own, other = now
        numbers = np.cumsum(np.append(0, (run_id[1:] != run_id[:-1]).any(axis=1)))
        a, b = _compare(numbers, fps, probe, own, other, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, words: int = 4,
                    carry: list[str] | None = None, root: bool = False) -> DataFrame:
    """doc_id (and ``carry``), fp and component_id: the smallest id reachable over links of at most ``radius`` bits.

    ``root`` adds the component's least fingerprint: it tells components apart where ids repeat or are missing. Carried
    columns named like a result give way.

    One row per input row. Null or empty texts have fingerprint 0 and are linked like any other. A null id never
    names a component unless the component has no other; repeated rows share their component. No rows: no rows.
    """
    folder = shared_folder(docs.sparkSession)
    made = {"fp", "component_id", *(["root"] if root else [])}
    keep = [F.col(f"`{c}`") for c in dict.fromkeys([doc_id, *(c for c in carry or [] if c not in made)])]
    rows = stage(fingerprints(docs.select(*keep, F.col(f"`{text}`").alias("_t")), "_t", words, "_fp"), folder, "prints")
    distinct = stage(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(doc_id).alias("least_id")), folder, "distinct")
    joined = components(links(distinct, radius), folder)
    roots = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = roots.join(names, "root").select(F.col("fp").alias("_key"), "component_id", *(["root"] if root else []))
    return rows.join(classes, F.col("_fp") == F.col("_key")).drop("_key").withColumnRenamed("_fp", "fp")
