"""Approximate nearest neighbours by cosine: cross-polytope hashing with multiprobe.

A unit vector is turned by a fast Hadamard pseudo-rotation (three times: random signs, then a Hadamard transform) and
hashed to its nearest signed axis; several such hashes make a bucket of one table. Every row stands in one bucket of
each table. A query looks into the buckets whose axes are nearest to its own vector, in order of the squared gaps; all
rows found there are ranked by their exact cosine, in blocks of bounded size.

How many probes are needed depends on the data: on a bounded sample of queries, whose true neighbours are found by one
pass over all rows, the fewest probes are chosen that reach the wanted recall, and the bucket width that makes them
cheapest. Probing every bucket of a table is among the choices and is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, stage
from .knn import _matrix
from .runs import runs

TABLES, RECALL, SAMPLE = 4, 0.95, 200
#: Most probes of a table; rows of a bucket on average at least; rows and queries of a bucket that meet in a task.
PROBES, FINEST, ROWS, QUERIES = 512, 256, 4096, 4096
#: Stands for no second id.
NONE = -(2**63)
#: What sending a query to one block of a bucket costs, in products of vectors.
SENDING = 1024


def fine(vector: Column) -> Column:
    """Not null and without null or non-finite components, and not all zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    return F.coalesce(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(wide, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two first, so that squares of very large or small components stay finite."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    x = np.ldexp(x, -power[:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Hadamard transform of each row, in d log d steps; d is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class Hashes:
    """Tables of cross-polytope hashes; ``axes`` lists how many turned coordinates each hash of a table looks at."""

    def __init__(self, width: int, axes: list[int], tables: int = TABLES, seed: int = 13):
        self.d = 1 << max(1, width - 1).bit_length()
        self.axes, self.tables = axes, tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 8, 3, self.d))
        self.buckets = math.prod(2 * m for m in axes)

    def turned(self, x: np.ndarray, table: int, number: int) -> np.ndarray:
        """Signed axes first to last: the products of the turned rows with them."""
        y = np.zeros((len(x), self.d))
        y[:, :x.shape[1]] = x
        for s in self.signs[table, number]:
            y = hadamard(y * s)
        y = y[:, :self.axes[number]]
        return np.concatenate([y, -y], axis=1)

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for j, m in enumerate(self.axes):
            code = code * (2 * m) + self.turned(x, table, j).argmax(axis=1)
        return code

    def probes(self, x: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` buckets nearest to each row, nearest first. Gaps add up over the hashes, so the best of k hashes begin with the best of k - 1."""
        out = []
        for a in range(0, len(x), 64):
            part = x[a:a + 64]
            code, cost = np.zeros((len(part), 1), np.int64), np.zeros((len(part), 1))
            for j, m in enumerate(self.axes):
                y = self.turned(part, table, j)
                gap = (y.max(axis=1)[:, None] - y) ** 2
                axis = np.argsort(gap, axis=1, kind="stable")[:, :most]
                cost = (cost[:, :, None] + np.take_along_axis(gap, axis, 1)[:, None]).reshape(len(part), -1)
                code = (code[:, :, None] * (2 * m) + axis[:, None]).reshape(len(part), -1)
                order = np.argsort(cost, axis=1, kind="stable")[:, :most]
                cost, code = np.take_along_axis(cost, order, 1), np.take_along_axis(code, order, 1)
            out.append(code)
        return np.concatenate(out) if out else np.zeros((0, 1), np.int64)


def _widths(d: int, rows: int):
    """Axes per hash of a table, coarsest first; each step doubles the buckets while they hold ``FINEST`` rows on average."""
    axes = [d]
    yield axes
    while math.prod(2 * m for m in axes) * 2 * FINEST <= rows and len(axes) < 8:
        axes = axes + [1] if axes[-1] == d else axes[:-1] + [axes[-1] * 2]
        yield axes


def plan(width: int, rows: int, asked: np.ndarray, near: list[np.ndarray], tables: int = TABLES, recall: float = RECALL) -> tuple[Hashes, int]:
    """Hashes and probes per table that find ``recall`` of the sample's true neighbours (``near`` of each ``asked``) at least cost."""
    total, best = sum(len(n) for n in near), None
    for axes in _widths(1 << max(1, width - 1).bit_length(), rows):
        made = Hashes(width, axes, tables)
        most = min(PROBES, made.buckets)
        # place of a neighbour's bucket in its query's order, in the table where it comes first
        place = np.full(total, most)
        for t in range(tables):
            order = made.probes(asked, t, most)
            code = made.codes(np.concatenate(near), t) if total else np.zeros(0, np.int64)
            same = np.repeat(order, [len(n) for n in near], axis=0) == code[:, None]
            place = np.minimum(place, np.where(same.any(axis=1), same.argmax(axis=1), most))
        needed = int(np.sort(place)[max(0, math.ceil(recall * total) - 1)]) + 1 if total else 1
        if needed > most:
            continue
        held = rows / made.buckets
        cost = needed * (SENDING * math.ceil(held / ROWS) + held)
        if best is None or cost < best[0]:
            best = cost, made, needed
    return best[1], best[2]


def nearest_neighbours(vectors: DataFrame, query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5,
                       tables: int = TABLES, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of greatest cosine found for every row for which ``query`` holds.

    A query's own rows (its id) are no answer; ties go to the smaller id. Rows without an id, and vectors null, zero or
    with a null or non-finite component, take no part; shorter vectors count as filled up with zeros. Equal vectors are
    indexed once, with their k + 1 least ids, which is all that an answer can need; repeated rows answer each. A
    repeated query id asks once, with its least vector. A query that finds fewer than k rows in its buckets searches
    all rows, so it gets k wherever there are as many. No rows: no rows.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("v"), F.coalesce(query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & fine(F.col("v")))

    def named(batches):
        """A digest of each vector's values (trailing zeros and the sign of zero do not count), and a number for the row."""
        import hashlib
        for batch in batches:
            v = batch.column("v")
            width = int(np.diff(v.offsets.to_numpy()).max(initial=0))
            x = _matrix(v, width) + 0.0
            name = [hashlib.sha256(r.tobytes().rstrip(b"\0")).digest() for r in x]
            yield pa.RecordBatch.from_arrays([batch.column("id"), v, batch.column("q"), pa.array(name, pa.binary())], names=["id", "v", "q", "name"])

    kind = rows.schema["v"].dataType.simpleString()
    rows = stage(rows.mapInArrow(named, f"id bigint, v {kind}, q boolean, name binary").withColumn("uid", F.monotonically_increasing_id()), folder, "rows")
    facts = rows.agg(F.max(F.size("v")), F.count_if("q")).first()
    if not facts[1]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width = facts[0]
    # per distinct vector its k + 1 least ids; ids of a vector are counted before they meet, and each task keeps its own k + 1
    ids = rows.groupBy("name", "id").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid"))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("r") <= k + 1)
    ids = ids.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("id", "n", "uid"))).alias("ids")).select(F.col("ids")[0]["uid"].alias("uid"), "ids")
    index = stage(rows.select("uid", "v").join(ids, "uid").select(
        "uid", "v", F.transform("ids", lambda x: F.struct(x["id"].alias("id"), x["n"].alias("n"))).alias("ids"), F.col("ids")[0]["id"].alias("first"),
        F.get("ids", F.lit(1))["id"].alias("second")), folder, "index")
    asked = stage(rows.where("q").groupBy("id").agg(F.min("v").alias("v")), folder, "asked")
    n = index.count()
    # at most ``sample`` queries
    drawn = asked.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    s_id = np.array([r["id"] for r in drawn], np.int64)
    s_unit = np.zeros((len(drawn), width))
    for i, r in enumerate(drawn):
        s_unit[i, :len(r["v"])] = r["v"]
    s_unit = unit(s_unit)

    def best(q_id, q, first, second, uid, x):
        """(query, score, uid, least id that is not the query's own) of the k best rows of each query, by score and id."""
        out = []
        for a in range(0, len(q), 512):
            score = q[a:a + 512] @ x.T
            least = np.broadcast_to(first, score.shape)
            own = least == q_id[a:a + 512, None]
            if own.any():
                least = np.where(own, second, first)
                score = np.where(least == NONE, -np.inf, score)
            m = min(k, score.shape[1])
            kth = np.partition(score, score.shape[1] - m, axis=1)[:, score.shape[1] - m]
            row, col = np.nonzero((score >= kth[:, None]) & (score > -np.inf))
            # the same pair has the same score wherever it meets, whatever the shape of the block
            exact = (q[a + row] * x[col]).sum(axis=1)
            order = np.lexsort((least[row, col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col = row[keep], col[keep]
            out.append((a + row, exact[keep], uid[col], least[row, col], col))
        return [np.concatenate(z) for z in zip(*out)] if out else [np.zeros(0, np.int64)] * 5

    def indexed(batch):
        return (batch.column("first").to_numpy(), batch.column("second").fill_null(NONE).to_numpy(), batch.column("uid").to_numpy(), unit(_matrix(batch.column("v"), width)))

    def against_sample(batches):
        for batch in batches:
            if batch.num_rows:
                row, score, uid, least, col = best(s_id, s_unit, *indexed(batch))
                yield pa.RecordBatch.from_arrays([pa.array(s_id[row]), pa.array(score), pa.array(least), batch.column("v").take(pa.array(col))], names=["query_id", "score", "least", "v"])

    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "least")
    true = index.mapInArrow(against_sample, f"query_id bigint, score double, least bigint, v {kind}")
    true = true.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("query_id", "v").collect()  # k rows a sampled query
    near = {int(i): [] for i in s_id}
    for r in true:
        near[r["query_id"]].append(list(r["v"]) + [0.0] * (width - len(r["v"])))
    hashes, probes = plan(width, n, s_unit, [unit(np.array(near[int(i)])) if near[int(i)] else np.zeros((0, width)) for i in s_id], tables, recall)

    def sizes(batches):
        """Rows per bucket of a task."""
        count = {}
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column("v"), width))
                for t in range(tables):
                    for code, m in zip(*(z.tolist() for z in np.unique(hashes.codes(x, t), return_counts=True))):
                        count[t, code] = count.get((t, code), 0) + m
                if len(count) > 100_000:
                    yield told(count)
                    count = {}
        yield told(count)

    def told(count):
        keys = list(count)
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int64()), pa.array([count[x] for x in keys], pa.int64())],
                                          names=["t", "bucket", "n"])

    def placed(batches):
        for batch in batches:
            x = unit(_matrix(batch.column("v"), width))
            at = np.arange(len(x))
            for t in range(tables):
                yield bucketed(batch, at, t, hashes.codes(x, t))

    def probed(batches):
        step = max(1, 65_536 // probes)
        for whole in batches:
            for batch in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                x = unit(_matrix(batch.column("v"), width))
                for t in range(tables):
                    code = hashes.probes(x, t, probes)
                    yield bucketed(batch, np.repeat(np.arange(len(x)), code.shape[1]), t, code.ravel())

    def bucketed(batch, at, t, code):
        rows = batch.take(pa.array(at))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(code), *rows.columns], names=["t", "bucket", *batch.schema.names])

    def solve(batches):
        for _, batch in runs(batches, ["t", "bucket", "part", "block"]):
            m = int((np.asarray(batch.column("kind")) == 0).sum())
            if 0 < m < batch.num_rows:
                ask, have = batch.slice(0, m), batch.slice(m)
                q_id = ask.column("uid").to_numpy()
                row, score, uid, least, _ = best(q_id, unit(_matrix(ask.column("v"), width)), *indexed(have))
                yield answer(q_id[row], uid, least, score)

    def answer(query_id, uid, least, score):
        return pa.RecordBatch.from_arrays([pa.array(query_id), pa.array(uid), pa.array(least), pa.array(score)], names=["query_id", "uid", "least", "score"])

    def met(look, members):
        """Queries and rows of equal buckets, in blocks: every part of a bucket's queries meets every part of its rows."""
        parts, blocks = F.coalesce("parts", F.lit(1)), F.coalesce("blocks", F.lit(1))
        members = members.select("t", "bucket", F.pmod(F.xxhash64("uid"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
                                 F.lit(1).alias("kind"), "uid", "first", "second", "v")
        look = look.select("t", "bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"),
                           F.lit(0).alias("kind"), F.col("id").alias("uid"), F.col("id").alias("first"), F.lit(None).cast("bigint").alias("second"), "v")
        both = look.unionByName(members).repartition("t", "bucket", "part", "block").sortWithinPartitions("t", "bucket", "part", "block", "kind")
        return both.mapInArrow(solve, "query_id bigint, uid bigint, least bigint, score double")

    def merged(met):
        """The k best vectors of each query; one that was met in several tables counts once."""
        once = met.groupBy("query_id", "uid").agg(F.min("least").alias("least"), F.max("score").alias("score"))
        return once.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r")

    # buckets beyond one block, of rows or of queries: split by a hash, each part of the queries meeting each of the rows
    wide = index.select("v").mapInArrow(sizes, "t int, bucket bigint, n bigint").groupBy("t", "bucket").agg(F.sum("n").alias("n"))
    wide = wide.select("t", "bucket", F.ceil(F.col("n") / ROWS).cast("int").alias("parts")).where("parts > 1")
    look = asked.select("id", "v").mapInArrow(probed, f"t int, bucket bigint, id bigint, v {kind}")
    crowd = asked.select("v").mapInArrow(_heads(hashes, probes, width, tables), "t int, bucket bigint, n bigint").groupBy("t", "bucket").agg(F.sum("n").alias("n"))
    crowd = crowd.select("t", "bucket", F.ceil(F.col("n") / QUERIES).cast("int").alias("blocks")).where("blocks > 1")
    split = stage(wide.join(crowd, ["t", "bucket"], "full").select("t", "bucket", F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("blocks", F.lit(1)).alias("blocks")), folder, "split")
    found = merged(met(look.join(split, ["t", "bucket"], "left"), index.select("uid", "v", "first", "second").mapInArrow(
        placed, f"t int, bucket bigint, uid bigint, v {kind}, first bigint, second bigint").join(split, ["t", "bucket"], "left")))
    answers = stage(_expanded(stage(found, folder, "found"), index, k), folder, "answers")
    # the buckets of these held fewer than k rows: all rows are searched
    short = asked.join(answers.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), F.col("id") == F.col("query_id"), "left").where(
        F.coalesce("n", F.lit(0)) < k).select("id", "v")
    short = stage(short, folder, "short")
    m = short.count()
    if m:
        one = [F.lit(-1).alias("t"), F.lit(0).cast("bigint").alias("bucket"), F.lit(math.ceil(n / ROWS)).alias("parts"), F.lit(math.ceil(m / QUERIES)).alias("blocks")]
        again = merged(met(short.select(*one, "id", "v"), index.select(*one, "uid", "v", "first", "second")))
        answers = answers.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_expanded(stage(again, folder, "again"), index, k))
    return answers


def _heads(hashes: Hashes, probes: int, width: int, tables: int):
    """Queries per bucket of a task."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column("v"), width))
                for t in range(tables):
                    code, n = np.unique(hashes.probes(x, t, probes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), t, np.int32)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["t", "bucket", "n"])
    return run


def _expanded(found: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Rows of the vectors found: every id but the query's own, as often as its row is repeated, the k first."""
    rows = found.join(index.select("uid", "ids"), "uid").select("query_id", "score", F.explode("ids").alias("x")).where("x.id <> query_id")
    rows = rows.select("query_id", F.col("x.id").alias("vec_id"), "score", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("x.n"), F.lit(k).cast("bigint")))).alias("i"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
