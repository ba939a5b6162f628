"""Exact top-k inner products by a Voronoi join.

Inner products become distances: a row x gets one more coordinate sqrt(M^2 - |x|^2), a query 0, so the nearest rows
are those of greatest product. Pivots cut the space into cells. Each cell of rows is summarised by its radii and its
few smallest distances to the pivot, each group of queries by its radius; from these a group's bound on the k-th
distance follows, and with it the ring of every cell that may hold an answer. Only those rows are sent to the group,
dealt over many tasks by their hash; each task solves its part, and a query's best rows are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, stage

SCALE = 1024
PIVOTS = 64
#: Rows that meet one block of queries in a task.
ROWS_PER_BLOCK = 65_536
QUERIES_PER_BLOCK = 4_096


def scaled(vector: Column) -> Column:
    """floor(1024 * x) of every component; null if the vector is null or any component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(wide, lambda x: F.floor(x * SCALE)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows as float64, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def top_products(vectors: DataFrame, query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10,
                 pivots: int = PIVOTS, groups: int = 16) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest integer products of every row for which ``query`` holds.

    A query's own row (its id) is no answer; ties go to the smaller id. Rows without an id, and vectors null or with
    a null or non-finite component, take no part; shorter vectors count as filled up with zeros. Repeated rows answer
    each; a repeated query id asks once, with its least vector. Fewer rows than k: all. No rows: no rows.
    Scores are exact: where a product may reach 2^53 they are summed in 64-bit integers, and where one may not fit in
    those (a squared length of 2^63 or more) the call is an error.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), scaled(F.col(f"`{vector}`")).alias("v"),
                          F.coalesce(query, F.lit(False)).alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = stage(rows.withColumn("s", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), folder, "rows")
    facts = rows.agg(F.max(F.size("v")), F.max("s"), F.sum(F.when(F.col("q"), 1)), F.count(F.lit(1))).first()
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not facts[2]:
        return spark.createDataFrame([], empty)
    width, top, n_queries, n_rows = facts[0], facts[1], facts[2], facts[3]
    # no product is greater than the greatest squared length, of which the sum above may be off by a rounding
    if top >= 2.0 ** 63 * (1 - 1e-9):
        raise OverflowError(f"products of these vectors may not fit in 64 bits: a squared length is about {top:.3g}")
    wide = top >= 2.0 ** 53 * (1 - 1e-9)
    none = np.iinfo(np.int64).min if wide else -np.inf
    # the vectors of the least hashes: only hashes are made distinct, not vectors; at most ``pivots`` of them
    least = rows.select(F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(pivots)
    sample = rows.select("v", "s", F.xxhash64("v").alias("h")).join(F.broadcast(least), "h").groupBy("h").agg(F.min(F.struct("v", "s")).alias("m")).select("m.*").collect()
    centre = np.zeros((len(sample), width + 1))
    for i, r in enumerate(sample):
        centre[i, :len(r["v"])] = r["v"]
        centre[i, width] = math.sqrt(top - r["s"])

    def cells(batches):
        norms = (centre ** 2).sum(axis=1)
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            s = np.asarray(batch.column("s"))
            lift = np.sqrt(np.maximum(top - s, 0))
            row = np.maximum(top - 2 * (x @ centre[:, :width].T + np.outer(lift, centre[:, width])) + norms, 0)
            cell = row.argmin(axis=1)
            ask = np.maximum(s[:, None] - 2 * x @ centre[:, :width].T + norms, 0)
            home = ask.argmin(axis=1)
            at = np.arange(len(cell))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("id", "v", "q")] + [pa.array(cell.astype(np.int32)), pa.array(np.sqrt(row[at, cell])),
                 pa.array(home.astype(np.int32)), pa.array(np.sqrt(ask[at, home]))], names=["id", "v", "q", "cell", "far", "home", "away"])

    placed = stage(rows.mapInArrow(cells, "id bigint, v array<bigint>, q boolean, cell int, far double, home int, away double"), folder, "placed")
    near = Window.partitionBy("cell").orderBy("far")
    # An id counts once, wherever it is nearest to its pivot: of k + 1 ids at most one is a query's own, however many rows
    # it has. Of each pivot k + 1 distances; each task keeps its own k + 1 first.
    once = placed.groupBy("id").agg(F.min(F.struct("far", "cell")).alias("m")).select("m.*")
    kept = once.groupBy("cell", "far").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    summary = {}
    for r in kept.groupBy("cell").agg(F.collect_list(F.struct("far", "n")).alias("least")).collect():
        summary[r["cell"]] = sorted((x["far"], x["n"]) for x in r["least"])
    asked = {r["home"]: r["away"] for r in placed.where("q").groupBy("home").agg(F.max("away").alias("away")).collect()}

    apart = np.sqrt(np.maximum(((centre[:, None] - centre[None]) ** 2).sum(axis=2), 0))
    # queries of one pivot form a group; groups beyond the allowed number join the nearest larger one
    order = sorted(asked, key=lambda g: -asked[g])
    heads = order[:groups]
    member = {g: g if g in heads else min(heads, key=lambda h: apart[g, h]) for g in order}
    radius = {h: max(asked[g] + apart[g, h] for g in order if member[g] == h) for h in heads}
    slack = 1e-6 * (1 + math.sqrt(top))
    rings = []
    for h in heads:
        upper = sorted((radius[h] + apart[h, c] + far, n) for c, least in summary.items() for far, n in least)
        have, bound = 0, math.inf
        for distance, n in upper:
            have += n
            if have > k:
                bound = distance
                break
        reach = bound + radius[h] + slack
        for c in range(len(sample)):
            low, high = apart[h, c] - reach, apart[h, c] + reach
            rings.append((c, h, float(low), float(high)))
    ring = spark.createDataFrame(rings, "cell int, home int, low double, high double").groupBy("cell").agg(
        F.collect_list(F.struct("home", "low", "high")).alias("rings"))
    parts = max(1, math.ceil(n_rows / ROWS_PER_BLOCK))
    blocks = max(1, math.ceil(n_queries / QUERIES_PER_BLOCK))
    data = placed.join(ring, "cell").withColumn("g", F.explode(F.expr("filter(rings, r -> r.low <= far AND far <= r.high)"))).select(
        F.col("g.home").alias("grp"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "v")
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else data.withColumn("block", F.lit(0))
    names = F.create_map(*[F.lit(x) for g, h in member.items() for x in (g, h)])
    ask = placed.where("q").groupBy("id").agg(F.min(F.struct("v", "home")).alias("m")).select("id", "m.*").select(names[F.col("home")].alias("grp"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    ask = ask.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = ask.select("grp", "part", "block", F.lit(0).alias("kind"), "id", "v").unionByName(
        data.select("grp", "part", "block", F.lit(1).alias("kind"), "id", "v"))
    both = both.repartition("grp", "part", "block").sortWithinPartitions("grp", "part", "block", "kind", "id")

    def solve(batches):
        where, ids, vecs, best = None, [], [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(n)) for n in ("grp", "part", "block")], axis=1)
            kind, own = np.asarray(batch.column("kind")), np.asarray(batch.column("id"))
            x = _matrix(batch.column("v"), width)
            x = x.astype(np.int64) if wide else x
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            for a, b in zip(cuts, np.append(cuts[1:], len(key))):
                here = tuple(key[a])
                if here != where:
                    yield from told(ids, best)
                    where, ids, vecs, best = here, [], [], None
                m = a + int((kind[a:b] == 0).sum())
                if m > a:
                    ids.append(own[a:m])
                    vecs.append(x[a:m])
                if b > m and ids:
                    if len(ids) > 1:
                        ids, vecs = [np.concatenate(ids)], [np.concatenate(vecs)]
                    best = better(ids[0], vecs[0], own[m:b], x[m:b], best)
        yield from told(ids, best)

    def better(q_ids, q, r_ids, r, best):
        """The k best of the rows so far for each query: scores and ids, worst first left out by (-score, id)."""
        for a in range(0, len(r), 4096):
            score = q @ r[a:a + 4096].T
            ids = np.broadcast_to(r_ids[a:a + 4096], score.shape)
            score = np.where(ids == q_ids[:, None], none, score)
            if best is not None:
                score, ids = np.concatenate([best[0], score], axis=1), np.concatenate([best[1], ids], axis=1)
            # a place without a row sorts last: its score has no negative in integers
            order = np.lexsort((ids, np.where(score == none, np.iinfo(np.int64).max, -score) if wide else -score), axis=1)[:, :k] if score.shape[1] <= 64 else _best(score, ids, k)
            best = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        return best

    def told(ids, best):
        if best is not None:
            q = np.repeat(ids[0], best[0].shape[1])
            score, row = best[0].ravel(), best[1].ravel()
            real = score > none
            yield pa.RecordBatch.from_arrays([pa.array(q[real]), pa.array(row[real]), pa.array(score[real].astype(np.int64))],
                                             names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best by (-score, id): those above the k-th score, then the smallest ids of its ties."""
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    out = np.empty((len(score), k), np.int64)
    for i in range(len(score)):
        at = np.flatnonzero(score[i] >= kth[i])
        out[i] = at[np.lexsort((ids[i, at], -score[i, at]))[:k]]
    return out


def oracle(k: int = 10) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM t WHERE rank <= {k}"""
