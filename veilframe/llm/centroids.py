"""Centroid clustering in exact integers, filtered by PCA-rotated coordinates.

A vector is stored with its leading coordinates along the principal axes of all vectors and the length of the rest. By
the triangle inequality the squared distance of two vectors is at least that of their leading coordinates plus the
squared difference of their rests, which bounds every centroid from below by one small product. Only centroids whose
bound does not exceed the exact distance of the first candidate are verified, in integers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, stage
from .knn import _matrix

WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
#: Coordinates kept of the rotated vectors.
LEADING = 24
#: Integer components stay below this, so that a squared distance fits in 62 bits.
LARGEST = 1 << 27
#: Vector and centroid pairs verified at a time.
PAIRS = 1 << 16
SPLIT = "cluster int, n bigint, s array<bigint>"


def whole(vector: Column, width: int, scale: int) -> Column:
    """floor(scale * x) of every component; null unless there are exactly ``width``, none of them null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = (F.size(vector) == width) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    beyond = F.raise_error(F.lit(f"a component times {scale} is not below {LARGEST}: squared distances would not fit")).cast("int")
    each = F.transform(wide, lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale).cast("int")).otherwise(beyond))
    return F.when(F.coalesce(fine, F.lit(False)), each)


def _moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of all vectors; a task sends 1 + width + width^2 sums, which Spark adds up by position."""
    def sums(batches):
        n, s, o = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            n, s, o = n + len(x), s + x.sum(axis=0), o + x.T @ x
        if n:
            value = np.concatenate([[float(n)], s, o.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], names=["i", "x"])

    told = rows.select("v").mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(1 + width + width * width)
    for r in told:
        flat[r["i"]] = r["x"]
    n = max(flat[0], 1.0)
    mean = flat[1:1 + width] / n
    return mean, flat[1 + width:].reshape(width, width) / n - np.outer(mean, mean)


def _distances(v: np.ndarray, centre: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact squared distances of the pairs (row, col), a bounded number of pairs at a time."""
    out = np.empty(len(row), np.int64)
    for a in range(0, len(row), PAIRS):
        gap = v[row[a:a + PAIRS]] - centre[col[a:a + PAIRS]]
        out[a:a + PAIRS] = (gap * gap).sum(axis=1)
    return out


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centre: np.ndarray, c_lead: np.ndarray,
            c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each vector's nearest centroid (ties: the smaller number), and how many were verified."""
    a, b = (lead ** 2).sum(axis=1), (c_lead ** 2).sum(axis=1)
    low = np.maximum(a[:, None] - 2 * lead @ c_lead.T + b, 0) + (rest[:, None] - c_rest) ** 2
    # leading coordinates are stored as floats of 24 bits: what that and the sums above may be off by
    low -= 4e-6 * ((a + rest ** 2)[:, None] + (b + c_rest ** 2)) + 1e-6
    at = np.arange(len(v))
    best = _distances(v, centre, at, low.argmin(axis=1))
    row, col = np.nonzero(low <= best[:, None])
    found = _distances(v, centre, row, col)
    # pairs come by row, then by number: the first of a row's least distances is that of the smallest number
    least = np.minimum.reduceat(found, np.searchsorted(row, at)) if len(v) else found
    first = np.flatnonzero(found == least[row])
    first = first[np.append(True, row[first][1:] != row[first][:-1])] if len(first) else first
    return col[first].astype(np.int32), least, len(row)


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
            width: int = WIDTH, scale: int = SCALE, leading: int = LEADING, salt: str = "2:") -> tuple[DataFrame, list]:
    """(vec_id, cluster, distance) of every vector as a written table, and the final centroids as lists of integers.

    Vectors of another length, null, or with a null or non-finite component take no part; components become
    floor(scale * x), an error where these are not below 2^27. The first centroids are the k vectors whose id has the
    least SHA-256 of ``salt`` and the id; equal ids by their components, rows without an id last. Each round assigns
    every vector to the nearest centroid, ties to the smaller number, and moves non-empty centroids to the exact floor
    of their mean. Repeated rows count each; fewer vectors than k: as many centroids. No vectors: no rows.
    """
    folder = shared_folder(vectors.sparkSession)
    rows = stage(vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), whole(F.col(f"`{vector}`"), width, scale).alias("v"))
                 .where("v IS NOT NULL"), folder, "vectors")
    name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    # k vectors at most
    centre = np.array([r["v"] for r in rows.withColumn("h", name).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()], np.int64)
    if not len(centre):
        return rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance").where("false"), []
    mean, spread = _moments(rows, width)
    axes = np.linalg.eigh(spread)[1][:, ::-1][:, :leading]

    def turned(x):
        gap = x - mean
        lead = gap @ axes
        return lead, np.sqrt(np.maximum((gap ** 2).sum(axis=1) - (lead ** 2).sum(axis=1), 0))

    def rotate(batches):
        for batch in batches:
            lead, rest = turned(_matrix(batch.column("v"), width))
            flat = pa.array(lead.astype(np.float32).ravel())
            ends = pa.array(np.arange(len(lead) + 1, dtype=np.int32) * axes.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(ends, flat), pa.array(rest)],
                                             names=["vec_id", "v", "lead", "rest"])

    rotated = stage(rows.mapInArrow(rotate, "vec_id bigint, v array<int>, lead array<float>, rest double"), folder, "rotated")

    def assigned(centre):
        c_lead, c_rest = turned(centre.astype(np.float64))

        def run(batch):
            v = _matrix(batch.column("v"), width).astype(np.int64)
            number, distance, _ = nearest(v, _matrix(batch.column("lead"), axes.shape[1]), np.asarray(batch.column("rest")), centre, c_lead, c_rest)
            return v, number, distance
        return run

    def totals(centre):
        run = assigned(centre)

        def add(batches):
            n, s = np.zeros(len(centre), np.int64), np.zeros(centre.shape, np.int64)
            for batch in batches:
                v, number, _ = run(batch)
                np.add.at(s, number, v)
                n += np.bincount(number, minlength=len(centre))
            at = np.flatnonzero(n)
            ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.ListArray.from_arrays(ends, pa.array(s[at].ravel()))],
                                             names=["cluster", "n", "s"])
        return add

    for _ in range(rounds):
        parts = rotated.mapInArrow(totals(centre), SPLIT).select("cluster", "n", F.posexplode("s").alias("i", "x"))
        # k * width rows: sums of sums, wider than 64 bits
        summed = parts.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x"), F.sum("n").alias("n")).collect()
        moved = centre.copy()
        for r in summed:
            moved[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
        if (moved == centre).all():
            break
        centre = moved

    def tell(batches):
        run = assigned(centre)
        for batch in batches:
            _, number, distance = run(batch)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return stage(rotated.mapInArrow(tell, "vec_id bigint, cluster int, distance bigint"), folder, "assigned"), centre.tolist()


def clustered(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 per vector of ``cluster``."""
    found, centres = cluster(vectors, **how)
    spark = found.sparkSession
    # as many rows as centroids
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    total = sum(sums.values())
    if total >= 1 << 63:
        raise OverflowError("the inertia does not fit in 64 bits")
    facts = [(i, sums.get(i, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia",
                                                            F.lit(total).cast("bigint").alias("inertia"), "centroid_sha256")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> str:
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT cluster, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS cluster FROM v)
WHERE cluster < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'cluster': cluster}}) AS m FROM (
SELECT rid, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN c{i}) GROUP BY rid)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.c, c.c) AS c FROM c{i} c LEFT JOIN (
SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
SELECT m.cluster AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, {width} + 1) r(i) GROUP BY ALL) GROUP BY cluster) n USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.m.cluster::INT AS cluster, a.m.d AS distance, sum(a.m.d) OVER (PARTITION BY a.m.cluster)::BIGINT AS cluster_inertia,
sum(a.m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.m.cluster = c.cluster"""
