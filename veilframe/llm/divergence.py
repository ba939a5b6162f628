"""Source divergence: how far the term distributions of a language's sources lie apart, by a quadtree over group x term counts.

Terms of a language are dealt into tiles; a task holds a tile's counts of all groups as K-squared quadtrees (K = 2): per
level the sorted codes of the quadrants that hold a count at all. Two row blocks are walked down jointly over the same
columns. Where both quadrants are empty, every pair's smoothed shares are constants of the two groups, so the columns
are only counted and priced once at the end; at the leaves at least one of the two counts is there. The language's own
totals stand in the tree as one more row, and the leaves shared with it give each group's leading terms.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, stage
from .runs import runs

UNIT, SMOOTH, LEAST_DOCUMENTS, LEADING = 10**9, 2, 10, 10
#: Terms of a tile, groups of a band (a task sees at most two bands), pairs of row blocks walked at a time.
TERMS, BAND, WALKED = 1024, 1024, 1 << 16
#: Distinct terms counted in a task before they are sent on; bytes of text cut into words at a time.
HELD, PIECE = 400_000, 1 << 22
#: Runs of letters A-Z in any case and of characters beyond ASCII, on bytes whose A-Z are lower-cased.
WORD = re.compile(rb"[a-z\x80-\xff]+")
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
PARTS = "part string, lang string, source string, item string, value bigint"


def _count(batches):
    """Per group and term its occurrences and documents; a row with an empty term for every group that occurs."""
    held, size = {}, 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, text = len(n), text.as_py().lower()
            if len(text) <= PIECE:
                words = WORD.findall(text)
                n.update(words)
                docs.update(set(words))
            else:
                found, seen = (m.group() for m in WORD.finditer(text)), set()
                while words := list(islice(found, PIECE // 8)):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
            size += len(n) - before
            if size > HELD:
                yield from _told(held)
                held, size = {}, 0
    yield from _told(held)


def _told(held: dict):
    for (lang, source), (n, docs) in held.items():
        terms = [b"", *n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
             pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n, docs over whole texts; nulls are empty strings, and an empty term marks that a group occurs."""
    empty = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))]
    # counted per task already: summed after the shuffle only
    counted = docs.select(*empty).mapInArrow(_count, COUNTS).repartition("lang", "source", "term")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total), exact: a long division by three digits at a time, as the product may pass 64 bits."""
    rest, out = count.astype(np.int64) + SMOOTH, np.zeros(len(count), np.int64)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits."""
    return (p - q) ** 2 // (p + q)


class Tree:
    """Nonzero cells (row, column) of a tile and the quadrants above them, ``top`` levels high.

    ``below[k]`` gives for each quadrant of level k its four children at level k - 1 (upper left, upper right, lower
    left, lower right), -1 where a child holds no count; its last row stands for a quadrant that is not there itself.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, share: np.ndarray, top: int):
        code = self.code(row, col)
        order = np.argsort(code)
        self.share, self.level, self.below = share[order], code[order], [np.zeros((0, 4), np.int32)]
        for _ in range(top):
            above, parent = np.unique(self.level >> 2, return_inverse=True)
            below = np.full((len(above) + 1, 4), -1, np.int32)
            below[parent, self.level & 3] = np.arange(len(self.level))
            self.below.append(below)
            self.level = above

    @staticmethod
    def code(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Bits of row and column interleaved: the four children of a quadrant follow each other."""
        out = np.zeros(len(row), np.int64)
        for b in range(int(max(row.max(), col.max())).bit_length() if len(row) else 0):
            out |= ((row >> b) & 1) << (2 * b + 1) | ((col >> b) & 1) << (2 * b)
        return out

    def roots(self, row: int, columns: int) -> np.ndarray:
        """Places of the highest quadrants of a row block, -1 where there is none."""
        code = self.code(np.full(columns, row), np.arange(columns))
        at = np.minimum(np.searchsorted(self.level, code), max(len(self.level) - 1, 0))
        return np.where(self.level[at] == code, at, -1) if len(self.level) else np.full(columns, -1)


def walk(tree: Tree, top: int, other: int, columns: int, rows: tuple[int, int], leaf, zero=None) -> None:
    """All pairs of row block 0 with row block ``other`` (0: pairs of different rows of block 0), from level ``top`` down.

    ``leaf(a, b, column, at_a, at_b)`` gets pairs of rows of which at least one has a count in the column, with the places
    of their cells (-1: none); rows count within their block. ``zero(level, a, b, width)`` gets pairs of row blocks without
    a count in ``width`` columns. Without ``zero`` the second row is full, and quadrants without a count of the first are
    skipped. ``rows``: how many rows either block has.
    """
    def settled(level, a, b, c, at_a, at_b):
        some = (at_a >= 0) | (at_b >= 0) if zero else at_a >= 0
        if some.all():
            return level, a, b, c, at_a, at_b
        if zero:
            gone = ~some
            start = c[gone] << level
            zero(level, a[gone], b[gone], np.minimum(columns, start + (1 << level)) - start)
        return level, a[some], b[some], c[some], at_a[some], at_b[some]

    n = -(-columns >> top)
    none = np.zeros(n, np.int32)
    todo = [settled(top, none, none, np.arange(n, dtype=np.int32), tree.roots(0, n), tree.roots(other, n))]
    while todo:
        level, a, b, c, at_a, at_b = todo.pop()
        if len(a) > WALKED:
            todo += [(level, *(z[i:i + WALKED] for z in (a, b, c, at_a, at_b))) for i in range(0, len(a), WALKED)]
        elif level == 0:
            leaf(a, b, c, at_a, at_b)
        else:
            level -= 1
            below, found = tree.below[level + 1], []
            for da, db, dc in np.ndindex(2, 2, 2):
                x, y, z = 2 * a + da, 2 * b + db, 2 * c + dc
                keep = (x << level < rows[0]) & (y << level < rows[1]) & (z << level < columns)
                if not other:  # one order of each pair, and no row with itself
                    keep &= x < y if level == 0 else x <= y
                if not keep.all():
                    x, y, z = x[keep], y[keep], z[keep]
                    left, right = below[at_a[keep], 2 * da + dc], below[at_b[keep], 2 * db + dc]
                else:
                    left, right = below[at_a, 2 * da + dc], below[at_b, 2 * db + dc]
                if len(x):
                    found.append(settled(level, x, y, z, left, right)[1:])
            # the eight children as one piece, or pieces would shrink eightfold at each level
            if found:
                todo.append((level, *(np.concatenate(z) for z in zip(*found))))


class Sums:
    """Per pair of groups of two bands the sum over the leaves, and the columns in which both have no count."""

    def __init__(self, lang: str, left: list, right: list, same: bool, p_left: np.ndarray, p_right: np.ndarray):
        self.lang, self.left, self.right, self.same = lang, left, right, same
        self.p = p_left, p_right
        self.top = max(len(left), len(right), 1) - 1
        self.top = int(self.top).bit_length()
        self.value = np.zeros((1 << self.top, 1 << self.top), np.int64)
        self.empty = [np.zeros((1 << self.top - level, 1 << self.top - level), np.int64) for level in range(self.top + 1)]

    def add(self, pair: np.ndarray, value: np.ndarray) -> None:
        """Values of pairs of one piece of a tile: fewer than 2^53 in sum, so that counting with weights is exact."""
        self.value += np.bincount(pair, value, minlength=self.value.size).astype(np.int64).reshape(self.value.shape)

    def rows(self) -> pa.RecordBatch:
        """Both directions of every pair, the all-zero quadrants priced."""
        columns = self.empty[self.top]
        for level in range(self.top - 1, -1, -1):
            columns = np.repeat(np.repeat(columns, 2, axis=0), 2, axis=1) + self.empty[level]
        n, m = len(self.left), len(self.right)
        value = self.value[:n, :m] + apart(self.p[0][:, None], self.p[1][None]) * columns[:n, :m]
        a, b = np.triu_indices(n, 1) if self.same else (x.ravel() for x in np.indices((n, m)))
        left, right = pa.array(self.left, pa.string()).take(pa.array(a)), pa.array(self.right, pa.string()).take(pa.array(b))
        both = pa.array(np.tile(value[a, b], 2))
        k = len(both)
        return pa.RecordBatch.from_arrays([pa.array(["pair"] * k, pa.string()), pa.array([self.lang] * k, pa.string()), pa.concat_arrays([left, right]),
                                           pa.concat_arrays([right, left]), both], names=["part", "lang", "source", "item", "value"])


def _tiles(batches):
    """Sums of group pairs over a task's tiles, and each tile's leading terms of every group."""
    sums, where = None, None
    for (lang, a, b, _), batch in runs(batches, ["lang", "a", "b", "tile"]):
        head = batch.filter(pc.equal(batch.column("kind"), 0))
        cell = batch.filter(pc.equal(batch.column("kind"), 1))
        place, total = np.asarray(head.column("place")), np.asarray(head.column("total"))
        # places: groups of band a, then those of band b, then the language's totals
        order = np.argsort(place, kind="stable")
        place, total = place[order], total[order]
        names = head.column("source").take(pa.array(order)).to_pylist()
        n, m = int((place < BAND).sum()), int(((place >= BAND) & (place < 2 * BAND)).sum())
        if (lang, a, b) != where:
            if sums:
                yield sums.rows()
            none = shares(np.zeros(n + m, np.int64), np.maximum(total[:n + m], 1))
            left, right = none[:n], none[n:] if a != b else none[:n]
            sums = Sums(lang, names[:n], names[n:n + m] if a != b else names[:n], a == b, left, right)
            where = (lang, a, b)
        if not cell.num_rows:
            continue
        term = cell.column("term")
        column = np.cumsum(np.append(False, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False))).astype(np.int64)
        spot = np.asarray(cell.column("place"))
        share = shares(np.asarray(cell.column("n")), total[np.searchsorted(place, spot)])
        top, second = sums.top, 1 << sums.top
        # rows of the tree: band a from 0, band b (or the totals) from the next block on
        row = np.where(spot < BAND, spot, np.where(spot < 2 * BAND, spot - BAND + second, second))
        own = spot < 2 * BAND if a != b else slice(None)  # the totals still give the tile its columns
        tree, columns = Tree(row[own], column[own], share[own], top), int(column[-1]) + 1

        def leaf(x, y, c, at_x, at_y):
            p = np.where(at_x >= 0, tree.share[at_x], sums.p[0][x])
            q = np.where(at_y >= 0, tree.share[at_y], sums.p[1][y])
            sums.add((x.astype(np.int64) << top) + y, apart(p, q))

        def zero(level, x, y, width):
            np.add.at(sums.empty[level], (x, y), width)

        if a != b:
            walk(tree, top, 1, columns, (n, m), leaf, zero)
            continue
        walk(tree, top, 0, columns, (n, n), leaf, zero)
        best = []

        def against(x, y, c, at_x, at_y):
            p, q = tree.share[at_x], tree.share[at_y]
            more = p > q
            best.append((x[more], c[more], apart(p[more], q[more])))

        walk(tree, top, 1, columns, (n, 1), against)
        x, c, value = (np.concatenate(z) for z in zip(*best)) if best else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((c, -value, x))
        x, c, value = x[order], c[order], value[order]
        first = np.arange(len(x)) - np.searchsorted(x, x) < LEADING
        words = term.take(pa.array(np.flatnonzero(np.append(True, column[1:] != column[:-1]))))
        k = int(first.sum())
        yield pa.RecordBatch.from_arrays([pa.array(["term"] * k, pa.string()), pa.array([lang] * k, pa.string()), pa.array(names[:n], pa.string()).take(pa.array(x[first])),
                                          words.take(pa.array(c[first])), pa.array(value[first])], names=["part", "lang", "source", "item", "value"])
    if sums:
        yield sums.rows()


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: every group against the other sources of its language, and its leading terms.

    A language keeps the terms of at least ten of its documents (rows; repeated rows count each). Part ``pair``: value
    is the sum over all kept terms of floor((p - q)^2 / (p + q)), all ranks. Part ``term``: terms that the group holds
    with a greater share than the language, ranks to 10. Null text, language and source count as empty strings; groups
    without terms take part; a language with one source has no pairs, one without kept terms pairs of value 0. Ties go
    to the lesser item. No documents: no rows. Other columns are not read.
    """
    folder = shared_folder(docs.sparkSession)
    cells = stage(term_counts(docs, lang, source, text), folder, "cells")
    terms = stage(cells.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
                  .where(F.col("docs") >= LEAST_DOCUMENTS).select("lang", "term", "n"), folder, "terms")
    kept = cells.join(terms.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("all"))
    alone = Window.partitionBy("lang")
    # one row per group; the result has the square of a language's groups
    groups = stage(cells.where("term = ''").select("lang", "source")
                   .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
                   .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"),
                           (F.row_number().over(alone.orderBy("source")) - 1).alias("i"), F.count(F.lit(1)).over(alone).alias("groups"),
                           F.coalesce("all", F.lit(0)).alias("all")), folder, "groups")
    tiles = F.greatest(F.lit(1), F.ceil(F.col("v") / F.lit(TERMS))).cast("int")
    bands = F.ceil(F.col("groups") / F.lit(BAND)).cast("int")
    own = F.floor(F.col("i") / F.lit(BAND)).cast("int")
    others = F.transform(F.sequence(F.lit(0), bands - 1), lambda h: F.struct(F.least(own, h).alias("a"), F.greatest(own, h).alias("b")))
    spot = (F.col("i") % BAND + F.when((F.col("p.a") != F.col("p.b")) & (own == F.col("p.b")), BAND).otherwise(0)).cast("int")
    each = F.flatten(F.transform(F.sequence(F.lit(0), bands - 1), lambda a: F.transform(F.sequence(a, bands - 1), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    all_tiles = F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile")
    tile = F.pmod(F.xxhash64("term"), tiles).cast("int").alias("tile")

    def rows(frame, kind, pairs, place, tile, source, term, n, total):
        return frame.withColumn("p", F.explode(pairs)).select("lang", F.col("p.a").alias("a"), F.col("p.b").alias("b"), tile, F.lit(kind).alias("kind"), term.alias("term"),
                                                              place.alias("place"), source.alias("source"), n.alias("n"), total.alias("total"))

    no, none, last = F.lit(""), F.lit(0).cast("bigint"), F.lit(2 * BAND)
    facts = groups.groupBy("lang").agg(F.max("v").alias("v"), F.max("all").alias("all"), F.max("groups").alias("groups"))
    placed = kept.join(groups.select("lang", "source", "v", "i", "groups"), ["lang", "source"])
    tree = (rows(groups, 0, others, spot, all_tiles, F.col("source"), no, none, F.col("n") + 2 * F.col("v"))
            .unionByName(rows(facts, 0, each, last, all_tiles, no, no, none, F.col("all") + 2 * F.col("v")))
            .unionByName(rows(placed, 1, others, spot, tile, no, F.col("term"), F.col("n"), none))
            .unionByName(rows(terms.join(facts, "lang"), 1, each, last, tile, no, F.col("term"), F.col("n"), none)))
    dealt = tree.repartition("lang", "a", "b", "tile").sortWithinPartitions("lang", "a", "b", "tile", "kind", "term", "place")
    found = dealt.mapInArrow(_tiles, PARTS)
    # sums of a pair's tiles; a term is in one tile only, so its rows stay as they are
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).where(f"part = 'pair' OR rank <= {LEADING}").select("lang", "source", "part", "item", "value", "rank")


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = f"1 + ({UNIT}::HUGEINT * ({{n}} + {SMOOTH})) // ({{total}} + 2 * v)"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM w GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCUMENTS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN (c SEMI JOIN k USING (lang, term)) c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, {share.format(n='coalesce(c.n, 0)', total='t.total')} AS p,
    {share.format(n='k.n', total='l.total')} AS q FROM t JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f FROM p x JOIN p y
        ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= {LEADING}"""
