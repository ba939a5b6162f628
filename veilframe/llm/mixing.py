"""Mixing sources to target weights, with DataFrame functions only.

Each source's words form one stream that is packed into blocks of fixed length. A source's target says how many
block slots it fills. Slots of output shards draw their source (multinomial counts per shard); draws beyond a
source's slots go to the sources that drew too few. A source's k-th slot takes block P(k mod n) of its n blocks,
P being a pseudorandom permutation of its own for every pass (swap-or-not shuffle: exact for any n, no tables), so
no block is taken more than ceil(slots / n) times. Slots and blocks meet in a join by (source, index).

All numbers derive from the data by the same integer arithmetic, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, split_rank, stage

WEIGHTS = (5, 2, 1)
#: Words of a block, slots of an output shard, cells of the lookup from a draw to its source, rounds of the shuffle.
BLOCK, SHARD, CELLS, ROUNDS = 64, 4096, 1024, 12
LIMIT = 3
#: Lists into which a source's documents are dealt to find their places in its stream.
PARTS = 1024
PRIME = 2147483647


def mixed(x: str, seed: str) -> str:
    """SQL of a number below PRIME that looks random in x and seed."""
    return f"((((({x}) % {PRIME}) * 48271 + ({seed})) % {PRIME}) * 69621 + ({x}) DIV {PRIME} + 12345) % {PRIME}"


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (words; null text: 0), a hash of the text, by which rows of equal id are ordered, and one to deal them by."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                       F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"),
                       F.xxhash64(F.col(f"`{text}`")).alias("h"),
                       F.conv(F.substring(F.md5(F.col(f"`{text}`")), 1, 6), 16, 10).cast("bigint").alias("deal"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """One row per source: sid (from 1, by code point, null last), source_size, target, blocks, slots.

    Shares by weight, stopped at ``limit`` times the source's size: the common level is the greatest of the levels
    that remain when the sources that stop first (least size for their weight) have stopped.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("sid", F.row_number().over(order))
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1)
    per = per.withColumn("weight", choice)
    full = F.col("source_size") * limit
    stop = Window.orderBy(full / F.col("weight"), "sid")
    stopped = F.coalesce(F.sum(full).over(stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(stop.rowsBetween(0, Window.unboundedFollowing))
    all_ = Window.partitionBy(F.lit(0))
    per = per.withColumn("level", (F.sum("source_size").over(all_) - stopped) / weight_left)
    per = per.withColumn("level", F.max("level").over(all_))
    target = F.least(full.cast("double"), F.col("weight") * F.col("level"))
    per = per.withColumn("target", target).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint"))
    slots = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5),
                                                     F.col("blocks") * limit)).otherwise(0).cast("bigint")
    return per.select("sid", "source", "source_size", "target", "blocks", slots.alias("slots"))


def _tasks(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def draws(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, sid, n, first): multinomial counts of every output shard, and the source's draws in the shards before."""
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(F.lit(0))
    cut = sources.where("slots > 0").withColumn("lo", F.coalesce(F.sum("slots").over(upto), F.lit(0))).withColumn(
        "m", F.sum("slots").over(all_)).select("sid", "slots", "m", F.expr(f"CAST(floor(lo / m * {PRIME}) AS BIGINT)").alias("lo"),
                                               F.expr(f"CAST(floor((lo + slots) / m * {PRIME}) AS BIGINT)").alias("hi"))
    wide = PRIME // CELLS + 1
    cells = cut.where("hi > lo").withColumn("cell", F.explode(F.expr(f"sequence(lo DIV {wide}, (hi - 1) DIV {wide})")))
    shards = cut.agg(F.max("m").alias("m")).where("m > 0").withColumn("shard", F.explode(F.expr(f"sequence(0L, (m - 1) DIV {shard})")))
    slots = shards.repartition(_tasks(sources), "shard").withColumn("g", F.explode(F.expr(f"sequence(shard * {shard}, least(m, (shard + 1) * {shard}) - 1)")))
    slots = slots.select("shard", "g", F.expr(mixed("g", "77")).alias("u")).withColumn("cell", F.expr(f"u DIV {wide}"))
    # Spark takes exploded ranges for small ones and would broadcast them; the hint keeps them in a shuffle.
    drawn = slots.hint("merge").join(cells.select("sid", "lo", "hi", "cell"), "cell").where("u >= lo AND u < hi")
    counts = drawn.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))
    # which shard's draws come first has no meaning, so a source's shards are ranked in many lists
    return split_rank(counts, ["sid"], ["shard"], F.col("n"), PARTS, "first")


def slots_of(sources: DataFrame, folder: str, shard: int = SHARD) -> DataFrame:
    """(shard, sid, k, block): which block of which source every slot takes.

    Draws beyond a source's slots are given to the sources that drew too few, in order.
    """
    counts = stage(draws(sources, shard), folder, "draws")
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    state = sources.where("slots > 0").join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left")
    state = state.withColumn("got", F.coalesce("got", F.lit(0))).withColumn(
        "over", F.greatest(F.col("got") - F.col("slots"), F.lit(0))).withColumn("under", F.greatest(F.col("slots") - F.col("got"), F.lit(0)))
    state = stage(state.select("sid", "blocks", "slots", "got", "under", F.coalesce(F.sum("over").over(upto), F.lit(0)).alias("over_at"),
                               F.coalesce(F.sum("under").over(upto), F.lit(0)).alias("under_at")), folder, "state")
    # few rows that become many: a fixed number of tasks, or they would be coalesced into one
    both = counts.join(state.select("sid", "blocks", "slots", "over_at"), "sid").repartition(_tasks(sources), "shard")
    kept = both.where("first < slots").select("shard", "sid", "blocks", F.explode(
        F.expr("sequence(first, least(first + n, slots) - 1)")).alias("k"))
    spare = both.where("first + n > slots").select("shard", F.explode(F.expr(
        "sequence(over_at + greatest(first, slots) - slots, over_at + first + n - 1 - slots)")).alias("e"))
    free = state.where("under > 0").select("sid", "blocks", "got", "under_at", F.explode(F.expr("sequence(got, slots - 1)")).alias("k"))
    free = free.select("sid", "blocks", "k", F.expr("under_at + k - got").alias("e"))
    slots = kept.unionByName(spare.hint("merge").join(free, "e").select("shard", "sid", "blocks", "k"))
    # written, or the planner would derive constraints from all rounds for every later join
    return stage(permuted(slots).select("shard", "sid", "k", "block"), folder, "slots")


def permuted(slots: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``block``, the block of slot k: a permutation of 0..blocks-1 for each source and pass.

    A round is two plain columns, so that all of them are compiled into one stage; as one fold over the rounds they
    would be interpreted, at many times the cost.
    """
    n = "blocks"
    slots = slots.withColumns({"_pass": F.expr(f"k DIV {n}"), "block": F.expr(f"k % {n}")})
    for r in range(rounds):
        key = f"({mixed(f'sid * 1000003 + _pass * 10007 + {r} * 101', '4242')}) % {n}"
        coin = f"(({mixed('greatest(block, _mirror)', f'sid * 911 + {r} * 7919')}) DIV 1024) % 2"
        slots = slots.withColumn("_mirror", F.expr(f"(({key}) + {n} - block) % {n}")).withColumn(
            "block", F.expr(f"CASE WHEN {coin} = 1 THEN _mirror ELSE block END"))
    return slots.drop("_pass", "_mirror")


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with words, its source's sid and the word of the stream at which it starts."""
    ids = sources.select("sid", F.col("source").alias("_s"))
    rows = sizes.where("size > 0").join(ids, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # by id and text: rows may share an id, or have none
    deal = F.expr("pmod(coalesce(doc_id, 0), 16777216) * 48271 + deal") % PRIME
    return split_rank(rows, ["sid"], ["doc_id", "h", "size"], F.col("size"), PARTS, "start", deal)


def spread(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document and block that holds words of it: ``part`` words from the document's word ``word`` on."""
    cut = rows.withColumn("block", F.explode(F.expr(f"sequence(start DIV {block}, (start + size - 1) DIV {block})")))
    return cut.withColumn("word", F.expr(f"greatest(block * {block} - start, 0L)")).withColumn(
        "part", F.expr(f"least((block + 1) * {block}, start + size) - greatest(block * {block}, start)"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK,
        shard: int = SHARD, weights: tuple = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of the row, repeats counted).

    One row per input row. A null text or one without words has size 0 and nothing is taken; a null source is a
    source, the last; repeated rows are documents of their own. Other columns are not read. No rows: no rows.
    """
    folder = shared_folder(docs.sparkSession)
    sizes = stage(sized(docs, doc_id, text, source), folder, "sizes")
    sources = stage(targets(sizes, weights, block=block), folder, "sources")
    times = slots_of(sources, folder, shard).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    pieces = spread(placed(sizes, sources), block).select("doc_id", "h", "sid", "start", "size", "block", "part")
    taken = pieces.hint("merge").join(times, ["sid", "block"], "left").groupBy("doc_id", "h", "sid", "start", "size").agg(
        F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"))
    facts = sources.select("sid", F.col("source").alias("_s"), "source_size", "target")
    out = ["doc_id", "h", "source", "size", "source_size", "target", "taken"]
    some = taken.join(facts, "sid").withColumnRenamed("_s", "source").select(*out)
    none = sizes.where("size = 0").join(facts, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "taken", F.lit(0).cast("bigint")).select(*out)
    return some.unionByName(none)


def mixed_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK,
                 shard: int = SHARD, weights: tuple = WEIGHTS) -> DataFrame:
    """(shard, source, block, words): the mixture itself, every slot with its block's words joined by spaces."""
    folder = shared_folder(docs.sparkSession)
    words = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), words.alias("ws")).distinct()
    sizes = stage(sized(docs, doc_id, text, source), folder, "sizes")
    sources = stage(targets(sizes, weights, block=block), folder, "sources")
    cut = spread(placed(sizes, sources), block).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "sid", "start", "block", "word", "part")
    cut = cut.join(texts, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")))
    cut = cut.select("sid", "block", "start", F.slice("ws", (F.col("word") + 1).cast("int"), F.col("part").cast("int")).alias("ws"))
    whole = cut.groupBy("sid", "block").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(
        F.struct("start", "ws"))), lambda p: p["ws"])), " ").alias("words"))  # at most ``block`` words
    return slots_of(sources, folder, shard).hint("merge").join(whole, ["sid", "block"]).join(sources.select("sid", "source"), "sid").select(
        "shard", "source", "block", "words")


def oracle(block: int = BLOCK, shard: int = SHARD, rounds: int = ROUNDS) -> str:
    """The same mix of ``documents`` in DuckDB's SQL, with the weights of WEIGHTS."""
    def m(x, seed):
        return mixed(x, seed).replace(" DIV ", " // ")
    wide = PRIME // CELLS + 1
    turns, last = [], "p0"
    for r in range(rounds):
        key = f"({m(f'sid * 1000003 + pass * 10007 + {r} * 101', '4242')}) % blocks"
        turns.append(f"y{r} AS (SELECT sid, blocks, pass, x, (({key}) + blocks - x) % blocks AS y FROM {last}), "
                     f"p{r + 1} AS (SELECT sid, blocks, pass, CASE WHEN (({m('greatest(x, y)', f'sid * 911 + {r} * 7919')}) // 1024) % 2 = 1 "
                     f"THEN y ELSE x END AS x FROM y{r})")
        last = f"p{r + 1}"
    choice = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))
    return rf"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, ('0x' || md5(text)[1:6])::BIGINT AS deal FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM d GROUP BY source),
s1 AS (SELECT *, (CASE (sid - 1) % {len(WEIGHTS)} {choice} END)::DOUBLE AS weight FROM s0),
s2 AS (SELECT *, ((SELECT sum(source_size) FROM s1) - coalesce(sum(source_size * {LIMIT}) OVER (ORDER BY source_size * {LIMIT} / weight, sid
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY source_size * {LIMIT} / weight, sid
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT sid, source, source_size, least((source_size * {LIMIT})::DOUBLE, weight * (SELECT max(level) FROM s2)) AS target,
  (source_size + {block - 1}) // {block} AS blocks FROM s2),
s AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target * blocks / source_size + 0.5)::BIGINT, blocks * {LIMIT}) ELSE 0 END AS slots FROM s3),
p0 AS (SELECT sid, blocks, k // blocks AS pass, k % blocks AS x FROM (SELECT sid, blocks, unnest(range(0, slots)) AS k FROM s WHERE slots > 0)),
{", ".join(turns)},
times AS (SELECT sid, x AS block, count(*) AS times FROM {last} GROUP BY sid, x),
q AS (SELECT doc_id, sid, size, (((coalesce(doc_id, 0) % 16777216 + 16777216) % 16777216 * 48271 + deal) % {PRIME}) % {PARTS} AS part
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source WHERE size > 0),
w AS (SELECT *, (sum(size) OVER (PARTITION BY sid ORDER BY part, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start FROM q),
c AS (SELECT doc_id, sid, start, size, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS block FROM w),
t AS (SELECT doc_id, sum((least((c.block + 1) * {block}, start + size) - greatest(c.block * {block}, start)) * coalesce(times, 0))::BIGINT AS taken
  FROM c LEFT JOIN times ON c.sid = times.sid AND c.block = times.block GROUP BY doc_id)
SELECT d.doc_id, d.size, s.source_size, s.target, coalesce(t.taken, 0) AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN t ON d.doc_id = t.doc_id"""
