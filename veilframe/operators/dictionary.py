"""Hits of a dictionary: names, places or any terms of a table, found in texts of any size.

A term of one or several words is found wherever its words follow each other, whatever their case. A dictionary up to a
stated size in bytes is sent to every worker once, indexed by first words; a text is looked up where it stands, so no
text leaves its row and no term, however frequent, gathers rows in a task. A larger dictionary is joined: only the runs
of words that may be terms leave, keyed by the digest of their text, since equal texts have equal hits.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog.rules import RuleBook
from ..functions.core import HITS_TYPE, column, ident, let, lits, pieces
from .scan import with_hits

WORDS = r"(?U)[\p{L}\p{N}]+"
#: The same words for Python's engine: letters and digits of any script.
_WORD = re.compile(r"[^\W_]+")
#: Dictionaries of up to this many bytes of terms and types are held by every worker.
HELD_BYTES = 64 << 20
#: Where a dictionary is joined, words of a text that one row holds.
BLOCK_WORDS = 512
#: pattern_id of a hit that no pattern of the rule book made.
FOREIGN = -1

# Executors get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def folded(word: str) -> str:
    """A word without its case: the upper case of its lower case, as ß and SS, or K and the Kelvin sign, are one in two cases."""
    return word.lower().upper()


#: The same in SQL; the planner would take upper(lower(w)) for upper(w).
_FOLDED = "upper(concat(lower({}), ''))"


def _index(rows) -> dict:
    """First word -> number of words -> words -> sorted types."""
    index: dict[str, dict[int, dict[tuple, set]]] = {}
    for term, kind in rows:
        words = tuple(folded(w) for w in _WORD.findall(term or ""))
        if words and kind is not None:
            index.setdefault(words[0], {}).setdefault(len(words), {}).setdefault(words, set()).add(kind)
    return {w: {n: {k: sorted(v) for k, v in t.items()} for n, t in by.items()} for w, by in index.items()}


def find_terms(text: str, index: dict, score: float) -> list[dict]:
    """Hits of one text, ordered by place; a word that begins no term costs one lookup."""
    found = list(_WORD.finditer(text))
    words = [folded(m.group()) for m in found]
    out = []
    for i, word in enumerate(words):
        for n, terms in (index.get(word) or {}).items():
            for kind in terms.get(tuple(words[i:i + n]), ()):
                out.append({"start": found[i].start(), "end": found[i + n - 1].end(), "entity_type": kind, "score": score, "pattern_id": FOREIGN})
    return sorted(out, key=lambda h: (h["start"], h["end"], h["entity_type"]))


def _hit_array(rows: list) -> pa.Array:
    return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("score", pa.float64()),
                                              ("pattern_id", pa.int32())])))


def _looked_up(df: DataFrame, text: str, rows: list[tuple], score: float, out: str) -> DataFrame:
    """Hits from a dictionary sent to the workers, indexed once in each."""
    sent = df.sparkSession.sparkContext.broadcast(rows)

    @F.arrow_udf(HITS_TYPE)
    def find(texts: pa.Array, missing: pa.Array) -> pa.Array:
        # the broadcast lives as long as the worker, and the index with it
        index = getattr(sent, "terms_index", None)
        if index is None:
            index = sent.terms_index = _index(sent.value)
        return _hit_array([None if gone else find_terms(t, index, score) for t, gone in zip(texts.to_pylist(), missing.to_pylist())])

    # the text is named twice: see variants.replaced_udf
    return df.withColumn(out, find.asNondeterministic()(F.col(ident(text)), F.col(ident(text)).isNull()))


def _joined(df: DataFrame, text: str, terms: DataFrame, score: float, lengths: list[int], out: str) -> DataFrame:
    """Hits from a join of the texts' runs of words with the terms; frequent terms are the planner's to split.

    What is shuffled of a text is its digest and the runs whose first word begins some term; copies of a text are folded
    in their task, and the hits of a text, a bounded row, come back by its digest. A word's row holds its own runs only:
    Spark keeps all rows made of one, so a text is first cut into blocks and no row carries more than its block.
    """
    words = F.transform(F.regexp_extract_all(F.col("term"), F.lit(WORDS), F.lit(0)), lambda w: F.upper(F.concat(F.lower(w), F.lit(""))))
    known = terms.select(words.alias("ws"), "entity_type").where((F.size("ws") > 0) & F.col("entity_type").isNotNull()).select(
        F.col("ws")[0].alias("word"), F.array_join("ws", " ").alias("run"), F.size("ws").alias("n"), "entity_type").distinct()
    digest = F.sha2(F.col(ident(text)), 256)
    blocks = (f"filter(transform(sequence(0, size(tn_t), {BLOCK_WORDS}), tn_c -> named_struct('n', least({BLOCK_WORDS}, size(tn_t) - tn_c), "
              f"'ws', slice(tn_t, tn_c + 1, {BLOCK_WORDS + max(lengths, default=1) - 1}))), tn_b -> tn_b.n > 0)")
    cut = df.select(digest.alias("_of"), column(let("tn_t", pieces(ident(text), WORDS, _FOLDED), blocks)).alias("bs")).where("_of IS NOT NULL")
    cut = cut.select("_of", F.explode_outer("bs").alias("b")).where("b IS NOT NULL")
    # one row per word of a text and place; those that begin no term go before they are shuffled
    runs = (f"transform(filter({lits(lengths, 'int')}, tn_n -> tn_i + tn_n <= size(b.ws)), tn_n -> named_struct('hit_end', get(b.ws, tn_i + tn_n - 1).`end`, "
            f"'run', array_join(transform(slice(b.ws, tn_i + 1, tn_n), tn_w -> tn_w.word), ' ')))")
    places = f"transform(sequence(0, b.n - 1), tn_i -> named_struct('word', get(b.ws, tn_i).word, 'start', get(b.ws, tn_i).start, 'rs', {runs}))"
    places = cut.select("_of", F.explode_outer(column(places)).alias("w")).where("w IS NOT NULL")
    heads = known.select("word").distinct()
    begun = places.select("_of", "w.word", F.col("w.start").alias("hit_start"), "w.rs").join(heads, "word", "left_semi")
    rows = begun.select("_of", "hit_start", F.explode("rs").alias("r")).select("_of", "hit_start", "r.hit_end", "r.run")
    hits = rows.join(known.select("run", "entity_type"), "run").groupBy("_of").agg(F.sort_array(F.collect_set(F.struct(
        F.col("hit_start").alias("start"), F.col("hit_end").alias("end"), "entity_type", F.lit(score).alias("score"), F.lit(FOREIGN).alias("pattern_id")))).alias(out))
    found = df.withColumn("_of", digest).join(hits, "_of", "left").drop("_of")
    return found.withColumn(out, column(f"case when {ident(text)} is not null then coalesce({ident(out)}, cast(array() as {HITS_TYPE})) end"))


def with_term_hits(df: DataFrame, terms: DataFrame, text: str = "text", score: float = 0.6, longest: int | None = None,
                   held_bytes: int = HELD_BYTES, out: str = "term_hits") -> DataFrame:
    """Add the dictionary's hits of a text column as an array; null for a null text.

    ``terms`` has term and entity_type; blank and null terms are no terms. ``longest`` leaves out terms of more words.
    The dictionary's size is measured by one job, and below ``held_bytes`` its terms are read by the driver.
    """
    kept = terms.select("term", "entity_type").where("term IS NOT NULL AND entity_type IS NOT NULL")
    many = F.size(F.regexp_extract_all(F.col("term"), F.lit(WORDS), F.lit(0)))
    kept = kept.where((many > 0) & (many <= longest)) if longest else kept.where(many > 0)
    size, lengths = kept.agg(F.sum(F.octet_length("term") + F.octet_length("entity_type")), F.sort_array(F.collect_set(many))).first()
    if (size or 0) <= held_bytes:
        return _looked_up(df, text, [tuple(r) for r in kept.distinct().collect()], score, out)
    return _joined(df, text, kept, score, lengths, out)


def term_hits(df: DataFrame, keys: list[str], text: str, terms: DataFrame, score: float = 0.6, longest: int | None = None,
              held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per hit of the dictionary: keys, entity_type, hit_start, hit_end, score."""
    found = with_term_hits(df, terms, text, score, longest, held_bytes, "_terms").select(*keys, F.explode_outer("_terms").alias("h"))
    return found.where("h IS NOT NULL").select(*keys, "h.entity_type", F.col("h.start").alias("hit_start"), F.col("h.end").alias("hit_end"), "h.score")


def with_terms(df: DataFrame, terms: DataFrame, text: str = "text", book: RuleBook | None = None, score: float = 0.6,
               longest: int | None = None, held_bytes: int = HELD_BYTES, **options) -> DataFrame:
    """``with_hits`` with the hits of a dictionary merged in, so that every rewriting and policy sees them.

    The hits of a row come from its own text: keys may repeat, be null or be missing.
    """
    found = with_term_hits(df, terms, text, score, longest, held_bytes, "_terms")
    return with_hits(found, text, book, extra_hits=F.col("_terms"), **options).drop("_terms")
