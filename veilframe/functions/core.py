"""Building blocks for the SQL expressions this package composes.

Expressions are composed as Spark SQL text and handed to ``F.expr``: one parse
instead of thousands of driver round trips, and the same text serves as the body
of a registered SQL function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIT_TYPE = "struct<start:int,end:int,entity_type:string,score:double,pattern_id:int>"
HITS_TYPE = f"array<{HIT_TYPE}>"
NO_HITS = f"cast(array() as {HITS_TYPE})"


def lit(value) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{value.hex()}'"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lits(values, element: str = "string") -> str:
    return f"cast(array({', '.join(lit(v) for v in values)}) as array<{element}>)"


def ident(name: str) -> str:
    """Column name -> quoted reference. A dotted name addresses a struct field."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def let(var: str, value: str, body: str) -> str:
    """Evaluate ``value`` once per row and use it as ``var`` in ``body``."""
    # A fold over nothing: its start is the value. It neither copies the result nor works out the type of the body for every row.
    return f"aggregate(cast(array() as array<int>), {value}, ({var}, {var}_none) -> {var}, {var} -> {body})"


def map_of(pairs: dict) -> str:
    return "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in pairs.items()) + ")"


def column(sql: str) -> Column:
    return F.expr(sql)


def blank(text: str) -> str:
    """Null, empty or white space only."""
    return f"({text} is null or not ({text} rlike {lit(r'(?U)' + chr(92) + 'S')}))"


def running(values: str, zero: str, combine) -> str:
    """Exclusive running fold of an array, in near-linear time.

    Entry i is the fold of all entries before i. Up to 16 entries are folded each by itself. Of more, blocks are folded first,
    then the block totals, then each entry within its block; appending to an array in one fold would copy it at every
    step. Blocks hold 8 entries, or 64 of long arrays: an entry costs half a block, a block half of all blocks.
    ``combine(a, x)`` must be associative with ``zero`` as its identity.
    """
    fold = "(rn_a, rn_x) -> " + combine("rn_a", "rn_x")
    few = f"transform(rn_v, (rn_z, rn_i) -> aggregate(slice(rn_v, 1, rn_i), {zero}, {fold}))"

    def blocks(bits: int) -> str:
        block, size = f"shiftright(rn_i, {bits})", 1 << bits
        totals = (f"transform(sequence(0, shiftright(size(rn_v), {bits})), "
                  f"rn_c -> aggregate(slice(rn_v, rn_c * {size} + 1, {size}), {zero}, {fold}))")
        before = f"transform(rn_s, (rn_y, rn_j) -> aggregate(slice(rn_s, 1, rn_j), {zero}, {fold}))"
        each = (f"transform(rn_v, (rn_z, rn_i) -> aggregate(slice(rn_v, {block} * {size} + 1, rn_i % {size}), "
                f"get(rn_p, {block}), {fold}))")
        return let("rn_s", totals, let("rn_p", before, each))

    return let("rn_v", values, f"case when size(rn_v) <= 16 then {few} when size(rn_v) <= 1024 then {blocks(3)} else {blocks(6)} end")


def _steps(size: str) -> str:
    """The powers of two down to 1 that a bisection of this length may need, at most two more than its digits."""
    steps = ", ".join(str(1 << b) for b in range(27, -1, -1))
    return f"slice(array({steps}), greatest(27 - cast(log2(greatest({size}, 1)) as int), 1), 28)"


def leading(size: str, holds) -> str:
    """How many of the positions 0, 1, ... below ``size`` satisfy ``holds``, by bisection.

    ``holds(position)`` must be true up to some position and false from there on.
    """
    return (f"aggregate({_steps(size)}, 0, (bi_c, bi_p) -> case when bi_c + bi_p <= {size} and {holds('bi_c + bi_p - 1')} "
            f"then bi_c + bi_p else bi_c end)")


def pieces(text: str, pattern: str, value: str = "{}") -> str:
    """array<struct<start,end,word,before>> of all matches of a pattern, in linear time.

    ``value`` is applied to each match; ``before`` is the place of its word when all words are joined by single characters.
    """
    pairs = (f"zip_with(split({text}, {lit(pattern)}, -1), transform(regexp_extract_all({text}, {lit(pattern)}, 0), pi_w -> named_struct("
             f"'w', {value.format('pi_w')}, 'n', length(pi_w))), (pi_g, pi_w) -> named_struct('gap', length(pi_g), 'n', pi_w.n, 'w', pi_w.w))")
    places = running("transform(pi_z, pi_c -> pi_c.gap + coalesce(pi_c.n, 0))", "0", lambda a, x: f"{a} + {x}")
    joined = running("transform(pi_z, pi_c -> coalesce(length(pi_c.w), 0) + 1)", "0", lambda a, x: f"{a} + {x}")
    start = "pi_d.gap + get(pi_y.places, pi_k)"
    found = (f"transform(filter(pi_z, pi_c -> pi_c.n is not null), (pi_d, pi_k) -> named_struct('start', {start}, 'end', {start} + pi_d.n, "
             f"'word', pi_d.w, 'before', get(pi_y.joined, pi_k)))")
    return let("pi_z", pairs, let("pi_y", f"named_struct('places', {places}, 'joined', {joined})", found))
