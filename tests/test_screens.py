"""Screens are necessary conditions: a text made from any alternative of any pattern passes the screen of its rule."""

import re
from re import _constants as c
from re import _parser as parser

from pyspark.sql import functions as F

from veilframe.catalog.rules import default_book
from veilframe.functions import spans
from veilframe.functions.core import let

#: A character for each class of characters that a pattern may ask for.
SAMPLES = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ -_.,:/#@$()[]'+?&=\\\t\n"


def _member(item) -> str:
    kind, value = item
    if kind is c.LITERAL:
        return chr(value)
    if kind is c.NOT_LITERAL:
        return next(x for x in SAMPLES if ord(x) != value)
    if kind is c.ANY:
        return "a"
    negated = any(k is c.NEGATE for k, _ in value)

    def holds(x: str) -> bool:
        for k, v in value:
            if k is c.LITERAL and ord(x) == v or k is c.RANGE and v[0] <= ord(x) <= v[1]:
                return True
            if k is c.CATEGORY:
                yes = {c.CATEGORY_DIGIT: x.isdigit(), c.CATEGORY_SPACE: x.isspace(), c.CATEGORY_WORD: x.isalnum() or x == "_"}
                no = {c.CATEGORY_NOT_DIGIT: not x.isdigit(), c.CATEGORY_NOT_SPACE: not x.isspace(), c.CATEGORY_NOT_WORD: not (x.isalnum() or x == "_")}
                if {**yes, **no}[v]:
                    return True
        return False
    return next(x for x in SAMPLES[1:] + "0" if holds(x) != negated)


def made(nodes) -> list[str]:
    """Texts that take every alternative of a pattern at least once."""
    parts: list[list[str]] = []
    for kind, value in nodes:
        if kind is c.BRANCH:
            parts.append([t for branch in value[1] for t in made(branch)])
        elif kind is c.SUBPATTERN:
            parts.append(made(value[3]))
        elif kind in (c.MAX_REPEAT, c.MIN_REPEAT, getattr(c, "POSSESSIVE_REPEAT", None)):
            low, high, inner = value
            some = made(inner)
            parts.append([t * max(low, 1) for t in some] + ([""] if low == 0 else []) + ([some[0] * min(high, low + 3)] if high != low else []))
        elif kind is getattr(c, "ATOMIC_GROUP", None):
            parts.append(made(value))
        elif kind in (c.AT, c.ASSERT, c.ASSERT_NOT, c.GROUPREF):
            parts.append([""])
        else:
            parts.append([_member((kind, value))])
    base = [p[0] for p in parts]
    out = ["".join(base)]
    for i, p in enumerate(parts):
        out += ["".join(base[:i]) + t + "".join(base[i + 1:]) for t in p[1:]]
    return list(dict.fromkeys(out))


def test_every_alternative_passes_its_screen(spark):
    rules = default_book().rules
    rows = []
    for k, rule in enumerate(rules):
        texts = [t for t in made(parser.parse(rule.regex, re.IGNORECASE)) for t in (t, t.upper(), t.lower(), f"x {t} y", f"({t})")]
        rows += [(k, t) for t in dict.fromkeys(texts) if re.search(rule.regex, t, re.IGNORECASE)]
    assert len({k for k, _ in rows}) == len(rules), "a pattern without a sample"
    assert len(rows) > 1500
    df = spark.createDataFrame(rows, "k int, t string").repartition(8)
    screened = F.expr(let("sp_t", "t", f"size(get({spans._matches('sp_t', rules)}, k)) > 0"))
    # matched without any screen by the engine that runs the patterns
    plain = F.expr(f"size(get(array({', '.join(f'regexp_extract_all(t, {spans.lit(r.java)}, 0)' for r in rules)}), k)) > 0")
    lost = df.where(plain).where(~F.coalesce(screened, F.lit(False))).collect()
    assert not lost, [(rules[r.k].pattern, r.t) for r in lost[:10]]
    assert df.where(plain).count() > 1500
