"""Deterministic stand-in values, as pure functions of (type, text, secret, salt).

No state is kept: equal input gives an equal stand-in in every task, run and
cluster.  The seed is a digest of 128 bits: the MD5 of the text, or with a secret
the first half of an HMAC-SHA256 over ``type::text``, so that common values cannot
be found by trying them out.  The formats are a table; every blank of a format is
filled from 32 bits of the digest of its own.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from ..catalog import pools
from .core import let, lit, lits


@dataclass(frozen=True)
class Pseudonyms:
    secret: str = ""
    salt: str = ""
    first_names: tuple[str, ...] = tuple(pools.FIRST_NAMES)
    last_names: tuple[str, ...] = tuple(pools.LAST_NAMES)
    cities: tuple[str, ...] = tuple(pools.CITIES)


def hmac_sha256_hex(key: bytes, message: str) -> str:
    """RFC 2104 over sha2: the two padded keys are fixed on the driver.

    The pads are literals of the plan: keep plans of keyed jobs out of shared logs.
    """
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return (f"sha2(concat({lit(outer)}, unhex(sha2(concat({lit(inner)}, encode({message}, 'UTF-8')), 256))), 256)")


#: Blanks that a digest can fill.
BLANKS = 4


def seed_sql(entity: str, original: str, how: Pseudonyms) -> str:
    """The digest that decides a stand-in: 32 hexadecimal digits."""
    salted = f"concat({lit(how.salt)}, {original})" if how.salt else original
    if how.secret:
        return f"left({hmac_sha256_hex(how.secret.encode(), f'concat({entity}, {lit('::')}, {salted})')}, 32)"
    return f"md5(encode({salted}, 'UTF-8'))"


def word_lists(how: Pseudonyms) -> dict[str, list[str]]:
    """What the named blanks of a format choose from."""
    return {"first": list(how.first_names), "last": list(how.last_names), "city": list(how.cities),
            "mailbox": [n.lower().replace(" ", "") for n in how.first_names], "domain": pools.MAIL_DOMAINS,
            "permit": pools.RESIDENCE_PERMITS, "accommodation": pools.ACCOMMODATIONS, "service": pools.SERVICE_RECORDS,
            "plate": list(pools.PLATE_LETTERS), "A-Z": [chr(c) for c in range(ord("A"), ord("Z") + 1)]}


def pieces_of(shape: str) -> list[tuple[str, str]]:
    """A format as ("text", characters) and ("blank", content) pieces, in order."""
    found = re.findall(r"\{([^}]*)\}|([^{]+)", shape)
    if sum(bool(blank) for blank, _ in found) > BLANKS:
        raise ValueError(f"{shape!r} has more than {BLANKS} blanks")
    return [("blank", blank) if blank else ("text", text) for blank, text in found]


def _filled(shape: str, lists: dict[str, list[str]]) -> str:
    parts, used = [], 0
    for kind, content in pieces_of(shape):
        if kind == "text":
            parts.append(lit(content))
            continue
        number = f"cast(conv(substring(ps_d, {8 * used + 1}, 8), 16, 10) as bigint)"
        used += 1
        if content in lists:
            parts.append(f"get({lits(lists[content])}, cast({number} % {len(lists[content])} as int))")
        else:
            low, high = content.split("-")
            value = f"cast({number} % {int(high) - int(low) + 1} + {int(low)} as string)"
            parts.append(f"lpad({value}, {len(low)}, '0')" if len(low) == len(high) else value)
    return f"concat({', '.join(parts)})"


def stand_in_sql(entity: str, seed: str, how: Pseudonyms = Pseudonyms()) -> str:
    """Stand-in value of an entity type for a digest; a type without a format is named in brackets."""
    lists = word_lists(how)
    branches = " ".join(f"when {lit(e)} then {_filled(shape, lists)}" for e, shape in pools.FORMATS.items())
    return let("ps_d", seed, f"case {entity} {branches} else concat('[', {entity}, ']') end")


def pseudonym_sql(entity: str, original: str, how: Pseudonyms = Pseudonyms()) -> str:
    return stand_in_sql(entity, seed_sql(entity, original, how), how)
