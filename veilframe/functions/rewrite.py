"""Rewriting a text from its disjoint hits, left to right."""

from __future__ import annotations

from ..catalog.policies import check_mode
from .core import blank, let, lit
from .overlap import resolve_overlaps
from .pseudonym import Pseudonyms, pseudonym_sql


def render_sql(text: str, kept: str, token: str) -> str:
    """Text with every kept hit replaced by ``token`` (an expression over rw_h and rw_t)."""
    before = "case when rw_i = 0 then 0 else get(rw_k, rw_i - 1).`end` end"
    pieces = (f"transform(rw_k, (rw_h, rw_i) -> concat(substring(rw_t, {before} + 1, rw_h.start - {before}), {token}))")
    tail = "substring(rw_t, element_at(rw_k, -1).`end` + 1)"
    body = f"case when size(rw_k) = 0 then rw_t else concat(array_join({pieces}, ''), {tail}) end"
    return let("rw_t", text, let("rw_k", kept, body))


MASK_TOKEN = "concat('[', rw_h.entity_type, ']')"


def token_sql(mode: str, redact_with: str = "", how: Pseudonyms = Pseudonyms()) -> str:
    if mode == "mask":
        return MASK_TOKEN
    if mode == "redact":
        return lit(redact_with)
    return pseudonym_sql("rw_h.entity_type", "substring(rw_t, rw_h.start + 1, rw_h.`end` - rw_h.start)", how)


def sanitize_sql(text: str, hits: str, mode: str, redact_with: str = "",
                 how: Pseudonyms = Pseudonyms()) -> str:
    """Sanitized text under one mode; null where exclude mode drops the text."""
    check_mode(mode)
    if mode == "exclude":
        return f"case when {blank(text)} or size({hits}) = 0 then {text} end"
    return let("rs_h", hits, f"case when size(rs_h) = 0 then {text} else "
               f"{render_sql(text, resolve_overlaps('rs_h'), token_sql(mode, redact_with, how))} end")


def sanitize_by_sql(text: str, hits: str, mode: str, redact_with: str = "",
                    how: Pseudonyms = Pseudonyms()) -> str:
    """Like sanitize_sql with the mode given by an expression, for modes that vary per row."""
    branches = " ".join(f"when {lit(m)} then {sanitize_sql(text, 'rm_h', m, redact_with, how)}"
                        for m in ("mask", "redact", "pseudonymize", "exclude"))
    return let("rm_h", hits, f"case {mode} {branches} end")
