"""Risk tiers of hits and rows."""

from ..catalog.risk import DEFAULT_TIER, ENTITY_TIER, TIERS, rank_of
from .core import lit, lits, map_of


def rank_sql(entity: str) -> str:
    """Entity type -> tier rank; unknown types take the default tier."""
    ranks = map_of({e: rank_of(t) for e, t in ENTITY_TIER.items()})
    return f"coalesce(try_element_at({ranks}, {entity}), {rank_of(DEFAULT_TIER)})"


def tier_sql(rank: str) -> str:
    return f"get({lits(TIERS)}, {rank})"


def entity_tier_sql(entity: str) -> str:
    return f"coalesce(try_element_at({map_of(ENTITY_TIER)}, {entity}), {lit(DEFAULT_TIER)})"


def max_rank_sql(hits: str) -> str:
    """Highest rank over the hits; no hits is the lowest tier."""
    return f"coalesce(array_max(transform({hits}, rk_h -> {rank_sql('rk_h.entity_type')})), 0)"


def types_sql(hits: str) -> str:
    """Distinct entity types of the hits, sorted."""
    return f"sort_array(array_distinct(transform({hits}, ty_h -> ty_h.entity_type)))"
