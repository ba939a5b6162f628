"""Job configuration from a JSON file, read once on the driver.

Keys: entity_thresholds, custom_patterns, schema_profiles, pseudo_pools.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from ..catalog.profiles import Profile
from ..catalog.rules import RuleBook, default_book
from ..functions.pseudonym import Pseudonyms


@dataclass(frozen=True)
class Config:
    book: RuleBook
    profiles: dict = field(default_factory=dict)
    pseudonyms: Pseudonyms = Pseudonyms()


def parse_config(data: dict, book: RuleBook | None = None) -> Config:
    book = book or default_book()
    for custom in data.get("custom_patterns", []):
        book = book.plus(custom["entity_type"],
                         [(p["name"], p["regex"], float(p["score"])) for p in custom["patterns"]],
                         custom.get("context", []))
    book = book.at(**{k: float(v) for k, v in data.get("entity_thresholds", {}).items()})
    profiles = {name: Profile(name, p.get("description", ""), dict(p.get("field_hints", {})),
                              p.get("default_mode", "mask"))
                for name, p in data.get("schema_profiles", {}).items()}
    pools = data.get("pseudo_pools", {})
    base = Pseudonyms()
    how = replace(base, first_names=tuple(pools.get("first_names") or base.first_names),
                  last_names=tuple(pools.get("last_names") or base.last_names),
                  cities=tuple(pools.get("cities") or base.cities))
    return Config(book, profiles, how)


def load_config(path: str | None, book: RuleBook | None = None) -> Config:
    """Read a config file; without a path the defaults apply. A broken file raises."""
    if not path:
        return Config(book or default_book())
    with open(path, encoding="utf-8") as f:
        return parse_config(json.load(f), book)
