"""The rule book: every pattern compiled to one immutable list on the driver.

A rule is (entity, pattern name, regex, base score, context words, validator)
plus *needs*: cheap necessary conditions checked before the regex runs.  A need
never decides a hit; it only lets rows that cannot match skip the pattern.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import lru_cache

from . import generic
from .education import EDUCATION_SPECS, GENERIC_CONTEXT

DEFAULT_DOMAIN = "campus.edu"
DEFAULT_THRESHOLD = 0.5

# Java flags: ignore case, Unicode classes and boundaries on every Java version.
FLAGS = "(?iU)"


@dataclass(frozen=True)
class Rule:
    rule_id: int
    entity: str
    recognizer: str
    pattern: str
    regex: str
    score: float
    context: tuple[str, ...] = ()
    validator: str | None = None
    group: str = "education"
    needs: tuple[tuple[str, tuple], ...] = ()

    @property
    def java(self) -> str:
        return FLAGS + self.regex


def _digits(n):
    return ("digits", (n,))


def _any(*stems):
    return ("any", stems)


def _starts(*stems):
    return ("starts", stems)


def _word(*words):
    return ("word", words)


def _one(*needs):
    return ("one", needs)


_TERMS = ("terms", ())
_LETTERS = ("letters", ())
_JOINED = ("joined", ())
_CODED = ("coded", ())
_DATED = ("dated", ())

# Needs per pattern; all listed needs must hold.
#   digits n   a run of n digits somewhere         any     one of the strings, in lower case
#   starts     a word starts with one of these     word    one of these as a whole word
#   terms      a listed title, name, place or group, case kept
#   letters    a letter somewhere                  joined   two digits with one of - / . : or a blank between them
#   coded      a word of one to three letters, two digits after it or after one blank or dash       dated    a letter, then blanks, then a digit
#   one        one of several needs
NEEDS = {
    "tix_case_id": [_starts("tix")],
    "tix_case_phrase": [_starts("title")],
    "irb_number": [_starts("irb")],
    "hs_protocol": [_starts("hs-", "hs_")],
    "irb_bare": [_starts("irb")],
    "named_award": [_any("$")],
    "award_dollar": [_any("$")],
    "touchnet_id": [_starts("tn-", "tn_")],
    "cashnet_id": [_starts("cn-", "cn_")],
    "sar_id": [_starts("sar-", "sar_")],
    "txn_explicit": [_digits(6), _starts("transaction", "payment")],
    "us_plate": [_digits(2), _CODED],
    "plate_explicit": [_starts("plate", "tag")],
    "d_prefix": [_digits(6), _CODED],
    "colleague_at": [_any("@"), _digits(6)],
    "banner_numeric": [_digits(6)],
    "colleague_numeric": [_digits(6)],
    "mm_dd_yyyy": [_digits(4), _JOINED, _any("-", "/")],
    "yyyy_mm_dd": [_digits(4), _JOINED, _any("-", "/")],
    "written_dob": [_digits(4), _DATED],
    "ferpa_phrase": [_starts("education record", "academic ", "transcript", "disciplinary record",
                             "financial aid", "tuition balance", "gpa", "grade point", "enrollment status",
                             "cumulative gpa", "degree audit", "student account", "disability accommodation",
                             "satisfactory academic", "sap status", "incomplete grade", "withdrawal",
                             "course withdrawal")],
    "fafsa_number": [_digits(6), _CODED],
    "fsa_id": [_starts("fsa")],
    "isir_reference": [_starts("isir")],
    "efc_value": [_starts("efc")],
    "visa_types": [_one(_starts("f-1", "f1", "j-1", "j1", "m-1", "m1", "h-1b", "h1b", "o-1", "o1", "daca",
                                "undocumented", "permanent resident", "green card", "naturalized",
                                "non-immigrant", "i-94", "i94", "sevis", "ds-2019", "i-20"),
                        _word("tn"))],
    "visa_expiry": [_digits(1), _starts("visa", "i-20", "ds-2019")],
    "accommodation_phrases": [_starts("disability ", "ada accommodation", "504 plan", "iep", "individualized",
                                      "testing accommodation", "extended time", "alternative format",
                                      "note-taker", "notetaker", "sign language", "assistive",
                                      "hearing impair", "visually impair", "learning disabilit",
                                      "attention deficit", "adhd", "autism", "accommodation letter",
                                      "accommodations letter")],
    "veteran_phrases": [_starts("veteran", "active duty", "military", "va benefit", "gi bill", "post-9/11",
                                "chapter 33", "chapter 30", "chapter 1606", "yellow ribbon", "deployment",
                                "servicemember", "national guard", "reserve component", "dd-214", "dd214")],
    "va_payment": [_any("$")],
    "health_phrases": [_starts("health record", "medical record", "mental health", "counseling ",
                               "psychiatric", "diagnosis", "prescription", "medication", "treatment plan",
                               "protected health", "phi", "hipaa", "immunization", "vaccination", "allergy",
                               "campus health", "student health", "behavioral health", "substance ",
                               "eating disorder", "suicid", "self-harm")],
    "ach_routing": [_digits(6)],
    "account_number": [_digits(6)],
    "account_explicit": [_digits(6), _LETTERS],
    "ml_prefix": [_digits(6), _CODED],
    "npi_10digit": [_digits(6), _LETTERS],
    "npi_bare": [_digits(6)],
    "ssn_dashed": [_digits(4), _JOINED, _any("-")],
    "ssn_spaced": [_digits(4), _JOINED],
    "ssn_dotted": [_digits(4), _JOINED, _any(".")],
    "ssn_nodash": [_digits(6)],
    "mailbox": [_any("@")],
    "nanp": [_digits(4), _JOINED],
    "international": [_any("+")],
    "card_number": [_digits(4)],
    "ipv4": [_digits(1), _JOINED, _any(".")],
    "ipv6": [_any(":")],
    "ipv6_short": [_any("::")],
    "ipv6_tail": [_any("::")],
    "scheme": [_any("://")],
    "www": [_starts("www.")],
    "iso": [_digits(4), _JOINED, _any("-")],
    "slashed": [_digits(2), _JOINED, _any("/")],
    "written": [_digits(4), _DATED],
    "clock": [_digits(2), _JOINED, _any(":")],
    "iban_compact": [_digits(2), _CODED],
    "iban_spaced": [_digits(4), _CODED],
    "base58_wallet": [_digits(1)],
    "bech32_wallet": [_starts("bc1")],
    "hex_wallet": [_starts("0x")],
    "bank_digits": [_digits(6)],
    "itin_separated": [_digits(4), _JOINED],
    "itin_bare": [_digits(6)],
    "passport_number": [_digits(6)],
    "licence_lettered": [_digits(6), _CODED],
    "licence_digits": [_digits(6)],
    "titled_name": [_TERMS],
    "given_and_family": [_TERMS],
    "street": [_digits(1), _LETTERS],
    "state_zip": [_digits(4), _CODED],
    "place_name": [_TERMS],
    "group_term": [_TERMS],
}


def by_first_letter(words) -> str:
    """An alternation grouped by first letter, so a position tries few branches."""
    groups: dict[str, set[str]] = {}
    for word in words:
        groups.setdefault(word[0], set()).add(re.escape(word[1:]))
    return "|".join(f"{re.escape(k)}(?:{'|'.join(sorted(v))})" for k, v in sorted(groups.items()))


def terms_screen(words: list[str]) -> str:
    """Necessary condition for any of the words; the look-ahead lets every other position fail at once."""
    initials = "".join(sorted({w[0] for w in words}))
    return f"(?=[{initials}])(?:{by_first_letter(words)})"


def starts_screen(starts, words) -> str:
    """Necessary condition, on padded lower-case text, for any word start or whole word listed.

    First letters are tried in groups of six behind a one-character look-ahead: measured as the
    cheapest form. ``\\W`` also holds before a Unicode word boundary, so nothing is lost.
    """
    letters = sorted({s[0] for s in starts})
    groups = [letters[k:k + 6] for k in range(0, len(letters), 6)]
    branches = [f"(?=[{''.join(g)}])(?:{by_first_letter([s for s in starts if s[0] in g])})" for g in groups]
    branches += [re.escape(w) + "(?![a-z0-9_])" for w in sorted(words)]
    return r"\W(?:" + "|".join(branches) + ")"


TERMS_SCREEN = terms_screen(generic.TITLES + generic.GIVEN_NAMES + generic.PLACE_NAMES + generic.GROUP_TERMS)


@lru_cache(maxsize=8)
def built_in_rules(domain: str = DEFAULT_DOMAIN) -> tuple[Rule, ...]:
    rules: list[Rule] = []

    def add(entity, recognizer, patterns, context, group):
        for name, regex, score, *validator in patterns:
            needs = tuple(NEEDS.get(name, ()))
            if "{domain}" in regex:
                # The unbounded local part is slow on long dotted runs: run it only near the domain.
                regex, needs = regex.replace("{domain}", re.escape(domain)), (_any("@" + domain.lower()),)
            rules.append(Rule(len(rules), entity, recognizer, name, regex, score, tuple(context),
                              validator[0] if validator else None, group, needs))

    for entity, recognizer, patterns, context in EDUCATION_SPECS:
        add(entity, recognizer, patterns, context, "education")
    for entity, recognizer, patterns in generic.GENERIC_SPECS:
        add(entity, recognizer, patterns, GENERIC_CONTEXT.get(entity, ()), "generic")
    return tuple(rules)


def context_words(entity: str) -> list[str]:
    """Context words of an entity: its own detector's, else the generic table's."""
    for name, _, _, words in EDUCATION_SPECS:
        if name == entity:
            return list(words)
    return list(GENERIC_CONTEXT.get(entity, ()))


def normal_words(words) -> list[str]:
    """Context words in the form they are compared in: lower case, single spaces, padded."""
    return [" " + re.sub(r"[^\w#]+|_+", " ", w.lower()).strip() + " " for w in words]


def check_pattern(regex: str) -> None:
    """Raise ValueError unless the engine that will run the pattern accepts it.

    That engine is Java's; it is asked if a session is there. Without one Python's is, less its own named groups.
    """
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    try:
        if session is not None:
            session._jvm.java.util.regex.Pattern.compile(FLAGS + regex)
        else:
            re.compile(regex)
    except Exception as e:
        raise ValueError(f"not a pattern: {regex!r}") from e
    if session is None and "(?P" in regex:
        raise ValueError(f"not a Java pattern: {regex!r}")


@dataclass(frozen=True)
class RuleBook:
    """What to detect and how to score it. Immutable; built once per job on the driver."""

    rules: tuple[Rule, ...] = field(default_factory=built_in_rules)
    threshold: float = DEFAULT_THRESHOLD
    entity_thresholds: tuple[tuple[str, float], ...] = ()
    boost: float = 0.35
    boost_floor: float = 0.4
    context_words: int = 5
    #: Characters looked at first for the context words; only speed depends on it.
    context_look: int = 200

    def __post_init__(self):
        if not 0.0 <= self.threshold <= 1.0:
            object.__setattr__(self, "threshold", DEFAULT_THRESHOLD)

    def only(self, entities=None) -> "RuleBook":
        """Keep the rules of these entity types (None = all)."""
        if entities is None:
            return self
        wanted = set(entities)
        return replace(self, rules=tuple(r for r in self.rules if r.entity in wanted))

    def without(self, entities=()) -> "RuleBook":
        """Drop the rules of these entity types; equal to filtering their hits afterwards."""
        dropped = set(entities or ())
        return replace(self, rules=tuple(r for r in self.rules if r.entity not in dropped)) if dropped else self

    def at(self, threshold: float | None = None, **per_entity: float) -> "RuleBook":
        """Change the global threshold and/or thresholds of single entity types."""
        merged = {**dict(self.entity_thresholds), **per_entity}
        return replace(self, threshold=self.threshold if threshold is None else threshold,
                       entity_thresholds=tuple(sorted(merged.items())))

    def plus(self, entity: str, patterns, context=(), recognizer: str | None = None) -> "RuleBook":
        """Append a custom detector; patterns are (name, regex, score) tuples."""
        start = max((r.rule_id for r in self.rules), default=-1) + 1
        added = []
        for k, (name, regex, score) in enumerate(patterns):
            check_pattern(regex)
            added.append(Rule(start + k, entity, recognizer or f"custom:{entity}", name, regex, float(score),
                              tuple(context), None, "custom", ()))
        return replace(self, rules=self.rules + tuple(added))

    def threshold_of(self, entity: str) -> float:
        return dict(self.entity_thresholds).get(entity, self.threshold)

    def reachable(self) -> "RuleBook":
        """Drop rules whose best possible score stays below their threshold."""
        def best(r):
            return min(1.0, max(r.score + self.boost, self.boost_floor)) if r.context else r.score
        return replace(self, rules=tuple(r for r in self.rules if best(r) >= self.threshold_of(r.entity)))

    @property
    def entities(self) -> list[str]:
        return list(dict.fromkeys(r.entity for r in self.rules))


@lru_cache(maxsize=8)
def default_book(domain: str = DEFAULT_DOMAIN) -> RuleBook:
    return RuleBook(rules=built_in_rules(domain))
