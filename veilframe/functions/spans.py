"""Detection: text -> array of scored hits, as one native expression.

Positions are code points. Spark's regex functions return the matched strings
but not where they are, so a start is rebuilt from both halves of the text: the
gaps left by ``split`` and the matches from ``regexp_extract_all``, which
alternate gap, match, gap, match ... A running sum over both is exact.
"""

from __future__ import annotations

import json

from ..catalog.rules import TERMS_SCREEN, Rule, RuleBook, context_words, normal_words, starts_screen
from .core import HITS_TYPE, NO_HITS, leading, let, lit, pieces, running
from .overlap import drop_contained
from .validators import checked

# Characters outside ASCII that equal an ASCII letter when case is ignored; lower() does not
# map all of them to it, so their presence switches the stem screens off for that row.
_CASE_ALIASES = ("ſ", "ı", "İ", "K")


#: Screens of texts that have a digit: letters of any alphabet, digits with a separator between them, digits behind a short word, digits behind a blank.
_BESIDE_DIGITS = {"letters": r"\p{L}", "joined": r"(?U)\d[-/. :]\d", "coded": r"(?iU)\b[a-z]{1,3}[-\s]?\d\d", "dated": r"(?U)\p{L}\.?\s+\d"}


def _any_in(haystack: str, stems) -> list[str]:
    return [f"contains({haystack}, {lit(s)})" for s in stems]


def _flat(needs):
    for kind, args in needs:
        if kind == "one":
            yield from _flat(args)
        else:
            yield kind, args


def _screens(text: str, rules) -> str:
    """Struct of cheap per-row facts that decide which patterns need to run."""
    needs = {need for r in rules for need in _flat(r.needs)}
    starts = {s for kind, args in needs if kind == "starts" for s in args}
    words = {w for kind, args in needs if kind == "word" for w in args}
    fields = []
    if any(kind in ("any", "starts", "word") for kind, _ in needs):
        fields += ["'low', sp_l", f"'odd', {' or '.join(_any_in(text, _CASE_ALIASES))}"]
    if starts or words:
        fields.append(f"'starts', sp_l rlike {lit(starts_screen(starts, words))}")
    if any(kind == "terms" for kind, _ in needs):
        fields.append(f"'terms', {text} rlike {lit(TERMS_SCREEN)}")
    runs = sorted({args[0] for kind, args in needs if kind == "digits"})
    fields += [f"'digits{n}', sp_d{n}" for n in runs]
    # These need a digit as well: every rule that asks for them asks for a run of digits.
    some = f"sp_d{runs[0]} and " if runs else ""
    fields += [f"{lit(kind)}, {some}{text} rlike {lit(screen)}" for kind, screen in _BESIDE_DIGITS.items() if any(kind == k for k, _ in needs)]
    screens = f"named_struct({', '.join(fields) or lit('none') + ', 0'})"
    # A longer run is looked for only where a shorter one was found.
    for k in range(len(runs) - 1, -1, -1):
        found = f"{text} rlike {lit('(?U)' + chr(92) + 'd{%d}' % runs[k])}"
        screens = let(f"sp_d{runs[k]}", f"sp_d{runs[k - 1]} and {found}" if k else found, screens)
    return let("sp_l", f"concat(' ', lower({text}))", screens)


def _holds(need, text: str, screen: str) -> str:
    kind, args = need
    if kind == "digits":
        return f"{screen}.digits{args[0]}"
    if kind in ("terms", *_BESIDE_DIGITS):
        return f"{screen}.{kind}"
    if kind == "any":
        return f"({' or '.join(_any_in(screen + '.low', args))} or {screen}.odd)"
    if kind in ("starts", "word"):
        screened = starts_screen(args, ()) if kind == "starts" else starts_screen((), args)
        return f"({screen}.odd or {screen}.starts and {screen}.low rlike {lit(screened)})"
    return "(" + " or ".join(_holds(n, text, screen) for n in args) + ")"


def _may_match(rule: Rule, text: str, screen: str) -> str:
    return " and ".join(_holds(need, text, screen) for need in rule.needs) or "true"


def _gate(rule: Rule) -> tuple[str, str]:
    """The kind of need that a rule shares with others, and what it asks of that kind, so that one look at each shuts them all."""
    kinds = [kind for kind, _ in rule.needs]
    gate = next((k for k in ("starts", "one", "terms", *_BESIDE_DIGITS, "any", "digits") if k in kinds), "").replace("one", "starts")
    if gate == "any":
        # rules that wait for the same mark: an address and a mail address both need an @
        return gate, min(s[0] for kind, args in rule.needs if kind == "any" for s in args)
    return gate, str(min((args[0] for kind, args in rule.needs if kind == "digits"), default="")) if gate not in ("starts", "terms") else ""


def _opened(gate: str, rules, screen: str) -> str:
    """Necessary condition for any of these rules, all of one gate."""
    if gate == "starts":
        return f"({screen}.odd or {screen}.starts)"
    if gate == "any":
        stems = sorted({s for r in rules for kind, args in r.needs if kind == "any" for s in args}, key=len)
        stems = [s for k, s in enumerate(stems) if not any(t in s for t in stems[:k])]
        return f"({' or '.join(_any_in(screen + '.low', stems))} or {screen}.odd)"
    runs = [args[0] for r in rules for kind, args in r.needs if kind == "digits"]
    needs = ([(gate, ())] if gate in ("terms", *_BESIDE_DIGITS) else []) + ([("digits", (min(runs),))] if len(runs) == len(rules) else [])
    return " and ".join(_holds(need, "", screen) for need in needs) or "true"


def _tried(text: str, rules) -> str:
    """array<struct<i,m>>: the place of every rule whose gates are open, with its matches. Rules of a shut gate cost nothing."""
    gates: dict[str, dict[str, list]] = {}
    for place, rule in enumerate(rules):
        gate, part = _gate(rule)
        gates.setdefault(gate, {}).setdefault(part, []).append((place, rule))
    none = "cast(array() as array<struct<i:int,m:array<string>>>)"

    def joined(parts):
        return parts[0] if len(parts) == 1 else f"flatten(array({', '.join(parts)}))"

    def opened(gate, placed, found):
        return f"if({_opened(gate, [r for _, r in placed], 'sp_s')}, {found}, {none})"

    parts = []
    for gate, inner in gates.items():
        found = [(placed, "array(" + ", ".join(
            f"named_struct('i', {place}, 'm', if({_may_match(r, text, 'sp_s')}, regexp_extract_all({text}, {lit(r.java)}, 0), null))"
            for place, r in placed) + ")") for placed in inner.values()]
        if len(found) > 1:
            parts.append(opened(gate, [p for placed in inner.values() for p in placed], joined([opened(gate, *f) for f in found])))
        else:
            parts.append(opened(gate, *found[0]))
    return let("sp_s", _screens(text, rules), joined(parts))


def _found(text: str, rules) -> str:
    """array<struct<i,m>>: the rules that match, by their places, with their matches."""
    return f"filter({_tried(text, rules)}, sp_n -> size(sp_n.m) > 0)"


def _matches(text: str, rules) -> str:
    """array<array<string>>: per rule its matches, null where it has none."""
    return let("sp_f", _found(text, rules), f"transform(sequence(0, {len(rules) - 1}), sp_k -> get(filter(sp_f, sp_n -> sp_n.i = sp_k), 0).m)")


_BLANKS = chr(92) + "s+"
_MARKS = "[^" + chr(92) + "p{L}" + chr(92) + "p{N}#]+"


def _tail_words(start: str, width: int) -> str:
    """The words among the last characters before a hit; the first of them may be cut."""
    tail = f"substring(sp_t, greatest({start} - {width} + 1, 1), least({start}, {width}))"
    return f"filter(split({tail}, {lit(_BLANKS)}), sp_u -> sp_u <> '')"


def _near_in(words: str, wanted: int) -> str:
    """Whether a context word stands in the last of these words: lower case, punctuation as single spaces, padded."""
    last = f"array_join(slice({words}, greatest(size({words}) - {wanted - 1}, 1), {wanted}), ' ')"
    plain = f"concat(' ', regexp_replace(lower({last}), {lit(_MARKS)}, ' '), ' ')"
    return let("sp_p", plain, "exists(sp_q.words, sp_v -> contains(sp_p, sp_v))")


def _said_at_all() -> str:
    """Necessary condition for a context word before any hit: it is in the text, at its end maybe only as the beginning of a word.

    A hit may cut the word before it. What a capital sigma becomes depends on the letter after it, so texts with one are looked at.
    """
    return "(contains(sp_t, 'Σ') or exists(sp_q.words, sp_v -> contains(sp_low, rtrim(sp_v))))"


def _context_index() -> str:
    """Where the words of the text start, its tokens, and the tokens in lower case joined by blanks; linear in the text."""
    token = "[" + _MARKS[2:]
    return (f"named_struct('starts', transform({pieces('sp_t', chr(92) + 'S+')}, sp_e -> sp_e.start), 'tokens', {pieces('sp_t', token, 'lower({})')}, "
            f"'plain', array_join(transform(regexp_extract_all(sp_t, {lit(token)}, 0), sp_e -> lower(sp_e)), ' '))")


def _near_by_index(wanted: int) -> str:
    """The same answer as ``_near_in`` for the words before sp_x.start, by bisections in the index instead of cutting the text.

    The last token is cut where the hit starts. What is copied of a text whose words are very long is searched as it is.
    """
    def tokens_before(bound):
        return leading("size(sp_ix.tokens)", lambda i: f"get(sp_ix.tokens, {i}).start < {bound}")

    words_before = leading("size(sp_ix.starts)", lambda i: f"get(sp_ix.starts, {i}) < sp_x.start")
    low = let("sp_b", f"get(sp_ix.starts, greatest({words_before} - {wanted}, 0))", tokens_before("sp_b"))
    ends = f"named_struct('low', {low}, 'last', {tokens_before('sp_x.start')} - 1)"
    first, last = "get(sp_ix.tokens, sp_a.low).before", "get(sp_ix.tokens, sp_a.last)"
    said = (f"concat(' ', substring(sp_ix.plain, {first} + 1, {last}.before - {first}), "
            f"lower(substring(sp_t, {last}.start + 1, least({last}.`end`, sp_x.start) - {last}.start)), ' ')")
    found = f"case when sp_a.low <= sp_a.last then {let('sp_p', said, 'exists(sp_q.words, sp_v -> contains(sp_p, sp_v))')} else false end"
    return let("sp_a", ends, found)


def hinted_entities(hint: str | None, book: RuleBook) -> set[str]:
    """Entity types boosted by a field hint: those sharing a context word with the hinted type."""
    words = set(context_words(hint)) if hint else set()
    return {r.entity for r in book.rules if words & set(r.context)}


def hits_sql(text: str, book: RuleBook, hint: str | None = None, boosted: str | None = None) -> str:
    """All hits of ``text`` under ``book``, ascending by (start, end, entity type).

    ``text``     SQL expression of the text.
    ``hint``     entity type of the field, known on the driver.
    ``boosted``  SQL expression of an array<string> of entity types to boost, when hints vary per row.
    """
    rules = book.reachable().rules
    if not rules:
        return NO_HITS
    always = hinted_entities(hint, book)
    seen = "sp_q.hinted"
    if boosted is not None:
        seen = f"(sp_q.hinted or coalesce(array_contains({boosted}, sp_q.entity), false))"
    # Per fired rule its spans, each with the words of the last characters before it. Where these are too few, as in
    # text with hardly any blanks, the words are looked up in an index of the text, built once and only then.
    # A rule none of whose context words stands anywhere in the text is not looked at any closer.
    width, wanted = book.context_look, book.context_words
    words = f"case when sp_said then {_tail_words('sp_g.start', width)} end"
    spans = f"transform({_spans(rules)}, sp_g -> named_struct('start', sp_g.start, 'end', sp_g.`end`, 'words', {words}))"
    said = f"size(sp_q.words) > 0 and not {seen} and {_said_at_all()}"
    rule = "get(sp_rules, sp_i.i)"
    spans = f"transform(sp_f, sp_i -> {let('sp_q', rule, let('sp_said', said, spans))})"
    spans = let("sp_low", f"concat(' ', regexp_replace(lower(sp_t), {lit(_MARKS)}, ' '))", spans)
    short = f"(size(sp_x.words) <= {wanted} and sp_x.start > {width})"
    index = f"case when exists(sp_w, sp_g -> exists(sp_g, sp_x -> {short})) then {_context_index()} end"
    near = f"case when sp_x.words is null then false when {short} then {_near_by_index(wanted)} else {_near_in('sp_x.words', wanted)} end"
    score = (f"case when size(sp_q.words) > 0 and ({seen} or {near}) "
             f"then least(1.0D, greatest(sp_q.base + {lit(float(book.boost))}, {lit(float(book.boost_floor))})) "
             f"else sp_q.base end")
    scored = (f"transform(get(sp_w, sp_s), sp_x -> named_struct('start', sp_x.start, 'end', sp_x.`end`, "
              f"'entity_type', sp_q.entity, 'score', {score}, 'pattern_id', sp_q.id))")
    per_rule = let("sp_q", rule, f"filter({scored}, sp_h -> sp_h.score >= sp_q.lim)")
    gathered = f"cast(flatten(transform(sp_f, (sp_i, sp_s) -> {per_rule})) as {HITS_TYPE})"
    gathered = let("sp_rules", _rule_table(rules, book, always), let("sp_w", spans, let("sp_ix", index, gathered)))
    found = f"case when size(sp_f) = 0 then {NO_HITS} else {drop_contained(f'sort_array({gathered})')} end"
    return let("sp_t", text, f"case when sp_t is null then {NO_HITS} else {let('sp_f', _found('sp_t', rules), found)} end")


def _rule_table(rules, book: RuleBook, always: set[str]) -> str:
    """The rules as one constant array: the planner folds the JSON text into a single literal."""
    rows = [{"id": r.rule_id, "entity": r.entity, "rx": r.java, "base": float(r.score),
             "lim": float(book.threshold_of(r.entity)), "kind": r.validator or "",
             "hinted": r.entity in always, "words": normal_words(r.context)} for r in rules]
    schema = ("array<struct<id:int,entity:string,rx:string,base:double,lim:double,kind:string,"
              "hinted:boolean,words:array<string>>>")
    return f"from_json({lit(json.dumps(rows))}, '{schema}')"


def _spans(rules) -> str:
    """array<struct<start,end,m>> of the rule sp_q, whose matches are sp_i.m; validated."""
    pairs = ("zip_with(sp_i.m, split(sp_t, sp_q.rx, -1), "
             "(sp_a, sp_b) -> named_struct('m', sp_a, 'gap', length(sp_b)))")
    steps = "transform(sp_z, sp_c -> sp_c.gap + coalesce(length(sp_c.m), 0))"
    start = "get(sp_y, sp_k) + sp_d.gap"
    # the only match of a text, and of many more the first, stands behind the first gap
    places = f"case when size(sp_z) <= 2 then array(0) else {running(steps, '0', lambda a, x: f'{a} + {x}')} end"
    spans = (f"transform(filter(sp_z, sp_c -> sp_c.m is not null), (sp_d, sp_k) -> named_struct('start', {start}, "
             f"'end', {start} + length(sp_d.m), 'm', sp_d.m))")
    folded = let("sp_z", pairs, let("sp_y", places, spans))
    if not any(r.validator for r in rules):
        return folded
    return f"filter({folded}, sp_g -> {checked('sp_q.kind', 'sp_g.m')})"
