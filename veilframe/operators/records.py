"""Records: several text columns of a row, nested values and schema profiles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog.policies import check_mode, get_policy
from ..catalog.profiles import Profile, get_profile
from ..catalog.risk import rank_of
from ..catalog.rules import RuleBook, default_book
from ..functions.core import NO_HITS, column, ident, let, lit, lits, running
from ..functions.pseudonym import Pseudonyms
from ..functions.risk import max_rank_sql, tier_sql, types_sql
from ..functions.rewrite import sanitize_sql
from ..functions.spans import hinted_entities, hits_sql
from ..functions.variants import replaced_udf, strings_udf
from .policy import verdict_sql
from .sanitize import kept_rows


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _field_type(schema: T.StructType, path: str):
    """Type of a column or of a dotted path into structs; None if there is no such field."""
    names = schema.fieldNames()
    if path in names:
        return schema[path].dataType
    head, _, rest = path.partition(".")
    if rest and head in names and isinstance(schema[head].dataType, T.StructType):
        return _field_type(schema[head].dataType, rest)
    return None


def ident_flat(name: str) -> str:
    """Reference to a whole column, dots in its name taken literally."""
    return "`" + name.replace("`", "``") + "`"


def _reference(schema: T.StructType, path: str) -> str:
    return ident_flat(path) if path in schema.fieldNames() else ident(path)


def _targets(df: DataFrame, fields, hints=(), partly: bool = False) -> list[str]:
    """String fields to treat: those named, else all string columns and the nested ones that a profile knows.

    A name that the table lacks is an error, as a typing error would leave a column as it is; so is a named column with
    text at depth, unless ``partly`` says that the caller reports it as skipped.
    """
    if fields is None:
        known = string_columns(df)
        fields = known + [f for f in hints if f not in known]
    else:
        missing = [f for f in fields if _field_type(df.schema, f) is None]
        if missing:
            raise ValueError(f"no such field: {missing}; columns: {df.columns}")
        deep = [f for f in fields if not isinstance(_field_type(df.schema, f), T.StringType) and _holds_text(_field_type(df.schema, f), f)]
        if deep and not partly:
            raise ValueError(f"text at depth in {deep}: sanitize_nested treats it")
    return [f for f in fields if isinstance(_field_type(df.schema, f), T.StringType)]


def _replace(df: DataFrame, values: dict) -> DataFrame:
    """Set columns or struct fields addressed by dotted paths."""
    flat = {f: v for f, v in values.items() if f in df.columns}
    for path, value in values.items():
        if path not in flat:
            head, _, rest = path.partition(".")
            flat[head] = flat.get(head, F.col(ident_flat(head))).withField(rest, value)
    return df.withColumns(flat)


def field_hints(profile: str | Profile | None, custom: dict | None = None) -> dict:
    return dict(get_profile(profile, custom).hints) if profile is not None else {}


def _with_field_hits(df: DataFrame, targets: list[str], hints: dict, book: RuleBook) -> DataFrame:
    """Add __texts (the target columns as one array) and __hits (their hit arrays).

    One detection expression serves all columns, so the plan does not grow with their number;
    the types each field's hint boosts are looked up by its position.
    """
    lists = [sorted(hinted_entities(hints.get(f), book)) for f in targets]
    boosts = f"from_json({lit(json.dumps(lists))}, 'array<array<string>>')"
    texts = f"cast(array({', '.join(_reference(df.schema, f) for f in targets)}) as array<string>)"
    boosted = f"get({boosts}, rc_k)" if any(lists) else None
    return df.withColumn("__texts", column(texts)).withColumn("__hits", column(
        f"transform(__texts, (rc_t, rc_k) -> {hits_sql('rc_t', book, boosted=boosted)})"))


def sanitize_record(df: DataFrame, fields=None, mode: str | None = None, book: RuleBook | None = None, *,
                    profile: str | Profile | None = None, policy=None, custom_profiles: dict | None = None,
                    skip=(), redact_with: str = "", how: Pseudonyms = Pseudonyms(),
                    include_excluded: bool = True) -> DataFrame:
    """Sanitize string columns in place; other columns pass through.

    Adds excluded_fields (columns set to null because the mode or the policy dropped them),
    field_hits (hits per field) and has_pii. A policy wins over a mode; a mode wins over the
    profile's default mode; without any of them the mode is mask. Profile hints boost
    detection in their field under every mode and policy.
    """
    chosen = get_policy(policy) if policy is not None else None
    found = get_profile(profile, custom_profiles) if profile is not None else None
    mode = check_mode(mode or (found.mode if found else "mask"))
    book = (book or default_book()).without(() if chosen else skip)
    targets = _targets(df, fields, dict(found.hints) if found else ())
    before = df.columns
    df = _with_field_hits(df, targets, dict(found.hints) if found else {}, book)
    # Arrays are bound once around each lambda: a plan that inlines them into the lambda would
    # repeat the detection for every field.
    hits = "get(rc_all, rc_k)"
    if chosen:
        verdict = verdict_sql("rc_h", lits(sorted(chosen.block)), lits(sorted(chosen.pass_through)),
                              lit(chosen.exclude_any), lit(chosen.mode), str(rank_of(chosen.warn_at)))
        df = df.withColumn("__verdicts", column(f"transform(__hits, rc_h -> {verdict})"))
        left_alone = lits(sorted({*chosen.pass_through, *skip}))
        rewritable = f"filter({hits}, rc_x -> not array_contains({left_alone}, rc_x.entity_type))"
        done = (f"case when not get(rc_v, rc_k).passed then null when get(rc_v, rc_k).hit_count = 0 "
                f"then rc_t else {sanitize_sql('rc_t', rewritable, chosen.mode, redact_with, how)} end")
        dropped, count = "not get(rc_v, rc_k).passed", "get(rc_v, rc_k).hit_count"
    else:
        done = sanitize_sql("rc_t", hits, mode, redact_with, how)
        dropped, count = f"size({hits}) > 0" if mode == "exclude" else "false", f"size({hits})"
    names = lits(targets)

    def bound(body: str):
        inner = let("rc_v", "__verdicts", body) if chosen else body
        return column(let("rc_all", "__hits", inner))

    df = df.withColumns({
        "__new": bound(f"transform(__texts, (rc_t, rc_k) -> {done})"),
        "excluded_fields": bound(f"filter({names}, (rc_n, rc_k) -> {dropped})"),
        "field_hits": bound(f"filter(transform({names}, (rc_n, rc_k) -> named_struct('field', rc_n, "
                            f"'hit_count', {count})), rc_c -> rc_c.hit_count > 0)"),
        "__all": column("flatten(__hits)" if not chosen else _relevant("flatten(__hits)", chosen)),
    })
    df = _replace(df, {f: column(f"get(__new, {k})") for k, f in enumerate(targets)})
    return _with_contract(df, [F.col(ident_flat(c)) for c in before], include_excluded)


def _relevant(hits: str, policy) -> str:
    return f"filter({hits}, rl_h -> not array_contains({lits(sorted(policy.pass_through))}, rl_h.entity_type))"


def _with_contract(df: DataFrame, before: list, include_excluded: bool = True) -> DataFrame:
    """The columns that every result has: hit_count, entity_types, risk_level, excluded; after the record's own."""
    df = df.select(*before, "excluded_fields", "field_hits", (F.size("field_hits") > 0).alias("has_pii"),
                   column("size(__all)").alias("hit_count"), column(types_sql("__all")).alias("entity_types"),
                   column(tier_sql(max_rank_sql("__all"))).alias("risk_level"),
                   (F.size("excluded_fields") > 0).alias("excluded"))
    return df if include_excluded else kept_rows(df)


def _none(leaf) -> str:
    return f"cast(array() as array<{leaf.typeName()}>)"


def _leaves(ref: str, kind: T.DataType, leaf=T.StringType, depth: int = 0) -> str:
    """All leaves of one type (strings, or variants) inside a value of type ``kind``, in order, as one array."""
    var = f"nl_{depth}"
    if isinstance(kind, leaf):
        return f"array({ref})"
    if isinstance(kind, T.StructType):
        parts = [_leaves(f"{ref}.{ident_flat(f.name)}", f.dataType, leaf, depth + 1) for f in kind if _has(f.dataType, leaf)]
        return f"concat({', '.join(parts)})"
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
    values = ref if isinstance(kind, T.ArrayType) else f"map_values({ref})"
    return f"coalesce(flatten(transform({values}, {var} -> {_leaves(var, inner, leaf, depth + 1)})), {_none(leaf)})"


def _leaf_paths(kind: T.DataType, path: str, ref: str, leaf=T.StringType, depth: int = 0) -> str:
    """The path of every leaf, in the order of ``_leaves``; elements of arrays and maps share their path."""
    var = f"nq_{depth}"
    if isinstance(kind, leaf):
        return f"array({lit(path)})"
    if isinstance(kind, T.StructType):
        parts = [_leaf_paths(f.dataType, f"{path}.{f.name}", f"{ref}.{ident_flat(f.name)}", leaf, depth + 1) for f in kind if _has(f.dataType, leaf)]
        return f"concat({', '.join(parts)})"
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
    values = ref if isinstance(kind, T.ArrayType) else f"map_values({ref})"
    return (f"coalesce(flatten(transform({values}, {var} -> {_leaf_paths(inner, path, var, leaf, depth + 1)})), "
            f"cast(array() as array<string>))")


def _leaf_count(ref: str, kind: T.DataType, leaf=T.StringType, depth: int = 0) -> str | int:
    """Number of leaves: a Python number if the type fixes it, else an expression."""
    if isinstance(kind, leaf):
        return 1
    if isinstance(kind, T.StructType):
        counts = [_leaf_count(f"{ref}.{ident_flat(f.name)}", f.dataType, leaf, depth + 1) for f in kind if _has(f.dataType, leaf)]
        return sum(counts) if all(isinstance(c, int) for c in counts) else "(" + " + ".join(map(str, counts)) + ")"
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
    values = ref if isinstance(kind, T.ArrayType) else f"map_values({ref})"
    each = _leaf_count(f"nc_{depth}", inner, leaf, depth + 1)
    if isinstance(each, int):
        return f"coalesce(size({values}) * {each}, 0)"
    return f"coalesce(aggregate({values}, 0, (nc_a{depth}, nc_{depth}) -> nc_a{depth} + {each}), 0)"


def _put_back(ref: str, kind: T.DataType, base: str, leaf=T.StringType, depth: int = 0) -> str:
    """The value with its leaves of one type taken from the array ``nv_new``, from position ``base`` on."""
    var, at = f"nv_{depth}", f"nv_i{depth}"
    if isinstance(kind, leaf):
        return f"get(nv_new, {base})"
    if not _has(kind, leaf):
        return ref
    if isinstance(kind, T.StructType):
        fields, before = [], [base]
        for f in kind:
            inner = f"{ref}.{ident_flat(f.name)}"
            fields.append(f"{lit(f.name)}, {_put_back(inner, f.dataType, ' + '.join(before), leaf, depth + 1)}")
            if _has(f.dataType, leaf):
                before.append(str(_leaf_count(inner, f.dataType, leaf, depth + 1)))
        return f"case when {ref} is null then null else named_struct({', '.join(fields)}) end"
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
    values = ref if isinstance(kind, T.ArrayType) else f"map_values({ref})"
    each = _leaf_count(var, inner, leaf, depth + 1)
    if isinstance(each, int):
        body = f"transform({values}, ({var}, {at}) -> {_put_back(var, inner, f'{base} + {at} * {each}', leaf, depth + 1)})"
    else:
        counts = f"transform({values}, {var} -> {each})"
        body = let(f"nv_o{depth}", running(counts, "0", lambda a, x: f"{a} + {x}"),
                   f"transform({values}, ({var}, {at}) -> {_put_back(var, inner, f'{base} + get(nv_o{depth}, {at})', leaf, depth + 1)})")
    if isinstance(kind, T.MapType):
        body = f"map_from_arrays(map_keys({ref}), {body})"
    return f"case when {ref} is null then null else {body} end"


def _inner(kind: T.DataType) -> list[T.DataType]:
    if isinstance(kind, T.StructType):
        return [f.dataType for f in kind]
    if isinstance(kind, T.ArrayType):
        return [kind.elementType]
    return [kind.valueType] if isinstance(kind, T.MapType) else []


def _has(kind: T.DataType, leaf) -> bool:
    return isinstance(kind, leaf) or any(_has(k, leaf) for k in _inner(kind))


#: Leaves that may hold text, and leaves that hold none. Any other type is refused, as text in it would stay in clear.
TEXTUAL = (T.StringType, T.VariantType)
PLAIN = (T.NumericType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType, T.AnsiIntervalType,
         T.CalendarIntervalType, getattr(T, "TimeType", T.NullType))


def _holds_text(kind: T.DataType, path: str) -> bool:
    """Whether there is text at any depth; an unknown type is an error."""
    inner = _inner(kind)
    if not inner and not isinstance(kind, (*TEXTUAL, *PLAIN, T.StructType)):
        raise TypeError(f"column {path}: no way to look for text in the type {kind.simpleString()}; leave it out by naming the columns to treat")
    return isinstance(kind, TEXTUAL) or any([_holds_text(k, path) for k in inner])


def _rewritten(df: DataFrame, policy, mode: str, skip, redact_with: str, how: Pseudonyms) -> DataFrame:
    """Add __done: per string of __texts, with hits __hits, its rewritten text and whether it was dropped.

    Detection sees every type; a policy's block list is checked on all hits, and ``skip`` only keeps types out of the
    rewriting, so a caller cannot let blocked data through.
    """
    hits = "get(rn_all, rn_k)"
    left_alone = lits(sorted({*skip, *(policy.pass_through if policy else ())}))
    kept = f"filter({hits}, rn_x -> not array_contains({left_alone}, rn_x.entity_type))"
    if policy:
        verdict = verdict_sql(hits, lits(sorted(policy.block)), lits(sorted(policy.pass_through)),
                              lit(policy.exclude_any), lit(policy.mode), str(rank_of(policy.warn_at)))
        done = sanitize_sql("rn_t", kept, policy.mode, redact_with, how)
        body = let("rn_v", verdict, f"named_struct('text', case when not rn_v.passed then null when rn_v.hit_count = 0 "
                                    f"then rn_t else {done} end, 'dropped', not rn_v.passed, 'hit_count', rn_v.hit_count)")
    else:
        body = let("rn_h", kept, f"named_struct('text', {sanitize_sql('rn_t', 'rn_h', mode, redact_with, how)}, "
                                 f"'dropped', {'size(rn_h) > 0' if mode == 'exclude' else 'false'}, 'hit_count', size(rn_h))")
    return df.withColumn("__done", column(let("rn_all", "__hits", f"transform(__texts, (rn_t, rn_k) -> {body})")))


#: Up to this many strings of a row are told apart, so that those that repeat are detected once; more are not compared with each other.
APART = 64


def _told_apart(texts: str) -> str:
    """The different strings of a row, or all of them if there are many or some are null."""
    return f"case when size({texts}) <= {APART} and not exists({texts}, ta_x -> ta_x is null) then array_distinct({texts}) else {texts} end"


def _for_each(texts: str, apart: str, found: str) -> str:
    """What was found for the different strings, for every string."""
    spread = let("fe_m", f"map_from_arrays(fe_a, {found})", "transform(fe_t, fe_x -> element_at(fe_m, fe_x))")
    return let("fe_t", texts, let("fe_a", apart, f"case when size(fe_t) = size(fe_a) then {found} else {spread} end"))


def sanitize_nested(df: DataFrame, columns=None, mode: str = "mask", book: RuleBook | None = None, *,
                    policy=None, profile: str | Profile | None = None, custom_profiles: dict | None = None, skip=(),
                    redact_with: str = "", how: Pseudonyms = Pseudonyms(), report: bool = False,
                    include_excluded: bool = True) -> DataFrame:
    """Sanitize every string at any depth of struct, array, map and VARIANT columns; other leaves unchanged.

    A row's strings are gathered into one array, detected once and put back by position, so the plan does not grow
    with the number of leaves. Strings of a VARIANT join them and are put back into the binary value, of which nothing
    else changes; a dropped one becomes the variant null. ``profile`` boosts the leaves whose dotted path it knows.
    ``report`` adds excluded_fields (paths of dropped leaves), field_hits and the columns of every result. Keys of maps
    and fields of a VARIANT are names: they are neither searched nor changed. A type that may hide text is an error.
    """
    chosen = get_policy(policy) if policy is not None else None
    hints = field_hints(profile, custom_profiles)
    book = book or default_book()
    before = df.columns
    missing = [c for c in columns or () if c not in before]
    if missing:
        raise ValueError(f"no such column: {missing}; columns: {before}")
    targets = [c for c in (columns if columns is not None else before) if _holds_text(df.schema[c].dataType, c)]
    kinds = {c: df.schema[c].dataType for c in targets}

    def gathered(leaf):
        held = [c for c in targets if _has(kinds[c], leaf)]
        if not held:
            return _none(leaf), "cast(array() as array<string>)"
        return (f"concat({', '.join(_leaves(ident_flat(c), kinds[c], leaf) for c in held)})",
                f"concat({', '.join(_leaf_paths(kinds[c], c, ident_flat(c), leaf) for c in held)})")

    texts, paths = gathered(T.StringType)
    deep = any(_has(k, T.VariantType) for k in kinds.values())
    boosts = {f: sorted(hinted_entities(e, book)) for f, e in hints.items() if e}
    named = bool(boosts) or report  # whether anything asks for the paths
    if deep:
        variants, roots = gathered(T.VariantType)
        df = df.withColumn("__variants", column(variants)).withColumn("__strings", strings_udf(named)("__variants"))
        texts = f"concat({texts}, transform(flatten(__strings), vs_x -> vs_x.text))"
        paths = f"concat({paths}, {let('vs_r', roots, 'flatten(transform(__strings, (vs_v, vs_i) -> transform(vs_v, vs_x -> concat_ws(' + lit('.') + ', get(vs_r, vs_i), nullif(vs_x.path, ' + lit('') + ')))))')})"
    boosted = None
    if boosts:
        table = f"from_json({lit(json.dumps(boosts))}, 'map<string,array<string>>')"
        boosted = f"coalesce(try_element_at({table}, get(rc_p, rc_k)), cast(array() as array<string>))"
    df = df.withColumns({"__every": column(texts), **({"__paths": column(paths)} if named else {})})
    df = df.withColumn("__texts", column("__every" if boosts else _told_apart("__every")))
    hits = f"transform(__texts, (rc_t, rc_k) -> {hits_sql('rc_t', book, boosted=boosted)})"
    df = df.withColumn("__hits", column(let("rc_p", "__paths", hits) if boosts else hits))
    df = _rewritten(df, chosen, check_mode(mode), skip, redact_with, how)
    if not boosts:
        df = df.withColumns({c: column(_for_each("__every", "__texts", c)) for c in ("__done", "__hits")[:1 + report]})
    values, base = {}, []
    for c in targets:
        if _has(kinds[c], T.StringType):
            values[c] = column(let("nv_new", "transform(__done, nd_x -> nd_x.text)", _put_back(ident_flat(c), kinds[c], " + ".join(base) or "0")))
            base.append(str(_leaf_count(ident_flat(c), kinds[c])))
    if deep:
        first = " + ".join(base) or "0"
        ends = running("transform(__strings, vp_v -> size(vp_v))", "0", lambda a, x: f"{a} + {x}")
        cut = let("vp_o", ends, f"transform(__strings, (vp_v, vp_i) -> transform(slice(vp_d, {first} + get(vp_o, vp_i) + 1, size(vp_v)), vp_x -> vp_x.text))")
        found = let("vp_d", "__done", f"case when exists(slice(vp_d, {first} + 1, size(vp_d)), vp_x -> vp_x.hit_count > 0) then {cut} end")
        df = df.withColumn("__cut", column(found)).withColumn("__put", replaced_udf()("__variants", "__cut", F.col("__cut").isNotNull()))
    names = [F.col(ident_flat(c)) for c in before]
    if report:
        alone = f"filter(rp_h, rp_x -> not array_contains({lits(sorted({*skip, *(chosen.pass_through if chosen else ())}))}, rp_x.entity_type))"
        df = df.withColumns({
            "excluded_fields": column("array_distinct(transform(filter(arrays_zip(__paths, __done), xf_z -> xf_z.__done.dropped), xf_y -> xf_y.__paths))"),
            "field_hits": column("filter(transform(arrays_zip(__paths, __done), fh_z -> named_struct('field', fh_z.__paths, "
                                 "'hit_count', fh_z.__done.hit_count)), fh_c -> fh_c.hit_count > 0)"),
            "__all": column(f"flatten(transform(__hits, rp_h -> {alone}))")})
    df = df.withColumns(values)
    if deep:
        values, base = {}, []
        for c in targets:
            if _has(kinds[c], T.VariantType):
                values[c] = column(let("nv_new", "__put", _put_back(ident_flat(c), kinds[c], " + ".join(base) or "0", T.VariantType)))
                base.append(str(_leaf_count(ident_flat(c), kinds[c], T.VariantType)))
        df = df.withColumns(values)
    return _with_contract(df, names, include_excluded) if report else df.select(*names)


#: Strings of a JSON text whose escapes are blanked out, keys included.
_JSON_STRING, _JSON_ESCAPE = '"[^"]*+"', r"(?s)\\."
CORRUPT = "_corrupt_record"


def sanitize_json(df: DataFrame, json_col: str, mode: str = "mask", book: RuleBook | None = None, *, policy=None,
                  skip=(), redact_with: str = "", how: Pseudonyms = Pseudonyms()) -> DataFrame:
    """Sanitize every string value inside a JSON text column, whatever its fields; keys, numbers and layout stay.

    A text that is no JSON becomes null and is kept in the column ``_corrupt_record``, to be set aside with
    ``split_rejects``. A dropped value becomes null.
    """
    chosen = get_policy(policy) if policy is not None else None
    before = [c for c in df.columns if c != CORRUPT]
    text = ident_flat(json_col)
    fine = f"case when try_parse_json({text}) is not null then {text} end"
    # Escapes are two characters and become two others, so a string's place is that in the blanked text; the patterns
    # have no repeated group, which Java would match by recursion. A string is a value unless a colon follows it.
    pairs = (f"zip_with(split(js_m, {lit(_JSON_STRING)}, -1), regexp_extract_all(js_m, {lit(_JSON_STRING)}, 0), "
             f"(js_g, js_s) -> named_struct('g', length(js_g), 's', length(js_s)))")
    starts = running("transform(js_z, js_c -> js_c.g + coalesce(js_c.s, 0))", "0", lambda a, x: f"{a} + {x}")
    cut = ("transform(js_z, (js_d, js_i) -> named_struct('gap', substring(js_t, get(js_o, js_i) + 1, js_d.g), 'raw', "
           "case when js_d.s is not null then substring(js_t, get(js_o, js_i) + js_d.g + 1, js_d.s) end))")
    told = ("transform(js_p, (js_x, js_k) -> named_struct('gap', js_x.gap, 'raw', js_x.raw, 'value', js_x.raw is not null and not "
            "startswith(ltrim(get(js_p, js_k + 1).gap), ':')))")
    df = df.withColumn("__fine", column(fine)).withColumn("__parts", column(let("js_t", "__fine", let(
        "js_m", f"regexp_replace(js_t, {lit(_JSON_ESCAPE)}, '##')", let("js_z", pairs, let("js_o", starts, let("js_p", cut, told)))))))
    df = df.withColumn("__texts", column("transform(__parts, jt_x -> case when jt_x.value then get(from_json(concat('[', jt_x.raw, ']'), 'array<string>'), 0) end)"))
    df = df.withColumn("__hits", column(f"transform(__texts, rc_t -> {hits_sql('rc_t', book or default_book())})"))
    df = _rewritten(df, chosen, check_mode(mode), skip, redact_with, how)
    quoted = "substring(to_json(array(jd_x.text)), 2, length(to_json(array(jd_x.text))) - 2)"
    piece = (f"transform(zip_with(__parts, __done, (jz_p, jz_d) -> named_struct('gap', jz_p.gap, 'raw', jz_p.raw, 'value', jz_p.value, "
             f"'hits', jz_d.hit_count, 'text', jz_d.text)), jd_x -> concat(jd_x.gap, case when jd_x.raw is null then '' "
             f"when not jd_x.value or jd_x.hits = 0 then jd_x.raw when jd_x.text is null then 'null' else {quoted} end))")
    return df.withColumns({json_col: column(f"case when __fine is not null then array_join({piece}, '') end"),
                           CORRUPT: column(f"case when __fine is null then {text} end")}).select(
        *[F.col(ident_flat(c)) for c in before], CORRUPT)


def scan_record(df: DataFrame, fields=None, book: RuleBook | None = None, *,
                profile: str | Profile | None = None, custom_profiles: dict | None = None, skip=()) -> DataFrame:
    """Field-by-field report of each row, text unchanged.

    Adds field_report (one struct per field; non-string fields are marked skipped), total_hits,
    highest_risk and flagged_fields.
    """
    book = (book or default_book()).without(skip)
    hints = field_hints(profile, custom_profiles)
    wanted = list(fields) if fields is not None else df.columns + [f for f in hints if f not in df.columns
                                                                    and _field_type(df.schema, f) is not None]
    targets = _targets(df, wanted, partly=True)
    before = df.columns
    df = _with_field_hits(df, targets, hints, book)
    # Position of each wanted field among the scanned ones; a field that is no string has none.
    places = lits([targets.index(f) if f in targets else None for f in wanted], "int")
    row = let("sr_p", f"get({places}, sr_k)", let("sr_h", f"coalesce(get(sr_all, sr_p), {NO_HITS})", (
        f"named_struct('field', sr_n, 'skipped', sr_p is null or get(__texts, sr_p) is null, "
        f"'pii_found', size(sr_h) > 0, 'hit_count', size(sr_h), 'entity_types', {types_sql('sr_h')}, "
        f"'risk_rank', {max_rank_sql('sr_h')})")))
    # Bound once around the lambda, or an inlined plan would detect anew for every field.
    df = df.withColumn("__report", column(
        let("sr_all", "__hits", f"transform({lits(wanted)}, (sr_n, sr_k) -> {row})")))
    return df.select(
        *[F.col(ident_flat(c)) for c in before],
        column(f"transform(__report, r -> named_struct('field', r.field, 'skipped', r.skipped, 'pii_found', "
               f"r.pii_found, 'hit_count', r.hit_count, 'entity_types', r.entity_types, "
               f"'risk_level', {tier_sql('r.risk_rank')}))").alias("field_report"),
        column("aggregate(__report, 0, (a, r) -> a + r.hit_count)").alias("total_hits"),
        column(tier_sql("coalesce(array_max(transform(__report, r -> r.risk_rank)), 0)")).alias("highest_risk"),
        column("transform(filter(__report, r -> r.pii_found), r -> r.field)").alias("flagged_fields"))


def field_rows(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (record, field) of a scanned table."""
    return scanned.select(*keys, F.explode_outer("field_report").alias("r")).where(
        F.col("r").isNotNull()).select(*keys, "r.*")


def column_profile(df: DataFrame, fields=None, book: RuleBook | None = None, *,
                   profile: str | Profile | None = None, skip=()) -> DataFrame:
    """Per column over the whole table: rows, rows with hits, hit rate, top type, highest risk."""
    rows = field_rows(scan_record(df, fields, book, profile=profile, skip=skip), [])
    rank = F.array_position(F.array(*[F.lit(t) for t in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]), F.col("risk_level")) - 1
    # One pass: a row for the field as a whole (no type) and one for each of its types; groups are as many as the types.
    marks = rows.withColumn("entity_type", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("entity_types"))))
    whole = F.col("entity_type").isNull()
    counted = marks.groupBy("field", "entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(whole & ~F.col("skipped")).alias("scanned_rows"),
        F.count_if(whole & F.col("pii_found")).alias("rows_with_pii"), F.sum(F.when(whole, F.col("hit_count"))).alias("hit_count"),
        F.max(F.when(whole, rank)).cast("int").alias("max_rank"))
    return counted.groupBy("field").agg(
        F.sum("scanned_rows").alias("scanned_rows"), F.sum("rows_with_pii").alias("rows_with_pii"), F.sum("hit_count").alias("hit_count"),
        F.min_by("entity_type", F.when(~whole, F.struct((-F.col("n")).alias("a"), F.col("entity_type").alias("b")))).alias("top_entity"),
        F.max("max_rank").alias("max_rank")).select(
        "field", "scanned_rows", "rows_with_pii", "hit_count", "top_entity",
        F.round(F.col("rows_with_pii") / F.greatest(F.col("scanned_rows"), F.lit(1)), 6).alias("hit_rate"),
        column(tier_sql("max_rank")).alias("highest_risk"))


def scan_by_profile(long: DataFrame, profile_col: str = "profile", field_col: str = "field",
                    value_col: str = "value", book: RuleBook | None = None,
                    custom_profiles: dict | None = None) -> DataFrame:
    """Hits of (profile, field, value) rows where the profile varies per row.

    The hint of each row comes from a join with the profile table, which holds one row per
    (profile, field) of the catalog and is broadcast for that reason.
    """
    book = book or default_book()
    from ..catalog.profiles import PROFILES
    merged = {**(custom_profiles or {}), **PROFILES}
    rows = [(p.name, f, sorted(hinted_entities(e, book))) for p in merged.values() for f, e in p.hints.items()]
    hints = long.sparkSession.createDataFrame(rows, "h_profile string, h_field string, boosted array<string>")
    joined = long.join(F.broadcast(hints), (F.col(profile_col) == F.col("h_profile"))
                       & (F.col(field_col) == F.col("h_field")), "left").drop("h_profile", "h_field")
    return joined.withColumn("hits", column(hits_sql(ident(value_col), book, boosted="boosted"))).drop("boosted")
