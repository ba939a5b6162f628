"""VARIANT values: their strings as an array, and a value with its strings replaced.

Spark has no expression that changes a leaf of a VARIANT, and a detour over JSON text would turn dates, times, binaries
and floats into strings or other numbers. So two small Arrow functions work on the binary form (the open VARIANT encoding
of Parquet): every byte that is not part of a replaced string, or of the offsets around it, stays as it is. Detection and
rewriting between the two are the same native expressions as for any text. Both walk all values of a batch at once, one
level of nesting after the other, so a node costs a few array operations and no Python object.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F

PRIMITIVE, SHORT, OBJECT, ARRAY = range(4)
LONG = 16
#: Bytes after the header of each primitive type, by its number; those of binaries and long strings carry their length.
SIZES = {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 4, 6: 8, 7: 8, 8: 5, 9: 9, 10: 17, 11: 4, 12: 8, 13: 8, 14: 4, 17: 8, 18: 8, 19: 8, 20: 16}
COUNTED = (15, LONG)
#: One per variant: its strings with their paths; null for a null variant.
STRINGS = "array<struct<path:string,text:string>>"
#: Strings up to this length are copied together, a byte of each at a time; longer ones one by one.
TOGETHER = 64
#: Bytes of values that are walked at once: what a walk keeps for every node is bounded, whatever a batch holds.
BLOCK = 1 << 22

# Executors get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column, and the bounds of its entries."""
    _, ends, data = column.buffers()
    bounds = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), bounds


def _ints(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Little-endian numbers of 1 to 4 bytes."""
    out = np.zeros(len(at), np.int64)
    for b in range(4):
        more = np.flatnonzero(size > b)
        out[more] |= data[at[more] + b].astype(np.int64) << 8 * b
    return out


def _put_ints(out: np.ndarray, at: np.ndarray, size: np.ndarray, values: np.ndarray) -> None:
    for b in range(4):
        more = np.flatnonzero(size > b)
        out[at[more] + b] = values[more] >> 8 * b & 255


def _copy(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    for k in np.flatnonzero(size > TOGETHER):
        out[to[k]:to[k] + size[k]] = data[start[k]:start[k] + size[k]]
    for b in range(TOGETHER):
        more = np.flatnonzero((size > b) & (size <= TOGETHER))
        if not len(more):
            break
        to, start, size = to[more], start[more], size[more]
        out[to + b] = data[start + b]


def _blocks(bounds: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    return np.split(rows, np.flatnonzero(np.diff(np.cumsum(bounds[rows + 1] - bounds[rows]) // BLOCK)) + 1)


def _before(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


class _Level:
    """All nodes of one depth, of every value: those of a parent stand together, in the order of its fields or elements."""

    def __init__(self, data: np.ndarray, at: np.ndarray, row: np.ndarray, parent: np.ndarray, place: np.ndarray, limit: np.ndarray):
        self.at, self.row, self.parent, self.place = at, row, parent, place
        if len(at) and (at >= limit[row]).any():
            raise ValueError("malformed VARIANT")
        head = data[at]
        self.kind, self.info = (head & 3).astype(np.int64), (head >> 2).astype(np.int64)
        plain, box = self.kind == PRIMITIVE, self.kind >= OBJECT
        counted = plain & np.isin(self.info, COUNTED)
        sizes = np.full(64, -1, np.int64)
        sizes[list(SIZES)] = list(SIZES.values())
        unknown = plain & ~counted & (sizes[self.info] < 0)
        if unknown.any():
            raise ValueError(f"unknown type {self.info[unknown][0]} in a VARIANT")
        self.first = at + np.where(counted, 5, np.where(plain, 0, 1))
        self.size = np.where(plain, 1 + sizes[self.info], self.info)
        self.size[counted] = _ints(data, at[counted] + 1, np.full(counted.sum(), 4))
        self.kind[counted & (self.info == LONG)] = SHORT
        self.text = self.kind == SHORT
        # containers: count, ids of the fields, offsets of the children
        is_object = self.kind == OBJECT
        wide = np.where(self.info >> np.where(is_object, 4, 2) & 1, 4, 1)
        self.offset = (self.info & 3) + 1
        self.ids = np.where(is_object, (self.info >> 2 & 3) + 1, 0)
        self.count = np.zeros(len(at), np.int64)
        self.count[box] = _ints(data, at[box] + 1, wide[box])
        self.ids_at = at + 1 + wide
        self.table = self.ids_at + self.count * self.ids
        self.size[box] = 0
        end = np.where(box, self.table + (self.count + 1) * self.offset, self.first + self.size)
        if (end > limit[row]).any():
            raise ValueError("malformed VARIANT")

    def below(self, data: np.ndarray, limit: np.ndarray) -> _Level:
        parent = np.repeat(np.arange(len(self.at)), self.count)
        place = np.arange(len(parent)) - _before(self.count)[parent]
        offset, table = self.offset[parent], self.table[parent]
        at = table + (self.count[parent] + 1) * offset + _ints(data, table + place * offset, offset)
        return _Level(data, at, self.row[parent], parent, place, limit)


def _levels(data: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> list[_Level]:
    """The nodes of the values with these numbers, by depth; ``texts`` is how many strings a node holds, ``order`` their first number."""
    limit = bounds[1:]
    none = np.zeros(len(rows), np.int64)
    levels = [_Level(data, bounds[rows], rows, none, none, limit)]
    while levels[-1].count.any():
        levels.append(levels[-1].below(data, limit))
    for level in levels:
        level.texts = level.text.astype(np.int64)
    for upper, lower in zip(levels[-2::-1], levels[:0:-1]):
        np.add.at(upper.texts, lower.parent, lower.texts)
    levels[0].order = _before(levels[0].texts)
    for upper, lower in zip(levels, levels[1:]):
        among = _before(lower.texts)
        lower.order = upper.order[lower.parent] + among - among[np.arange(len(among)) - lower.place]
    return levels


def _paths(data: np.ndarray, levels: list[_Level], metadata: pa.Array, total: int) -> list[str]:
    """The dotted path of every string, by its number. Elements share their array's path, as in a plain array."""
    names = metadata.dictionary_encode()
    number, held = names.indices.to_numpy(zero_copy_only=False), [m or b"" for m in names.dictionary.to_pylist()]
    known, out, above = {}, [""] * total, np.array([""] * len(levels[0].at), object)
    for upper, level in zip([None, *levels], levels):
        paths = above
        if upper is not None:
            paths = above[level.parent]
            width = upper.ids[level.parent]
            some = np.flatnonzero((width > 0) & (level.texts > 0))
            parent, width = level.parent[some], width[some]
            ids = _ints(data, upper.ids_at[parent] + level.place[some] * width, width)
            for k, key in zip(some.tolist(), zip(number[level.row[some]].tolist(), ids.tolist())):
                if key not in known:
                    known[key] = _key(held[key[0]], key[1])
                paths[k] = f"{paths[k]}.{known[key]}" if paths[k] else known[key]
        texts = np.flatnonzero(level.text)
        for k, path in zip(level.order[texts].tolist(), paths[texts].tolist()):
            out[k] = path
        above = paths
    return out


def _key(metadata: bytes, number: int) -> str:
    def at(k):
        return int.from_bytes(metadata[k:k + size], "little")

    size = (metadata[0] >> 6) + 1
    first = 1 + size
    base = first + (at(1) + 1) * size
    return metadata[base + at(first + number * size):base + at(first + (number + 1) * size)].decode()


def _column(kind: pa.DataType, sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError("the texts of an Arrow batch exceed 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def strings_of(value: pa.Array, metadata: pa.Array, there: np.ndarray, with_paths: bool = True) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """How many strings each variant has, and the paths and texts of all, in order; where it is not there, none."""
    data, bounds = _bytes(value)
    counts, paths, texts = np.zeros(len(value), np.int64), [], []
    for rows in _blocks(bounds, np.flatnonzero(there)):
        levels = _levels(data, bounds, rows)
        counts[rows] = levels[0].texts
        total = int(levels[0].texts.sum())
        first, size = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for level in levels:
            order = level.order[level.text]
            first[order], size[order] = level.first[level.text], level.size[level.text]
        out = np.zeros(size.sum(), np.uint8)
        _copy(out, _before(size), data, first, size)
        texts.append(_column(pa.string(), size, out))
        texts[-1].validate(full=True)
        paths.append(pa.array(_paths(data, levels, metadata, total), pa.string()) if with_paths else pa.nulls(total, pa.string()))
    return counts, pa.concat_arrays(paths), pa.concat_arrays(texts)


def replaced_in(value: pa.Array, rows: np.ndarray, texts: pa.Array) -> pa.Array:
    """The values with these numbers, their strings replaced in the order of ``strings_of``; null becomes the variant null."""
    data, bounds = _bytes(value)
    done, out = 0, []
    for block in _blocks(bounds, rows):
        levels = _levels(data, bounds, block)
        wanted = int(levels[0].texts.sum())
        out.append(_rebuilt(data, levels, texts[done:done + wanted]))
        done += wanted
    if done != len(texts):
        raise ValueError("not as many texts as strings")
    return pa.concat_arrays(out)


def _rebuilt(data: np.ndarray, levels: list[_Level], texts: pa.Array) -> pa.Array:
    new, ends = _bytes(texts)
    null, length = texts.is_null().to_numpy(zero_copy_only=False), np.diff(ends)
    length = np.where(null, 0, length)
    own = np.where(null | (length < 64), 1, 5)
    # sizes from the leaves up: a container's head, its ids, the ends of its children, and these
    for k, level in reversed(list(enumerate(levels))):
        box = level.kind >= OBJECT
        level.held = np.zeros(len(level.at), np.int64)
        if k + 1 < len(levels):
            np.add.at(level.held, levels[k + 1].parent, levels[k + 1].new_size)
        level.width = 1 + (level.held >= 1 << 8).astype(np.int64) + (level.held >= 1 << 16) + (level.held >= 1 << 24)
        level.wide = np.where(level.count > 255, 4, 1)
        level.new_size = np.where(box, 1 + level.wide + level.count * level.ids + (level.count + 1) * level.width + level.held,
                                  level.size + (level.first - level.at))
        mine = level.order[level.text]
        level.new_size[level.text] = own[mine] + length[mine]
    sizes = levels[0].new_size
    out = np.zeros(sizes.sum(), np.uint8)
    for k, level in enumerate(levels):
        if not k:
            level.to = _before(sizes)
        else:
            upper, parent = levels[k - 1], level.parent
            among = _before(level.new_size)
            end = among + level.new_size - among[np.arange(len(among)) - level.place]
            table = upper.to + 1 + upper.wide + upper.count * upper.ids
            _put_ints(out, table[parent] + (level.place + 1) * upper.width[parent], upper.width[parent], end)
            level.to = (table + (upper.count + 1) * upper.width)[parent] + end - level.new_size
        leaf = np.flatnonzero(level.kind == PRIMITIVE)
        _copy(out, level.to[leaf], data, level.at[leaf], level.new_size[leaf])
        text = np.flatnonzero(level.text)
        to, mine = level.to[text], level.order[text]
        size = length[mine]
        out[to] = np.where(null[mine], 0, np.where(own[mine] == 1, size << 2 | SHORT, LONG << 2))
        _put_ints(out, to + 1, own[mine] - 1, size)
        _copy(out, to + own[mine], new, ends[mine], size)
        box = np.flatnonzero(level.kind >= OBJECT)
        to, many, is_object = level.to[box], level.wide[box] == 4, level.kind[box] == OBJECT
        info = level.width[box] - 1 | np.where(is_object, level.info[box] & 12 | np.where(many, 16, 0), np.where(many, 4, 0))
        out[to] = info << 2 | level.kind[box]
        _put_ints(out, to + 1, level.wide[box], level.count[box])
        _copy(out, to + 1 + level.wide[box], data, level.ids_at[box], (level.count * level.ids)[box])
    return _column(pa.binary(), sizes, out)


def strings(value: bytes, metadata: bytes) -> list[dict]:
    """Every string of a variant with its dotted path (empty at the top), in order."""
    _, paths, texts = strings_of(pa.array([value], pa.binary()), pa.array([metadata], pa.binary()), np.ones(1, bool))
    return [{"path": p, "text": t} for p, t in zip(paths.to_pylist(), texts.to_pylist())]


def replaced(value: bytes, texts: list) -> bytes:
    """The value with its strings, in the order of ``strings``, replaced; null becomes the variant null."""
    return replaced_in(pa.array([value], pa.binary()), np.zeros(1, np.int64), pa.array(texts, pa.string()))[0].as_py()


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _parts(variants: pa.Array):
    """Of an array<variant> column: variants to a row, their values and metadata, and which of them are no null."""
    flat = variants.flatten()
    return (variants.value_lengths().fill_null(0).to_numpy(), flat.field("value").cast(pa.binary()), flat.field("metadata").cast(pa.binary()),
            flat.is_valid().to_numpy(zero_copy_only=False))


def strings_udf(with_paths: bool = True):
    """array<variant> -> array<array<struct<path, text>>>, null variants as empty arrays; paths are null unless asked for."""
    @F.arrow_udf(f"array<{STRINGS}>")
    def run(variants: pa.Array) -> pa.Array:
        lengths, value, metadata, there = _parts(variants)
        counts, paths, texts = strings_of(value, metadata, there, with_paths)
        return _lists(lengths, _lists(counts, pa.StructArray.from_arrays([paths, texts], ["path", "text"])))
    # kept out of the expressions around it: a Python function inside of a higher-order one cannot be evaluated
    return run.asNondeterministic()


def replaced_udf():
    """(array<variant>, array<array<string>>, boolean) -> array<variant>: the variants with their strings replaced, if the row is changed.

    The flag also names the texts a second time, which keeps the planner from moving their expression into this call:
    Spark does not take a Python function out of a plan whose argument has a lambda over another lambda's variable.
    """
    @F.arrow_udf("array<variant>")
    def run(variants: pa.Array, texts: pa.Array, changed: pa.Array) -> pa.Array:
        lengths, value, metadata, there = _parts(variants)
        per_variant = texts.flatten()  # the texts of each variant of a changed row; those of other rows are null
        rows = np.flatnonzero(np.repeat(texts.is_valid().to_numpy(zero_copy_only=False), lengths))
        rows = rows[per_variant.value_lengths().fill_null(0).to_numpy() > 0]
        if len(rows):
            hit = np.zeros(len(value), bool)
            hit[rows] = True
            value = pc.replace_with_mask(value, pa.array(hit), replaced_in(value, rows, per_variant.flatten().cast(pa.string())))
        fields = [pa.field("value", pa.binary(), nullable=False), pa.field("metadata", pa.binary(), nullable=False, metadata={b"variant": b"true"})]
        return _lists(lengths, pa.StructArray.from_arrays([value, metadata], fields=fields, mask=pa.array(~there, pa.bool_())))
    return run.asNondeterministic()
