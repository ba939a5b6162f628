"""Chat formatting at the level of tokens.

Every text is encoded on its own, so no token spans a text and a marker. Markers are reserved ids beyond the
vocabulary and cannot come from text; the marker strings are escaped where they occur in text, so that the formatted
string is as unambiguous as the ids. The loss mask is the prefix sum of +1 and -1 at the ends of the assistant's texts.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import vocabulary_path

#: The first id that the vocabulary leaves free, and the markers that take the ids from there on.
FIRST_FREE = 50257
MARKERS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
IDS = {m: FIRST_FREE + i for i, m in enumerate(MARKERS)}
NAMES = {i: m for m, i in IDS.items()}
#: Before and after the text of a role; any other role is written out between [ROLE] and [/ROLE].
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": (None, "</s>")}
_MARKER = r"(<)({0})(s>|/s>|<SYS>>|</SYS>>)|(\[)({0})(INST\]|/INST\]|ROLE\]|/ROLE\])"
_PLAIN, _ESCAPED = re.compile(_MARKER.format(r"\\*")), re.compile(_MARKER.format(r"\\+"))


def escape(text: str) -> str:
    """One more backslash after the first character of every marker string, however many it has."""
    return _PLAIN.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] if m[1] else m[5]) + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[4]) + (m[2] if m[1] else m[5])[1:] + (m[3] or m[6]), text)


def coder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def turn_tokens(encode, role: str, text: str, first: bool) -> tuple[list[int], np.ndarray, str]:
    """Ids, loss mask and formatted string of one turn; the first one opens the conversation."""
    before, after = TEMPLATE.get(role, ("[ROLE]", "</s>"))
    parts: list[tuple[str, bool]] = [("<s>", True)] if first else []  # (string, is a marker)
    if before:
        parts.append((before, True))
    if role not in TEMPLATE:
        parts += [(escape(role), False), ("[/ROLE]", True)]
    body = len(parts)
    parts += [(escape(text), False), (after, True)]
    ids, ends = [], [0]
    for string, marker in parts:
        ids += [IDS[string]] if marker else encode(string)
        ends.append(len(ids))
    change = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        change[ends[body]] += 1
        change[ends[body + 1]] -= 1
    return ids, np.cumsum(change[:-1], dtype=np.int8), "".join(s for s, _ in parts)


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                path: str | None = None) -> DataFrame:
    """(conv_id, part, ids, mask, formatted), a row per turn, a conversation's rows together and in order.

    Turns follow ``turn``, then role and text (nulls first); a null text or role is an empty one, and rows without a
    conv_id form one conversation. Repeated rows are turns of their own. Rows stream through a task one by one, so a
    conversation may have any number of turns. Other columns are not carried. No rows: no rows.
    """
    path = path or vocabulary_path("byte_bpe_50k.tiktoken")
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        encode = coder(path).encode_ordinary
        now, part = (), 0
        for batch in batches:
            convs, roles, texts = (batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))
            numbers, ids, masks, strings = [], [], [], []
            for c, r, t in zip(convs, roles, texts):
                part = part + 1 if now == (c,) else 0
                now = (c,)
                made = turn_tokens(encode, r, t, part == 0)
                numbers.append(part)
                ids.append(made[0])
                masks.append(made[1])
                strings.append(made[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(numbers, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(masks, pa.list_(pa.int8())), pa.array(strings, pa.string())],
                names=["conv_id", "part", "ids", "mask", "formatted"])

    return rows.mapInArrow(run, f"conv_id {kind}, part bigint, ids array<int>, mask array<tinyint>, formatted string")


def turns_of(ids: list[int], decode):
    """(role, text) of the turns that the ids hold."""
    k = 0
    while k < len(ids):
        if ids[k] == IDS["<s>"]:
            k += 1
            continue
        mark, role = NAMES.get(ids[k]), "assistant"
        if mark in ("<<SYS>>", "[INST]"):
            role, k = ("system" if mark == "<<SYS>>" else "user"), k + 1
        elif mark == "[ROLE]":
            end = ids.index(IDS["[/ROLE]"], k)
            role, k = unescape(decode(ids[k + 1:end])), end + 1
        end = k
        while ids[end] < FIRST_FREE:
            end += 1
        yield role, unescape(decode(ids[k:end]))
        k = end + 1


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """What the formatted rows of each conversation say, read from their ids and masks alone (see ``format_chat``)."""
    path = path or vocabulary_path("byte_bpe_50k.tiktoken")
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        known = coder(path)

        def decode(ids):
            return known.decode_bytes(ids).decode()

        state = None
        for batch in batches:
            done = []
            for c, part, ids, mask, string in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if part == 0:
                    if state:
                        done.append(told(state))
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(ids, decode):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                lost = unescape(decode([i for i, m in zip(ids, mask) if m]))
                state[3] += len(lost)
                state[4].update(lost.encode())
                state[5] += len(string)
            if done:
                yield batch_of(done)
        if state:
            yield batch_of([told(state)])

    def told(s):
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    def batch_of(done):
        columns = list(zip(*done))
        kinds = (None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) if k else pa.array(list(c), arrow_kind) for c, k in zip(columns, kinds)],
                                          names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    from pyspark.sql.pandas.types import to_arrow_type
    arrow_kind = to_arrow_type(formatted.schema["conv_id"].dataType)
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                     "loss_sha256 string, formatted_chars bigint")
