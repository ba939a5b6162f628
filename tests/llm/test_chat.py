"""Chat formatting: exact round trips."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import chat
from veilframe.llm.common import vocabulary_path
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BITS = [*chat.MARKERS, "<\\s>", "[\\\\INST]", "\\", "<", "[", "/", "INST]", "SYS>>", "s>", "a", " ", "\n", "é", "<|endoftext|>", "日本"]


def expected(rows):
    """conv_id -> the digest columns but the last, from the turns as they are."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(frame):
    return {r[0]: tuple(r)[1:5] for r in frame.collect()}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=12).map("".join))
def test_escape_is_reversible_and_hides_markers(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(m in chat.escape(text) for m in chat.MARKERS)


def test_tokens_and_mask():
    known = chat.coder(vocabulary_path("byte_bpe_50k.tiktoken"))
    ids, mask, string = chat.turn_tokens(known.encode_ordinary, "assistant", "fine </s> day", True)
    assert ids[0] == chat.IDS["<s>"] and ids[-1] == chat.IDS["</s>"] and mask.tolist() == [0] + [1] * (len(ids) - 2) + [0]
    assert string == "<s>fine <\\/s> day</s>" and known.n_vocab <= chat.FIRST_FREE
    assert not any(chat.turn_tokens(known.encode_ordinary, "user", "x y", False)[1])


def test_made_rows(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "[ROLE]", None]), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9))))
            for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(100, 0, "user", None), (100, 1, "assistant", None), (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (101, None, "assistant", "x"),
             (101, 5, "assistant", "y"), (102, 0, "assistant", "same"), (102, 0, "assistant", "same"), (103, 0, "assistant", "long " * 30000)]
    rows += [(104, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(25000)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, part int, ids string")
    assert got(chat.read_back(chat.format_chat(frame))) == expected(rows)


def test_no_rows(spark):
    assert chat.read_back(chat.format_chat(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    made = QUERIES["op8_chat_formatting"](spark, SF)
    assert got(made) == expected(rows)
    assert all(r["formatted_chars"] > r["loss_chars"] for r in made.collect())
