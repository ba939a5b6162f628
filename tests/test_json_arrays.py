"""JSON array files read in pieces: the same rows and rejects as from whole strings, whatever the splits."""

import json
import random

import pytest

from veilframe.sources import readers


def _text(rng):
    return rng.choice(["", "plain", "a,b", "[{,", "}]", 'say "hi"', "back\\slash", "\\", '\\"', "line\nbreak", "é,ü", "x" * 300, "\u2028"])


def _written(tmp_path, rng, files=6):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(files):
        items = [rng.choice([{"id": rng.randrange(99), "text": _text(rng), "more": [1, {"q": _text(rng)}]}, {"id": "wrong", "text": "u"}, None, 7, [1, 2], "a, string", {},
                             {"text": None, "id": 5}]) for _ in range(rng.choice([0, 1, 3, 40]))]
        text = json.dumps(items, indent=rng.choice([None, 2]), ensure_ascii=rng.choice([True, False]))
        (folder / f"{k}.json").write_text(rng.choice(["", "  \n"]) + text + rng.choice(["", "\n \n"]), "utf-8")
    return str(folder)


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_pieces_equal_whole_files(spark, tmp_path, split):
    path = _written(tmp_path, random.Random(split))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        whole, pieces = ([tuple(r) for r in readers.read_json_array(spark, path, "id bigint, text string", whole_bytes=n).collect()] for n in (1 << 20, 0))
        assert sorted(map(repr, whole)) == sorted(map(repr, pieces)) and len(whole) > 5
        named = readers.read_json_array(spark, path, whole_bytes=0)
        assert set(named.columns) == {"id", "text", "more", readers.CORRUPT}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_files_lose_nothing(spark, tmp_path):
    for k, text in enumerate(['[{"id": 1, "text": "cut', '{"id": 1, "text": "alone"}', '[{"id": 1}], ', "[]", " [ ] ", '[{"id": 3, "text": "good"}]']):
        (tmp_path / f"{k}.json").write_text(text)
    rows = readers.read_json_array(spark, str(tmp_path), "id bigint, text string", whole_bytes=0).collect()
    assert [(r.id, r.text) for r in rows if r[readers.CORRUPT] is None] == [(3, "good")]
    # every other byte is in some reject; the two empty arrays hold nothing
    lost = sorted(r[readers.CORRUPT].strip() for r in rows if r[readers.CORRUPT] is not None)
    assert "".join(lost).count("id") == 3 and any("cut" in x for x in lost) and any("alone" in x for x in lost)


def test_large_files_are_not_read_as_one_string(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": k, "text": "t" * 50} for k in range(5000)]))
    frame = readers.read_json_array(spark, str(tmp_path), "id bigint, text string", whole_bytes=1000)
    good, bad = readers.split_rejects(frame)
    assert good.count() == 5000 and good.selectExpr("sum(id)").first()[0] == sum(range(5000)) and bad.count() == 0
