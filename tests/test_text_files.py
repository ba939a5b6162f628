"""A file per row: how they are written, and texts read from very many small files."""

import gzip

from checks import queries
from veilframe.sources import layout, readers


def test_many_small_files_share_tasks(spark, tmp_path):
    for k in range(2000):
        (tmp_path / f"{k:04d}.txt").write_text(f"text {k}\n")
    df = readers.read_text_files(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.text for r in df.collect()) == sorted(f"text {k}\n" for k in range(2000))
    few = spark.range(100, numPartitions=4)
    assert layout.gather(few).rdd.getNumPartitions() == 4


def test_texts_of_any_name(spark, tmp_path):
    """Bytes as they are, packed files unpacked, hidden ones left out: what Spark's reader of whole texts gives."""
    names = {"a.txt": b"one\ntwo", "empty.txt": b"", "B.TXT": b"upper\n", "t": b"t", "xt": b"xt", "txt": b"txt", "atxt": b"no dot", "c.md": b"\xef\xbb\xbfmark",
             "d.txt.bak": b"bak", "e.tx": b"tx", "f é.txt": "ä\r\n€".encode(), ".hidden.txt": b"no", "_hidden.txt": b"no"}
    for name, body in names.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "g.txt.gz").write_bytes(gzip.compress(b"packed"))
    got = [tuple(r) for r in readers.read_text_files(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(tuple(r) for r in spark.read.text(str(tmp_path), wholetext=True).select("_metadata.file_path", "value").collect())
    assert sorted(t for _, t in got) == sorted([b.decode() for n, b in names.items() if b and "hidden" not in n] + ["packed"])
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe")
    raw = readers.read_text_files(spark, [str(tmp_path / "d.txt"), str(tmp_path / "t")]).selectExpr("hex(text) AS h").collect()
    assert sorted(r.h for r in raw) == ["74", "FFFE"]


def test_a_file_per_row_and_no_other(spark, tmp_path):
    """Equal rows have a file each, and none has a file of check sums beside it, whose permissions would be set by a process of its own."""
    rows = spark.createDataFrame([("x\ny",), ("x\ny",), ("",), (None,), ("ä",)], "value string")
    queries._file_each(rows, str(tmp_path / "some"))
    files = list((tmp_path / "some").iterdir())
    assert sorted(f.read_bytes() for f in files) == sorted([b"x\ny\n", b"x\ny\n", b"\n", b"\n", "ä\n".encode()])
    queries._file_each(rows.where("false"), f"file://{tmp_path}/none")
    assert list((tmp_path / "none").iterdir()) == []
