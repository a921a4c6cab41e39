"""Archives made on executors, and completions whose replies are kept."""

import io
import json
import os
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark import cloudpickle

from tessera.operators import replies
from tessera.sources import archive

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors cannot import this file


def documents(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


@pytest.mark.parametrize("piece", [archive.PIECE, 50])
def test_zip(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(archive, "PIECE", piece)
    rows = [(f"modules/m{i}.md", f"text {i} " * (i * 7)) for i in range(60)] + [("index.md", None), ("é/中文.md", "知识 " * 400), ("empty.md", "")]
    target = str(tmp_path / "a.zip")
    assert archive.write_zip(documents(spark, rows), target) == len(rows)
    with zipfile.ZipFile(target) as z:
        assert z.testzip() is None
        assert z.namelist() == sorted((f"knowledge/{p}" for p, _ in rows), key=str.encode)
        assert {n: z.read(n).decode() for n in z.namelist()} == {f"knowledge/{p}": c or "" for p, c in rows}


def test_zip_of_nothing_and_of_a_repeated_path(spark, tmp_path):
    target = str(tmp_path / "a.zip")
    assert archive.write_zip(documents(spark, []), target) == 0 and zipfile.ZipFile(target).namelist() == []
    with pytest.raises(ValueError, match="twice"):
        archive.write_zip(documents(spark, [("a", "1"), ("a", "2")]), target)


def test_records_of_large_archives(monkeypatch):
    """With small limits every length and offset takes the 64-bit form, which zipfile reads."""
    import zlib

    monkeypatch.setattr(archive, "MANY", 0)
    out, central = io.BytesIO(), b""
    for name in (b"a", b"b"):
        raw = name * 100
        pack = zlib.compressobj(wbits=-15)
        data = pack.compress(raw) + pack.flush()
        central += archive.central_record(name, zlib.crc32(raw), len(data), len(raw), out.tell())
        out.write(archive.local_record(name, zlib.crc32(raw), len(data), len(raw)) + data)
    start = out.tell()
    ending = archive.end_records(2, start, len(central))
    assert len(ending) == 56 + 20 + 22
    with zipfile.ZipFile(io.BytesIO(out.getvalue() + central + ending)) as z:
        assert z.namelist() == ["a", "b"] and z.read("b") == b"b" * 100
    big = archive.central_record(b"x", 1, 5, 6 << 30, 7 << 32)
    assert big[-20:] == (1).to_bytes(2, "little") + (16).to_bytes(2, "little") + (6 << 30).to_bytes(8, "little") + (7 << 32).to_bytes(8, "little")


def test_the_driver_holds_one_piece(spark, tmp_path):
    """Pieces come one at a time: the longest write to the target is a piece."""
    written = []

    class Target(io.BytesIO):
        def write(self, b):
            written.append(len(b))
            return super().write(b)

        def close(self):
            self.kept = self.getvalue()
            super().close()

    target = Target()
    rows = [(f"f{i}", os.urandom(400_000).hex()) for i in range(6)]
    archive.write_zip(documents(spark, rows), lambda: target)
    assert max(written) <= archive.PIECE and zipfile.ZipFile(io.BytesIO(target.kept)).testzip() is None


def good(text):
    return 200, json.dumps({"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}})


def counting(log, other=None):
    """A service on executors that notes each call in a file."""

    def call(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return (other and other(prompt)) or good(f"re {prompt}")

    return call


def calls(log):
    return sorted(Path(log).read_text().split("\n")[:-1]) if Path(log).exists() else []


def test_no_call_is_made_twice(spark, tmp_path):
    store, log = f"file://{tmp_path}/store", str(tmp_path / "log")
    df = spark.createDataFrame([(i, f"p{i % 20}", "m") for i in range(60)], "id int, prompt string, mock string")
    got = replies.complete(df, counting(log), store, "gpt", batch=3)
    assert {(r.prompt, r.reply.text, r.reply.input_tokens, r.reply.ok) for r in got.collect()} == {(f"p{i}", f"re p{i}", 3, True) for i in range(20)}
    assert got.count() == 60 and calls(log) == sorted(f"p{i}" for i in range(20))
    more = df.unionByName(spark.createDataFrame([(99, "new", "m"), (100, None, "m")], df.schema))
    assert replies.complete(more, counting(log), store, "gpt").where("reply.ok").count() == 62
    assert calls(log) == sorted([*[f"p{i}" for i in range(20)], "new", ""])
    replies.complete(df.limit(1), counting(log), store, "other model").collect()
    assert len(calls(log)) == 23


def test_bad_replies_give_the_mock_text_and_are_asked_again(spark, tmp_path):
    store, log = f"file://{tmp_path}/store", str(tmp_path / "log")
    df = spark.createDataFrame([(p, f"mock {p}") for p in ("a", "b", "c", "d")], "prompt string, mock string")
    odd = {"a": (500, "busy"), "b": (200, "{}"), "c": (200, "no json")}
    got = {r.prompt: r.reply for r in replies.complete(df, counting(log, odd.get), store).collect()}
    assert [(got[p].text, got[p].ok) for p in "abcd"] == [("mock a", False), ("mock b", False), ("mock c", False), ("re d", True)]
    assert "500" in got["a"].error and got["b"].error and got["c"].error and got["d"].error is None
    again = {r.prompt: r.reply.text for r in replies.complete(df, counting(log), store).collect()}
    assert again == {p: f"re {p}" for p in "abcd"} and calls(log) == ["a", "a", "b", "b", "c", "c", "d"]


def test_a_killed_task_repeats_no_stored_call(spark, tmp_path):
    store, log, mark = f"file://{tmp_path}/store", str(tmp_path / "log"), str(tmp_path / "died")
    df = spark.createDataFrame([(f"p{i:02}", "m") for i in range(12)], "prompt string, mock string").coalesce(1)

    def dies(prompt, log=log, mark=mark):
        seen = len(Path(log).read_text().split("\n")) - 1 if Path(log).exists() else 0
        if seen == 9 and not Path(mark).exists():
            Path(mark).touch()
            os._exit(1)  # the worker is lost in its batch
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return good(f"re {prompt}")

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        try:
            replies.complete(df, dies, store, batch=4, at_once=1).collect()
        except Exception:  # a local master does not try a task again
            pass
        assert Path(mark).exists() and len(calls(log)) == 9
        got = replies.complete(df, dies, store, batch=4, at_once=1)
        assert got.where("reply.ok").count() == 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # Two batches of four were stored; of the third, one call had been made and was lost with the worker.
    assert len(calls(log)) == 13 and len(set(calls(log))) == 12
