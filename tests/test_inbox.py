"""Files that come in, are worked on and leave; failures on the way; two takers."""

import os
import time

from pyspark.sql import functions as F

from flockscope.sources.inbox import Inbox


def put(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def names(folder, state):
    return sorted(str(p.relative_to(folder / state)) for p in (folder / state).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def read(spark, paths):
    return spark.read.text(paths, wholetext=True).withColumn("path", F.col("_metadata.file_path"))


def work(files):
    return files.select("path", F.col("value").contains("good").cast("int").alias("ok"), F.col("value").contains("bad").cast("int").alias("errors"))


def test_files_leave_by_their_results(spark, tmp_path):
    put(tmp_path / "inbox", {"a.json": "good", "sub/b.json": "bad", "c.json": "good and bad", "d.error.json": "bad", "e.txt": "x", "f.json": "good", "f.jsonZone.Identifier": "x"})
    box = Inbox(spark, f"file://{tmp_path}")
    assert box.run(work, read) == {"a.json": "done", "b.json": "error", "c.json": "done", "f.json": "done"}
    assert names(tmp_path, "done") == ["a.json", "c.json", "f.json"] and names(tmp_path, "processing") == []
    assert names(tmp_path, "inbox") == ["b.error.json", "d.error.json", "e.txt", "f.jsonZone.Identifier"]
    assert box.run(work, read) == {}


def test_a_failure_leaves_files_that_come_back(spark, tmp_path):
    put(tmp_path / "inbox", {"a.json": "good", "b.json": "good"})
    box = Inbox(spark, f"file://{tmp_path}")

    def fails(files):
        raise RuntimeError("lost")

    try:
        box.run(fails, read, most=1)
    except RuntimeError:
        pass
    left = names(tmp_path, "processing")
    assert len(left) == 1 and box.recover(3600) == []
    os.utime(tmp_path / "processing" / left[0], (time.time() - 7200,) * 2)
    assert box.recover(3600) == left and names(tmp_path, "inbox") == ["a.json", "b.json"]
    assert set(box.run(work, read).values()) == {"done"}


def test_two_takers_share_the_files(spark, tmp_path):
    put(tmp_path / "inbox", {f"{i}.json": "good" for i in range(7)} | {"x/0.json": "good"})
    one, two = (Inbox(spark, f"file://{tmp_path}") for _ in range(2))
    a, b = one.take(4), two.take(9)
    assert len(a) == 4 and len(a) + len(b) == 7 and not set(a) & set(b)  # of two files of one name the other waits
    assert [one.leave(n, 1, 0) for n in a] == ["done"] * 4 and two.leave("nothing.json", 1, 0) == "gone"
    assert len(two.take()) == ("0.json" in a)
