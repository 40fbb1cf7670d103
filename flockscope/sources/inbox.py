"""A folder of files that come in, are worked on and leave: inbox, processing, done.

A file is taken by a rename into ``processing``, which only one of several takers can do.
Afterwards it goes to ``done``, or, if it has errors and nothing of it went well, back to
the inbox as ``.error.json``, where it is taken again once somebody renames it.  What a
taker that died has left in ``processing`` goes back after ``lease`` seconds.  Only names
pass through the driver, ``most`` at a time; the files are read by Spark.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Inbox:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for state in ("inbox", "processing", "done"):
            self._fs.mkdirs(self._path(f"{self.folder}/{state}"))

    def _files(self, state: str) -> list[tuple[int, str]]:
        """(time, path below the state's folder) of its files, oldest first."""
        root = self._path(f"{self.folder}/{state}")
        top, out, walk = self._fs.resolvePath(root).toString(), [], self._fs.listFiles(root, True)
        while walk.hasNext():
            f = walk.next()
            name = f.getPath().toString().removeprefix(top).lstrip("/")
            if name.endswith(".json") and not name.endswith("Zone.Identifier"):
                out.append((f.getModificationTime(), name))
        return sorted(out)

    def _move(self, source: str, target: str) -> bool:
        """Whether the file was moved: not where it has gone or its place is taken."""
        here, there = self._path(f"{self.folder}/{source}"), self._path(f"{self.folder}/{target}")
        try:
            return self._fs.exists(here) and not self._fs.exists(there) and self._fs.rename(here, there)
        except Py4JJavaError:  # local folders say by an error that somebody else was first
            if self._fs.exists(here):
                raise
            return False

    def take(self, most: int = 1000) -> list[str]:
        """Moves up to ``most`` of the oldest files into processing; their names there."""
        names = [n for _, n in self._files("inbox") if not n.endswith(".error.json")]
        out = []
        for name in names:
            if len(out) == most:
                break
            bare = name.rsplit("/", 1)[-1]  # files of one name wait for each other
            if self._move(f"inbox/{name}", f"processing/{bare}"):
                self._fs.setTimes(self._path(f"{self.folder}/processing/{bare}"), int(time.time() * 1000), -1)
                out.append(bare)
        return out

    def leave(self, name: str, ok: int, errors: int) -> str:
        """Moves a file out of processing; the state that it has then."""
        if errors > 0 and ok == 0:
            target, state = f"inbox/{name.removesuffix('.json')}.error.json", "error"
        else:
            target, state = f"done/{name}", "done"
        if not self._fs.exists(self._path(f"{self.folder}/processing/{name}")):
            return "gone"
        self._fs.delete(self._path(f"{self.folder}/{target}"), False)  # a file of that name came before
        return state if self._move(f"processing/{name}", target) else "gone"

    def recover(self, lease: float = 3600) -> list[str]:
        """Files that have been in processing for longer than ``lease`` seconds go back."""
        late = [n for at, n in self._files("processing") if at < (time.time() - lease) * 1000]
        return [n for n in late if self._move(f"processing/{n}", f"inbox/{n}")]

    def run(self, work: Callable[[DataFrame], DataFrame], read: Callable[[SparkSession, list[str]], DataFrame], most: int = 1000) -> dict[str, str]:
        """Takes files, lets ``work`` make (path, ok, errors) of what ``read`` reads of them, and moves each; its state by name.

        Files of which nothing comes back count as errors.  Where ``work`` fails, all stay in
        processing and go back by ``recover``."""
        names = self.take(most)
        if not names:
            return {}
        found = work(read(self.spark, [f"{self.folder}/processing/{n}" for n in names]))
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        counts = {r.name: (r.ok, r.errors) for r in found.groupBy(name.alias("name")).agg(F.sum("ok").alias("ok"), F.sum("errors").alias("errors")).collect()}  # ``most`` rows
        return {n: self.leave(n, *counts.get(n, (0, 1))) for n in names}
