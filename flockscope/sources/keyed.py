"""Keyed tables: Parquet files that documents are inserted into, updated in and deleted from by key.

A table is a folder of buckets (by hash of the key) and of commits.  A write reads the
buckets that its rows touch, merges, writes those buckets anew beside the old ones, and
commits by giving a manifest its name; the name is the next number, and a name that is
taken cannot be given again.  So readers see the last commit whole, a write that fails
leaves nothing but files that no manifest lists, and of two writers that began at the
same commit one has to begin again.  Manifests hold one line a bucket.

Rows without a key (any part null) are not written.  Repeated keys within one write count
as writes in the order that ``order`` states.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flockscope.sources.shared import settle


class Conflict(Exception):
    """Another write was committed first."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # files

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if not known:
            return None
        stream = self._fs.open(self._at(f"{self.path}/commits/{version or known[-1]:020d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Names the manifest; whoever comes second finds the name taken."""
        name = self._at(f"{self.path}/commits/{manifest['version']:020d}.json")
        draft = self._at(f"{self.path}/commits/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        # a rename onto an existing name fails on HDFS; where a store would replace it, its absence is looked at as well
        if self._fs.exists(name) or not self._fs.rename(draft, name):
            self._fs.delete(draft, False)
            raise Conflict(f"commit {manifest['version']} of {self.path} is taken")

    # reading

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table as of its last commit, or of an earlier one; None before the first."""
        m = self._manifest(version)
        if m is None:
            return None
        schema = StructType.fromJson(m["schema"])
        paths = [p for b, p in m["files"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{p}" for p in paths])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    # writing

    def _write(self, base: dict | None, rows: DataFrame, touched: list[int]) -> int:
        """Puts ``rows`` in place of the touched buckets."""
        name = uuid.uuid4().hex
        # large buckets are split, small ones are one file each
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        there = {s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/data/{name}"))}
        files = {b: p for b, p in (base["files"] if base else {}).items() if int(b) not in touched}
        files |= {str(b): f"{name}/_bucket={b}" for b in touched if f"_bucket={b}" in there}
        version = (base["version"] if base else 0) + 1
        self._commit({"version": version, "key": self.key, "buckets": self.buckets, "schema": rows.schema.jsonValue(), "files": files})
        return version

    def merge(self, rows: DataFrame, order: list[str], merged: Callable[[DataFrame], DataFrame]) -> int | None:
        """Commits what ``merged`` makes of the rows with the keys' old documents.

        ``merged`` gets one row for each key of the touched buckets: the key, the old
        document as ``old`` (null if there is none) and the new rows as ``new``, an array
        in ``order`` (empty if there are none); combine a key's rows first where many may
        come.  Returns the commit's number, None where
        there is nothing to write."""
        base = self._manifest()
        if base and (base["key"] != self.key or base["buckets"] != self.buckets):
            raise ValueError(f"{self.path} has the key {base['key']} in {base['buckets']} buckets")
        rows = settle(rows.dropna(subset=self.key))
        touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]  # at most ``buckets``
        if not touched:
            return None
        first = [c for c in order if c not in self.key]
        rest = [c for c in rows.columns if c not in self.key and c not in first]
        new = rows.groupBy(*self.key).agg(F.sort_array(F.collect_list(F.struct(*first, *rest))).alias("new"))
        have = self.read(base["version"], touched) if base else None
        if have is None:
            both = new.withColumn("old", F.lit(None))
        else:
            old = have.select(*[F.col(c).alias(f"_{c}") for c in self.key], F.struct(*[c for c in have.columns if c not in self.key]).alias("old"))
            same = [F.col(c) == F.col(f"_{c}") for c in self.key]
            both = old.join(new, same, "full").select(*[F.coalesce(c, f"_{c}").alias(c) for c in self.key], "old", F.coalesce("new", F.array()).alias("new"))
        return self._write(base, merged(both), touched)

    def insert_absent(self, rows: DataFrame, order: list[str]) -> int | None:
        """First write wins: documents that there are already stay as they are."""
        fields = [c for c in rows.columns if c not in self.key]

        def put(both: DataFrame) -> DataFrame:
            known = dict(both.dtypes)["old"] != "void"
            first = lambda c: F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col("new")[0][c]) if known else F.col("new")[0][c]
            return both.select(*self.key, *[first(c).alias(c) for c in fields])

        return self.merge(_once(rows, self.key, order, F.min), order, put)

    def upsert(self, rows: DataFrame, order: list[str]) -> int | None:
        """Last write wins, field by field: what a write does not have or has null stays as it was; other fields stay too."""
        new = [c for c in rows.columns if c not in self.key]
        # the last value of each field, combined before the shuffle: a key's rows are never gathered
        place = F.struct(*[c for c in order if c not in self.key] or [F.lit(0)])
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in new]
        rows = rows.dropna(subset=self.key).groupBy(*self.key).agg(*last)

        def put(both: DataFrame) -> DataFrame:
            kind = both.schema["old"].dataType
            old = kind.fieldNames() if isinstance(kind, StructType) else []

            def field(c: str) -> Column:
                if c not in new:
                    return F.col(f"old.{c}")
                last = F.try_element_at(F.filter(F.transform("new", lambda r: r[c]), lambda x: x.isNotNull()), F.lit(-1))
                return F.coalesce(last, F.col(f"old.{c}")) if c in old else last

            return both.select(*self.key, *[field(c).alias(c) for c in [*old, *[c for c in new if c not in old]]])

        return self.merge(rows, [], put)

    def accumulate(self, rows: DataFrame, sets: list[str], counter: str) -> int | None:
        """Adds values to the documents' sets and counts how often a document was touched.

        Rows are combined by key before they meet the table; ``counter`` grows by the rows of
        a key, so a rerun counts them again, as increments do, while sets stay the same."""
        grouped = rows.dropna(subset=self.key).groupBy(*self.key).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in sets], F.count(F.lit(1)).alias(counter))

        def put(both: DataFrame) -> DataFrame:
            if dict(both.dtypes)["old"] == "void":
                return both.select(*self.key, *[F.col("new")[0][c].alias(c) for c in [*sets, counter]])
            one = F.try_element_at("new", F.lit(1))
            union = [F.array_sort(F.array_union(F.coalesce(F.col(f"old.{c}"), F.array()), F.coalesce(one[c], F.array()))).alias(c) for c in sets]
            return both.select(*self.key, *union, (F.coalesce(f"old.{counter}", F.lit(0)) + F.coalesce(one[counter], F.lit(0))).alias(counter))

        return self.merge(grouped, [], put)

    def delete(self, gone: Column) -> int | None:
        """Drops the documents for which the condition holds; only buckets that hold some are written anew."""
        base = self._manifest()
        if base is None:
            return None
        rows = self.read(base["version"])
        hit = F.coalesce(gone, F.lit(False))
        touched = [r[0] for r in rows.filter(hit).select(self._bucket()).distinct().collect()]
        if not touched:
            return None
        return self._write(base, self.read(base["version"], touched).filter(~hit), touched)

    def vacuum(self, keep: int = 2) -> int:
        """Removes commits but the last ``keep`` and all files that none of those lists; the number of folders removed.

        Not to be run beside a write: its files are not listed yet."""
        versions = self.versions()
        listed = {p for v in versions[-keep:] for p in self._manifest(v)["files"].values()}
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"{self.path}/commits/{v:020d}.json"), False)
        removed = 0
        for write in self._fs.listStatus(self._at(f"{self.path}/data")):
            for bucket in self._fs.listStatus(write.getPath()):
                name = f"{write.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in listed:
                    removed += bool(self._fs.delete(bucket.getPath(), True))
        return removed


def _once(rows: DataFrame, key: list[str], order: list[str], agg) -> DataFrame:
    """One row a key, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    first = [c for c in order if c not in key]
    one = rows.dropna(subset=key).groupBy(*key).agg(agg(F.struct(*first, *rest)).alias("_r"))
    return one.select(*key, *[F.col(f"_r.{c}").alias(c) for c in [*first, *rest]])


def retried(write: Callable[[], int | None], attempts: int = 5) -> int | None:
    """Begins a write anew when another one was committed first."""
    for _ in range(attempts - 1):
        try:
            return write()
        except Conflict:
            continue
    return write()
