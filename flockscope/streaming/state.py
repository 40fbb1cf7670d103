"""Streams with state of their own: a job queue with leases, and near duplicates among recent rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flockscope.streaming.pipelines import run_available, work_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

JOB = "status string, attempts int, worker string, error string, until long, at long"


def step(state: tuple, kind: str, at: int, worker: str | None, retry: bool, lease: int, most: int) -> tuple:
    """What an event makes of a job (status, attempts, worker, error, until, at); times in microseconds.

    ``created`` makes a job that is not there pending.  ``claim`` takes a job that waits and
    has attempts left, for ``lease``; ``complete`` and ``fail`` count only from the worker
    that holds it.  A lease that has run out before the event returns the job first."""
    status, attempts, holder, error, until, _ = state
    if status == "processing" and at > until:
        status, holder, error = returned(attempts, most)
    if kind == "created":
        status = status or "pending"
    elif kind == "claim" and status in ("pending", "retrying") and attempts < most:
        status, attempts, holder, until = "processing", attempts + 1, worker, at + lease
    elif kind == "complete" and status == "processing" and worker == holder:
        status, holder = "done", None
    elif kind == "fail" and status == "processing" and worker == holder:
        status, holder, error = ("retrying" if retry and attempts < most else "error"), None, "failed"
    return status, attempts, holder, error, until, at


def returned(attempts: int, most: int) -> tuple[str, None, str]:
    """A job whose lease has run out waits again while it has attempts left."""
    return ("retrying" if attempts < most else "error"), None, "lease expired"


class JobQueue(StatefulProcessor):
    """One job's state by its events, in the order of (at, seq) within a batch; a timer for its lease."""

    def __init__(self, lease: int, most: int) -> None:
        self.lease, self.most = lease, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)

    def _out(self, key, state: tuple) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *state[:4])], columns=["job_id", "status", "attempts", "worker", "error"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.job.get()) if self.job.exists() else (None, 0, None, None, 0, 0)
        before = state
        events = pd.concat(list(rows)).sort_values(["at", "seq"])
        for kind, at, worker, retry in zip(events["kind"], events["at"], events["worker"], events["retry"], strict=True):
            state = step(state, kind, int(at), worker, bool(retry), self.lease, self.most)
        if state[0] is None:  # events of a job that was never created
            return
        self.job.update(state)
        if before[0] == "processing" and before[4] != state[4]:
            self.handle.deleteTimer(before[4] // 1000 + 1)
        if state[0] == "processing":
            self.handle.registerTimer(state[4] // 1000 + 1)
        yield self._out(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.job.get())
        if state[0] != "processing" or state[4] // 1000 + 1 > expiredTimerInfo.getExpiryTimeInMs():
            return
        state = (*returned(state[1], self.most)[:1], state[1], None, "lease expired", state[4], state[5])
        self.job.update(state)
        yield self._out(key, state)

    def close(self) -> None:
        pass


def _with_rocks(spark: SparkSession, run) -> None:
    """Runs a stream whose operators keep their state in RocksDB; the session's own setting comes back."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        run()
    finally:
        spark.conf.unset(PROVIDER) if was is None else spark.conf.set(PROVIDER, was)


def job_states(stream: DataFrame, lease: str = "10 minutes", most: int = 3, late: str = "1 minute") -> DataFrame:
    """The stream of job states (job_id, status, attempts, worker, error) that events(job_id, kind, ts, seq, worker, retry) make."""
    micros = int(pd.Timedelta(lease).total_seconds() * 1e6)
    events = stream.filter("job_id is not null and ts is not null").withWatermark("ts", late)
    events = events.select("job_id", "kind", "ts", F.unix_micros("ts").alias("at"), "seq", "worker", F.coalesce("retry", F.lit(True)).alias("retry"))
    kind = dict(events.dtypes)["job_id"]
    return events.groupBy("job_id").transformWithStateInPandas(statefulProcessor=JobQueue(micros, most), outputStructType=f"job_id {kind}, status string, attempts int, worker string, error string",
                                                               outputMode="Update", timeMode="EventTime")


def last_states(spark: SparkSession, states: DataFrame, key: str, folder: str | None = None) -> DataFrame:
    """The last row of each key once the stream has caught up; a folder that is given again goes on where it was left."""
    folder = folder or work_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        # rerun after a failure, a batch overwrites what it wrote before
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/b{number}")

    _with_rocks(spark, lambda: run_available(states, f"{folder}/out", f"{folder}/checkpoint", "update", put))
    rows = spark.read.schema(f"{_ddl(states)}, batch int").option("recursiveFileLookup", True).parquet(f"{folder}/out")
    rest = [c for c in states.columns if c != key]
    last = rows.groupBy(key).agg(F.max(F.struct("batch", *rest)).alias("l"))
    return last.select(key, *[F.col(f"l.{c}").alias(c) for c in rest])


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


class Sessions(StatefulProcessor):
    """The sessions of one key that rows may still reach: those that change are written, with no rows where one was merged away."""

    def __init__(self, gap: int, names: list[str]) -> None:
        self.gap, self.names = gap, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "starts array<long>, ends array<long>, counts array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = list(zip(*self.open.get(), strict=True)) if self.open.exists() else []
        times = np.concatenate([r["event_micros"].to_numpy(np.int64) for r in rows])
        merged: list[list[int]] = []
        for start, end, n in sorted([*old, *[(int(t), int(t) + self.gap, 1) for t in times]]):
            if merged and start < merged[-1][1]:
                merged[-1][1:] = [max(end, merged[-1][1]), merged[-1][2] + n]
            else:
                merged.append([start, end, n])
        now = [tuple(m) for m in merged]
        changed = [s for s in now if s not in old] + [(s, e, 0) for s, e, _ in old if s not in {m[0] for m in now}]
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        kept = [s for s in now if s[1] > mark] or now[-1:]
        self.open.update(tuple(list(c) for c in zip(*kept, strict=True)))
        self.handle.registerTimer(max(e for _, e, _ in kept) // 1000 + 1)
        yield pd.DataFrame([(*key, *s) for s in changed], columns=[*self.names, "start", "end", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists() and max(self.open.get()[1]) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
        yield pd.DataFrame([], columns=[*self.names, "start", "end", "n"])

    def close(self) -> None:
        pass


def sessions(spark: SparkSession, stream: DataFrame, time: str, by: list[str], gap: str, late: str, folder: str | None = None) -> DataFrame:
    """(key, start, end, n): runs of events less than ``gap`` apart, after the whole stream; open ones count as they stand.

    State holds only sessions that late rows may still reach, and a batch writes only those that it changes."""
    folder = folder or work_folder(spark)
    rows = stream.filter(F.col(time).isNotNull()).withWatermark(time, late).select(*by, F.col(time).alias("event_time"), F.unix_micros(time).alias("event_micros"))
    keys = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n in by)
    out = rows.groupBy(*by).transformWithStateInPandas(statefulProcessor=Sessions(int(pd.Timedelta(gap).total_seconds() * 1e6), by),
                                                      outputStructType=f"{keys}, start long, end long, n long", outputMode="Update", timeMode="EventTime")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/b{number}")

    _with_rocks(spark, lambda: run_available(out, f"{folder}/out", f"{folder}/checkpoint", "update", put))
    found = spark.read.schema(f"{_ddl(out)}, batch int").option("recursiveFileLookup", True).parquet(f"{folder}/out")
    last = found.groupBy(*by, "start").agg(F.max(F.struct("batch", "end", "n")).alias("l")).filter("l.n > 0")
    return last.select(*by, F.timestamp_micros("start").alias("start"), F.timestamp_micros("l.end").alias("end"), F.col("l.n").alias("n"))


class Recent(StatefulProcessor):
    """Each row's most similar among the ``most`` rows before it in its group, in the order of (at, id) within a batch."""

    def __init__(self, least: float, most: int) -> None:
        self.least, self.most = least, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a ring of ``most`` places, and how many rows there have been
        self.ring = handle.getMapState("ring", "place int", "id long, v binary")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "id"])
        n = before = self.seen.get()[0] if self.seen.exists() else 0
        held = sorted(((n - 1 - (n - 1 - p[0]) % self.most), v[0], np.frombuffer(v[1], np.float64)) for p, v in self.ring.iterator()) if n else []
        ids, vectors = [h[1] for h in held], [h[2] for h in held]
        out = []
        for i, v in zip(new["id"], new["v"], strict=True):
            x = np.asarray(v, np.float64)
            length = np.linalg.norm(x)
            if not np.isfinite(length) or length == 0:
                continue
            x = x / length
            if ids:
                score = np.round(np.stack(vectors) @ x, 9)
                best = int(np.lexsort((ids, -score))[0])
                if score[best] >= self.least:
                    out.append((int(i), ids[best], float(score[best])))
            ids, vectors = [*ids, int(i)][-self.most :], [*vectors, x][-self.most :]
            n += 1
        # of a batch only what is still recent after it is written
        for back, (i, x) in enumerate(zip(reversed(ids), reversed(vectors), strict=True), 1):
            if back > n - before:
                break
            self.ring.updateValue(((n - back) % self.most,), (i, x.tobytes()))
        self.seen.update((n,))
        yield pd.DataFrame(out, columns=["id", "duplicate_of", "score"]).astype({"id": "int64", "duplicate_of": "int64", "score": "float64"})

    def close(self) -> None:
        pass


def recent_duplicates(stream: DataFrame, group: str, least: float = 0.95, most: int = 5000) -> DataFrame:
    """(id, duplicate_of, score) for rows(id, v, at, group) that are similar to one of the ``most`` rows before them in their group.

    State is bounded by ``most`` vectors a group; those without a direction are left out."""
    rows = stream.filter("id is not null and v is not null").select(F.col(group).alias("_g"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), "at")
    return rows.groupBy("_g").transformWithStateInPandas(statefulProcessor=Recent(least, most), outputStructType="id long, duplicate_of long, score double", outputMode="Append", timeMode="None")


def found_duplicates(spark: SparkSession, duplicates: DataFrame, folder: str | None = None) -> DataFrame:
    """What ``recent_duplicates`` finds once the stream has caught up."""
    folder = folder or work_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/b{number}")

    spark.createDataFrame([], duplicates.schema).write.mode("overwrite").parquet(f"{folder}/out/none")  # a stream without files has no batch
    _with_rocks(spark, lambda: run_available(duplicates, f"{folder}/out", f"{folder}/checkpoint", "append", put))
    return spark.read.schema(_ddl(duplicates)).option("recursiveFileLookup", True).parquet(f"{folder}/out")
