"""Structured Streaming around the batch operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from flockscope.sources.keyed import KeyedTable, retried


def read_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one executors share, or a temporary one where none is set."""
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="flockscope-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what there is and stop; each batch goes to Parquet, or to ``each``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    query: StreamingQuery = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", out).start()
    query.awaitTermination()


def ingest(spark: SparkSession, stream: DataFrame, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``shape`` makes of a stream, once it has caught up."""
    folder = work_folder(spark)
    run_available(shape(stream), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(shape(stream).schema).parquet(f"{folder}/out")


def first_writes(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key, remembered for as long as rows may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def tumbling_counts(spark: SparkSession, stream: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts by window and key after the whole stream: the last of the updates of each window is kept."""
    folder = work_folder(spark)
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        # rerun after a failure, a batch overwrites what it wrote before
        batch.select(F.col("w.start").alias("start"), *by, "n").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/b{number}")

    run_available(counts, f"{folder}/out", f"{folder}/checkpoint", "update", put)
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/out")
    last = F.max(F.struct("batch", "n")).alias("l")
    return rows.groupBy("start", *by).agg(last).select("start", *by, F.col("l.n").alias("n"))


def sessions(stream: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Activity sessions: runs of events no further apart than ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *by).agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(spark: SparkSession, stream: DataFrame, time: str, by: list[str], width: str, slide: str, least: int, late: str) -> DataFrame:
    """Windows of ``width``, one every ``slide``, with ``least`` rows of a key or more, after the whole stream."""
    folder = work_folder(spark)
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("start"), *by, "n").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/b{number}")

    run_available(counts, f"{folder}/out", f"{folder}/checkpoint", "update", put)
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/out")
    return rows.groupBy("start", *by).agg(F.max(F.struct("batch", "n")).alias("l")).select("start", *by, F.col("l.n").alias("n")).filter(F.col("n") >= least)


def backfill_then_stream(history: DataFrame, stream: DataFrame, shape: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: list[str], order: list[str]) -> KeyedTable:
    """History first, as a batch, then what streams in, through the same ``shape``, into a keyed table: a key is written once,
    whether it comes in the history, in several batches or again after a failure."""
    table = KeyedTable(history.sparkSession, out, key)
    retried(lambda: table.insert_absent(shape(history), order))
    run_available(shape(stream), out, checkpoint, "append", lambda batch, number: retried(lambda: table.insert_absent(batch, order)))
    return table


def poll(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 120) -> StreamingQuery:
    """A query that looks for new files every ``seconds`` seconds."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(each).start()


def with_retries(run: Callable[[], None], attempts: int = 10, delay: float = 5.0, wait: Callable[[float], None] | None = None) -> int:
    """Run again after a failure, ``attempts`` times in all, ``delay`` seconds apart; a stream goes on from its checkpoint. The attempts it took."""
    import time

    for attempt in range(1, attempts + 1):
        try:
            run()
            return attempt
        except Exception:
            if attempt == attempts:
                raise
            (wait or time.sleep)(delay)
    return attempts


def idle_listener(trigger: IdleTrigger):
    """A query listener that tells the trigger of each batch and of every look that found nothing."""
    import time

    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:
            pass

        def onQueryProgress(self, event) -> None:
            trigger.progress(event.progress.numInputRows, time.time())

        def onQueryIdle(self, event) -> None:
            trigger.progress(0, time.time())

        def onQueryTerminated(self, event) -> None:
            pass

    return Listener()


class IdleTrigger:
    """Calls ``job`` once when a stream has had nothing for ``seconds``, and again only after new rows.

    One job runs at a time; what comes due meanwhile is run once more after it.
    """

    def __init__(self, job: Callable[[], None], seconds: float) -> None:
        import threading

        self.job, self.seconds, self.last, self.armed = job, seconds, None, False
        self.lock, self.running, self.queued = threading.Lock(), False, False

    def progress(self, rows: int, now: float) -> bool:
        """Tell it of a batch; whether the job was run."""
        if rows:
            self.last, self.armed = now, True
            return False
        if not self.armed or self.last is None or now - self.last < self.seconds:
            return False
        self.armed = False
        return self.run()

    def run(self) -> bool:
        # whether a job runs and whether another is due change together, under one lock
        with self.lock:
            if self.running:
                self.queued = True
                return False
            self.running = True
        try:
            while True:
                self.job()
                with self.lock:
                    if not self.queued:
                        self.running = False
                        return True
                    self.queued = False
        except BaseException:
            with self.lock:
                self.running = self.queued = False
            raise
