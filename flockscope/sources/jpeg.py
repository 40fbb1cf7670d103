"""Quantisation tables of JPEG files, read from their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscope.functions import scalars as S

#: Markers without a length: fill bytes, restarts, the start and end of the image.
BARE = {0x01, *range(0xD0, 0xDA)}


def tables(data: bytes) -> dict[int, list[int]]:
    """The quantisation tables by number, as they stand before the image's first scan; none for what is no JPEG or is cut short."""
    out: dict[int, list[int]] = {}
    if data[:2] != b"\xff\xd8":
        return out
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return out
        marker = data[at + 1]
        if marker == 0xFF or marker in BARE:
            at += 1 if marker == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDA or size < 2 or len(body) < size - 2:
            return out
        if marker == 0xDB:
            place = 0
            while place < len(body):
                wide, number = body[place] >> 4, body[place] & 15
                step = 2 if wide else 1
                values = body[place + 1 : place + 1 + 64 * step]
                if len(values) < 64 * step:
                    break
                out[number] = [int.from_bytes(values[i : i + step], "big") for i in range(0, len(values), step)]
                place += 1 + 64 * step
        at += 2 + size
    return out


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        luma = [tables(x.as_py() or b"").get(0) for x in b["content"]]
        yield pa.RecordBatch.from_arrays([b["path"], pa.array([sum(t) / 64 if t else None for t in luma], pa.float64())], ["path", "luma"])


def artifact_tiers(files: DataFrame) -> DataFrame:
    """(path, luma, artifact) of files(path, content): the luminance table's mean and its tier; both null without such a table."""
    out = files.select("path", "content").mapInArrow(_means, "path string, luma double")
    return out.withColumn("artifact", F.when(F.col("luma").isNotNull(), S.artifact_tier(F.col("luma"))))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All JPEG files below a folder, as their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.filter(F.lower("path").rlike(r"\.jpe?g$")).select("path", "content")
