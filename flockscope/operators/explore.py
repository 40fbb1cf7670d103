"""Exploration and monitoring: facets, pages, counters and shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facets(equal: dict | None = None, within: dict | None = None, at_least: dict | None = None, search: tuple[str, str] | None = None, flags: dict | None = None) -> Column:
    """All given facets hold; one that is None, empty or, for ``at_least``, not above 0 asks for nothing."""
    tests = [F.col(c) == v for c, v in (equal or {}).items() if v not in (None, "")]
    tests += [F.col(c).isin(v) for c, v in (within or {}).items() if v]
    tests += [F.col(c) >= v for c, v in (at_least or {}).items() if v and v > 0]
    tests += [F.col(c) == v for c, v in (flags or {}).items() if v is not None]
    if search and search[1]:
        tests.append(F.col(search[0]).rlike("(?i)" + search[1]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def page(df: DataFrame, newest: list[str], number: int, size: int, most: int = 5000) -> DataFrame:
    """A page of rows, newest first, with the total, which is counted up to ``most`` only."""
    total = df.limit(most).agg(F.count(F.lit(1)).alias("total"))
    first, *rest = newest
    return df.orderBy(F.desc(first), *rest).offset((max(number, 1) - 1) * size).limit(size).crossJoin(total)  # one row


def status_counts(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    rows = [df.groupBy(F.col(c).alias("status")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("collection"), "status", "n") for name, (df, c) in frames.items()]
    return reduce(DataFrame.unionByName, rows)


def shares(df: DataFrame, field: str) -> DataFrame:
    n = df.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
