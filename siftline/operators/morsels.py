"""Rows by position: numbers in key order, morsels and vectors of them, and work on one morsel after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MORSEL, VECTOR = 1 << 14, 1 << 10


def numbered(rows: DataFrame, key: str, more: tuple[str, ...] = (), buckets: int = 64, name: str = "position") -> DataFrame:
    """rows with their places 0, 1, ... in the order of a numeric ``key`` (then ``more``); null keys come first.

    Quantiles cut the keys into buckets, so no task sorts more than about a ``buckets``-th of the rows, and a bucket's
    first place is the sum of the counts before it: a table of at most buckets + 1 rows, which is broadcast. A bucket
    is a function of the key, so the places don't depend on partitions or retries.
    """
    cuts = sorted(set(rows.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.01 / buckets)))
    at = F.lit(0) if not cuts else F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))))
    held = rows.withColumn("_bucket", at)
    sizes = held.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key, *more))
    return held.withColumn("_inside", inside).join(F.broadcast(first), "_bucket").withColumn(name, F.col("_first") + F.col("_inside") - 1).drop("_bucket", "_inside", "_first")


def block_of(position: Column, size: int) -> Column:
    """Number of the morsel or vector that a place is in."""
    return F.floor(position / size).cast("long")


def ranges(n: DataFrame, size: int = MORSEL) -> DataFrame:
    """One row with column n to (morsel, begin_row, end_row): the last range is cut off at n, and no rows have no ranges."""
    some = n.filter("n > 0").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size).cast("long"))).alias("morsel"))
    return some.select("morsel", (F.col("morsel") * size).alias("begin_row"), F.least((F.col("morsel") + 1) * size, F.col("n")).alias("end_row"))


def map_morsels(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str, size: int = MORSEL, finished: Callable[[int], None] | None = None) -> DataFrame:
    """What ``work`` makes of each run of at most ``size`` rows of a partition; ``finished`` hears of each one's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, size - n)
                held.append(batch.slice(0, take))
                n, batch = n + take, batch.slice(take)
                if n == size:
                    yield work(pa.Table.from_batches(held))
                    if finished:
                        finished(n)
                    held, n = [], 0
        if n:
            yield work(pa.Table.from_batches(held))
            if finished:
                finished(n)

    return rows.mapInArrow(run, schema)
