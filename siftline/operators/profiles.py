"""Benchmark profiles: pivots, derived costs and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GI = 1 << 30


def pivot_mean(df: DataFrame, index: str, columns: str, values: str, labels: list, places: int = 4) -> DataFrame:
    """Mean of values by index and column label; the labels are given, so no extra pass finds them."""
    out = df.groupBy(index).pivot(columns, labels).agg(F.round(F.avg(values), places))
    return out.select(index, *(F.col(f"`{v}`").alias(f"c_{v}") for v in labels))


def pivot_last(df: DataFrame, index: str, columns: str, values: str, order: list[str], labels: list) -> DataFrame:
    """The value of the last row, in ``order``, of each index and column label."""
    out = df.groupBy(index).pivot(columns, labels).agg(F.max_by(values, F.struct(*order)))
    return out.select(index, *(F.col(f"`{v}`").alias(f"c_{v}") for v in labels))


def labels(df: DataFrame, column: str) -> DataFrame:
    """The distinct labels of a column, for a pivot's rows or columns."""
    return df.select(F.col(column).alias("label")).distinct()


def stage_rates(df: DataFrame, by: list[str], stages: list[str], places: int = 4) -> DataFrame:
    """Rows a second of each stage, whose columns hold milliseconds, and of all stages together."""
    total = sum((F.col(s) for s in stages[1:]), F.col(stages[0]))
    rate = lambda ms: F.round(throughput(F.count(F.lit(1)), F.sum(ms)), places)
    return df.groupBy(*by).agg(*(rate(F.col(s)).alias(f"{s}_rate") for s in stages), rate(total).alias("total_rate"))


def join_cost(join_time: Column, filtered: Column) -> Column:
    """Join time a filtered row; no filtered rows stands for 2^30 unfiltered ones."""
    return join_time / F.when(filtered == 0, F.lit(GI)).otherwise(filtered)


def utilisation(consumed: Column) -> Column:
    """Share of 2^30 rows in percent."""
    return 100.0 * consumed / GI


def masked(value: Column, slowdown: Column, filter_bits: Column) -> Column:
    """value, or null where a filter cannot pay: from 8 MiB without extra cost, from 256 MiB at a cost of 50."""
    size = filter_bits / 8
    bad = ((slowdown == 0) & (size >= 8 * 1024 * 1024)) | ((slowdown == 50) & (size >= 256 * 1024 * 1024))
    return F.when(~bad, value)


def throughput(rows: Column, milliseconds: Column) -> Column:
    """Rows a second."""
    return rows / (milliseconds / 1000.0)


def work_time(fraction: Column, seconds: Column, rows: Column) -> Column:
    """Measured work a probe row, in picoseconds."""
    return fraction * seconds / rows * 1e12
