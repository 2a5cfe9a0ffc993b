"""Probe-side joins: existence, absence, at most one match, and several tables in a row.

No side is broadcast here: Spark does that itself for a side below spark.sql.autoBroadcastJoinThreshold,
and adaptive execution splits a hot key's partition otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semi(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str) -> DataFrame:
    """Probe rows with a match; duplicate build keys don't multiply them, nulls never match."""
    return probe.join(build.select(F.col(build_key).alias("_b")), F.col(probe_key) == F.col("_b"), "left_semi")


def anti(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str) -> DataFrame:
    """Probe rows without a match, null keys among them."""
    return probe.join(build.select(F.col(build_key).alias("_b")), F.col(probe_key) == F.col("_b"), "left_anti")


def lookup(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str, payload: list[str]) -> DataFrame:
    """Inner join with at most one match: of duplicate build keys the row of least payload holds, columns compared in order."""
    one = build.groupBy(F.col(build_key).alias("_b")).agg(F.min(F.struct(*payload)).alias("_one"))
    found = probe.join(one, F.col(probe_key) == F.col("_b"))
    return found.select(*(probe[c] for c in probe.columns), *(F.col("_one")[c].alias(c) for c in payload))


def pipelined(probe: DataFrame, steps: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Semi-joins one after the other: (build, probe key, build key)."""
    return reduce(lambda p, s: semi(p, s[0], s[1], s[2]), steps, probe)


def sum_or_zero(c: str | Column) -> Column:
    """SUM that is 0 for no rows."""
    return F.coalesce(F.sum(c), F.lit(0).cast("long"))
