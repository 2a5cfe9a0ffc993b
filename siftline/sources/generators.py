"""Deterministic test relations: incremental keys, unique random keys, probe sides of exact selectivity.

Values come from hashes of row numbers, so they don't depend on partitions, and every answer has a closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.hashing import hash32

TOP = 2**31 - 1


def incremental(spark: SparkSession, n: int, payloads: int = 0) -> DataFrame:
    """key 1..n and payloads p_i = key + i."""
    keys = spark.range(1, n + 1).withColumnRenamed("id", "key")
    return keys.select("key", *((F.col("key") + i).alias(f"p{i}") for i in range(1, payloads + 1)))


def filled(spark: SparkSession, n: int, columns: dict[str, Column]) -> DataFrame:
    """n rows with the given expressions of ``id``."""
    return spark.range(n).select(*(c.alias(name) for name, c in columns.items()))


def unique32(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n distinct 32-bit values: hash32 is a bijection of 32-bit numbers."""
    return spark.range(n).select(hash32(F.col("id").bitwiseXOR(F.lit(seed & 0xFFFFFFFF))).alias("key"))


def unique64(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n distinct longs: four rounds of a Feistel cipher over the halves of a row number, a bijection of 64-bit numbers."""
    rows = spark.range(n).select(F.shiftrightunsigned("id", 32).alias("a"), F.col("id").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"))
    for i in range(4):
        rows = rows.select(F.col("b").alias("a"), F.col("a").bitwiseXOR(hash32(F.col("b") + (seed * 4 + i) % TOP)).alias("b"))
    return rows.select(F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("key"))


def uniform32(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n values over all 32-bit numbers, repeats allowed."""
    return uniform(spark, n, 0, 0xFFFFFFFF, seed)


def uniform(spark: SparkSession, n: int, low: int, high: int, seed: int = 0) -> DataFrame:
    """n values in [low, high], repeats allowed."""
    return spark.range(n).select((low + F.pmod(hash32(F.col("id") * 2 + seed), F.lit(high - low + 1))).alias("key"))


def probe_of_selectivity(spark: SparkSession, build_rows: int, probe_rows: int, percent: int, scale: int = 0) -> DataFrame:
    """Keys of which floor(percent * stored / 100) match a build side 1..build_rows, times ``scale``.

    probe_rows / scale rows are stored; matching ones cycle through the build keys, others lie above them.
    """
    times = max(1, scale)
    stored = probe_rows // times
    members = percent * stored // 100
    outside = build_rows + 1 + F.pmod(hash32(F.col("id")), F.lit(TOP - build_rows))
    keys = spark.range(stored).select(F.when(F.col("id") < members, F.pmod("id", F.lit(build_rows)) + 1).otherwise(outside).alias("key"))
    return replicated(keys, times)


def replicated(rows: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, without a shuffle."""
    return rows if times <= 1 else rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy")


def expected(build_rows: int, probe_rows: int, percent: int, scale: int = 0) -> tuple[int, int]:
    """Closed form of a generated probe side: key sum and matches."""
    times = max(1, scale)
    members = percent * (probe_rows // times) // 100
    full, rest = divmod(members, build_rows)
    return (full * build_rows * (build_rows + 1) // 2 + rest * (rest + 1) // 2) * times, members * times
