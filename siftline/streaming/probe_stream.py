"""The probe query over a stream: a static build side, and running totals of what matched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matching_totals(stream: DataFrame, build: DataFrame, probe_key: str, build_key: str) -> DataFrame:
    """Key sum and number of the stream's rows whose key is in ``build``, for complete or update output.

    The build side is a batch table read for each micro-batch; the state is one row.
    """
    keys = build.select(F.col(build_key).alias("_b")).distinct()
    return stream.join(keys, F.col(probe_key) == F.col("_b"), "left_semi").agg(F.coalesce(F.sum(probe_key), F.lit(0).cast("long")).alias("ksum"), F.count(F.lit(1)).alias("n_matches"))
