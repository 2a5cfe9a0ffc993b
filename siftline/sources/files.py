"""Files of relations: delimited text, raw 32-bit columns, caches of generated data, logs of key-value lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.session import ship_package


def write_delimited(df: DataFrame, path: str, sep: str = "|", header: bool = False, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", sep).option("header", header).csv(path)


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "|", header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def write_column(df: DataFrame, column: str, path: str, rows_per_block: int = 1 << 20) -> None:
    """An int column as blocks of raw little-endian 32-bit values, with each block's number of values and sum.

    Blocks are rows of a Parquet table, so any file system that Spark writes can hold them. A null has no value in
    such a file, so it raises.
    """
    ship_package(df.sparkSession)
    schema = pa.schema([("n", pa.int64()), ("total", pa.int64()), ("data", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def block():
            x = np.concatenate(held).astype("<i4")
            return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([int(x.sum(dtype=np.int64))], pa.int64()), pa.array([x.tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            if batch.column(0).null_count:
                raise ValueError("a raw column can't hold nulls")
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= rows_per_block:
                yield block()
                held, size = [], 0
        if size:
            yield block()

    df.select(F.col(column).cast("int")).mapInArrow(pack, "n long, total long, data binary").write.mode("overwrite").parquet(path)


def read_column(spark: SparkSession, path: str, column: str = "key", scale: int = 1) -> DataFrame:
    """The values of :func:`write_column`, each ``scale`` times; a block whose size or sum is wrong raises."""
    ship_package(spark)
    schema = pa.schema([(column, pa.int32())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, total, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(data, "<i4")
                if len(x) != n or int(x.sum(dtype=np.int64)) != total:
                    raise ValueError("a block of the column is damaged")
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(x, scale) if scale > 1 else x)], schema=schema)

    return spark.read.parquet(path).select("n", "total", "data").mapInArrow(unpack, f"{column} int")


def write_scalar(spark: SparkSession, value: int, path: str) -> None:
    """One long beside a data set, such as its expected sum."""
    spark.createDataFrame([(value,)], "value long").coalesce(1).write.mode("overwrite").parquet(path)


def read_scalar(spark: SparkSession, path: str) -> int:
    (row,) = spark.read.parquet(path).collect()
    return row.value


def parse_options(args: list[str]) -> dict[str, str]:
    """``--key=value`` arguments; a key without a value is "1", of repeated keys the last holds, anything else raises."""
    out = {}
    for arg in args:
        if not arg.startswith("--") or len(arg) < 3:
            raise ValueError(f"not an option: {arg}")
        key, eq, value = arg[2:].partition("=")
        out[key] = value if eq else "1"
    return out


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written first if it isn't there."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def dataset_path(base: str, kind: str, selectivity: int, build_rows: int, probe_rows: int) -> str:
    """Where generated data of these parameters is kept."""
    return f"{base}/{kind}-sel{selectivity}-b{build_rows}-p{probe_rows}"


CONFIG_FIELDS = ("w", "s", "z", "k", "m", "slowdown", "filtersize", "tw", "probe_size", "build_size")


def parse_config_lines(lines: DataFrame) -> DataFrame:
    """Lines of ``name value`` pairs in column value, the rate glued to its name: device, the numbers, fpr."""
    number = lambda name: F.regexp_extract("value", rf"(?:^|\s){name} (\d+)", 1).cast("long").alias(name)
    return lines.select(F.regexp_extract("value", r"\b(CPU|GPU)\b", 1).alias("device"), *(number(c) for c in CONFIG_FIELDS), F.regexp_extract("value", r"fpr ?([0-9.eE+-]+)", 1).cast("double").alias("fpr"))


def lines_with(lines: DataFrame, text: str, flag: str = "") -> DataFrame:
    """The lines that hold ``text``, with ``flag`` behind each."""
    return lines.filter(F.contains("value", F.lit(text))).withColumn("value", F.concat("value", F.lit(f" {flag}" if flag else "")))


def latex_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One text line a row, cells joined as a LaTeX table wants them."""
    return df.select(F.concat(F.concat_ws(" & ", *(F.col(c).cast("string") for c in columns)), F.lit(r" \\")).alias("value"))
