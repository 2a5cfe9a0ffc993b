"""Experiments: generated inputs, warm-up runs, repetitions, profile rows and a log of phases."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.plans.probe_query import ProbeQuery
from siftline.sources import files, generators

PROFILE = "strategy string, selectivity int, build_rows long, probe_rows long, filter_words long, repeats int, morsel_rows long, seconds double, ksum long, n_matches long, runs int"
EVENT = "id int, tick long, rel long, name string, offset long, num_tuples long"


@dataclass
class PhaseLog:
    """Phases with their time, kept in memory and written as one delimited file by ``flush``."""

    worker: int = 0
    rows: list[tuple] = field(default_factory=list)
    begun: int = field(default_factory=time.monotonic_ns)

    def push(self, name: str, offset: int = 0, tuples: int = 0) -> None:
        now = time.monotonic_ns()
        self.rows.append((self.worker, now, now - self.begun, name, offset, tuples))

    def flush(self, spark: SparkSession, path: str) -> None:
        files.write_delimited(spark.createDataFrame(self.rows, EVENT), path, mode="append")
        self.rows.clear()


def probe_for(spark: SparkSession, build_rows: int, probe_rows: int, percent: int, scale: int = 0, payloads: int = 0, words: int | None = None, repeats: int = 0, morsel_rows: int = 0) -> ProbeQuery:
    """The query over generated relations; ``morsel_rows`` sets the rows that a task gets at a time."""
    probe = generators.probe_of_selectivity(spark, build_rows, probe_rows, percent, scale)
    if morsel_rows:
        probe = probe.repartition(-(-probe_rows // morsel_rows))
    return ProbeQuery(probe, generators.incremental(spark, build_rows, payloads), "key", "key", words=words, repeats=repeats)


def grid(**axes: Iterable) -> list[dict]:
    """Every combination of the axes' values."""
    return [dict(zip(axes, values, strict=True)) for values in product(*axes.values())]


#: The published experiments as grids; sizes are the caller's.
EXPERIMENTS = {
    "selectivity": grid(percent=(1, *range(5, 101, 5))),
    "expensive_op": grid(percent=(5,), repeats=range(0, 31, 3)),
    "morsel": grid(percent=(5,), morsel_rows=[1 << i for i in range(14, 23, 2)]),
    "op_by_filter_size": grid(percent=(5,), repeats=(0, 10, 20), words=[1 << i for i in range(10, 19, 2)]),
    "filter_size": grid(percent=(5,), words=[1 << i for i in range(8, 19)]),
}


def answers(spark: SparkSession, strategies: Iterable[str], points: Iterable[dict], build_rows: int, probe_rows: int) -> DataFrame:
    """(strategy, percent, repeats, words, morsel_rows, ksum, n_matches) of every combination, as one plan."""
    out = None
    for s in strategies:
        for point in points:
            named = [F.lit(s).alias("strategy"), *(F.lit(point.get(k, 0)).cast("long").alias(k) for k in ("percent", "repeats", "words", "morsel_rows"))]
            row = probe_for(spark, build_rows, probe_rows, **point).result(s).select(*named, "ksum", "n_matches")
            out = row if out is None else out.unionByName(row)
    return out


def sweep(spark: SparkSession, strategies: Iterable[str], points: Iterable[dict], build_rows: int, probe_rows: int, warm_ups: int = 2, runs: int = 3, log: PhaseLog | None = None) -> DataFrame:
    """A profile row for each strategy and point: mean seconds over ``runs`` after ``warm_ups``.

    A key sum other than the generator's closed form raises.
    """
    rows = []
    for point in points:
        want = generators.expected(build_rows, probe_rows, point["percent"])
        for s in strategies:
            query, took = probe_for(spark, build_rows, probe_rows, **point), []
            for _ in range(warm_ups + runs):
                began = time.perf_counter()
                got = query.result(s).first()
                took.append(time.perf_counter() - began)
                query.release()
                if log:
                    log.push(s.upper(), 0, probe_rows)
                if (got.ksum, got.n_matches) != want:
                    raise ValueError(f"{s} at {point}: {tuple(got)} instead of {want}")
            rows.append((s, point["percent"], build_rows, probe_rows, query.words or 0, query.repeats, point.get("morsel_rows", 0), sum(took[warm_ups:]) / max(1, runs), *want, runs))
    return spark.createDataFrame(rows, PROFILE)


def write_datasets(spark: SparkSession, base: str, percents: Iterable[int], build_rows: int, probe_rows: int) -> dict[int, str]:
    """Generated probe sides at their places under ``base``, each with its expected sum beside it; those that are there stay."""
    paths = {}
    for p in percents:
        path = paths[p] = files.dataset_path(base, "probe", p, build_rows, probe_rows)
        files.cached(spark, path, lambda p=p: generators.probe_of_selectivity(spark, build_rows, probe_rows, p))
        files.write_scalar(spark, generators.expected(build_rows, probe_rows, p)[0], f"{path}-ksum")
    return paths
