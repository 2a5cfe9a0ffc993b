"""The engine's query: probe rows that match a build side, their key sum and count, under a chosen strategy."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.hashing import expensive_steps, hash32
from siftline.operators import bloom, joins

STRATEGIES = ("none", "bloom", "bloom_clustered", "bloom_cached", "catalyst")


RUNTIME_FILTER = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}


@contextlib.contextmanager
def runtime_filters(spark: SparkSession) -> Iterator[None]:
    """Spark's own runtime filters for what is planned inside; the session's settings are as before afterwards."""
    before = {k: spark.conf.get(k) for k in RUNTIME_FILTER}
    try:
        for k, v in RUNTIME_FILTER.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@dataclass
class ProbeQuery:
    """``probe`` semi-joined with ``build``. Strategies differ in the plan, never in the answer.

    none: the plain join. bloom: rows that an explicit filter rejects go before the join. bloom_clustered:
    the same after clustering by hash prefix. bloom_cached: the same on persisted keys, until ``release``. catalyst:
    Spark's own runtime filter. ``words`` None sizes the filter by the number of build keys; one too large to be
    broadcast would cost more than it saves, so the plain join takes its place. ``repeats`` products of an expensive
    operation are computed for every row between filter and join.
    """

    probe: DataFrame
    build: DataFrame
    probe_key: str
    build_key: str
    words: int | None = None
    shape: bloom.Shape = bloom.Shape()
    bits: int = 6
    repeats: int = 0
    persisted: list[DataFrame] = field(default_factory=list)

    def filter_words(self) -> tuple[DataFrame, int]:
        words = self.words or bloom.words_for(self.build.count(), shape=self.shape)
        return bloom.build(self.build, self.build_key, words, self.shape), words

    def worked(self, keys: DataFrame) -> DataFrame:
        """keys after the expensive operation, whose result no later step can leave out; null keys, which match nothing, are left out."""
        if not self.repeats:
            return keys
        h = hash32(F.col(self.probe_key))
        rows = expensive_steps(keys.withColumns({"_t1": h, "_t2": h + 1, "_t3": h + 2}), self.repeats, "_t1", "_t2", "_t3")
        # the row number, which counts for nothing, keeps the filter above the work
        done = rows.withColumn("_done", F.col("_t1").bitwiseXOR(F.col("_t3")) + F.monotonically_increasing_id() * 0)
        return done.filter(F.col("_done").isNotNull()).select(self.probe_key)

    def matches(self, strategy: str = "none") -> DataFrame:
        """The keys of matching probe rows."""
        if strategy not in STRATEGIES:
            raise ValueError(f"no such strategy: {strategy}")
        keys = self.probe.select(self.probe_key)
        if strategy == "catalyst":
            return joins.semi(self.worked(keys).hint("shuffle_merge"), self.build, self.probe_key, self.build_key)
        if strategy != "none":
            if strategy == "bloom_clustered":
                keys = bloom.clustered(keys, self.probe_key, self.bits)
            elif strategy == "bloom_cached":
                keys = keys.persist(StorageLevel.MEMORY_AND_DISK)
                self.persisted.append(keys)
            words, n = self.filter_words()
            if self.words or n <= bloom.BROADCAST_WORDS:
                keys = bloom.candidates(keys, self.probe_key, words, n, self.shape)
        return joins.semi(self.worked(keys), self.build, self.probe_key, self.build_key)

    def release(self) -> None:
        """Let go of the keys that bloom_cached holds."""
        while self.persisted:
            self.persisted.pop().unpersist()

    def result(self, strategy: str = "none") -> DataFrame:
        """One row: ksum and n_matches; zeros for no match. Under catalyst the result is planned here, with runtime filters."""
        total = lambda: self.matches(strategy).agg(joins.sum_or_zero(self.probe_key).alias("ksum"), F.count(F.lit(1)).alias("n_matches"))
        if strategy != "catalyst":
            return total()
        with runtime_filters(self.probe.sparkSession):
            out = total()
            out._jdf.queryExecution().executedPlan()  # kept by the DataFrame
            return out

    def counters(self) -> DataFrame:
        """One row, in one pass: the pipeline's counters, and the shares passed in percent.

        pre_filter, post_filter, pre_join, post_join: rows at each step. filter_probed: rows that were held against the
        filter; filter_consumed: those whose flags were read on; processed: rows done with; morsel_rows: rows handed out.
        Nothing is lost or left over between Spark's steps, so several of them are equal by design.
        """
        words, n = self.filter_words()
        some = bloom.flagged(self.probe.select(self.probe_key), self.probe_key, words, n, self.shape)
        inner = self.build.select(F.col(self.build_key).alias("_b")).distinct().withColumn("_hit", F.lit(True))
        rows = some.join(inner, F.col(self.probe_key) == F.col("_b"), "left")
        count = F.count(F.lit(1))
        passed = F.count_if("flag")
        out = rows.agg(
            count.alias("pre_filter"), passed.alias("post_filter"), passed.alias("pre_join"), F.count_if(F.col("flag") & F.col("_hit")).alias("post_join"),
            F.count("flag").alias("filter_probed"), (F.count_if("flag") + F.count_if(~F.col("flag"))).alias("filter_consumed"), count.alias("processed"), count.alias("morsel_rows"),
        )
        share = lambda a, b: F.round(100.0 * F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
        return out.select("*", share("post_filter", "pre_filter").alias("filter_pct"), share("post_join", "pre_join").alias("join_pct"))
