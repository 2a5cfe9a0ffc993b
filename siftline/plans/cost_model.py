"""Which filter pays: false-positive rates, lookup times, overheads and the rule that applies them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Nanoseconds a lookup by filter size in MiB, for each device with keys over the bus or cached.
SIZES_MIB = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)
LOOKUP_NS = {
    ("gtx1080", "pcie"): (0.3362, 0.3363, 0.4563, 0.6000, 0.6870, 0.7363, 0.7625, 0.7761, 0.7831, 0.7864),
    ("gtx1080", "cached"): (0.1553, 0.1844, 0.3866, 0.5551, 0.6556, 0.7134, 0.7445, 0.7606, 0.7688, 0.7728),
    ("gtx1080ti", "pcie"): (0.3419, 0.3384, 0.3399, 0.3639, 0.4333, 0.4746, 0.5049, 0.5104, 0.5166, 0.5204),
    ("gtx1080ti", "cached"): (0.1358, 0.1252, 0.1921, 0.3154, 0.3986, 0.4474, 0.4759, 0.4910, 0.4987, 0.5033),
    ("gtx1050ti", "pcie"): (0.3420, 0.3393, 0.3401, 0.3759, 0.4469, 0.4856, 0.5009, 0.5244, 0.5268, 0.5250),
    ("gtx1050ti", "cached"): (0.1358, 0.1254, 0.1935, 0.3177, 0.3961, 0.4521, 0.4759, 0.4910, 0.5045, 0.5026),
}
BLOCK_BITS = 1024
MIB_BITS = 8 * 1024 * 1024


def fpr_standard(m: float, n: float, k: float) -> float:
    """Classic filter of m bits, n keys, k hashes."""
    return 0.0 if n <= 0 else (1 - (1 - 1 / m) ** (k * n)) ** k


def _poisson(i: int, rate: float) -> float:
    return math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) if rate > 0 else float(i == 0)


def fpr_sectorized(m: float, n: float, words: int, sectors: int, zones: int, k: int) -> float:
    """Blocked filter of ``words`` 32-bit words a block; with sectors > 1, k/zones bits in one sector of each zone."""
    block = 32 * words
    rate = block * n / m
    reach = range(int(rate + 12 * math.sqrt(rate) + 30))
    if sectors == 1:
        return sum(_poisson(i, rate) * fpr_standard(block, i, k) for i in reach)
    size, share = block / sectors, zones / sectors
    total = 0.0
    for i in reach:
        inner = sum(math.exp(math.lgamma(i + 1) - math.lgamma(j + 1) - math.lgamma(i - j + 1)) * share**j * (1 - share) ** (i - j) * fpr_standard(size, j, k / zones) for j in range(i + 1))
        total += _poisson(i, rate) * inner**zones
    return total


def _pmf(rows: DataFrame, by: list[str], rate: str) -> DataFrame:
    """Rows with i = 0.. for each group, and Poisson(i; rate) from running sums of logs."""
    upto = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.ceil(F.col(rate) + 12 * F.sqrt(rate) + 30).cast("long")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), reach)))
    step = F.when(F.col("i") == 0, 0.0).otherwise(F.ln(F.col(rate) / F.col("i")))
    return rows.withColumn("pmf", F.exp(F.sum(step).over(upto) - F.col(rate)))


def _std(bits, n, k):
    return F.when(n <= 0, 0.0).otherwise(F.pow(1 - F.pow(1 - 1.0 / bits, k * n), k))


def blocked_rates(configs: DataFrame) -> DataFrame:
    """configs (m, n, k, block) with fpr of a blocked filter, as one aggregation over Poisson terms."""
    rows = _pmf(configs.withColumn("rate", F.col("block") * F.col("n") / F.col("m")), ["m", "n", "k", "block"], "rate")
    return rows.groupBy("m", "n", "k", "block").agg(F.sum(F.col("pmf") * _std(F.col("block"), F.col("i"), F.col("k"))).alias("fpr"))


def sectorized_rates(configs: DataFrame) -> DataFrame:
    """configs (m, n, k, block, s, z) with fpr of a sectorized filter."""
    keys = ["m", "n", "k", "block", "s", "z"]
    rows = _pmf(configs.withColumn("rate", F.col("block") * F.col("n") / F.col("m")), keys, "rate")
    # binomial terms from running sums of logs as well: C(i,j) q^j (1-q)^(i-j)
    q = F.col("z") / F.col("s")
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("i"))))
    upto = Window.partitionBy(*keys, "i").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("j") == 0, F.col("i") * F.ln(1 - q)).otherwise(F.ln((F.col("i") - F.col("j") + 1) / F.col("j")) + F.ln(q / (1 - q)))
    rows = rows.withColumn("choose", F.exp(F.sum(step).over(upto)))
    inner = rows.groupBy(*keys, "i").agg(F.max("pmf").alias("pmf"), F.sum(F.col("choose") * _std(F.col("block") / F.col("s"), F.col("j"), F.col("k") / F.col("z"))).alias("inside"))
    return inner.groupBy(*keys).agg(F.sum(F.col("pmf") * F.pow("inside", F.col("z"))).alias("fpr"))


def lookup_table(spark: SparkSession) -> DataFrame:
    """(device, mode, size_mib, ns)."""
    rows = [(d, m, s, ns) for (d, m), values in LOOKUP_NS.items() for s, ns in zip(SIZES_MIB, values, strict=True)]
    return spark.createDataFrame(rows, "device string, mode string, size_mib int, ns double")


def overhead_grid(spark: SparkSession, n: int, work_ns: float) -> DataFrame:
    """Every filter size and k in 1..15, for each device and mode: lookup time + fpr * work time.

    60 lookup rows meet 15 values of k: a fixed grid, whatever the data.
    """
    sizes = spark.createDataFrame([(s, s * MIB_BITS, n, k, BLOCK_BITS) for s in SIZES_MIB for k in range(1, 16)], "size_mib int, m long, n long, k int, block int")
    rates = blocked_rates(sizes.drop("size_mib")).withColumn("size_mib", (F.col("m") / MIB_BITS).cast("int"))
    return rates.join(F.broadcast(lookup_table(spark)), "size_mib").select("device", "mode", "size_mib", "k", "fpr", (F.col("ns") + F.col("fpr") * work_ns).alias("overhead"))


def best_parameters(grid: DataFrame) -> DataFrame:
    """The least overhead for each device and mode; of equals the smallest filter, then the least k."""
    best = F.min(F.struct("overhead", "size_mib", "k", "fpr")).alias("b")
    return grid.groupBy("device", "mode").agg(best).select("device", "mode", "b.size_mib", "b.k", "b.fpr", "b.overhead")


def lookup_ns(device: str, mode: str, bits: int) -> float:
    """Time of a lookup: that of the first tabulated size not below ``bits``."""
    if (device, mode) not in LOOKUP_NS:
        raise ValueError(f"unknown device or mode: {device}, {mode}")
    for size, ns in zip(SIZES_MIB, LOOKUP_NS[device, mode], strict=True):
        if size * MIB_BITS >= bits:
            return ns
    raise ValueError("no overhead is known for a filter of this size")


def worth_it(lookup: float, work: float, selectivity: float, fpr: float) -> bool:
    """Whether a filter saves time: its lookup and the rows it lets through cost less than all rows."""
    return lookup + work * (selectivity + (1 - selectivity) * fpr) < work


def max_selectivity(lookup: float, work: float, fpr: float) -> float:
    """The selectivity below which a filter saves time, as :func:`worth_it` has it; 0 if it never does."""
    return 0.0 if work <= 0 or fpr >= 1 else max(0.0, (1 - fpr - lookup / work) / (1 - fpr))


@dataclass(frozen=True)
class FilterChoice:
    """A filter of ``m`` bits and the time of a lookup in it, in nanoseconds, on one device."""

    words: int
    sectors: int
    zones: int
    k: int
    m: int
    lookup: float


def describe(cpu: FilterChoice, gpu: FilterChoice, work_ps: int, probe_rows: int, build_rows: int, selectivity: float, slowdown: int = 0, filter_bits: int = 0) -> list[str]:
    """A line for each device with its filter's parameters and rate, the selectivity, and up to which each device's filter pays.

    Lookup times belong to the caller: none are published for CPUs, and :func:`lookup_ns` knows those of the GPUs.
    """
    rate = lambda f: fpr_sectorized(f.m, build_rows, f.words, f.sectors, f.zones, f.k)
    limits = {name: max_selectivity(f.lookup, work_ps / 1000, rate(f)) for name, f in (("cpu", cpu), ("gpu", gpu))}
    pays = " ".join(f"max_{name}_sel {x:.6g} smaller {'smaller' if selectivity < x else 'NOT'}" for name, x in limits.items())
    return [
        f"w {f.words} s {f.sectors} z {f.zones} k {f.k} m {f.m} {name}  slowdown {slowdown} filtersize {filter_bits} tw {work_ps} probe_size {probe_rows} build_size {build_rows} fpr {rate(f):.6g} sel {selectivity:g} {pays}"
        for name, f in (("CPU", cpu), ("GPU", gpu))
    ]
