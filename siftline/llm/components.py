"""Connected components by alternating large and small stars, all in shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import drop_scratch, written


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
    return tuple(row)


def star_roots(links: DataFrame) -> DataFrame:
    """(u, v) links to (u, v): every linked node but the least of its component, with that least node.

    Each round joins every node's neighbours to the least of them, larger neighbours first, then smaller
    ones, and stops when nothing changes. Minima are pre-aggregated before each shuffle; the joins go by
    node and may be split where a node has many neighbours. A round's edges are a written table, so a
    lost executor costs one round at most. Loops and repeated links do no harm.
    """
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    known = _checksum(edges)
    while known[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written before they are joined: with a plain exchange on either side, Spark can split
        # the partition of a node that has very many neighbours
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m")), "least")
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        new = written(small.union(lower.select("u", F.col("m").alias("v"))).distinct(), "small-stars")
        now = _checksum(new)
        for old in (least, large, lower, edges):
            drop_scratch(old)
        edges = new
        if now == known:
            break
        known = now
    return edges
