"""SimHash near-duplicates: documents whose 64-bit fingerprints differ in a few bits, and the groups they form.

If two fingerprints differ in at most d bits and the 64 bits are cut into b > d blocks, then b-d blocks
at least are equal in both. So every choice of b-d blocks is a key, close pairs share one key at least,
and only fingerprints with a common key are compared (pigeonhole). More blocks mean longer keys and more
of them; b grows with the number of distinct fingerprints so that a key's bucket stays small.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from siftline.llm.common import columns_of, fresh, from_texts, slices, table, written
from siftline.llm.components import star_roots

#: Rows of 8 bits for each byte value, lowest bit first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
SEED = 42


def fingerprint(text: bytes, n: int = 4) -> int:
    """SimHash of a text's n-word shingles: A-Z lower-cased, words split at ASCII blanks; 0 without a word.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, as the definition asks.
    """
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    total = max(1, len(words) - n + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, total).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ BITS for k in range(8)])
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, fp long) of whole texts; a null text has no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t or b"", n) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield table(schema, batch.column(0), fps.view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(compute, "doc_id long, fp long")


def n_blocks(n: int, distance: int) -> int:
    """Blocks for n fingerprints: the fewest, up to twice the distance, whose keys leave about 4 to a bucket."""
    b = distance + 1
    while b < 2 * distance and n > 4 * 2 ** (64 * (b - distance) / b):
        b += 1
    return b


def block_keys(fp, blocks: int, distance: int):
    """Array of (which blocks, their bits) for each choice of blocks - distance blocks, as structs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for t, kept in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in kept)
        mask -= (1 << 64) * (mask >> 63)
        keys.append(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) to one link for each node but the least of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def close_links(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is close in each run of equal ``group``: all pairs compared, a forest returned."""
    n = len(fp)
    last = np.append(np.flatnonzero(group[1:] != group[:-1]), n - 1)
    end = np.repeat(last + 1, np.diff(np.append(-1, last)))
    us, vs, here, d = [], [], np.arange(n), 1
    held = 0
    while len(here := here[here + d < end[here]]):
        near = np.bitwise_count(fp[here] ^ fp[here + d]) <= distance
        us.append(fp[here[near]])
        vs.append(fp[here[near] + d])
        held += len(us[-1])
        if held > 1 << 18:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], 0
        d += 1
    if not us:
        return fp[:0], fp[:0]
    return forest(np.concatenate(us), np.concatenate(vs))


def close_fingerprints(fps: DataFrame, n: int, distance: int = 4, tile: int = 1024) -> DataFrame:
    """(u, v) links between distinct fingerprints that join all within ``distance`` bits.

    Buckets of more than ``tile`` fingerprints are dealt into tiles; every two tiles meet in a task of their
    own, so no bucket, however large, must fit one task, and each meeting returns a forest, never all pairs.
    """
    blocks = n_blocks(n, distance)
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("k")).select("fp", "k.t", "k.bits")
    sizes = keyed.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = keyed.join(sizes, ["t", "bits"]).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    keyed = keyed.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    met = keyed.select("t", "bits", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    met = met.select("fp", F.xxhash64("t", "bits", F.least("mine", "other"), F.greatest("mine", "other")).alias("meeting"))
    met = met.repartition("meeting").sortWithinPartitions("meeting")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            group = np.concatenate([group, batch.column(1).to_numpy()])
            fp = np.concatenate([fp, batch.column(0).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(group == group[-1], True)) if len(group) else 0  # the last run may go on
            u, v = close_links(group[:whole], fp[:whole], distance) if whole else (fp[:0], fp[:0])
            yield table(schema, u.view(np.int64), v.view(np.int64))
            group, fp = group[whole:], fp[whole:]
        if len(fp):
            u, v = close_links(group, fp, distance)
            yield table(schema, u.view(np.int64), v.view(np.int64))

    return met.mapInArrow(link, "u long, v long")


def rooted_fingerprints(nodes: DataFrame, distance: int) -> DataFrame:
    """nodes (one row for each fp) with the least fingerprint that its links lead to, as ``root``."""
    roots = star_roots(close_fingerprints(nodes.select("fp"), nodes.count(), distance))
    rooted = nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return written(rooted, "rooted")


def simhash_groups(docs: DataFrame, distance: int = 4, n: int = 4) -> DataFrame:
    """Fingerprint and component of every document: doc_id, fingerprint (16 hex digits), component_id.

    docs needs doc_id and text; other columns are not read, whatever their names. Documents without a word have
    fingerprint zero and are linked like any other. Equal fingerprints are one node, however many copies there are;
    a component's id is the least doc_id in it (null if it has none but null). Repeated rows come back repeated,
    whole texts are read however long, and an empty table gives an empty result.
    """
    by_doc = written(fingerprints(docs, n), "fingerprints")
    nodes = written(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    rooted = rooted_fingerprints(nodes, distance)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return by_doc.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, distance: int = 4, n: int = 4) -> DataFrame:
    """One row of every component, all columns as they were, whatever their names.

    Rows are nodes, so rows of one doc_id with unlike texts stay side by side, and of repeated rows one stays. The row
    of least doc_id stays (a null doc_id comes last); of equal ones that of least fingerprint, then of least text hash.
    A null text has no words and is linked like an empty one; an empty table gives an empty result.
    """
    fp, row = fresh("fp", docs.columns), fresh("row", docs.columns)

    def make(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint((t or "").encode(), n) for t in texts], np.uint64).view(np.int64))]

    # numbers of rows are fixed once they are written
    tagged = written(from_texts(docs, [StructField(fp, LongType())], make).withColumn(row, F.monotonically_increasing_id()), "tagged")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").cast("long").alias("b"), F.col(fp).alias("c"), F.xxhash64(F.col("text").cast("string")).alias("d"), F.col(row).alias("row"))
    nodes = written(tagged.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first")), "nodes")
    kept = rooted_fingerprints(nodes, distance).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return tagged.join(kept, row, "left_semi").select(*columns_of(docs))
