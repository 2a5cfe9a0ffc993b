"""Best-fit packing of documents into token sequences.

Lengths are whole numbers up to the capacity, so pieces of equal length are interchangeable, and
best-fit decreasing over all documents needs only the histogram of lengths: at most ``capacity``
numbers, however large the corpus. The driver replays best-fit decreasing on it with a segment tree
over remaining capacities; a step places all bins of one remainder at once, exactly as placing one
piece after another would. Each piece then finds its bin from its rank among pieces of its length,
a rank built from salted counts, so no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import slices, table, written
from siftline.llm.tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED_ARROW = PIECE_ARROW.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))
#: Bits of a rank in the search key (length, rank).
RANK_BITS = 48


class RemainderTree:
    """Segment tree over remaining capacities 0..capacity: which remainders have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def push(self, rest: int, first: int, n: int) -> None:
        """``n`` bins, numbered from ``first``, with ``rest`` left in each."""
        self.groups[rest].append((first, n))
        if len(self.groups[rest]) == 1:
            at = rest + self.size
            while at and not self.any[at]:
                self.any[at] = 1
                at >>= 1

    def pop(self, rest: int) -> tuple[int, int]:
        got = self.groups[rest].pop()
        if not self.groups[rest]:
            at = rest + self.size
            self.any[at] = 0
            while (at := at >> 1) and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
        return got

    def tightest(self, need: int) -> int | None:
        """The least remainder >= need that has open bins, in O(log capacity)."""
        at = need + self.size
        if at >= 2 * self.size:
            return None
        if self.any[at]:
            return need
        while at > 1:  # climb until a right sibling has something
            if not at & 1 and self.any[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces, pieces a bin, first bin, offset): where pieces of a length go, by rank.

    The same bins as best-fit decreasing one piece at a time: the bin with the tightest remainder r takes
    a piece of length l and, since r-l is then tighter than any other remainder, pieces of the same
    length until fewer than l tokens are left.
    """
    tree, rows, bins = RemainderTree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            rest = tree.tightest(length)
            if rest is None:
                rest, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = tree.pop(rest)
            each = rest // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full * each, each, first, capacity - rest))
                tree.push(rest - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                rows.append((length, rank, left, left, first + full, capacity - rest))
                tree.push(rest - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                tree.push(rest, first + full, n - full)
    return np.array(rows, np.int64).reshape(-1, 6)


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of a document's ids. A null text counts as empty; repeated rows stay repeated."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in slices(batches):
            ids, counts = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum(counts)
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, a, b in zip(batch.column(0).to_pylist(), ends - counts, ends, strict=True):
                all_ids = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(all_ids), capacity)):
                    part = all_ids[start : start + capacity]
                    for col, x in zip(out, (doc, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        col.append(x)
            yield table(PIECE_ARROW, *out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE)


def pack(pieces: DataFrame, capacity: int, salt_rows: int = 1 << 19) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Pieces of one length are told apart by rank: a length has a salt for each ``salt_rows`` of its pieces, the counts
    of (length, salt) give each salt its first rank, and a window ranks the pieces of one salt. Identical rows may
    swap places, which no one can tell.
    """
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # <= capacity rows
    histogram = {r.length: r.n for r in counts}
    places = best_fit_decreasing(histogram, capacity)
    order = np.lexsort((places[:, 1], places[:, 0]))
    places = places[order]
    starts = (places[:, 0] << RANK_BITS) + places[:, 1]

    # a hash of a piece modulo its length's number of salts; lengths are whole numbers up to capacity, so an array holds these
    salts = [1] * (capacity + 1)
    for length, n in histogram.items():
        salts[length] = -(-n // salt_rows)
    mine = F.lit(1) if max(salts) == 1 else F.get(F.from_json(F.lit(str(salts)), "array<int>"), F.col("length").cast("int"))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), mine).cast("int"))
    by_salt = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    first = sizes.select("length", "salt", F.coalesce(F.sum("n").over(by_salt), F.lit(0)).alias("first"))
    ranked = pieces.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")))
    ranked = ranked.join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("k") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(starts, (length << RANK_BITS) + rank, side="right") - 1
            row = places[at]
            k = rank - row[:, 1]
            yield table(PLACED_ARROW, *batch.columns[:5], row[:, 4] + k // row[:, 3], row[:, 5] + k % row[:, 3] * length)

    return ranked.select(*PIECE_ARROW.names, "rank").mapInArrow(place, f"{PIECE}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    docs needs doc_id and text; other columns are not read. A null or empty text is the end id alone.
    A null doc_id stays null; repeated rows are packed each; a very long text is cut into pieces as it is read.
    An empty table gives an empty result.
    Result: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return pack(written(cut_documents(docs, tokenizer_path, end_id, capacity), "packing-pieces"), capacity)
