"""Token ids in directly addressable codes, kept in shards of a Parquet table.

An id is split into 8-bit chunks, lowest first. Level 0 holds one chunk for each token; a bitmap says
which tokens go on in the next level, and a rank directory (set bits before each block) gives the
place there in constant time. So any token can be read alone, without decoding a block.

A shard's bytes::

    "DAC1" | levels u32 | tokens u64 | for each level: entries u64
    then for each level: chunks u8[entries] | bitmap u8[ceil(entries/8)] | directory u64[ceil(entries/512)]

(the last level has neither bitmap nor directory). A shard is a row of a table: the part it belongs
to, its number there, the tokens of the part before it, its documents with their starts, and the bytes,
which are not compressed again. Any file system that Spark writes can hold it. An index beside the shards says
which tokens each holds, so that one token of the corpus is found by its number.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import scratch_path, slices, table
from siftline.llm.tokens import encoder

BLOCK = 512
ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
SHARD = "part int, shard int, before long, n_tokens long, docs binary, starts binary, codes binary"
INDEX = "part int, shard int, start long, n_tokens long"
SHARD_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("docs", pa.binary()), ("starts", pa.binary()), ("codes", pa.binary())])


def encode_codes(ids: np.ndarray) -> bytes:
    """Codes of unsigned 32-bit ids."""
    values, levels = np.ascontiguousarray(ids, np.uint32), []
    while len(values) or not levels:
        more = values >> 8 != 0
        levels.append((values.astype(np.uint8), np.packbits(more, bitorder="little")))
        values = values[more] >> 8
    out = [b"DAC1", struct.pack("<IQ", len(levels), len(ids)), *(struct.pack("<Q", len(c)) for c, _ in levels)]
    for k, (chunks, bitmap) in enumerate(levels):
        out.append(chunks.tobytes())
        if k < len(levels) - 1:
            ones = np.add.reduceat(ONES[bitmap], np.arange(0, len(bitmap), BLOCK // 8))
            out += [bitmap.tobytes(), (np.cumsum(ones) - ones).astype("<u8").tobytes()]
    return b"".join(out)


class DirectCodes:
    """Reader of :func:`encode_codes`."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a DAC1 shard")
        n_levels, self.n = struct.unpack_from("<IQ", data, 4)
        sizes = struct.unpack_from(f"<{n_levels}Q", data, 16)
        at, self.levels = 16 + 8 * n_levels, []
        for k, n in enumerate(sizes):
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bitmap = directory = None
            if k < n_levels - 1:
                bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
                at += len(bitmap)
                directory = np.frombuffer(data, "<u8", -(-len(bitmap) * 8 // BLOCK), at)
                at += 8 * len(directory)
            self.levels.append((chunks, bitmap, directory))

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i: the directory's count and the rest of one block."""
        _, bitmap, directory = self.levels[level]
        block = i // BLOCK
        if block >= len(directory):
            block = len(directory) - 1
        first = block * BLOCK // 8
        bits = int(ONES[bitmap[first : i // 8]].sum())
        if i % 8:
            bits += int(ONES[bitmap[i // 8] & ((1 << i % 8) - 1)])
        return int(directory[block]) + bits

    def __getitem__(self, i: int) -> int:
        """The id at place i; no other token is decoded."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if bitmap is None or not bitmap[i // 8] >> i % 8 & 1:
                break
            i = self._rank(k, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a..b-1, level by level."""
        a, b = max(0, a), min(b, self.n)
        out = np.zeros(max(0, b - a), np.uint32)
        who = np.arange(len(out))
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[who] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            if bitmap is None or a >= b:
                break
            bits = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            who, a = who[bits], self._rank(k, a)
            b = a + len(who)
            if not len(who):
                break
        return out


def write_codes(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shard_tokens: int = 1 << 20) -> None:
    """Encode whole texts and write their ids, in ascending doc_id order: shards at ``path``/shards, their places at ``path``/index.

    A null text counts as empty, so it holds the end id alone; null doc_ids come first; repeated rows stay, and
    very long texts are shards of their own. A shard closes after the document that brings it to ``shard_tokens``.
    Columns other than doc_id and text are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, before = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer_path)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal shard, before, size
            all_ids = np.concatenate(held)
            doc = np.array([-1 if d is None else d for d in names], "<i8").tobytes() + np.packbits([d is None for d in names]).tobytes()
            starts = np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype("<i8")
            row = ([part], [shard], [before], [len(all_ids)], [doc], [starts.tobytes()], [encode_codes(all_ids)])
            shard, before, size = shard + 1, before + len(all_ids), 0
            names.clear()
            held.clear()
            lens.clear()
            return table(SHARD_ARROW, *row)

        for batch in slices(batches):
            ids, counts = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            docs_, counts = batch.column(0).to_pylist(), counts + 1
            ends = np.cumsum(counts)
            all_ids = np.full(ends[-1], end_id, np.uint32)
            own = np.ones(len(all_ids), bool)
            own[ends - 1] = False
            all_ids[own] = ids
            at = 0
            while at < len(docs_):
                begin = int(ends[at] - counts[at])
                to = min(len(docs_), int(np.searchsorted(ends - begin + size, shard_tokens)) + 1)
                names += docs_[at:to]
                held.append(all_ids[begin : ends[to - 1]])
                lens.append(counts[at:to])
                size += len(held[-1])
                at = to
                if size >= shard_tokens:
                    yield close()
        if names:
            yield close()

    spark = docs.sparkSession
    # parts follow doc_id: a range partitioning, so part numbers ascend with the ids in them; a hash tells rows of one id apart
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    # codes are read in place, so they are not compressed again
    ordered.mapInArrow(encode, SHARD).write.option("compression", "none").parquet(f"{path}/shards")
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards").select("part", "shard", "before", "n_tokens")
    # one row for each part, as many as the writer had partitions
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("first"))
    index = shards.join(parts, "part").select("part", "shard", (F.col("first") + F.col("before")).alias("start"), "n_tokens")
    index.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{path}/index")


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the shards at ``path``: doc_id, start, n_tokens, ids_crc32, computed from the bytes read back."""
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards")
    # the tokens before each part: as many rows as the writer had partitions
    first = {r.part: r.n for r in spark.read.schema(INDEX).parquet(f"{path}/index").groupBy("part").agg(F.min("start").alias("n")).collect()}
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, before, docs, starts, codes = (batch.column(c)[i].as_py() for c in range(5))
                starts = np.frombuffer(starts, "<i8")
                n = len(starts) - 1
                ids = np.frombuffer(docs, "<i8", n)
                null = np.unpackbits(np.frombuffer(docs, np.uint8, offset=8 * n))[:n].astype(bool)
                reader = DirectCodes(codes)
                whole = memoryview(reader.slice(0, len(reader)).astype("<u4")).cast("B")
                crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in pairwise(starts.tolist())]
                yield table(schema, pa.array(ids, mask=null), first[part] + before + starts[:-1], np.diff(starts), crc)

    return shards.select("part", "before", "docs", "starts", "codes").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, path: str, first: int, n: int = 1) -> list[int]:
    """The ids at places ``first`` to ``first + n - 1`` of all documents together.

    The index names the shards that hold them, and only these are read; in a shard each id is found by its place.
    """
    held = spark.read.schema(INDEX).parquet(f"{path}/index").filter((F.col("start") < first + n) & (F.col("start") + F.col("n_tokens") > first)).collect()
    if sum(min(r.start + r.n_tokens, first + n) - max(r.start, first) for r in held) < n:
        raise IndexError(first + n - 1)
    out: list[int] = []
    for r in sorted(held, key=lambda r: r.start):
        codes = spark.read.schema(SHARD).parquet(f"{path}/shards").filter((F.col("part") == r.part) & (F.col("shard") == r.shard)).select("codes").first().codes
        out += DirectCodes(codes).slice(max(first, r.start) - r.start, min(first + n, r.start + r.n_tokens) - r.start).tolist()
    return out


def token_id_roundtrip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the ids of all documents to ``path`` (default: the shared folder) and read them back.

    Odd input fares as in :func:`write_codes`; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-codes")
    write_codes(docs, path, tokenizer_path, end_id)
    return read_codes(spark, path)
