"""Blocked Bloom filters as relations and as broadcast arrays.

A filter is W words of 32 bits, W a power of two, cut into blocks of ``block_words`` words. A key's block comes
from the low bits of its hash, and all its k bits are in that block: anywhere in it with one sector; else k/zones
bits in one sector of each zone, a zone being a run of sectors/zones sectors. Bits come from products of the hash,
each with a multiplier of its own. Building is one aggregation that combines on the map side; probing is an
expression on an array that every task holds, or, for a filter too large for that, a join by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.hashing import MASK32, hash32, hash32_int, hash32_sql, prefix

WORD = 32
#: Filters up to so many words (8 bytes each as an array) travel to every task.
BROADCAST_WORDS = 1 << 20
MOST_BITS = 15


@dataclass(frozen=True)
class Shape:
    """Words of a block, its sectors and zones, and bits a key."""

    block_words: int = 1
    sectors: int = 1
    zones: int = 1
    k: int = 4

    def __post_init__(self):
        powers = (self.block_words, self.sectors, self.zones)
        if any(x < 1 or x & (x - 1) for x in powers) or not 1 <= self.k <= MOST_BITS:
            raise ValueError("words of a block, sectors and zones must be powers of two, and k in 1..15")
        if self.zones > self.sectors or self.sectors > WORD * self.block_words or (self.sectors > 1 and self.k % self.zones):
            raise ValueError("a zone needs a sector, a sector a bit, and k must be a multiple of zones")

    @classmethod
    def parse(cls, text: str) -> Shape:
        """``w,s,z,k``."""
        return cls(*(int(x) for x in text.split(",")))

    def bits(self) -> list[tuple[int, int, int, int]]:
        """For each of the k bits: its zone's first bit, bits to choose the sector, bits to choose in the sector, its number."""
        size = WORD * self.block_words // self.sectors
        zones = self.zones if self.sectors > 1 else 1
        each = self.sectors // zones
        return [(z * each * size, each.bit_length() - 1, size.bit_length() - 1, i) for i in range(self.k) for z in [i * zones // self.k]]


def multiplier(i: int) -> int:
    """Odd 31-bit multiplier number i."""
    return hash32_int(i + 1) & 0x7FFFFFFF | 1


def _top(x: Column, by: int, bits: int) -> Column:
    if not bits:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned((x * by).bitwiseAND(F.lit(MASK32)), 32 - bits)


def _top_sql(x: str, by: int, bits: int) -> str:
    return f"((({x} * {by}) & {MASK32}) >> {32 - bits})" if bits else "0"


def positions(hash_: Column, shape: Shape) -> list[Column]:
    """The k bits' places in the block; all bits of a zone fall into one sector of it."""
    return [_top(hash_, multiplier(i), inner) + F.shiftleft(_top(hash_, multiplier(MOST_BITS + first), sector), inner) + first for first, sector, inner, i in shape.bits()]


def positions_sql(hash_: str, shape: Shape) -> list[str]:
    return [f"({_top_sql(hash_, multiplier(i), inner)} + ({_top_sql(hash_, multiplier(MOST_BITS + first), sector)} << {inner}) + {first})" for first, sector, inner, i in shape.bits()]


def _blocks(words: int, shape: Shape) -> int:
    if words & (words - 1) or words < shape.block_words:
        raise ValueError("words must be a power of two and hold a block")
    return words // shape.block_words


def words_and_masks(hash_: Column, words: int, shape: Shape) -> list[tuple[Column, Column]]:
    """The words that a key's bits are in, and its mask in each: one of the whole block if that is a word, else one for each bit."""
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
    first = hash_.bitwiseAND(F.lit(_blocks(words, shape) - 1))
    places = positions(hash_, shape)
    if shape.block_words == 1:
        mask = F.lit(0).cast("long")
        for p in places:
            mask = mask.bitwiseOR(one(p))
        return [(first, mask)]
    return [(first * shape.block_words + F.shiftrightunsigned(p, 5), one(p.bitwiseAND(F.lit(31)))) for p in places]


def words_and_masks_sql(hash_: str, words: str, shape: Shape) -> list[tuple[str, str]]:
    """The same as SQL text; ``words`` is an expression."""
    first = f"({hash_} & ({words} // {shape.block_words} - 1))"
    places = positions_sql(hash_, shape)
    if shape.block_words == 1:
        return [(first, "(" + " | ".join(f"(1::BIGINT << ({p})::INT)" for p in places) + ")")]
    return [(f"({first} * {shape.block_words} + ({p} >> 5))", f"(1::BIGINT << ({p} & 31)::INT)") for p in places]


def words_for(keys: int, bits_per_key: int = 12, shape: Shape = Shape()) -> int:  # noqa: B008
    """Words of a filter for so many keys: a power of two, 32 and a block at least."""
    return max(shape.block_words, 1 << max(5, (-(-max(1, keys) * bits_per_key // WORD) - 1).bit_length()))


def words_for_sql(keys: str, bits_per_key: int = 12) -> str:
    return f"greatest(32, pow(2, ceil(log2(greatest(1, ({keys} * {bits_per_key} + {WORD - 1}) // {WORD}))))::BIGINT)"


def hashed(rows: DataFrame, key: str, name: str = "_hash") -> DataFrame:
    """rows with the key's hash in a column of its own.

    The hash is used many times over. A filter on it would be pushed below and carry a copy of it for each use; the
    row number, which counts for nothing, keeps the two apart, so it is computed once a row.
    """
    return rows.withColumn(name, hash32(F.col(key)) + F.monotonically_increasing_id() * 0)


def build(keys: DataFrame, key: str, words: int, shape: Shape) -> DataFrame:
    """(word, bits) of the words that have a bit. Null keys are left out; empty input gives no rows."""
    some = hashed(keys.filter(F.col(key).isNotNull()).select(key), key)
    pairs = words_and_masks(F.col("_hash"), words, shape)
    if len(pairs) == 1:
        rows = some.select(pairs[0][0].alias("word"), pairs[0][1].alias("mask"))
    else:
        rows = some.select(F.explode(F.array(*(F.struct(w.alias("word"), m.alias("mask")) for w, m in pairs))).alias("x")).select("x.word", "x.mask")
    return rows.groupBy("word").agg(F.bit_or("mask").alias("bits"))


def as_array(filter_words: DataFrame, words: int) -> Column:
    """The whole filter as one array, by a scalar subquery: words in order, zero where no key fell."""
    spark = filter_words.sparkSession
    dense = spark.range(words).withColumnRenamed("id", "word").join(filter_words, "word", "left")
    one = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("w"))
    return one.scalar()


def contains(filter_array: Column, hash_: Column, words: int, shape: Shape) -> Column:
    """Whether a key of this hash may be in the filter: no bit of its masks is missing. False for null."""
    out = None
    for word, mask in words_and_masks(hash_, words, shape):
        here = F.bitwise_not(F.get(filter_array, word.cast("int"))).bitwiseAND(mask) == 0
        out = here if out is None else out & here
    return F.coalesce(out, F.lit(False))


def flagged(probe: DataFrame, key: str, filter_words: DataFrame, words: int, shape: Shape) -> DataFrame:
    """probe with a boolean ``flag``. Filters above BROADCAST_WORDS are joined by word instead of broadcast."""
    if words <= BROADCAST_WORDS:
        return hashed(probe, key).withColumn("flag", contains(as_array(filter_words, words), F.col("_hash"), words, shape)).drop("_hash")
    # the words of a key one after the other: each join keeps the rows and says whether the bits are there
    out = hashed(probe, key).withColumn("flag", F.lit(True))
    for word, mask in words_and_masks(F.col("_hash"), words, shape):
        out = out.withColumn("_word", word).join(filter_words.select(F.col("word").alias("_w"), F.col("bits").alias("_bits")), F.col("_word") == F.col("_w"), "left")
        out = out.withColumn("flag", F.col("flag") & F.coalesce(F.bitwise_not("_bits").bitwiseAND(mask) == 0, F.lit(False))).drop("_word", "_w", "_bits")
    return out.drop("_hash")


def candidates(probe: DataFrame, key: str, filter_words: DataFrame, words: int, shape: Shape) -> DataFrame:
    """The rows of probe that the filter lets through (compaction); duplicates stay."""
    return flagged(probe, key, filter_words, words, shape).filter("flag").drop("flag")


def clustered(probe: DataFrame, key: str, bits: int) -> DataFrame:
    """probe clustered by the top bits of the hash: neighbouring rows read neighbouring words.

    A shuffle; worth it only where a filter exceeds the caches, so never a default.
    """
    top = prefix(hash32(F.col(key)), bits)
    return probe.withColumn("prefix", top).repartitionByRange("prefix", key).sortWithinPartitions("prefix", key).drop("prefix")


def bitmap(flags: DataFrame, position: str, flag: str) -> DataFrame:
    """(word, bits): lane i of a word of 32 is position 32 * word + i, lowest bit first."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(position), F.lit(WORD)).cast("int"))
    set_bit = F.when(F.col(flag), bit).otherwise(F.lit(0).cast("long"))
    return flags.select(F.floor(F.col(position) / WORD).cast("long").alias("word"), set_bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def selection(words: DataFrame, lanes: int | None = None) -> DataFrame:
    """Positions of the set bits of (word, bits); lanes bounds the positions, so stray bits beyond are left out."""
    out = words.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("lane"))
    out = out.filter(F.expr("getbit(bits, lane) = 1")).select((F.col("word") * WORD + F.col("lane")).alias("position"))
    return out if lanes is None else out.filter(F.col("position") < lanes)
