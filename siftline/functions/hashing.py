"""Integer hashes as Spark columns, with the same arithmetic as DuckDB SQL text for checks.

Everything stays in 64-bit integers below 2^63, so nothing overflows with ANSI arithmetic on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
#: The multipliers of the two 32-bit hashes.
MIX = 0x45D9F3B
KNUTH = 2654435761
#: Odd 31-bit multiplier of the second hash, taken from the middle of a product with the first.
SECOND = 0x2545F491


def hash32(key: Column) -> Column:
    """32-bit mixing hash of a key's low 32 bits, in [0, 2^32). Null stays null."""
    x = key.cast("long").bitwiseAND(F.lit(MASK32))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftrightunsigned(x, 16)) * MIX).bitwiseAND(F.lit(MASK32))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def hash32_sql(key: str) -> str:
    x = f"(({key})::BIGINT & {MASK32})"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {MIX}) & {MASK32})"
    return f"xor({x}, {x} >> 16)"


def hash32_int(key: int) -> int:
    x = key & MASK32
    for _ in range(2):
        x = (x ^ x >> 16) * MIX & MASK32
    return x ^ x >> 16


def second_hash(first: Column) -> Column:
    """Another 32 bits from a 32-bit hash: the product stays below 2^63."""
    return F.shiftrightunsigned(first * SECOND, 24).bitwiseAND(F.lit(MASK32))


def second_hash_sql(first: str) -> str:
    return f"((({first}) * {SECOND} >> 24) & {MASK32})"


def multiplicative_hash(key: Column) -> Column:
    """(key * 2654435761) mod 2^32 by halves of the key, so that no product leaves 63 bits."""
    x = key.cast("long").bitwiseAND(F.lit(MASK32))
    low = x.bitwiseAND(F.lit(0xFFFF)) * KNUTH
    high = (F.shiftrightunsigned(x, 16) * KNUTH).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(MASK32))


def slot(hash_: Column, slots: int) -> Column:
    """Slot of a hash in a table of 2^p slots."""
    if slots & (slots - 1):
        raise ValueError("slots must be a power of two")
    return hash_.bitwiseAND(F.lit(slots - 1))


def prefix(hash_: Column, bits: int) -> Column:
    """The top ``bits`` bits of a 32-bit hash."""
    return F.shiftrightunsigned(hash_, 32 - bits)


def wrapping_multiply(a: Column, b: Column) -> Column:
    """Product of two longs modulo 2^64, as a signed long (ANSI multiplication would raise)."""
    whole = F.pmod(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), F.lit("18446744073709551616").cast("decimal(20,0)"))
    signed = F.when(whole >= F.lit("9223372036854775808").cast("decimal(20,0)"), whole - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(whole)
    return signed.cast("long")


def expensive(repeats: int, t1: Column, t2: Column, t3: Column) -> tuple[Column, Column, Column]:
    """A chain of wrapping products: every third writes t1, the others t3. The caller must consume a result."""
    for i in range(repeats):
        if i % 3 == 0:
            t1 = wrapping_multiply(t2, t3)
        else:
            t3 = wrapping_multiply(t1, t2)
    return t1, t2, t3


def expensive_steps(rows: DataFrame, repeats: int, t1: str, t2: str, t3: str) -> DataFrame:
    """The same chain on columns of rows, a projection for each product, so that long chains stay small expressions."""
    for i in range(repeats):
        rows = rows.withColumn(t1, wrapping_multiply(F.col(t2), F.col(t3))) if i % 3 == 0 else rows.withColumn(t3, wrapping_multiply(F.col(t1), F.col(t2)))
    return rows


def unit_text(value: Column) -> Column:
    """A count with its largest binary unit: 4194304 gives '4.0~Mi'; below 1024 the number itself."""
    out = value.cast("string")
    for scale, name in ((1 << 10, "Ki"), (1 << 20, "Mi"), (1 << 30, "Gi")):
        out = F.when(value >= scale, F.concat(F.format_string("%.1f", value / scale), F.lit(f"~{name}"))).otherwise(out)
    return out


def amdahl(parallel: Column, workers: Column) -> Column:
    """Speed-up when the share ``parallel`` of the work runs on ``workers`` workers."""
    return 1.0 / ((1.0 - parallel) + parallel / workers)
