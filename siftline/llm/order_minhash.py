"""Order MinHash fingerprints of documents, in DataFrame expressions only.

A text's k-mers are runs of ``k`` words, numbered by occurrence, so a repeated run counts as often as it
stands. Their hashes fall into ``bins`` bins; from each bin the ``tuple_size`` least are selected, put
back into text order, and their k-mers hashed as one tuple. Two texts agree in a bin if they share its
minimal k-mers in the same order, which moves, inserts and deletions all disturb: the share of equal
bins falls with edit distance, not only with the sets of k-mers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import let, words

K, TUPLE_SIZE, BIN_BITS = 3, 2, 5
#: A packed entry: 35 bits of hash over 28 bits of place, sorted as a positive long.
PLACE_BITS = 28
VALUE_BITS = 32 - BIN_BITS


def _packed(hash_: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hash_, 1 + PLACE_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def _place(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _bin(entry: Column) -> Column:
    return F.shiftrightunsigned(entry, 63 - BIN_BITS)


def _numbered(kmers: Column) -> Column:
    """Packed hashes of (k-mer, occurrence) for all places. Texts without a repeated k-mer need no sort."""

    def runs(entries: Column) -> Column:
        at = lambda t: F.get(kmers, _place(F.get(entries, t)))
        starts = F.filter(F.sequence(F.lit(0), F.size(entries) - 1), lambda t: (t == 0) | (at(t) != at(F.greatest(t - 1, F.lit(0)))))

        def each(firsts: Column) -> Column:
            one = lambda s, t: _packed(F.xxhash64(at(t), t - s), _place(F.get(entries, t)))
            return F.flatten(F.transform(firsts, lambda s, j: F.transform(F.sequence(s, F.coalesce(F.get(firsts, j + 1), F.size(entries)) - 1), lambda t: one(s, t))))

        return let(starts, each)

    single = F.transform(kmers, lambda h, i: _packed(F.xxhash64(h, F.lit(0)), i))
    return F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), single).otherwise(let(F.sort_array(F.transform(kmers, _packed)), runs))


def _tuples(kmers: Column, entries: Column, tuple_size: int) -> Column:
    """One value for each bin that has k-mers: the bin's number over its tuple's hash."""
    least = F.filter(entries, lambda e, i: (i < tuple_size) | (_bin(F.get(entries, F.greatest(i - tuple_size, F.lit(0)))) != _bin(e)))

    def values(picked: Column) -> Column:
        first = lambda i: (i == 0) | (_bin(F.get(picked, F.greatest(i - 1, F.lit(0)))) != _bin(F.get(picked, i)))

        def value(i: Column) -> Column:
            entry = F.get(picked, i)
            mine = F.filter(F.slice(picked, i + 1, F.lit(tuple_size)), lambda e: _bin(e) == _bin(entry))
            in_order = F.sort_array(F.transform(mine, _place))
            tuple_hash = F.aggregate(in_order, F.lit(0).cast("long"), lambda a, p: F.xxhash64(a, F.get(kmers, p)))
            return F.shiftleft(_bin(entry), VALUE_BITS).bitwiseOR(F.shiftrightunsigned(tuple_hash, 64 - VALUE_BITS))

        places = F.filter(F.sequence(F.lit(0), F.size(picked) - 1), first)
        return F.transform(places, value)

    return let(least, values)


def sketch(text: Column, k: int = K, tuple_size: int = TUPLE_SIZE) -> Column:
    """``array<bigint>``: a value for each non-empty bin, in the bins' order; empty for a text without words.

    A text of fewer than ``k`` words is one k-mer, the whole sequence.
    """
    empty = F.array().cast("array<bigint>")

    def of_words(h: Column) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
        short = F.array(F.aggregate(h, F.lit(k).cast("long"), lambda a, x: F.xxhash64(a, x)))
        kmers = F.when(F.size(h) >= k, run).otherwise(short)
        return F.when(F.size(h) == 0, empty).otherwise(let(kmers, lambda m: let(F.sort_array(_numbered(m)), lambda e: _tuples(m, e, tuple_size))))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of_words)


def spelled(values: Column) -> Column:
    """Eight hex digits for each bin that has k-mers; an empty string for none."""
    return F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those that one of the texts has; 1 for two texts without words."""
    bins = lambda s: F.transform(s, lambda v: F.shiftrightunsigned(v, VALUE_BITS))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def with_next(docs: DataFrame, order: str, columns: list[str], tie: str) -> DataFrame:
    """Each row with ``next_<column>`` of the row that follows in descending ``order`` (after the last: the first).

    Rows are dealt into ranges between values of ``order`` that occur, a few for each shuffle partition; the
    first row of a range is also dealt, as a ghost, to the end of the range before it. So one shuffle and one
    window by range give every row its successor, and no task sees more than its ranges. Equal values of
    ``order`` follow each other by ``tie``. Rows without one have no successor.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)]
    row = docs.agg(F.percentile_approx(order, shares, 10_000).alias("cuts"), F.max(order).alias("most")).first()
    bounds = sorted({*(row.cuts or []), *([row.most] if row.most is not None else [])})
    cuts = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    here = F.size(F.filter(cuts, lambda b: b < F.col(order)))
    before = F.when(F.col(order) == F.lit(bounds[-1] if bounds else None), 0).otherwise(here + 1)
    own = F.struct(F.when(F.col(order).isNull(), -1 - F.pmod(F.xxhash64(tie), F.lit(n)).cast("int")).otherwise(here).alias("range"), F.lit(0).alias("ghost"))
    ghost = F.struct(before.alias("range"), F.lit(1).alias("ghost"))
    dealt = docs.withColumn("_at", F.explode(F.when(F.array_contains(cuts, F.col(order)), F.array(own, ghost)).otherwise(F.array(own))))
    dealt = dealt.withColumn("_range", F.col("_at.range")).withColumn("_ghost", F.col("_at.ghost")).drop("_at")
    following = Window.partitionBy("_range").orderBy("_ghost", F.col(order).desc(), tie)
    for c in columns:
        dealt = dealt.withColumn(f"next_{c}", F.when(F.col(order).isNotNull(), F.lead(c).over(following)))
    return dealt.filter("_ghost = 0").drop("_range", "_ghost")


def order_minhash_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last third (whole code points, rounded down) replaced by as many of the first of
    the next document's, in descending doc_id. A null text counts as empty. Rows with equal doc_id follow each
    other by text; a row with a null doc_id has an empty text for its next. Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = with_next(base.withColumn("sketch", sketch(F.col("text"))), "doc_id", ["text", "sketch"], "text")
    third = F.floor(F.length("text") / 3).cast("int")
    tail = F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third)
    edited = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - third), tail))
    edited = edited.withColumn("edited_sketch", sketch(F.col("edited")))
    return edited.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("sketch")).alias("fingerprint"),
        spelled(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.coalesce("next_sketch", F.array().cast("array<bigint>"))).alias("near_next"),
    )
