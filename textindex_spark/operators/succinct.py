"""Bit vectors, rank and select, packed integers and gap-coded sequences as tables.

A bit vector is a table (vec_id, i, bit) or, packed, (vec_id, block, word) with 64 bits a word, the lowest first. Rank and
select run on packed words with a running count over the blocks: a vector is divided into superblocks of
2**SUPER blocks, counts run inside a superblock and over superblocks, so no task needs a whole vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import _shl, bit_mask, idiv_ceil, ilog2_ceil, popcnt, rank1_u64, select0_u64, select1_u64

SUPER = 12


def pack(bits: DataFrame, by: str = "vec_id") -> DataFrame:
    """(vec_id, block, word, n): words of 64 bits; n is the number of positions that the block holds."""
    i = F.col("i").cast("bigint")
    word = F.bit_or(_shl(F.col("bit").cast("bigint"), i.bitwiseAND(F.lit(63).cast("bigint"))))
    return bits.groupBy(by, F.call_function("shiftright", i, F.lit(6)).alias("block")).agg(word.alias("word"), F.count(F.lit(1)).alias("n"))


def directory(words: DataFrame, by: str = "vec_id") -> DataFrame:
    """words with `ones` and `zeros` before each block."""
    d = words.withColumn("super", F.call_function("shiftright", "block", F.lit(SUPER))).withColumn("c", popcnt(F.col("word")))
    inner = Window.partitionBy(by, "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("in1", F.coalesce(F.sum("c").over(inner), F.lit(0))).withColumn("in0", F.coalesce(F.sum(F.col("n") - F.col("c")).over(inner), F.lit(0)))
    outer = Window.partitionBy(by).orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    tops = d.groupBy(by, "super").agg(F.sum("c").alias("s1"), F.sum(F.col("n") - F.col("c")).alias("s0"))
    tops = tops.select(by, "super", F.coalesce(F.sum("s1").over(outer), F.lit(0)).alias("o1"), F.coalesce(F.sum("s0").over(outer), F.lit(0)).alias("o0"))
    return d.join(tops, [by, "super"]).select(by, "block", "word", "n", (F.col("in1") + F.col("o1")).alias("ones"), (F.col("in0") + F.col("o0")).alias("zeros"))


def rank(queries: DataFrame, words: DataFrame, by: str = "vec_id", i: str = "i") -> DataFrame:
    """queries with `bit`, `rank1` and `rank0`: set and unset bits among the positions 0 to i."""
    d = directory(words, by)
    q = queries.withColumn("block", F.call_function("shiftright", F.col(i).cast("bigint"), F.lit(6)))
    at = F.col(i).bitwiseAND(F.lit(63).cast("bigint"))
    one = F.col("ones") + rank1_u64(F.col("word"), at)
    bit = F.call_function("shiftrightunsigned", F.col("word"), at.cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
    return q.join(d, [by, "block"], "left").select(*queries.columns, bit.alias("bit"), one.alias("rank1"), (F.col(i) + 1 - one).alias("rank0"))


def select(queries: DataFrame, words: DataFrame, by: str = "vec_id", k: str = "k", bit: int = 1) -> DataFrame:
    """queries with `pos`: the place of the k-th bit of this kind, counted from 1; NULL beyond the last.

    A block answers the queries k in (bits before it, bits up to it]: every block offers one row for each bit it holds
    of 64 at most, and queries meet it by equality.
    """
    d = directory(words, by)
    before = F.col("ones" if bit else "zeros")
    has = popcnt(F.col("word")) if bit else F.col("n") - popcnt(F.col("word"))
    find = select1_u64 if bit else select0_u64
    offers = d.where(has > 0).select(by, "block", "word", before.alias("b"), F.explode(F.sequence(F.lit(1).cast("bigint"), has)).alias("j"))
    offers = offers.select(F.col(by).alias("_v"), (F.col("b") + F.col("j")).alias("_k"), (F.col("block") * 64 + find(F.col("word"), F.col("j"))).alias("pos"))
    return queries.join(offers, (F.col(by) == F.col("_v")) & (F.col(k) == F.col("_k")), "left").select(*queries.columns, "pos")


def masked(value, width):
    """What an integer vector of this width keeps of a value."""
    return value.cast("bigint").bitwiseAND(bit_mask(width))


def int_vector_bytes(n, width):
    """Bytes of n packed integers, in whole words."""
    return idiv_ceil(n * width, F.lit(64).cast("bigint")) * 8


def narrowest(values: DataFrame, by: str, value: str) -> DataFrame:
    """The width that holds a vector's values, the storage chosen for it, and packed and stored bytes."""
    d = values.groupBy(by).agg(F.count(F.lit(1)).alias("n"), ilog2_ceil(F.max(value)).alias("width"))
    width = F.greatest("width", F.lit(1).cast("bigint"))
    native = F.expr("CASE WHEN width <= 1 THEN 1 WHEN width <= 8 THEN 8 WHEN width <= 16 THEN 16 WHEN width <= 32 THEN 32 WHEN width <= 40 THEN 40 ELSE 64 END").cast("bigint")
    return d.select(by, "n", width.alias("width"), native.alias("native_width"), int_vector_bytes(F.col("n"), width).alias("packed_bytes"), idiv_ceil(F.col("n") * native, F.lit(8).cast("bigint")).alias("native_bytes"))


def gaps(keys: DataFrame, by: str, key: str) -> DataFrame:
    """Distinct keys of each sequence in order: (by, i, key, gap); the first gap is NULL."""
    w = Window.partitionBy(by).orderBy(key)
    d = keys.select(by, key).distinct()
    return d.select(by, (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.col(key), (F.col(key) - F.lag(key).over(w)).alias("gap"))


def from_gaps(coded: DataFrame, first: DataFrame, by: str) -> DataFrame:
    """Keys back from gaps and the first key of each sequence."""
    w = Window.partitionBy(by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return coded.join(first, by).select(by, "i", (F.col("first") + F.sum(F.coalesce("gap", F.lit(0))).over(w)).alias("key"))


def gap_space(keys: DataFrame, by: str, key: str) -> DataFrame:
    """Bits of the unary gap code (largest less smallest key, and one a key) and of plain 64-bit keys."""
    d = keys.select(by, key).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    return d.select(by, "n", "first", "last", (F.col("last") - F.col("first") + F.col("n")).alias("gap_bits"), (F.col("n") * 64).alias("plain_bits"))


def every(rows: DataFrame, by: str, order: str, skip: int, offset: int = 0) -> DataFrame:
    """Every skip-th row of each sequence, from offset on."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w) - 1).where((F.col("_n") >= offset) & ((F.col("_n") - offset) % skip == 0)).drop("_n")


def ring(rows: DataFrame, by: str, order: str, value: str, size: int) -> DataFrame:
    """rows with `ring`: the last `size` values up to each row, oldest first."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(size - 1), 0)
    return rows.withColumn("ring", F.collect_list(value).over(w))


def assert_ascending(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """rows, whose computation fails where a sequence's values fall."""
    w = Window.partitionBy(by).orderBy(order)
    risen = F.coalesce(F.lag(value).over(w) <= F.col(value), F.lit(True))
    return rows.withColumn("_up", risen).where(F.assert_true(F.col("_up"), F.lit("values are not ascending")).isNull()).drop("_up")
