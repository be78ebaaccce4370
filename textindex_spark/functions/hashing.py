"""Hash functions as column expressions. Products are split so that ANSI arithmetic never overflows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import _c, _shl, _ushr, bit_length

M32 = (1 << 32) - 1
#: FNV-1a, 32 bits.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
#: Fixed value: Knuth's multiplier.
KNUTH = 2654435761
MERSENNE61 = (1 << 61) - 1
#: Fixed value: the modulus of hashes of q-grams.
GRAM_PRIME = (1 << 62) - 273
#: A base of our own for rolling fingerprints, so that they are the same in every run.
ROLLING_BASE = 1_000_003


def crc32(data: Column) -> Column:
    return F.crc32(data)


def byte_pairs(text: Column) -> Column:
    """The UTF-8 bytes of a text as pairs of hexadecimal digits, found in one pass."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))


def bytes_of(text: Column) -> Column:
    """The UTF-8 bytes of a text as an array of whole numbers."""
    return F.transform(byte_pairs(text), lambda x: F.conv(x, 16, 10).cast("bigint"))


def fnv1a(data: Column) -> Column:
    """FNV-1a over an array of bytes."""
    return F.aggregate(data, F.lit(FNV_BASIS).cast("bigint"), lambda h, b: low32_mul(h.bitwiseXOR(b), FNV_PRIME))


def low32_mul(x, m: int) -> Column:
    """x * m modulo 2**32 for x and m below 2**32."""
    v = _c(x)
    high = (_ushr(v, 16) * m).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    return (_shl(high, 16) + v.bitwiseAND(F.lit(0xFFFF).cast("bigint")) * m).bitwiseAND(F.lit(M32).cast("bigint"))


def identity(x) -> Column:
    return _c(x)


def modulo(x, m: int) -> Column:
    return F.pmod(_c(x), F.lit(m).cast("bigint"))


def multiplicative(x, k: int = KNUTH) -> Column:
    """x * k modulo 2**64, as a signed number; x and k are not negative."""
    product = _c(x).cast("decimal(19,0)") * F.lit(k).cast("decimal(19,0)")
    low = product % F.lit(Decimal(1 << 64))
    return F.when(low >= F.lit(Decimal(1 << 63)), low - F.lit(Decimal(1 << 64))).otherwise(low).cast("bigint")


def mulmod61(a: Column, b) -> Column:
    """a * b modulo 2**61 - 1 for factors below that."""
    product = a.cast("decimal(19,0)") * (b if isinstance(b, Column) else F.lit(b)).cast("decimal(19,0)")
    return (product % F.lit(MERSENNE61).cast("decimal(19,0)")).cast("bigint")


def karp_rabin(symbols: Column, base: int = ROLLING_BASE) -> Column:
    """Fingerprint of an array of symbols: the value of the polynomial with these coefficients at base."""
    return F.aggregate(symbols, F.lit(0).cast("bigint"), lambda h, s: (mulmod61(h, base) + s) % MERSENNE61)


def roll(fp: Column, out: Column, into: Column, window: int, base: int = ROLLING_BASE) -> Column:
    """The fingerprint of the window that lost the symbol `out` in front and gained `into` at its end."""
    lead = pow(base, window, MERSENNE61)
    return F.pmod(mulmod61(fp, base) + into - mulmod61(out, lead), F.lit(MERSENNE61))


def gram_hash(key) -> Column:
    """Hash of a q-gram held in 64 bits: its significant bits, repeated as often as they fit, modulo GRAM_PRIME; 0 for 0."""
    x = _c(key)
    n = bit_length(x).cast("int")
    more = F.when(2 * n <= 64, F.sequence(F.lit(1), F.floor((64 - n) / n).cast("int"))).otherwise(F.array().cast("array<int>"))
    repeated = F.aggregate(more, x, lambda h, _: _shl(h, n).bitwiseOR(x))
    wide = repeated.cast("decimal(20,0)")
    unsigned = F.when(repeated < 0, wide + F.lit(Decimal(1 << 64))).otherwise(wide)
    return F.when(x == 0, F.lit(0).cast("bigint")).otherwise((unsigned % F.lit(Decimal(GRAM_PRIME))).cast("bigint"))


#: Our own odd multipliers, one for each row of a count-min sketch.
CM_MULTIPLIERS = tuple((0x9E3779B1 * (2 * j + 1)) & M32 | 1 for j in range(8))
CM_PRIME = (1 << 19) - 1


def count_min_hash(key, row: int, width: int) -> Column:
    """Column of a key in a row of a count-min sketch whose width is a power of two."""
    v, m = _c(key), CM_MULTIPLIERS[row]
    low, high = low32_mul(v.bitwiseAND(F.lit(M32).cast("bigint")), m), low32_mul(_ushr(v, 32), m)
    return (low.bitwiseXOR(high) % CM_PRIME).bitwiseAND(F.lit(width - 1).cast("bigint"))
