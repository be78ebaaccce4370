"""Bit and integer functions as column expressions; all but the tests for primes stay inside the JVM.

Whole numbers are BIGINT. Results that do not exist (a select beyond the last bit, a code of a number that has none) are
NULL. Codes are strings of the characters 0 and 1, most significant bit first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ONES = -1

# SI and IEC multipliers of sizes
_K, _M, _G = 1000, 1000**2, 1000**3
_KI, _MI, _GI = 1 << 10, 1 << 20, 1 << 30


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("bigint")


def _ushr(x, n) -> Column:
    return F.call_function("shiftrightunsigned", _c(x).cast("bigint"), _c(n).cast("int"))


def _shl(x, n) -> Column:
    return F.call_function("shiftleft", _c(x).cast("bigint"), _c(n).cast("int"))


def bit_mask(bits) -> Column:
    """The lowest `bits` bits set; all 64 from 64 on."""
    b = _c(bits)
    return F.when(b <= 0, F.lit(0).cast("bigint")).when(b >= 64, F.lit(ONES).cast("bigint")).otherwise(_ushr(ONES, 64 - b))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def idiv_ceil(a, b) -> Column:
    return _div(_c(a) + _c(b) - 1, _c(b))


def bit_length(x) -> Column:
    """Number of bits up to the highest that is set; 0 for 0."""
    return F.when(_c(x) == 0, 0).otherwise(F.length(F.bin(_c(x)))).cast("bigint")


def ilog2_ceil(x) -> Column:
    return bit_length(x)


def ilog2_floor(x) -> Column:
    return F.when(_c(x) == 0, F.lit(0)).otherwise(bit_length(x) - 1).cast("bigint")


def isqrt_floor(x) -> Column:
    """Exact floor of the square root of a number from 0 to 2**63 - 1; compared by division, so nothing overflows."""
    v = _c(x).cast("bigint")
    r = F.floor(F.sqrt(v.cast("double"))).cast("bigint")
    return F.when((r > 0) & (r > _div(v, F.greatest(r, F.lit(1).cast("bigint")))), r - 1).when(r + 1 <= _div(v, r + 1), r + 1).otherwise(r)


def isqrt_ceil(x) -> Column:
    r = isqrt_floor(x)
    return F.when(r * r == _c(x), r).otherwise(r + 1)


def is_prime(x) -> Column:
    """Strong-probable-prime tests with bases that leave no doubt."""

    @F.pandas_udf("boolean")
    def test(values):
        return values.map(prime)

    v = _c(x).cast("bigint")
    return F.when(v.isNotNull(), test(F.coalesce(v, F.lit(0).cast("bigint"))))


#: Bases whose strong-probable-prime tests together are exact below 2**64 (fixed values).
_BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def prime(n: int) -> bool:
    """Exact below 2**64."""
    if n < 2:
        return False
    for p in _BASES:
        if n % p == 0:
            return n == p
    if n < 41 * 41:
        return True
    s = (n - 1 & 1 - n).bit_length() - 1
    for base in _BASES[:4] if n < 3_215_031_751 else _BASES:
        x = pow(base, n - 1 >> s, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def nearest_primes(values: list[int], step: int) -> list[int | None]:
    """For each value the nearest prime from it on in steps of -1 or 1, None if there is none of 63 bits.

    Values are taken in order, so a number between two of them is tested once.
    """
    found: dict[int, int | None] = {}
    last, answer = None, None
    for v in sorted(set(values), reverse=step > 0):
        k = max(v, 2) if step > 0 else v
        while 2 <= k < 1 << 63 and k != last and not prime(k):
            k += step
        answer = answer if k == last else k if 2 <= k < 1 << 63 else None
        found[v], last = answer, v
    return [found[v] for v in values]


def _prime_column(v: Column, step: int) -> Column:
    @F.pandas_udf("bigint")
    def nearest(values):
        return pd.Series(nearest_primes(values.tolist(), step), dtype="Int64")

    return nearest(F.coalesce(v, F.lit(0).cast("bigint")))  # without nulls, which would make numbers floating


def prime_predecessor(x) -> Column:
    """The largest prime up to x; NULL below 2."""
    return _prime_column(_c(x).cast("bigint"), -1)


def prime_successor(x) -> Column:
    """The smallest prime from x on."""
    return _prime_column(F.greatest(_c(x).cast("bigint"), F.lit(2).cast("bigint")), 1)


def popcnt(x) -> Column:
    return F.bit_count(_c(x)).cast("bigint")


def lzcnt(x) -> Column:
    return 64 - bit_length(x)


def tzcnt(x) -> Column:
    """Number of zero bits below the lowest set one; 64 for 0."""
    v = _c(x)
    text = F.bin(v)
    return F.when(v == 0, 64).otherwise(F.length(text) - F.length(F.rtrim(text, F.lit("0")))).cast("bigint")


def getbit(x, i) -> Column:
    return _ushr(x, i).bitwiseAND(F.lit(1).cast("bigint"))


def rank1_u64(v, x=63) -> Column:
    """Set bits among the positions 0 to x."""
    return popcnt(_c(v).bitwiseAND(bit_mask(_c(x) + 1)))


def rank1_range_u64(v, a, b) -> Column:
    """Set bits among the positions a to b."""
    return popcnt(_ushr(v, a).bitwiseAND(bit_mask(_c(b) - _c(a) + 1)))


def _select(v, k, bit: int) -> Column:
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: getbit(v, i) == bit)
    return F.when(_c(k) >= 1, F.get(places, (_c(k) - 1).cast("int"))).cast("bigint")


def select1_u64(v, k) -> Column:
    """Position of the k-th set bit, counted from 1."""
    return _select(v, k, 1)


def select0_u64(v, k) -> Column:
    return _select(v, k, 0)


def pext(x, mask) -> Column:
    """The bits of x at the set bits of mask, moved together to the low end."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: getbit(mask, i) == 1)
    return F.aggregate(F.transform(places, lambda i, k: _shl(getbit(x, i), k)), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def pcmpgtu(a: Column, b: Column) -> Column:
    """Unsigned a > b for each pair of two arrays."""
    low = F.lit(-(1 << 63)).cast("bigint")
    return F.zip_with(a, b, lambda p, q: p.bitwiseXOR(low) > q.bitwiseXOR(low))


def packed_rank(keys: Column, x: Column) -> Column:
    """How many of an array's keys are at most x."""
    return F.size(F.filter(keys, lambda k: k <= x)).cast("bigint")


def binary_code(x, width) -> Column:
    """`width` bits of x; NULL if it has more."""
    return F.when(bit_length(x) <= _c(width), F.lpad(F.bin(_c(x)), _c(width).cast("int"), F.lit("0")))


def _low(x: Column, n: Column) -> Column:
    """The lowest n bits of x as a string."""
    return F.when(n > 0, F.lpad(F.bin(x.bitwiseAND(bit_mask(n))), n.cast("int"), F.lit("0"))).otherwise("")


def unary_code(x) -> Column:
    """x zeros and a one."""
    return F.concat(F.repeat(F.lit("0"), _c(x).cast("int")), F.lit("1"))


def _gamma(digits: Column) -> Column:
    """Gamma code of a number from its binary digits: as many zeros as digits follow the first, then the digits."""
    return F.concat(F.repeat(F.lit("0"), F.length(digits) - 1), digits)


def gamma_code(x) -> Column:
    return F.when(_c(x) > 0, _gamma(F.bin(_c(x))))


def delta_code(x) -> Column:
    """The number of binary digits in gamma code, then the digits after the first."""
    digits = F.bin(_c(x))
    return F.when(_c(x) > 0, F.concat(_gamma(F.bin(F.length(digits))), F.substring(digits, 2, 64)))


def delta0_code(x) -> Column:
    return delta_code(_c(x) + 1)


def rice_code(x, p) -> Column:
    """Quotient plus one in gamma code, then the p low bits."""
    return F.when(_c(x) >= 0, F.concat(gamma_code(_ushr(x, p) + 1), _low(_c(x), _c(p))))


def gamma_bits(x) -> Column:
    return F.when(_c(x) > 0, 2 * ilog2_floor(x) + 1)


def delta_bits(x) -> Column:
    b = ilog2_floor(x)
    return F.when(_c(x) > 0, b + 2 * ilog2_floor(b + 1) + 1)


def delta0_bits(x) -> Column:
    return delta_bits(_c(x) + 1)


def rice_bits(x, p) -> Column:
    return F.when(_c(x) >= 0, gamma_bits(_ushr(x, p) + 1) + _c(p))


def pack_bits(code: Column) -> Column:
    """A bit string as bytes, the last one filled with zeros."""
    whole = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("0"))
    digits = F.transform(F.sequence(F.lit(1), (F.length(whole) / 4).cast("int")), lambda i: F.hex(F.conv(F.substr(whole, (i - 1) * 4 + 1, F.lit(4)), 2, 10).cast("bigint")))
    hexes = F.array_join(digits, "")
    even = F.rpad(hexes, (F.ceil(F.length(hexes) / 2) * 2).cast("int"), F.lit("0"))
    return F.when(F.length(code) > 0, F.unhex(even)).otherwise(F.lit(b""))


def _number(digits: Column) -> Column:
    return F.when(digits == "", F.lit(0)).otherwise(F.conv(digits, 2, 10)).cast("bigint")


def _zeros(code: Column) -> Column:
    return F.instr(code, "1") - 1


def unary_value(code: Column) -> Column:
    """The number of a unary code; NULL if the string is none."""
    return F.when(code.rlike("^0*1$"), _zeros(code)).cast("bigint")


def gamma_value(code: Column) -> Column:
    return F.when(F.length(code) == 2 * _zeros(code) + 1, _number(code))


def delta_value(code: Column) -> Column:
    z = _zeros(code)
    b = _number(F.substr(code, F.lit(1), 2 * z + 1)) - 1
    low = F.substr(code, 2 * z + 2)
    return F.when((z >= 0) & (F.length(low) == b), _shl(1, b) + _number(low))


def rice_value(code: Column, p: int) -> Column:
    z = _zeros(code)
    low = F.substr(code, 2 * z + 2)
    return F.when((z >= 0) & (F.length(low) == p), _shl(_number(F.substr(code, F.lit(1), 2 * z + 1)) - 1, p) + _number(low))


def binary_value(code: Column) -> Column:
    return _number(code)
