"""Whole numbers of 40, 128, 256, 512 and 1024 bits.

40-bit numbers are masked BIGINTs and stay in the JVM. Wider ones are big-endian BINARY of fixed length, whose order is
numeric order in Spark; their arithmetic is a vectorised function over Python's integers and wraps at their width.
Division by zero is NULL.
"""

import decimal
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import _c

MASK40 = (1 << 40) - 1
WIDTHS = (128, 256, 512, 1024)


def uint40(x) -> Column:
    return _c(x).bitwiseAND(F.lit(MASK40).cast("bigint"))


def _apply(op: str, a: int, b: int, bits: int) -> int | None:
    if op in ("div", "mod") and b == 0:
        return None
    return {
        "add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: a // b, "mod": lambda: a % b,
        "and": lambda: a & b, "or": lambda: a | b, "xor": lambda: a ^ b, "not": lambda: ~a,
        "shl": lambda: a << b if b < bits else 0, "shr": lambda: a >> b if b < bits else 0,
        "popcnt": lambda: a.bit_count(), "lzcnt": lambda: bits - a.bit_length(), "tzcnt": lambda: (a & -a).bit_length() - 1 if a else bits,
    }[op]() & ((1 << bits) - 1)


def wide(op: str, a: Column, b=None, bits: int = 128) -> Column:
    """add, sub, mul, div, mod, and, or, xor, not, shl, shr, popcnt, lzcnt or tzcnt of big-endian numbers."""
    size = bits // 8

    @F.pandas_udf("binary")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            v = None if p is None or q is None else _apply(op, int.from_bytes(p, "big"), int.from_bytes(q, "big"), bits)
            out.append(None if v is None else v.to_bytes(size, "big"))
        return pd.Series(out, dtype=object)

    return run(a, b if b is not None else a)


def from_long(x, bits: int = 128) -> Column:
    """A number from 0 on as a wide one."""
    return F.unhex(F.lpad(F.hex(_c(x)), bits // 4, "0"))


def print_uint(x: Column, base: int = 10) -> Column:
    """Digits of a wide number in base 8, 10 or 16."""
    if base == 16:
        return F.coalesce(F.nullif(F.ltrim(F.lower(F.hex(x)), F.lit("0")), F.lit("")), F.lit("0"))
    code = {8: "o", 10: "d"}[base]

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda b: None if b is None else format(int.from_bytes(b, "big"), code))

    return run(x)


def _round(x: decimal.Decimal, how: str) -> decimal.Decimal:
    return x.to_integral_value(rounding=how)


def _lgamma(x: decimal.Decimal) -> decimal.Decimal:
    """Stirling's series after shifting the argument up until the series is exact to the precision."""
    digits = decimal.getcontext().prec
    shift, z = decimal.Decimal(0), x
    while z < digits:
        shift += z.ln()
        z += 1
    total = (z - decimal.Decimal("0.5")) * z.ln() - z + (2 * _pi()).ln() / 2
    power, bernoulli = z, _bernoulli(digits // 2 + 4)
    for k in range(1, len(bernoulli)):
        total += bernoulli[k] / (2 * k * (2 * k - 1) * power)
        power *= z * z
    return total - shift


def _bernoulli(n: int) -> list[decimal.Decimal]:
    from fractions import Fraction

    full: list[Fraction] = []
    for m in range(2 * n):
        full.append(-sum((math.comb(m + 1, k) * full[k] for k in range(m)), Fraction(0)) / (m + 1) if m else Fraction(1))
    return [decimal.Decimal(b.numerator) / b.denominator for b in full[::2]]


def _pi() -> decimal.Decimal:
    """Machin's formula at the current precision."""

    def arctan(inverse: int) -> decimal.Decimal:
        x = decimal.Decimal(1) / inverse
        term, total, k, sign = x, x, 1, -1
        while True:
            term /= inverse * inverse
            k += 2
            step = term / k
            if total + step == total:
                return total
            total += sign * step
            sign = -sign

    return 4 * (4 * arctan(5) - arctan(239))


_FLOATS = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "mod": lambda a, b: a % b, "pow": lambda a, b: a**b,
    "min": min, "max": max, "abs": lambda a, _: abs(a), "sqrt": lambda a, _: a.sqrt(), "log": lambda a, _: a.ln(), "exp": lambda a, _: a.exp(), "lgamma": lambda a, _: _lgamma(a),
    "floor": lambda a, _: _round(a, decimal.ROUND_FLOOR), "ceil": lambda a, _: _round(a, decimal.ROUND_CEILING), "round": lambda a, _: _round(a, decimal.ROUND_HALF_UP), "pi": lambda *_: _pi(),
}


def bigfloat(op: str, a: Column, b=None, digits: int = 50) -> Column:
    """An operation on decimal numbers given as strings, to `digits` significant digits; NULL where undefined."""

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            if p is None or q is None:
                return None
            with decimal.localcontext() as c:
                c.prec = digits + 8
                try:
                    v = _FLOATS[op](decimal.Decimal(p), decimal.Decimal(q))
                    c.prec = digits
                    return str(+v)
                except (decimal.InvalidOperation, decimal.DivisionByZero, decimal.Overflow):
                    return None

        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype=object)

    return run(a, b if b is not None else a)
