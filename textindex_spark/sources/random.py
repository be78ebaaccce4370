"""Seeded data: permutations, random vectors and operation streams."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import _c

SEED = 147
#: A seed of 64 bits is combined with both by exclusive or and added modulo 2**64.
SEED_MASKS = 0x9696594B6A5936B2, 0xD2165B4B66592AD6


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 2**64."""
    if n < 2:
        return False
    bases = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    for p in bases:
        if n % p == 0:
            return n == p
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in bases:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def permutation_prime(universe: int) -> int:
    """The largest prime up to the universe that leaves 3 modulo 4; squares modulo it are a permutation of each half."""
    p = universe
    while p > 3 and not (p % 4 == 3 and _is_prime(p)):
        p -= 1
    return max(p, 3)


def _residue(i: Column, prime: int) -> Column:
    """i for the few numbers from the prime on; else the square, or its complement in the upper half."""
    wide = i.cast("decimal(19,0)")
    square = (wide * wide % F.lit(prime).cast("decimal(19,0)")).cast("bigint")
    return F.when(i >= prime, i).when(2 * i <= prime, square).otherwise(prime - square)


def permuted(i, universe: int, seed: int = SEED) -> Column:
    """Where a fixed permutation of 0 .. universe - 1 sends i: two rounds of residues with a shift between them."""
    prime = permutation_prime(universe)
    shift = seed ^ SEED_MASKS[0] ^ SEED_MASKS[1]
    moved = (_residue(_c(i), prime).cast("decimal(20,0)") + F.lit(Decimal(shift))) % F.lit(Decimal(1 << 64))
    return _residue((moved % F.lit(Decimal(universe))).cast("bigint"), prime)


def permutation(spark: SparkSession, universe: int, seed: int = SEED, n: int | None = None, start: int = 0) -> DataFrame:
    """(i, value): n values of the permutation from i = start on."""
    end = universe if n is None else min(universe, start + n)
    return spark.range(start, end).select(F.col("id").alias("i"), permuted(F.col("id"), universe, seed).alias("value"))


def primes(spark: SparkSession, low: int, high: int) -> DataFrame:
    """(value): the primes from low to high."""
    from ..functions.bits import is_prime

    return spark.range(low, high + 1).where(is_prime(F.col("id"))).select(F.col("id").alias("value"))


def vector(spark: SparkSession, n: int, low: int, high: int, seed: int = SEED) -> DataFrame:
    """(i, value): n numbers drawn evenly from low to high."""
    return spark.range(n).select(F.col("id").alias("i"), (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("bigint").alias("value"))


def distributions(spark: SparkSession, n: int, seed: int = SEED, mean: float = 0.0, deviation: float = 1.0, trials: int = 10, chance: float = 0.5) -> DataFrame:
    """(i, uniform, normal, binomial) draws; partitions draw from streams of their own, fixed by the seed and the row."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(binomial=[int(np.random.Generator(np.random.Philox(key=seed, counter=[int(i), 0, 0, 0])).binomial(trials, chance)) for i in pdf["i"]])

    d = spark.range(n).select(F.col("id").alias("i"), F.rand(seed).alias("uniform"), (F.randn(seed) * deviation + mean).alias("normal"))
    return d.mapInPandas(draw, "i long, uniform double, normal double, binomial long")


def generate_operations(seed: int, most: int, universe: int, batch: int, grow: float = 0.9, hold: float = 0.25, query: float = 0.5) -> Iterator[tuple[str, list[int]]]:
    """(opcode, keys) batches: the set grows to `most` keys, is held there for a share of the time, and shrinks to nothing.

    Only absent keys are inserted and only live ones deleted. While growing, a change is an insert with chance `grow`;
    while shrinking, a delete; while held, either. Each batch of changes is followed by queries with chance `query`.
    """
    rng = np.random.default_rng(seed)
    live: list[int] = []
    there: set[int] = set()

    def change(insert: bool) -> tuple[str, list[int]]:
        if insert or not live:
            keys: list[int] = []
            while len(keys) < min(batch, most - len(live)):
                k = int(rng.integers(0, universe))
                if k not in there:
                    there.add(k)
                    keys.append(k)
            live.extend(keys)
            return "I", keys
        keys = []
        for _ in range(min(batch, len(live))):
            j = int(rng.integers(0, len(live)))
            live[j], live[-1] = live[-1], live[j]
            keys.append(live.pop())
        there.difference_update(keys)
        return "D", keys

    def step(p_insert: float) -> Iterator[tuple[str, list[int]]]:
        op = change(len(live) < most and rng.random() < p_insert)
        if op[1]:
            yield op
        if rng.random() < query:
            yield "Q", rng.integers(0, universe, batch).tolist()

    rounds = 0
    while len(live) < most:
        rounds += 1
        yield from step(grow)
    for _ in range(int(rounds * hold)):
        yield from step(0.5)
    while live:
        yield from step(1 - grow)
