"""Work that is not to grow with a table, or with the size of its numbers."""

from pyspark.sql import functions as F

from textindex_spark.functions import bits


def test_prime_numbers():
    plain = [n for n in range(3000) if n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))]
    assert [n for n in range(3000) if bits.prime(n)] == plain
    # strong pseudoprimes to several bases, a square, and large primes
    assert not any(map(bits.prime, (2047, 3215031751, 3825123056546413051, 4294967291**2, (1 << 62) - 1)))
    assert all(map(bits.prime, ((1 << 61) - 1, (1 << 63) - 25, 4294967291)))
    values = [90, 14, 0, 1, 2, 97, 96, 14, 3000]
    assert bits.nearest_primes(values, -1) == [89, 13, None, None, 2, 97, 89, 13, 2999]
    assert bits.nearest_primes(values, 1) == [97, 17, 2, 2, 2, 97, 97, 17, 3001]
    assert bits.nearest_primes([(1 << 63) - 1], 1) == [None]


def test_large_keys_are_no_slower(spark):
    import time

    d = spark.range(1 << 60, (1 << 60) + 200).select("id", bits.is_prime(F.col("id")).alias("p"), bits.prime_successor(F.col("id")).alias("s"))
    began = time.time()
    rows = d.collect()
    assert time.time() - began < 60  # trial division takes 2**30 / 3 steps for each number
    assert all(r.p == (r.s == r.id) for r in rows) and any(r.p for r in rows)


def test_replay_in_steps(spark, tmp_path):
    import random

    from textindex_spark.streaming.replay import run_available, run_in_order

    rng = random.Random(2)
    rows = [(i, rng.choice("IDQ"), rng.randrange(-30, 30)) for i in range(300)]
    rng.shuffle(rows)
    ops = spark.createDataFrame(rows, "op_seq long, opcode string, key long").repartition(3)
    ops.write.parquet(str(tmp_path / "in"))
    whole = run_available(spark.readStream.schema(ops.schema).parquet(str(tmp_path / "in")), str(tmp_path / "whole"), 5, -64, 31)
    steps = run_in_order(ops, str(tmp_path / "steps"), 5, -64, 31, at_once=80)
    assert len(list((tmp_path / "steps" / "state" / "commits").glob("[0-9]*"))) >= 4
    assert sorted(map(tuple, steps.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
