"""Replay of operation streams: dynamic predecessor queries over a stream, with the live keys as state.

State is one sorted list of live keys for each bucket (key >> shift) of the universe, so buckets are replayed by different
tasks. A query goes to every bucket of the universe from `lowest` to `highest`, negative keys included; each answers for
its own keys, and `answers` joins what they say. The number of buckets is therefore bounded (MOST_BUCKETS).

Operations inside a trigger are put in order of op_seq before they are applied; triggers must come in order. State is
kept by Spark's state store, so a query resumes from its checkpoint after a failure.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BUCKETS = 4096
OUT = "bucket long, op_seq long, key long, pred long, succ long, size long"


#: Answers in one frame that a bucket hands out.
ANSWERS = 50_000


def _apply(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    live: list[int] = list(state.get[0]) if state.exists else []
    # plain numbers, 17 bytes an operation
    codes = {"I": 1, "D": 2, "Q": 3}
    columns = [(x["op_seq"].to_numpy(np.int64), x["opcode"].map(codes).fillna(0).to_numpy(np.int8), x["key"].to_numpy(np.int64)) for x in batches]
    seqs, ops, keys = map(np.concatenate, zip(*columns))
    del columns
    order = np.argsort(seqs, kind="stable")
    out = []
    for at in order:
        code, k = ops[at], int(keys[at])
        spot = bisect_left(live, k)
        there = spot < len(live) and live[spot] == k
        if code == 1 and not there:
            live.insert(spot, k)
        elif code == 2 and there:
            live.pop(spot)
        elif code == 3:
            i = bisect_right(live, k)
            out.append((key[0], int(seqs[at]), k, live[i - 1] if i else None, live[spot] if spot < len(live) else None, len(live)))
            if len(out) == ANSWERS:
                yield _frame(out)
                out = []
    state.update((live,))
    if out:
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["bucket", "op_seq", "key", "pred", "succ", "size"]
    return pd.DataFrame(rows, columns=names).astype(dict.fromkeys(names, "Int64"))


def replay(ops: DataFrame, shift: int = 62, lowest: int = -(1 << 63), highest: int = (1 << 63) - 1) -> DataFrame:
    """Answers to the queries of an operation stream: a row for each query and bucket of 2**shift keys.

    Keys lie between lowest and highest. Without these the universe is that of all BIGINT keys, in four buckets.
    """
    first, last = lowest >> shift, highest >> shift
    if last - first >= MOST_BUCKETS:
        raise ValueError(f"{last - first + 1} buckets are too many; use a larger shift")
    own = F.call_function("shiftright", F.col("key"), F.lit(shift))
    spread = F.explode(F.when(F.col("opcode") == "Q", F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))).otherwise(F.array(own)))
    rows = ops.select("op_seq", "opcode", "key", spread.alias("bucket"))
    return rows.groupBy("bucket").applyInPandasWithState(_apply, OUT, "live array<long>", "append", "NoTimeout")


def answers(replayed: DataFrame) -> DataFrame:
    """(op_seq, key, pred, succ, size): the buckets' answers to each query, joined."""
    return replayed.groupBy("op_seq", "key").agg(F.max("pred").alias("pred"), F.min("succ").alias("succ"), F.sum("size").alias("size"))


def run_available(ops: DataFrame, folder: str, shift: int = 62, lowest: int = -(1 << 63), highest: int = (1 << 63) - 1) -> DataFrame:
    """Replay all that a streaming source has now; the answers are a table in the folder, beside the query's state."""
    query = replay(ops, shift, lowest, highest).writeStream.format("parquet").option("path", f"{folder}/answers").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return answers(ops.sparkSession.read.schema(OUT).parquet(f"{folder}/answers"))


#: Operations that are replayed in one trigger; a bucket's task holds its share of them and all their queries.
AT_ONCE = 1_000_000


def run_in_order(ops: DataFrame, folder: str, shift: int = 62, lowest: int = -(1 << 63), highest: int = (1 << 63) - 1, at_once: int = AT_ONCE) -> DataFrame:
    """Replay a table of operations as a stream that grows: each step adds the next operations in order of op_seq, some
    `at_once` of them, and goes on from the state of the step before, so memory does not follow the table's size."""
    spark = ops.sparkSession
    n, low, high = ops.agg(F.count(F.lit(1)), F.min("op_seq"), F.max("op_seq")).first()
    steps = max(1, -(-n // at_once))
    cuts = sorted({int(x) for x in ops.approxQuantile("op_seq", [k / steps for k in range(1, steps)], 0.1 / steps)}) if steps > 1 else []
    bounds = [*(c for c in cuts if low < c <= high), None]
    begin = None
    for end in bounds:
        part = ops if begin is None else ops.where(F.col("op_seq") >= begin)
        part = part if end is None else part.where(F.col("op_seq") < end)
        part.write.mode("append").parquet(f"{folder}/operations")
        found = run_available(spark.readStream.schema(ops.schema).parquet(f"{folder}/operations"), folder, shift, lowest, highest)
        begin = end
    return found
