"""Dynamic ordered key sets: answers to queries in a stream of inserts and deletes, as a batch.

An operation has a sequence number, an opcode (I, D or Q) and a key. Each insert opens an interval of validity of its key
that the next delete of the key closes; inserts of a live key and deletes of a dead one change nothing. A query at
sequence s for x then asks for the largest key up to x (predecessor) or the smallest from x on (successor) whose interval
holds s.

Answers come from two levels. A bucket of the universe (key >> shift) is live while any of its keys is; these intervals
are merged, so there are far fewer of them than of keys. A query is first answered inside its own bucket by an equi-join;
if that fails, the nearest live bucket is found, by the same method one level up or from a broadcast table of bounded
size, and the answer lies in that bucket. Only that table of buckets is compared with queries by a range; no query is paired with all keys.

NULL stands for no answer. Structures behind the set (trees, bitmaps, lists) are not visible in the answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import materialize

#: Live intervals of buckets are broadcast up to this many rows of 24 bytes.
BROADCAST_SPANS = 200_000
#: Levels of the tree over time that are broadcast: 2**(TOP_LEVELS + 1) rows at most.
TOP_LEVELS = 15


def intervals(ops: DataFrame, seq: str = "op_seq", opcode: str = "opcode", key: str = "key") -> DataFrame:
    """(key, ins, del): when each key was live; del is NULL while it still is."""
    w = Window.partitionBy("key").orderBy("ins")
    changes = ops.where(F.col(opcode).isin("I", "D")).select(F.col(key).alias("key"), F.col(seq).alias("ins"), F.col(opcode).alias("code"))
    # only changes of state count
    state = changes.withColumn("was", F.lag("code").over(w)).where(F.coalesce(F.col("was") != F.col("code"), F.col("code") == "I"))
    return state.withColumn("del", F.lead("ins").over(w)).where("code = 'I'").select("key", "ins", "del")


def size_over_time(ops: DataFrame, seq: str = "op_seq") -> DataFrame:
    """(op_seq, size): the number of live keys after each change.

    The running sum is taken inside blocks of sequence numbers and over the blocks' totals, so no task sees all changes.
    """
    spans = intervals(ops, seq)
    change = spans.select(F.col("ins").alias("op_seq"), F.lit(1).alias("d")).unionAll(spans.where("del is not null").select(F.col("del").alias("op_seq"), F.lit(-1).alias("d")))
    change = change.withColumn("block", F.call_function("shiftright", F.col("op_seq"), F.lit(12)))
    inside = Window.partitionBy("block").orderBy("op_seq").rowsBetween(Window.unboundedPreceding, 0)
    totals = change.groupBy("block").agg(F.sum("d").alias("t"))
    base = totals.select("block", F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return change.withColumn("s", F.sum("d").over(inside)).join(base, "block").select("op_seq", (F.col("s") + F.col("base")).alias("size"))


def _bucketed(spans: DataFrame, shift: int) -> DataFrame:
    return spans.withColumn("bucket", F.call_function("shiftright", F.col("key"), F.lit(shift)))


def _union(spans: DataFrame, by: str, far: int) -> DataFrame:
    """Maximal intervals in which some key of each bucket is live."""
    w = Window.partitionBy(by).orderBy("ins").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce("del", F.lit(far))
    runs = spans.withColumn("end", end).withColumn("new", F.when(F.col("ins") <= F.max("end").over(w), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(Window.partitionBy(by).orderBy("ins").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "run").agg(F.min("ins").alias("ins"), F.max("end").alias("del")).drop("run")


def nearest(queries: DataFrame, spans: DataFrame, x: str, seq: str, shift: int = 8, below: bool = True) -> DataFrame:
    """queries with `answer`: the predecessor (or successor) of x among the keys live at seq.

    Two levels: first inside x's own bucket of 2**shift keys; queries without an answer there look for the nearest
    bucket that is live at seq, and then inside that bucket.
    """
    far = (1 << 62)
    q = queries.select(F.col(x).alias("x"), F.col(seq).alias("s")).distinct()
    b = _bucketed(spans, shift)
    ok = (F.col("key") <= F.col("x")) if below else (F.col("key") >= F.col("x"))
    pick = F.max if below else F.min
    live = (F.col("ins") < F.col("s")) & (F.coalesce("del", F.lit(far)) > F.col("s"))
    q = q.withColumn("bucket", F.call_function("shiftright", F.col("x"), F.lit(shift)))
    own = q.join(b, "bucket").where(ok & live).groupBy("x", "s").agg(pick("key").alias("own"))
    rest = q.join(own, ["x", "s"], "left_anti")
    whole = materialize(_union(b.select("bucket", "ins", "del"), "bucket", far))
    if whole.count() <= BROADCAST_SPANS:
        whole = whole.withColumnRenamed("bucket", "other")
        side = (F.col("other") < F.col("bucket")) if below else (F.col("other") > F.col("bucket"))
        found = rest.join(F.broadcast(whole), side & (F.col("ins") < F.col("s")) & (F.col("del") > F.col("s")))
        target = found.groupBy("x", "s").agg(pick("other").alias("bucket"))
    else:
        next_to = rest.withColumn("beside", F.col("bucket") + F.lit(-1 if below else 1))
        target = nearest(next_to, whole.withColumnRenamed("bucket", "key"), "beside", "s", shift, below).where("answer is not null").select("x", "s", F.col("answer").alias("bucket"))
    there = target.join(b, "bucket").where(live).groupBy("x", "s").agg(pick("key").alias("there"))
    answers = q.select("x", "s").join(own, ["x", "s"], "left").join(there, ["x", "s"], "left").select(F.col("x").alias("_x"), F.col("s").alias("_s"), F.coalesce("own", "there").alias("answer"))
    return queries.join(answers, F.col(x).eqNullSafe(F.col("_x")) & F.col(seq).eqNullSafe(F.col("_s")), "left").drop("_x", "_s")


def extremes_over_time(ops: DataFrame, seq: str = "op_seq") -> DataFrame:
    """(op_seq, size, min_key, max_key) after each change; NULL extremes when the set is empty.

    Time is a binary tree over sequence numbers. The interval of a key splits into two nodes a level at most; a node keeps
    the smallest and the largest key that is live in all of it, and a change asks the nodes above it, one a level. The
    upper levels have few nodes (2**TOP_LEVELS at the widest) and are broadcast; below, a node stands over a bounded
    stretch of time, so no key of the join is hot.
    """
    spans = intervals(ops, seq)
    least, most = spans.agg(F.min("ins"), F.max(F.greatest("ins", F.coalesce("del", "ins")))).first()
    least, most = least or 0, most or 0
    levels = (most - least + 1).bit_length()
    shift = lambda x, n: F.call_function("shiftright", x, n)
    start, end = F.col("ins") - least, F.coalesce(F.col("del") - least, F.lit(1 << levels).cast("bigint"))

    def at(level):
        low, high = shift(start + F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1, level), shift(end, level)
        some = low < high
        node = lambda n: F.struct(level.alias("level"), n.alias("node"))
        return F.array(F.when(some & (low % 2 == 1), node(low)), F.when(some & (high % 2 == 1), node(high - 1)))

    nodes = spans.select("key", F.explode(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)))).alias("n"))
    nodes = materialize(nodes.groupBy("n.level", "n.node").agg(F.min("key").alias("lo"), F.max("key").alias("hi")))
    split = max(0, levels - TOP_LEVELS)
    sizes = materialize(size_over_time(ops, seq))
    asked = sizes.select("op_seq", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    asked = asked.withColumn("node", shift(F.col("op_seq") - least, F.col("level")))
    upper = asked.where(F.col("level") > split).join(F.broadcast(nodes.where(F.col("level") > split)), ["level", "node"])
    lower = asked.where(F.col("level") <= split).join(nodes.where(F.col("level") <= split), ["level", "node"])
    found = upper.unionByName(lower).groupBy("op_seq").agg(F.min("lo").alias("min_key"), F.max("hi").alias("max_key"))
    return sizes.join(found, "op_seq", "left").select("op_seq", "size", "min_key", "max_key")


def contained(queries: DataFrame, spans: DataFrame, x: str, seq: str) -> DataFrame:
    """The queries whose key is live at their sequence number."""
    live = (F.col("ins") < F.col(seq)) & (F.coalesce("del", F.lit(1 << 62)) > F.col(seq))
    return queries.join(spans, (F.col(x) == F.col("key")) & live, "left_semi")


def emit(spans: DataFrame, shift: int = 8) -> DataFrame:
    """(pos, key): the keys that are live at the end, in order; positions count from 0.

    Keys are numbered inside buckets of 2**shift keys and over the buckets' totals, so no task sees all keys.
    """
    live = _bucketed(spans.where("del is null").select("key"), shift)
    totals = live.groupBy("bucket").agg(F.count(F.lit(1)).alias("t"))
    base = totals.select("bucket", F.coalesce(F.sum("t").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("key")) - 1
    return live.withColumn("own", own).join(base, "bucket").select((F.col("own") + F.col("base")).alias("pos"), "key")
