"""Predecessor, successor and rank of queries in sorted sets of keys, as one relational operator.

Keys and queries are dealt to buckets of the universe (key >> shift), so a large set is searched by many tasks. Inside a
bucket one window pass over keys and queries in order answers all queries; what lies in earlier or later buckets comes
from a running total over the buckets that exist, one row each. A set with a hot range only needs a smaller shift;
queries to one hot bucket are sorted and streamed, never held together.

Keys equal to a query are its predecessor and successor. Missing answers are NULL. Duplicate keys count once. Null keys
are dropped; a null query gets NULL answers.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Key tables of at most this many rows may go to every executor.
BROADCAST_KEYS = 1_000_000


def search(queries: DataFrame, keys: DataFrame, x: str, key: str, by: list[str] = (), shift: int = 20) -> DataFrame:
    """queries with `pred`, `pos` (0-based rank of pred among the set's keys) and `succ`. x and key are BIGINT columns."""
    # input rows travel as one column, so their names cannot clash with those used here
    sets = [f"b{i}" for i in range(len(by))]
    bucket = F.call_function("shiftright", F.col("v"), F.lit(shift)).alias("bucket")
    q = _rows(queries, x, by).select("*", bucket)
    k = _keys(keys, key, by).select("*", bucket)
    # one row for each bucket of a set that has keys or queries
    have = k.groupBy(*sets, "bucket").agg(F.max("v").alias("hi"), F.min("v").alias("lo"), F.count(F.lit(1)).alias("n"))
    ask = q.where("v is not null").select(*sets, "bucket").distinct()
    none = F.lit(None).cast("bigint")
    spots = ask.select("*", none.alias("hi"), none.alias("lo"), F.lit(0).cast("bigint").alias("n")).unionByName(have).groupBy(*sets, "bucket").agg(F.max("hi").alias("hi"), F.max("lo").alias("lo"), F.max("n").alias("n"))
    order = Window.partitionBy(*sets).orderBy("bucket")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    carry = spots.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(sets)], F.col("bucket").alias("at"), F.last("hi", True).over(before).alias("below"), F.first("lo", True).over(after).alias("above"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank"))
    both = q.select(F.lit(1).alias("asked"), "*").unionByName(k.select(F.lit(0).alias("asked"), "*"), allowMissingColumns=True)
    inside = Window.partitionBy(*sets, "bucket").orderBy("v", "asked").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*sets, "bucket").orderBy(F.col("v").desc(), "asked").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("asked") == 0, F.col("v"))
    answered = both.select("*", F.last(own, True).over(inside).alias("p"), F.count(own).over(inside).alias("m"), F.last(own, True).over(ahead).alias("s")).where("asked = 1")
    same = F.col("bucket") == F.col("at")
    for i, c in enumerate(sets):
        same = same & F.col(c).eqNullSafe(F.col(f"c{i}"))
    pos, known = F.col("rank") + F.col("m") - 1, F.col("v").isNotNull()
    return answered.join(carry, same, "left").select(
        "row.*", F.when(known, F.coalesce("p", "below")).alias("pred"), F.when(known & (pos >= 0), pos).alias("pos"), F.when(known, F.coalesce("s", "above")).alias("succ"),
    )


def _rows(queries: DataFrame, x: str, by) -> DataFrame:
    """(row, v, b0, b1, ...): the input row, its number and its set."""
    return queries.select(F.struct(*[F.col(f"`{c}`") for c in queries.columns]).alias("row"), F.col(x).cast("bigint").alias("v"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(by)])


def _keys(keys: DataFrame, key: str, by) -> DataFrame:
    """Distinct (v, b0, b1, ...) without null keys."""
    return keys.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("v"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(by)]).distinct()


def search_windowed(queries: DataFrame, keys: DataFrame, x: str, key: str, by: list[str]) -> DataFrame:
    """The same answers with one window for each set: for many sets of moderate size."""
    sets = [f"b{i}" for i in range(len(by))]
    both = _rows(queries, x, by).select(F.lit(1).alias("asked"), "*").unionByName(_keys(keys, key, by).select(F.lit(0).alias("asked"), "*"), allowMissingColumns=True)
    own = F.when(F.col("asked") == 0, F.col("v"))
    up = Window.partitionBy(*sets).orderBy("v", "asked").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*sets).orderBy(F.col("v").desc(), "asked").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(own).over(up) - 1
    out = both.select("*", F.last(own, True).over(up).alias("p"), F.when(n >= 0, n).alias("m"), F.last(own, True).over(down).alias("s")).where("asked = 1")
    known = F.col("v").isNotNull()
    return out.select("row.*", *[F.when(known, F.col(c)).alias(name) for c, name in (("p", "pred"), ("m", "pos"), ("s", "succ"))])


def search_broadcast(queries: DataFrame, keys: DataFrame, x: str, key: str) -> DataFrame:
    """The same answers by binary search in a sorted array that every worker holds; a set of more than BROADCAST_KEYS rows
    is searched by buckets."""
    if keys.count() > BROADCAST_KEYS:
        return search(queries, keys, x, key)
    held = np.sort(keys.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k")).distinct().toPandas()["k"].to_numpy(dtype=np.int64))
    shared = queries.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("pred long, pos long, succ long")
    def look(v: pd.Series) -> pd.DataFrame:
        k, known = shared.value, v.notna().to_numpy()
        a = v.fillna(0).to_numpy(dtype=np.int64)
        at, above = np.searchsorted(k, a, side="right") - 1, np.searchsorted(k, a, side="left")
        pick = lambda i, ok: pd.array(np.where(ok, k[np.clip(i, 0, max(len(k) - 1, 0))], 0) if len(k) else np.zeros(len(a), np.int64), dtype="Int64")
        has, more = known & (at >= 0), known & (above < len(k))
        pred, succ, pos = pick(at, has), pick(above, more), pd.array(at, dtype="Int64")
        pred[~has], pos[~has], succ[~more] = pd.NA, pd.NA, pd.NA
        return pd.DataFrame({"pred": pred, "pos": pos, "succ": succ})

    return _rows(queries, x, ()).select("row", look("v").alias("found")).select("row.*", "found.*")


def predecessor(queries, keys, x, key, by=(), **kw) -> DataFrame:
    return search(queries, keys, x, key, by, **kw).drop("pos", "succ")


def successor(queries, keys, x, key, by=(), **kw) -> DataFrame:
    return search(queries, keys, x, key, by, **kw).drop("pos", "pred")


def contains(queries: DataFrame, keys: DataFrame, x: str, key: str) -> DataFrame:
    """The queries whose value is a key."""
    k = keys.select(F.col(key).alias("k"))
    return queries.join(k, queries[x] == k["k"], "left_semi")
