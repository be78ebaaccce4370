"""Sketches, frequent items and minima."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import CM_MULTIPLIERS, CM_PRIME, M32, count_min_hash


def count_min(items: DataFrame, key: str, times: Column, width: int, height: int) -> DataFrame:
    """(row, col, n): the cells of a count-min sketch; sketches of the same shape merge by adding cells."""
    spots = F.array(*[F.struct(F.lit(j).alias("row"), count_min_hash(F.col(key), j, width).alias("col")) for j in range(height)])
    # equal keys are added up before they are spread over the rows
    summed = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(times).alias("t"))
    return summed.select("t", F.explode(spots).alias("s")).groupBy(F.col("s.row").alias("row"), F.col("s.col").alias("col")).agg(F.sum("t").alias("n"))


def estimates(sketch: DataFrame, keys: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """keys with `estimate`, never under the true count. The sketch (width * height rows) is broadcast by its fixed size."""
    spots = F.array(*[F.struct(F.lit(j).alias("row"), count_min_hash(F.col(key), j, width).alias("col")) for j in range(height)])
    asked = keys.select(F.col(key)).distinct().select(key, F.explode(spots).alias("s")).select(key, "s.row", "s.col")
    return asked.join(F.broadcast(sketch), ["row", "col"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def heavy_hitters(items: DataFrame, key: str, k: int, by: list[str] = ()) -> DataFrame:
    """The k most frequent keys, exactly, with counts; ties go to the smaller key."""
    counts = items.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), key).limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc("n"), key)
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def minimum_items(items: DataFrame, item: str, by: list[str] = ()) -> DataFrame:
    """The least frequent item and its count: what a minimum structure over counts holds after all increments."""
    counts = items.groupBy(*by, item).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min(F.struct("n", item)).alias("m")).select(*by, f"m.{item}", "m.n")


class Minimum:
    """Items in buckets of equal count: insert, raise by one, and take an item of least count, each in constant time."""

    def __init__(self):
        self.count: dict = {}
        self.buckets: dict[int, dict] = {}
        self.least = 0

    def insert(self, item, count: int = 1) -> None:
        self.count[item] = count
        self.buckets.setdefault(count, {})[item] = None
        self.least = min(self.least, count) if len(self.count) > 1 else count

    def _leave(self, item) -> int:
        n = self.count[item]
        del self.buckets[n][item]
        if not self.buckets[n]:
            del self.buckets[n]
        return n

    def increase(self, item) -> None:
        n = self._leave(item)
        self.count[item] = n + 1
        self.buckets.setdefault(n + 1, {})[item] = None
        if n == self.least and n not in self.buckets:
            self.least = n + 1

    def minimum(self):
        return next(iter(self.buckets[self.least])), self.least

    def extract_min(self):
        item, n = self.minimum()
        self._leave(item)
        del self.count[item]
        if n not in self.buckets and self.buckets:
            self.least = min(self.buckets)
        return item, n


def _column(key: int, row: int, width: int) -> int:
    m = CM_MULTIPLIERS[row]
    return ((((key & M32) * m & M32) ^ ((key >> 32) * m & M32)) % CM_PRIME) & (width - 1)


class AugmentedSketch:
    """A filter of frequent keys with exact counts since they entered, before a count-min sketch.

    A key outside the filter is counted in the sketch; once its estimate passes the filter's least count they swap, and
    the key that leaves is added to the sketch with what it gained inside.
    """

    def __init__(self, size: int, width: int, height: int):
        self.size, self.width, self.height = size, 1 << (width - 1).bit_length(), height
        self.cells = [[0] * self.width for _ in range(height)]
        self.filter, self.entered, self.value = Minimum(), {}, {}

    def _add(self, key: int, times: int) -> int:
        spots = [_column(key, j, self.width) for j in range(self.height)]
        for row, c in zip(self.cells, spots):
            row[c] += times
        return min(row[c] for row, c in zip(self.cells, spots))

    def count(self, key: int, value=None) -> None:
        f = self.filter
        if key in f.count:
            f.increase(key)
        elif len(f.count) < self.size:
            f.insert(key)
            self.entered[key] = 0
        else:
            estimate = self._add(key, 1)
            if estimate <= f.least:
                return
            gone, n = f.extract_min()
            self._add(gone, n - self.entered.pop(gone))
            self.value.pop(gone, None)
            f.insert(key, estimate)
            self.entered[key] = estimate
        self.value[key] = value

    def frequent(self) -> list[tuple]:
        return sorted(((k, n, self.value[k]) for k, n in self.filter.count.items()), key=lambda x: (-x[1], x[0]))


def augmented_sketch(items: DataFrame, by: str, order: str, key: str, size: int, width: int, height: int) -> DataFrame:
    """(by, key, n, last): frequent keys of each group's stream with estimated counts and the place of their last occurrence.

    Order decides the result, so a group is streamed in order through one sketch; memory is the sketch's, not the group's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sketch = None, None

        def done() -> pd.DataFrame:
            return pd.DataFrame([(current, *x) for x in sketch.frequent()], columns=["by", "key", "n", "last"])

        for pdf in batches:
            for b, o, k in zip(pdf["by"], pdf["o"], pdf["k"]):
                if sketch is None or b != current:
                    if sketch is not None:
                        yield done()
                    current, sketch = b, AugmentedSketch(size, width, height)
                sketch.count(int(k), int(o))
        if sketch is not None:
            yield done()

    rows = items.where(F.col(key).isNotNull()).select(F.col(by).cast("string").alias("by"), F.col(order).cast("bigint").alias("o"), F.col(key).cast("bigint").alias("k"))
    return rows.repartition("by").sortWithinPartitions("by", "o").mapInPandas(run, "by string, key long, n long, last long")
