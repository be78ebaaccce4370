"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A text is reduced to the numbers of STATISTICS. Standardised, they pass through FEATURES random cosines, whose inner
products approximate a Gaussian kernel. Each partition of the labelled sample (PER_CLASS documents of each class at
most) sums its part of the normal equations, one set for each of two folds; the sums are added up by Spark and solved
once. Scores of either fold under the other's weights are made monotone in the label rate by pooling adjacent
violators, and that step function, with straight lines between its steps, is the calibration.

Only the text enters a score. Model: FEATURES squared numbers at most, whatever the input.

Defined results: null and empty texts have zero statistics and a score like any other; repeated rows score alike; with
no labels, or one class, the score is that class's share (0.5 without labels); an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, materialize, read_table

PER_CLASS = 4000
FEATURES = 200
SEED = 147
WIDTH = 2.0
RIDGE = 1.0
THRESHOLD = 0.5
STATISTICS = ("log_words", "word_length", "symbols", "pipes", "marks", "capitals", "digits", "unique_words", "repeats", "repeated_lines", "log_line_words", "longest_word")

_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&<>"
_MARKS = b"!?\"()[]{}=+@^~\\/_"


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, each a ratio or logarithm, so that length alone does not carry them away."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, raw = len(words), text.encode("utf-8", "replace")
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    capitals, small = without(_CAPITALS), without(_SMALL)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    lengths = [*map(len, words)]
    return [
        math.log1p(n), min(sum(lengths) / n, 30.0), math.sqrt(min(without(_SYMBOLS) / n, 9.0)), math.sqrt(min(without(b"|") / n, 9.0)), math.sqrt(min(without(_MARKS) / n, 9.0)),
        capitals / max(1, capitals + small), math.sqrt(min(without(_DIGITS) / n, 9.0)), len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), math.log1p(max(lengths)),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def projection(features: int = FEATURES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Fixed random directions and phases."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((len(STATISTICS), features)) / WIDTH, rng.uniform(0, 2 * math.pi, features)


def cosines(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of rows of statistics, with a constant in front."""
    directions, phases = projection()
    z = np.cos(np.clip((x - mean) / scale, -4, 4) @ directions + phases) * math.sqrt(2 / FEATURES)
    return np.column_stack([np.ones(len(z)), z])


def _normal_parts(mean: np.ndarray, scale: np.ndarray):
    """This partition's part of both folds' normal equations, as (fold, place, value) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + 1
        sums = np.zeros((2, size, size + 1))
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
            y, fold = np.array(batch.column(1).to_pylist(), dtype=float), np.array(batch.column(3).to_pylist())
            z = cosines(x, mean, scale)
            for f in (0, 1):
                own = z[fold == f]
                sums[f, :, :size] += own.T @ own
                sums[f, :, size] += own.T @ y[fold == f]
        keep = np.flatnonzero(sums.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(sums.reshape(-1)[keep], pa.float64())], ["place", "value"])

    return run


def pool_violators(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of the increasing function of x nearest to y in squares; equal x form one point."""
    xs, first, counts = np.unique(x, return_index=False, return_inverse=True, return_counts=True)
    sums = np.bincount(first, weights=y)
    blocks: list[list[float]] = []  # [sum, count, lowest x, highest x]
    for v, s, n in zip(xs, sums, counts):
        blocks.append([s, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2], high]
    knots, values = [], []
    for s, n, low, high in blocks:
        for v in dict.fromkeys((low, high)):
            knots.append(float(v))
            values.append(float(s / n))
    return knots, values


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> dict:
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, per_class).select(F.col("doc_id").cast("long"), "text", "label")
    ddl = "doc_id long, label int, x array<double>"
    known = materialize(sample.mapInArrow(_measured, ddl), "quality-sample").withColumn("fold", (F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))) % 2).cast("int"))
    x = [F.col("x")[i] for i in range(len(STATISTICS))]
    first = known.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    if not first["n"] or first["share"] in (0, 1):
        share = 0.5 if not first["n"] else float(first["share"])
        return {"mean": [0.0] * len(x), "scale": [1.0] * len(x), "weights": [0.0] * (FEATURES + 1), "knots": [0.0], "values": [share]}
    mean = np.array([first[f"m{i}"] for i in range(len(x))])
    scale = np.maximum([first[f"s{i}"] for i in range(len(x))], 1e-3)
    size = FEATURES + 1
    parts = known.mapInArrow(_normal_parts(mean, scale), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    sums = np.zeros(2 * size * (size + 1))
    sums[parts["place"].to_numpy()] = parts["value"].to_numpy()
    sums = sums.reshape(2, size, size + 1)
    solve = lambda m: np.linalg.solve(m[:, :size] + RIDGE * np.diag([1e-6] + [1.0] * FEATURES), m[:, size])
    weights, crossed = solve(sums[0] + sums[1]), (solve(sums[1]), solve(sums[0]))
    rows = known.select("x", "label", "fold").toPandas()  # at most 2 * per_class rows
    z = cosines(np.array(rows["x"].tolist()), mean, scale)
    raw = np.where(rows["fold"].to_numpy() == 0, z @ crossed[0], z @ crossed[1])
    knots, values = pool_violators(np.round(raw, 6), rows["label"].to_numpy(dtype=float))
    return {"mean": mean.tolist(), "scale": scale.tolist(), "weights": weights.tolist(), "knots": knots, "values": values}


def predict(texts: list[str | None], m: dict) -> tuple[np.ndarray, np.ndarray]:
    """(calibrated, raw) scores of texts."""
    x = np.array([statistics(t) for t in texts], dtype=float).reshape(-1, len(STATISTICS))
    raw = np.round(cosines(x, np.array(m["mean"]), np.array(m["scale"])) @ np.array(m["weights"]), 6)
    return np.round(np.clip(np.interp(raw, m["knots"], m["values"]), 0, 1), 6), raw


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, raw = predict(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(raw)], ["doc_id", "score", "raw"])

    return run


def _kept(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = predict(batch.column(batch.schema.get_field_index("text")).to_pylist(), shared.value)
            yield batch.filter(pa.array(score >= threshold))

    return run


def keep(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_kept(shared, threshold), docs.schema)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, calibrated score and raw ridge score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scored(shared), "doc_id long, score double, raw double")


def op8_quality(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "raw")
