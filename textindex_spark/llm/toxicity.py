"""Toxic passages as maximal scoring segments over token log-odds.

Fitting. Over a bounded labelled sample (PER_CLASS documents of each class, distinct texts), documents that hold a token
are counted by label. A token's share of toxic documents has a Dirichlet prior of weight PRIOR whose mean is the share of
the other documents of its longest known prefix, smoothed in the same way towards the share of the whole sample; so rare
forms lean on their stem. A token's score is the log-odds of its share less those of the sample, positive or negative, less DRIFT, which makes the
mean score negative. Tokens and prefixes of under LEAST_DOCS documents take the score of the longest prefix that has one.

Scan. All maximal scoring segments of a text are found in one linear pass over its scores. The k-th mention of a word with
a positive score counts 1/k within a segment, so its score is that of the best stretch that is left.

Calibration. The highest segment of a text of n tokens follows an extreme-value law: it stays under S with probability
exp(-K n exp(-lambda S)). lambda and K are fitted by maximum likelihood to the highest segments of the documents labelled
0, each scored by a model of the other half of the sample. A segment of score S in a text of n tokens then stands against
K n exp(-lambda S) equally good chance segments. Segments with less than REPORTED of these are the passages. A document's
evidence is the sum over its segments with less than MAX_EXPECTED, the strongest first, of lambda S - ln(K n), where
mentions in stronger ones count as well among the k, so repeats add ever less. A logistic curve, fitted to the halves in the same way, turns the evidence into a score between 0 and 1.

Only the text enters a score. Workers memorise the scores of words they have met, up to a bound.

Defined results: null and empty texts have no segments and get the score of no evidence; repeated rows score alike;
an id with several texts, or a text with both labels, is left out of the sample; ties between segments keep text order; an
empty table or a sample with one class or none gives a constant score next to 0; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, read_table

PER_CLASS = 3000
PREFIXES = (6, 5, 4)
#: A token or prefix has a score of its own from so many documents on.
LEAST_DOCS = 5
PRIOR = 10.0
DRIFT = 0.5
#: Segments that chance gives less often count as evidence, and those that it gives far less often are reported.
MAX_EXPECTED, REPORTED = 1.0, 0.01
THRESHOLD = 0.7
MEMORY = 300_000
WORD = re.compile(r"[^\W_]+")


def features(word: str) -> list[str]:
    """The word and its prefixes, the most specific first; prefixes end in a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a list of scores, in one linear pass.

    A candidate keeps the running totals before and after it. A new candidate looks back for the nearest one that
    begins lower; if that one also ends lower, everything from its beginning on becomes one candidate.
    """
    found: list[list] = []  # [start, end, total before, total after, index of the nearest earlier one that begins lower]
    total = 0.0
    for i, x in enumerate(scores):
        if x <= 0:
            total += x
            continue
        new = [i, i + 1, total, total + x, -1]
        total += x
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
            j -= 1
    return [(a, b, r - l) for a, b, l, r, _ in found]


def rise(values: np.ndarray) -> float:
    """The score of the highest segment, without damping; 0 where no score is positive."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return float((total - np.minimum.accumulate(total)).max())


def damped(words: list[str], values: list[float], said: Counter) -> list[float]:
    """The scores with the k-th mention of a word at 1/k of a positive score; `said` counts mentions, here as well."""
    out = []
    for w, v in zip(words, values):
        if v > 0:
            said[w] += 1
            v /= said[w]
        out.append(v)
    return out


class Model:
    """Scores of features, extreme-value parameters and the calibration curve."""

    def __init__(self, scores: dict[str, float], lam: float, k: float, slope: float, intercept: float):
        self.scores, self.lam, self.k, self.slope, self.intercept = scores, lam, k, slope, intercept

    def state(self) -> tuple:
        return self.scores, self.lam, self.k, self.slope, self.intercept

    def of_word(self, word: str) -> float:
        for f in features(word):
            if f in self.scores:
                return self.scores[f] - DRIFT
        return -DRIFT

    def values(self, words: list[str], memory: dict[str, float]) -> np.ndarray:
        if len(memory) > MEMORY:
            memory.clear()
        new = set(words).difference(memory)
        memory.update(zip(new, map(self.of_word, new)))
        return np.fromiter(map(memory.__getitem__, words), dtype=np.float64, count=len(words))

    def above(self, words: list[str], memory: dict[str, float], least: float) -> list[tuple[float, int, int]]:
        """(score, first word, end) of the maximal segments that score over `least`, with repeats damped."""
        values = self.values(words, memory)
        if rise(values) <= least:
            return []
        listed = values.tolist()
        out = []
        for a, b, s in segments(listed):
            if s > least and (best := max((x for _, _, x in segments(damped(words[a:b], listed[a:b], Counter()))), default=0.0)) > least:
                out.append((best, a, b))
        return out

    def scan(self, words: list[str], memory: dict[str, float]) -> tuple[list[tuple[int, int, float]], float]:
        """Passages (first word, end, evidence), and the evidence of the text."""
        if not words:
            return [], 0.0
        chance = math.log(self.k * len(words))
        least = max(0.0, (chance - math.log(MAX_EXPECTED)) / self.lam)
        found = self.above(words, memory, least)
        said: Counter = Counter()
        whole = 0.0
        # the strongest passage first, so a mention elsewhere does not weaken it
        for _, a, b in sorted(found, key=lambda x: (-x[0], x[1])):
            left = damped(words[a:b], [memory[w] for w in words[a:b]], said)
            whole += sum(self.lam * s - chance for _, _, s in segments(left) if s > least)
        return [(a, b, self.lam * s - chance) for s, a, b in found if self.lam * s - chance > -math.log(REPORTED)], whole

    def highest(self, words: list[str], memory: dict[str, float]) -> float:
        return max((s for s, _, _ in self.above(words, memory, 0.0)), default=0.0)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(max(0.0, evidence)) + self.intercept))))


def log_odds(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> dict[str, float]:
    """Log-odds of features, less those of the sample, from the toxic and the other documents that hold them."""
    sample = toxic / (toxic + other)
    known = {f: n for f, n in counts.items() if sum(n) >= LEAST_DOCS}
    out = {}
    for f, (a, b) in known.items():
        above = next((g for g in features(f.rstrip("*"))[1:] if g != f and g in known), None)
        # the prefix without this feature's own documents, so that none counts twice
        x, y = (max(0, n - m) for n, m in zip(known[above], (a, b))) if above else (0, 0)
        prior = (x + PRIOR * sample) / (x + y + PRIOR)
        share = (a + PRIOR * prior) / (a + b + PRIOR)
        out[f] = math.log(share / (1 - share)) - math.log(toxic / other)
    return out


def extreme_values(highest: list[tuple[int, float]]) -> tuple[float, float]:
    """(lambda, K) by maximum likelihood from (tokens, highest segment's score) of chance texts; 0 where none is positive.

    For a given lambda the best K has a closed form; lambda is found by golden sections of the likelihood.
    """
    n = np.array([x for x, _ in highest if x > 0], dtype=float)
    top = np.array([s for x, s in highest if x > 0], dtype=float)
    some = top > 0
    if some.sum() < 2:
        return 1.0, 1.0

    def best_k(lam: float) -> float:
        return float(some.sum() / np.where(some, n * np.exp(-lam * top), n).sum())

    def likelihood(lam: float) -> float:
        k = best_k(lam)
        return float((math.log(k * lam) - lam * top[some]).sum() - k * np.where(some, n * np.exp(-lam * top), n).sum())

    lo, hi, golden = math.log(1e-3), math.log(50.0), (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (a, hi) if likelihood(math.exp(a)) < likelihood(math.exp(b)) else (lo, b)
    lam = math.exp((lo + hi) / 2)
    return lam, best_k(lam)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve with a small ridge, by Newton's method."""
    w, design = np.zeros(2), np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag([0.05, 1e-3]), design.T @ (y - p) - np.array([0.05, 1e-3]) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, half, label, documents) of the documents of a partition; the empty feature counts all of them."""
    counts: dict[tuple[int, int], Counter] = {(h, y): Counter() for h in (0, 1) for y in (0, 1)}
    for batch in batches:
        for text, label, half in zip(*(c.to_pylist() for c in batch.columns)):
            counts[half, label].update({"", *chain.from_iterable(map(features, set(WORD.findall((text or "").lower()))))})
    for (half, label), c in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array([half] * len(c), pa.int32()), pa.array([label] * len(c), pa.int32()), pa.array(c.values(), pa.int64())], ["feature", "half", "label", "n"])


def _crossed(shared, found):
    """What `found` gives for each document of the sample by the model of the other half: (label, words, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, memories = [Model(*state) for state in shared.value], [{}, {}]
        for batch in batches:
            rows = []
            for text, label, half in zip(*(c.to_pylist() for c in batch.columns)):
                words = WORD.findall((text or "").lower())
                rows.append((label, len(words), found(models[1 - half], words, memories[1 - half])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.int64(), pa.float64()))], ["label", "words", "value"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    from .common import materialize

    spark = docs.sparkSession
    # one row for each text of the sample, without texts of both labels
    texts = labelled_sample(docs, labels, label, per_class).groupBy("text").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    sample = materialize(texts.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")), "toxic-sample")
    counted = sample.mapInArrow(_partial_counts, "feature string, half int, label int, n long").groupBy("feature").agg(
        *[F.coalesce(F.sum(F.when((F.col("half") == h) & (F.col("label") == y), F.col("n"))), F.lit(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)], F.sum("n").alias("docs")
    )
    # bounded by the sample: the features that LEAST_DOCS of its documents hold
    rows = counted.where((F.col("docs") >= LEAST_DOCS) | (F.col("feature") == "")).collect()
    whole = next((r for r in rows if r["feature"] == ""), None)
    if whole is None or min(whole["n01"], whole["n11"], whole["n00"], whole["n10"]) == 0:
        return Model({}, 1.0, 1.0, 0.0, -30.0)

    def scores(of) -> dict[str, float]:
        return log_odds({r["feature"]: of(r) for r in rows if r["feature"]}, *of(whole))

    halves = [scores(lambda r, h=h: (r[f"n{h}1"], r[f"n{h}0"])) for h in (0, 1)]
    model = Model(scores(lambda r: (r["n01"] + r["n11"], r["n00"] + r["n10"])), 1.0, 1.0, 0.0, 0.0)

    def crossed(found) -> DataFrame:
        shared = spark.sparkContext.broadcast([(x, model.lam, model.k, 0.0, 0.0) for x in halves])
        return sample.mapInArrow(_crossed(shared, found), "label int, words long, value double")

    model.lam, model.k = extreme_values([(r["words"], r["value"]) for r in crossed(Model.highest).where("label = 0").collect()])
    known = crossed(lambda m, words, memory: m.scan(words, memory)[1]).select("label", "value").toPandas()
    model.slope, model.intercept = _logistic(np.log1p(known["value"].to_numpy()), known["label"].to_numpy(dtype=float))
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = Model(*shared.value), {}
        for batch in batches:
            n, spans, evidence = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found, whole = model.scan(WORD.findall(text.lower()), memory)
                n.append(len(found))
                evidence.append(whole)
                # places in the text, where its lower-case form has as many characters
                at = [m.span() for m in WORD.finditer(text)] if found else []
                spans.append([{"start": at[a][0], "end": at[b - 1][1], "evidence": e} for a, b, e in found if b <= len(at)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([round(model.score(e), 6) for e in evidence], pa.float64()), pa.array(evidence, pa.float64()), pa.array(n, pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())])))],
                ["doc_id", "score", "evidence", "n_passages", "passages"],
            )

    return run


SCORED = "doc_id long, score double, evidence double, n_passages int, passages array<struct<start:long,end:long,evidence:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence and the significant passages (character spans) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scored(shared), SCORED)


def _kept(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = Model(*shared.value), {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            evidence = [model.scan(WORD.findall((t or "").lower()), memory)[1] for t in texts]
            yield batch.filter(pa.array([round(model.score(e), 6) < threshold for e in evidence], pa.bool_()))

    return run


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())
    return docs.mapInArrow(_kept(shared, threshold), docs.schema)


def op4_toxicity(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_passages", "passages")
