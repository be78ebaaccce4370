"""Suffix arrays, LCP arrays and q-gram tables of documents.

Suffix arrays are built in one pass over the documents, a document at a time, by prefix doubling on numpy arrays
(n log n sorting steps): suffixes themselves are never written out. The ranks of all log n widths are kept for common
prefixes, so a text of n bytes costs 8 n log n bytes at most. q-grams are counted in numpy and the counts added by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .batches import agreement, parts, suffix_order


def doubled_ranks(text: bytes) -> list[np.ndarray]:
    """ranks[k][i]: order of the substring of length 2**k at i among all such; a shorter rest sorts first."""
    n = len(text)
    rank = np.unique(np.frombuffer(text, dtype=np.uint8), return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while n and rank.max() < n - 1 and width < n:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - width] = rank[width:]
        rank = np.unique(rank * (n + 1) + second + 1, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        width *= 2
    return levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at each pair of places; -1 stands for no suffix."""
    n = len(levels[0])
    a, b = a.copy(), b.copy()
    ok = (a >= 0) & (b >= 0)
    a[~ok], b[~ok] = n, n
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # equal ranks of length 2**k mean equal substrings only where both are that long
        inside = np.flatnonzero((a + (1 << k) <= n) & (b + (1 << k) <= n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        out[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return out


def suffix_array(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, common prefix with the suffix before; 0 for the first)."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels = doubled_ranks(text)
    order = np.argsort(levels[-1], kind="stable")
    lcp = np.zeros(len(text), dtype=np.int64)
    lcp[1:] = common_prefix(levels, order[:-1], order[1:])
    return order, lcp


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            order, lcp = suffix_array((text or "").encode())
            if len(order):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), doc_id, dtype=np.int64)), pa.array(np.arange(len(order), dtype=np.int64)), pa.array(order), pa.array(lcp)], ["doc_id", "rank", "pos", "lcp"])


def suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, rank, pos, lcp) of the UTF-8 bytes of each document; positions and ranks count from 0.

    The inverse suffix array is the same table read by pos.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_suffixes, "doc_id long, rank long, pos long, lcp long")


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, t in parts(batch.column("content")):
            order, n = suffix_order(t), np.diff(t.bounds)
            before = np.full(t.n, -1, np.int64)
            before[order[1:]] = np.where(t.doc[order[1:]] == t.doc[order[:-1]], order[:-1], -1)
            lcp = agreement(t, before)
            columns = [n, np.add.reduceat(lcp, t.bounds[:-1]), np.maximum.reduceat(lcp, t.bounds[:-1]), order[t.bounds[1:] - 1] - t.bounds[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *map(pa.array, columns)], ["doc_id", "n", "sum_lcp", "max_lcp", "last_pos"])


def suffix_summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sum_lcp, max_lcp, last_pos): of each document's suffix array its length, the sum and maximum of common
    prefixes and its last entry; many texts are sorted at once and no suffix becomes a row. Empty texts have none."""
    rows = docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8").alias("content"))
    return rows.where("doc_id is not null and length(content) > 0").mapInArrow(_summary, "doc_id long, n long, sum_lcp long, max_lcp long, last_pos long")


def previous_matches(text: bytes) -> tuple[np.ndarray, ...]:
    """For each place: its rank in suffix order, the nearest earlier places before and after it in that order (-1 for
    none), and the lengths of the matches there, the longer of which is the longest that begins earlier."""
    n = len(text)
    if n == 0:
        return (np.zeros(0, np.int64),) * 5
    levels = doubled_ranks(text)
    order = np.argsort(levels[-1], kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    before, after = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    waiting: list[int] = []
    for p in order.tolist():
        while waiting and waiting[-1] > p:
            after[waiting.pop()] = p
        if waiting:
            before[p] = waiting[-1]
        waiting.append(p)
    places = np.arange(n)
    return rank, before, after, common_prefix(levels, places, before), common_prefix(levels, places, after)


def _previous(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            rank, before, after, *lengths = previous_matches((text or "").encode())
            if n := len(rank):
                near = [pa.array(x, mask=x < 0) for x in (before, after)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, doc_id, dtype=np.int64)), pa.array(np.arange(n)), pa.array(rank), *near, pa.array(np.maximum(*lengths))], ["doc_id", "pos", "rank", "psv", "nsv", "lpf"])


def previous_table(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, rank, psv, nsv, lpf) of the UTF-8 bytes of each document: inverse suffix array, nearest earlier
    places on both sides in suffix order (NULL for none), and the longest previous factor."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_previous, "doc_id long, pos long, rank long, psv long, nsv long, lpf long")


def gram_rows(docs: DataFrame, q: int, by: list[str]) -> DataFrame:
    """(by, pos, gram): every q-gram of code points; positions from 1.

    A text is cut into its characters once, so a gram costs q steps wherever it stands.
    """
    chars = docs.select(*by, F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), ""), lambda c: c != "").alias("_c"))
    places = F.when(F.size("_c") >= q, F.sequence(F.lit(1), F.size("_c") - (q - 1))).otherwise(F.array().cast("array<int>"))
    grams = F.transform(places, lambda i: F.struct(i.alias("pos"), F.concat(*[F.element_at("_c", i + k) for k in range(q)]).alias("gram")))
    return chars.select(*by, F.explode(grams).alias("g")).select(*by, "g.pos", "g.gram")


#: Code points that are counted at once, or one longer text.
COUNTED = 1 << 20


def _counted(texts: list[str], q: int) -> list[tuple[np.ndarray, ...]]:
    """(gram, n, first_pos, last_pos) columns of the q-grams of some texts, each gram once."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    places = np.arange(len(points)) - np.repeat(ends - lengths, lengths) + 1
    at = np.flatnonzero(places + q - 1 <= np.repeat(lengths, lengths))
    if not len(at):
        return []
    # numbers of grams of k code points, then of k + 1, as far as they fit into 63 bits
    seen = np.zeros(1 << 21, bool)
    seen[points] = True
    number, size = (np.cumsum(seen) - 1)[points], int(seen.sum())
    key, bound = number[at], size
    for k in range(1, q):
        if bound * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            bound = int(key.max()) + 1
        key, bound = key * size + number[at + k], bound * size
    order = np.argsort(key)
    key, at = key[order], at[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    letters = points[at[starts][:, None] + np.arange(q)].astype("<u4").tobytes().decode("utf-32-le")
    grams = [letters[i : i + q] for i in range(0, len(letters), q)]
    return grams, np.diff(np.append(starts, len(key))), np.minimum.reduceat(places[at], starts), np.maximum.reduceat(places[at], starts)


def _gram_counts(q: int, by: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            keys = [batch.column(c).to_pylist() for c in by]
            for i, key in enumerate(zip(*keys) if by else [()] * batch.num_rows):
                groups.setdefault(key, []).append(i)
            content = batch.column("_content")
            for rows in groups.values():
                texts, size = [], 0
                for n, i in enumerate(rows, 1):
                    texts.append((content[i].as_py() or b"").decode("utf-8", "replace"))
                    size += len(texts[-1])
                    if (size >= COUNTED or n == len(rows)) and (found := _counted(texts, q)):
                        same = pa.array(np.full(len(found[0]), i))
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in by), pa.array(found[0], pa.string()), *map(pa.array, found[1:])], [*by, "gram", "n", "first_pos", "last_pos"])
                    if size >= COUNTED:
                        texts, size = [], 0

    return run


def qgrams(docs: DataFrame, q: int, by: list[str] = ()) -> DataFrame:
    """(by, gram, n, first_pos, last_pos): q-grams of code points with how often and where they occur; positions from 1.

    Grams are counted for a million code points of a group at once, and only the counts are shuffled.
    """
    by = list(by)
    rows = docs.select(*by, F.encode(F.col("text").cast("string"), "UTF-8").alias("_content"))
    schema = StructType([*rows.select(*by).schema.fields, StructField("gram", StringType()), *(StructField(c, LongType()) for c in ("n", "first_pos", "last_pos"))])
    return rows.mapInArrow(_gram_counts(q, by), schema).groupBy(*by, "gram").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"))
