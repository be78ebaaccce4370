"""Operators on factor streams: rows (doc_id, seq, pos, src, len, literal)."""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import delta_bits, rice_bits
from ..plans.durable import materialize
from .coding import to_bytes, write_factors
from .factorize import FACTORS


def is_ref():
    return F.col("len") > 0



def stats(factors: DataFrame, by: list[str] = ("doc_id",)) -> DataFrame:
    """Sizes, counts, and lengths and distances of references; minima, maxima and averages are NULL without references."""
    ref_len, dist = F.when(is_ref(), F.col("len")), F.when(is_ref(), F.col("pos") - F.col("src"))
    d = factors.groupBy(*by).agg(
        F.sum(F.greatest("len", F.lit(1))).alias("input_size"), F.count(ref_len).alias("num_refs"), F.count(F.when(~is_ref(), 1)).alias("num_literals"),
        F.min(ref_len).alias("min_ref_len"), F.max(ref_len).alias("max_ref_len"), F.coalesce(F.sum(ref_len), F.lit(0)).alias("total_ref_len"),
        F.min(dist).alias("min_ref_dist"), F.max(dist).alias("max_ref_dist"), F.coalesce(F.sum(dist), F.lit(0)).alias("total_ref_dist"),
    )
    half_up = lambda c: F.when(F.col("num_refs") > 0, F.floor(F.col(c) / F.col("num_refs") + 0.5)).cast("bigint")
    return d.withColumn("avg_ref_len", half_up("total_ref_len")).withColumn("avg_ref_dist", half_up("total_ref_dist"))


def positions(factors: DataFrame) -> DataFrame:
    """Factor rows with pos worked out from the lengths before them."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return factors.withColumn("pos", F.coalesce(F.sum(F.greatest("len", F.lit(1))).over(w), F.lit(0)))


def readable(factors: DataFrame) -> DataFrame:
    """(doc_id, factors): references as (src,len), literals as their character."""
    one = F.when(is_ref(), F.concat(F.lit("("), F.col("src").cast("string"), F.lit(","), F.col("len").cast("string"), F.lit(")"))).otherwise(F.decode(F.unhex(F.lpad(F.hex(F.col("literal")), 2, "0")), "ISO-8859-1"))
    return factors.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("t")))), lambda x: x["t"]), "").alias("factors"))


def _by_document(factors: DataFrame, columns: list[str]) -> DataFrame:
    return factors.select(*columns).repartition("doc_id").sortWithinPartitions("doc_id", "seq")


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(doc_id, rows) of a partition that is sorted by document; one document is held at a time."""
    current, part = None, []
    for pdf in batches:
        for doc_id, rows in pdf.groupby("doc_id", sort=False):
            if part and doc_id != current:
                yield current, pd.concat(part)
                part = []
            current = doc_id
            part.append(rows)
    if part:
        yield current, pd.concat(part)


def expand(src: list, length: list, lit: list) -> bytes:
    """The text of a list of factors."""
    out = bytearray()
    for s, n, c in zip(src, length, lit):
        if n == 0:
            out.append(int(c))
            continue
        s, n = int(s), int(n)
        while n:  # what an overlapping reference copies doubles each time
            piece = out[s : s + n]
            out += piece
            n -= len(piece)
    return bytes(out)


def decode(factors: DataFrame) -> DataFrame:
    """(doc_id, content): the texts that factors stand for."""

    def run(batches):
        for doc_id, rows in _documents(batches):
            yield pd.DataFrame({"doc_id": [doc_id], "content": [expand(rows["src"], rows["len"], rows["literal"])]})

    return _by_document(factors, ["doc_id", "seq", "src", "len", "literal"]).mapInPandas(run, "doc_id long, content binary")


def merge_lists(*streams: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """At each place the factor greatest by (length, source, is a reference); all streams skip what it covers.

    Streams are (source, length) lists of the same text; references that are partly skipped go on at src + k.
    """
    at, rest = [0] * len(streams), [list(s[0]) if s else None for s in streams]
    out = []
    while all(r is not None for r in rest):
        best = max(rest, key=lambda f: (f[1], f[0], f[1] > 0))
        out.append(tuple(best))
        step = max(best[1], 1)
        for k, s in enumerate(streams):
            left = step
            while left and rest[k] is not None:
                size = max(rest[k][1], 1)
                if size > left:
                    rest[k] = [rest[k][0] + left, rest[k][1] - left]
                    left = 0
                else:
                    left -= size
                    at[k] += 1
                    rest[k] = list(s[at[k]]) if at[k] < len(s) else None
    return out


def merge(*streams: DataFrame) -> DataFrame:
    """Two or more factor streams of the same documents merged into one."""
    tagged = streams[0].withColumn("stream", F.lit(0))
    for k, s in enumerate(streams[1:], 1):
        tagged = tagged.unionByName(s.withColumn("stream", F.lit(k)))
    n = len(streams)

    def run(batches):
        for doc_id, rows in _documents(batches):
            parts = [rows[rows["stream"] == k].sort_values("seq") for k in range(n)]
            lists = [[(int(c), 0) if ln == 0 else (int(s), int(ln)) for s, ln, c in zip(p["src"], p["len"], p["literal"])] for p in parts]
            # one byte left of a reference is a reference of length 1
            merged = merge_lists(*lists)
            size = pd.Series([max(f[1], 1) for f in merged], dtype="int64")
            lit = [f[1] == 0 for f in merged]
            yield pd.DataFrame({
                "doc_id": doc_id, "seq": range(len(merged)), "pos": size.cumsum() - size, "src": pd.array([None if x else f[0] for f, x in zip(merged, lit)], dtype="Int64"),
                "len": [f[1] for f in merged], "literal": pd.array([f[0] if x else None for f, x in zip(merged, lit)], dtype="Int16"),
            })

    rows = tagged.select("doc_id", "seq", "stream", "src", "len", "literal").repartition("doc_id").sortWithinPartitions("doc_id", "stream", "seq")
    return rows.mapInPandas(run, FACTORS)


def join_runs(factors: DataFrame) -> DataFrame:
    """References that go on where the one before ends become one: runs of equal distance, found by windows."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    same = is_ref() & (F.lag("len").over(w) > 0) & (F.lag("src").over(w) + F.lag("len").over(w) == F.col("src"))
    runs = factors.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = runs.groupBy("doc_id", "run").agg(F.min("pos").alias("pos"), F.min("src").alias("src"), F.sum("len").alias("len"), F.min("literal").alias("literal"))
    return d.select("doc_id", (F.col("run") - 1).alias("seq"), "pos", "src", "len", "literal")


def encoded_bits(factors: DataFrame) -> DataFrame:
    """(doc_id, flag_bits, dist_bits, len_bits): a flag a factor, distances in delta code, lengths in Rice code with 4 low bits."""
    return factors.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("flag_bits"), F.coalesce(F.sum(F.when(is_ref(), delta_bits(F.col("pos") - F.col("src")))), F.lit(0)).alias("dist_bits"),
        F.coalesce(F.sum(F.when(is_ref(), rice_bits(F.col("len"), 4))), F.lit(0)).alias("len_bits"),
    )


def bzip2_bytes(factors: DataFrame) -> DataFrame:
    """(doc_id, bytes): size of the literals and of the (pos, src, len) triples after bzip2."""

    def run(batches):
        for doc_id, rows in _documents(batches):
            lits = bytes(int(c) for c in rows["literal"].dropna())
            triples = rows.loc[rows["len"] > 0, ["pos", "src", "len"]].to_numpy(dtype="<u8").tobytes()
            yield pd.DataFrame({"doc_id": [doc_id], "bytes": [len(bz2.compress(lits + triples))]})

    return _by_document(factors, ["doc_id", "seq", "pos", "src", "len", "literal"]).mapInPandas(run, "doc_id long, bytes long")


def containers(factors: DataFrame) -> DataFrame:
    """(doc_id, bits, n_bits): each document's factors in one bit container, which coding.read_factors reads."""

    def run(batches):
        for doc_id, rows in _documents(batches):
            code = write_factors([(int(c), 0) if n == 0 else (int(s), int(n)) for s, n, c in zip(rows["src"], rows["len"], rows["literal"])])
            yield pd.DataFrame({"doc_id": [doc_id], "bits": [to_bytes(code)], "n_bits": [len(code)]})

    return _by_document(factors, ["doc_id", "seq", "src", "len", "literal"]).mapInPandas(run, "doc_id long, bits binary, n_bits long")


def tee(factors: DataFrame, *sinks) -> list:
    """What several sinks make of one factor stream, which is computed once."""
    stored = materialize(factors)
    return [sink(stored) for sink in sinks]
