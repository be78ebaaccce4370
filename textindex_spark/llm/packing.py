"""Best-fit packing of documents into bins of a fixed length, under conflicts.

Two pieces may share a bin only if their sources differ and their duplicate clusters differ. A document longer than the
capacity is cut into full pieces, which fill bins of their own, and a rest, which is packed like a short document.

Documents are dealt to shards of about SHARD_ROWS rows by a hash of all that is known of them, and each shard is packed
by itself, so the number of shards follows the data and a task holds one shard's numbers and no text. A hot source or
group of copies is spread over all shards, in proportion. In a shard, longest piece first, bins are kept in an order of
residual room; a successor search begins at the smallest residual that holds the piece and goes on upwards until a bin
is found whose source bitmap and cluster bitmap lack the piece's bits: the tightest compatible bin. Runs of bins that
conflict for the same reason are skipped together: bins of one residual and one pair of bitmaps form one entry.

Defined results: a null or empty text has length 0 and is placed with length 0; null sources or clusters conflict with
nothing; a null id sorts first; repeated rows are packed each on its own; ties go to the smaller id, and to the oldest
bin; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard_join
from .common import materialize, read_table, words_of

CAPACITY = 2048
SHARD_ROWS = 4096
OUT = "doc_id long, piece int, shard int, bin int, at int, length int, residual int"


def pack_shard(lengths, sources, clusters, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin number and offset of every piece, and the room left in every bin. Pieces come in the order of placing.

    sources and clusters are whole numbers, negative for none; lengths are at most capacity.
    """
    # Bins that are alike (same residual, same bitmaps) form one entry of `order`; only the newest entries differ much.
    order: list[tuple[int, int, int]] = []  # sorted (residual, source bitmap, cluster bitmap)
    alike: dict[tuple[int, int, int], list[int]] = {}  # bins of an entry, oldest last
    room: list[int] = []
    bins, offsets = [], []
    for n, source, cluster in zip(lengths, sources, clusters):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        i, found = bisect_left(order, (n, 0, 0)), None
        while i < len(order):
            if not (order[i][1] & s or order[i][2] & c):
                found = order[i]
                # of entries with this residual, the one with the oldest bin
                j = i + 1
                while j < len(order) and order[j][0] == found[0]:
                    if not (order[j][1] & s or order[j][2] & c) and alike[order[j]][-1] < alike[found][-1]:
                        found = order[j]
                    j += 1
                break
            i += 1
        if found is None:
            b = len(room)
            room.append(capacity)
            state = (capacity, 0, 0)
        else:
            b = alike[found].pop()
            if not alike[found]:
                del alike[found]
                order.pop(bisect_left(order, found))
            state = found
        bins.append(b)
        offsets.append(capacity - state[0])
        state = (state[0] - n, state[1] | s, state[2] | c)
        room[b] = state[0]
        if state in alike:
            insort(alike[state], b, key=lambda x: -x)
        else:
            alike[state] = [b]
            insort(order, state)
    return bins, offsets, room


def _numbered(values: pd.Series, shared_only: bool) -> list[int]:
    """Small numbers for equal values, -1 for null and, with shared_only, for values that occur once."""
    codes, _ = pd.factorize(values)
    if shared_only:
        counts = pd.Series(codes).map(pd.Series(codes).value_counts())
        codes, _ = pd.factorize(pd.Series(codes).where((counts > 1) & (codes >= 0)))
    return codes.tolist()


def _pack(capacity: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part: list[pd.DataFrame] = []

        def done() -> Iterator[pd.DataFrame]:
            if part:
                yield _pack_rows(pd.concat(part, ignore_index=True), capacity)
                part.clear()

        # a partition holds whole shards, one after the other
        for pdf in batches:
            for shard, rows in pdf.groupby("shard", sort=False):
                if part and part[0]["shard"].iat[0] != shard:
                    yield from done()
                part.append(rows)
        yield from done()

    return pack


def _pack_rows(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    full, rest = rows["length"] // capacity, rows["length"] % capacity
    rows = rows.assign(full=full, rest=rest)
    short = rows[(rows["rest"] > 0) | (rows["full"] == 0)].sort_values(["rest", "doc_id", "cluster", "source"], ascending=[False, True, True, True], kind="stable", na_position="first")
    bins, offsets, room = pack_shard(short["rest"].tolist(), _numbered(short["source"], False), _numbered(short["cluster"], True), capacity)
    out = [pd.DataFrame({"doc_id": short["doc_id"], "piece": short["full"], "bin": bins, "at": offsets, "length": short["rest"], "residual": [room[b] for b in bins]})]
    long = rows[rows["full"] > 0].sort_values(["doc_id", "cluster", "source"], kind="stable", na_position="first")
    if len(long):
        each = long.loc[long.index.repeat(long["full"])]
        piece = each.groupby(level=0).cumcount()
        out.append(pd.DataFrame({"doc_id": each["doc_id"], "piece": piece, "bin": range(len(room), len(room) + len(each)), "at": 0, "length": capacity, "residual": 0}))
    both = pd.concat(out, ignore_index=True)
    both["shard"] = rows["shard"].iat[0]
    return both.astype({"doc_id": "Int64"})[["doc_id", "piece", "shard", "bin", "at", "length", "residual"]]


def pack(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Place (doc_id, length, source, cluster) rows; a row for each piece: its shard, bin, offset, length, the bin's rest."""
    items = items.select("doc_id", F.greatest(F.coalesce("length", F.lit(0)), F.lit(0)).cast("long").alias("length"), F.col("source").cast("string"), F.col("cluster").cast("string"))
    shards = max(1, -(-items.count() // shard_rows))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "cluster", "source"), F.lit(shards)).cast("int"))
    # a partition holds many shards, so partitions follow the session's setting and not the rows
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInPandas(_pack(capacity), OUT)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None) -> DataFrame:
    """Pack documents by their number of words. Without a cluster column, equal texts but for case and space are one."""
    words = words_of(F.lower(F.col("text")))
    same = cluster if cluster is not None else F.when(F.size("_w") > 0, F.md5(F.array_join("_w", " ")))
    return pack(docs.select("doc_id", "source", words.alias("_w"), *[]).select("doc_id", F.size("_w").alias("length"), "source", same.alias("cluster")), capacity)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, source, length, cluster) of every row: its number of words, and its class of the n-gram join.

    Texts are read once, by the join. Rows of one id that are similar to no other row share a cluster. A row without an
    id is in no class; its cluster is the key of its words, so that copies among such rows conflict.
    """
    rows = jaccard_join.classes(docs, carry=("source",))
    cluster = F.when(F.col("n_words") > 0, F.coalesce(F.col("class_id").cast("string"), F.hex("key")))
    return rows.select("doc_id", "source", F.col("n_words").alias("length"), cluster.alias("cluster"))


def op1_packing(spark, sf_dir) -> DataFrame:
    return pack(materialize(near_copies(read_table(spark, sf_dir, "documents")), "items"))
