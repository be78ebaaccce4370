"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts are sets of five-word shingles (lower-case words between white space; a text of under five words is one shingle).
Two documents are linked if the Jaccard similarity of their sets is at least THRESHOLD.

1. Texts that are equal as word sequences form one representative with a key of its own and its number of copies
   (map-side combination, so a group of copies with a third of all rows is one partial row a task).
2. A representative has a label in each of TREES tries: DEPTH min-hashes of its own. A trie is the table of labels in
   sorted order: leaves with a common prefix are neighbours, so one range-partitioned sort builds all tries, and no
   prefix, however common, has to fit a task. A leaf's match is its longest prefix in common with a neighbour.
3. Each text begins with the prefix of DEPTH and shortens it until the target recall. At length k, a text at the
   threshold misses it in all trees with probability (1 - t^k)^TREES; all texts of a cell are compared, so it must also
   miss the texts that the first one has matched in other trees (at distance 1 - t or less of it, so by the triangle
   inequality it has similarity 2t - 1 or more with them). A text with enough such matches keeps its length; one with too few
   shortens it by one, down to the length at which no match is needed. A run of leaves that share a prefix is tied
   together where the prefix is long enough for one of its texts: neighbour to neighbour, so no text has many ties.
4. Ties form cells (connected components). All texts of a cell meet and are compared exactly. A large cell is cut into
   bands of set size, of which only equal and neighbouring ones can hold similar texts, and bands into blocks; each pair
   of blocks is a unit. Pairs are never emitted: a unit counts links and returns each text's links and the smallest text
   it is connected with.
5. Components of the verified links are the classes; a class is named by its smallest doc_id.

No candidate is dropped and nothing is capped.

Defined results: null texts and texts without words are linked with nothing; each row of the input gives one row, also
if ids or rows repeat: equal rows are copies of each other, and rows of one id with different texts are linked by their
own texts; ties in naming go to the smallest id; rows with a null id do not count as links of others; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import materialize, read_table

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
TARGET_RECALL = 0.999
#: A block holds so many texts and shingles at most (but one text, however long).
BLOCK = 2048
BLOCK_SHINGLES = 1 << 21
#: Rows of three columns (some 60 bytes each) that may be broadcast.
BROADCAST_ROWS = 300_000
SEED = 147
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 4096
#: Bytes up to which words are hashed together.
LONG = 64
#: Rows and bytes of text that are hashed at once (but one text, however long).
PART_ROWS = 64
PART_BYTES = 1 << 20
#: Edges (16 bytes each) that one task connects.
FEW_EDGES = 1 << 20

MIX = np.uint64(0x9E3779B97F4A7C15)
BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: The lowest k bytes of a number.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def missed(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that texts of this similarity have no prefix of this depth in common in any tree."""
    return (1 - max(0.0, similarity) ** depth) ** trees


def enough_matches(depth: int, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> float:
    """In how many trees a text must be matched to this depth to keep it: 0 where the depth reaches the recall alone."""
    alone, through = missed(threshold, depth), missed(2 * threshold - 1, depth)
    if alone <= 1 - recall:
        return 0
    return math.ceil(math.log((1 - recall) / alone) / math.log(through)) if through < 1 else math.inf


def least_depth(threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> int:
    """The length down to which a text without matches shortens its prefix."""
    for k in range(DEPTH, 0, -1):
        if enough_matches(k, threshold, recall) == 0:
            return k
    raise ValueError("more trees are needed for this recall")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of many texts and where each text's begin, from their words' hashes. Texts have a word at least."""
    n = np.diff(offsets)
    count = np.maximum(n - SHINGLE + 1, 1)
    begins = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    at = offsets[:-1][text] + np.arange(begins[-1]) - begins[:-1][text]
    end = offsets[1:][text]
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(SHINGLE):
        inside = at + k < end
        h = mix(h * MIX + np.where(inside, words[np.minimum(at + k, len(words) - 1)], np.uint64(k)) + np.uint64(k + 1))
    return h, begins


def plain(text: str | None) -> bytes:
    """The lower-case words of a text, with one space between them; words are split at exactly the six blanks of ASCII."""
    low = (text or "").lower().encode().translate(BLANKS)
    while b"  " in low:
        low = low.replace(b"  ", b" ")
    return low.strip(b" ")


def key_of(words: bytes) -> bytes | None:
    """Key of a plain text, equal for copies; null where there is no word."""
    return hashlib.md5(words, usedforsecurity=False).digest() if words else None


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of plain texts, and where each text's begin. Texts have a word at least.

    Words are read eight bytes at a time, all words at once; those over LONG bytes are hashed one by one.
    """
    joined = b" ".join(texts) + bytes(8)
    size = len(joined) - 8
    eight = np.ndarray(size, "<u8", joined, strides=(1,))  # the eight bytes from each place on
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8, size) == 32), size)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = ends - starts
    h = mix(n.astype(np.uint64) * MIX + (eight[starts] & FIRST[np.minimum(n, 8)]))
    for k in range(8, LONG, 8):
        at = np.flatnonzero(n > k)
        if not len(at):
            break
        h[at] = mix(h[at] * MIX + (eight[starts[at] + k] & FIRST[np.minimum(n[at] - k, 8)]))
    for i in np.flatnonzero(n > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(joined[starts[i] : ends[i]], digest_size=8).digest(), "little")
    last = np.cumsum([len(t) + 1 for t in texts]) - 1
    return h, np.concatenate([[0], np.searchsorted(ends, last) + 1])


def distinct(h: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes of each text, in ascending order."""
    out = []
    for a, b in zip(begins[:-1], begins[1:]):
        s = np.sort(h[a:b])
        out.append(s[np.append(True, s[1:] != s[:-1])])
    return out


def signatures(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """TREES * DEPTH min-hashes of 16 bits for each text, in big-endian bytes, so that byte order is label order.

    Minima are taken over odd numbers of 32 bits, times an odd factor of each min-hash: a bijection of these numbers.
    """
    odd = np.random.default_rng(SEED).integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low = np.empty((TREES * DEPTH, len(begins) - 1), dtype=np.uint32)
    h = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    moved = np.empty_like(h)
    for j in range(TREES * DEPTH):
        np.minimum.reduceat(np.multiply(h, odd[j], out=moved), begins[:-1], out=low[j])
    return np.ascontiguousarray((mix(low.T.astype(np.uint64)) >> np.uint64(48)).astype(">u2"))


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of PART_ROWS and PART_BYTES at most; text: its column of texts."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        fit = int(np.searchsorted(size, (size[a - 1] if a else 0) + PART_BYTES, side="right"))
        b = min(a + PART_ROWS, max(a + 1, fit))
        yield batch.slice(a, b - a)
        a = b


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, number of distinct shingles, labels, number of words) of every row, and its columns behind the text.

    Key, shingles and labels are null where a text has no word.
    """
    for batch in batches:
        for part in _parts(batch, 1):
            texts = [plain(t) for t in part.column(1).to_pylist()]
            some = [k for k, t in enumerate(texts) if t]
            sizes, labels = [None] * len(texts), [None] * len(texts)
            if some:
                h, begins = shingles(*word_hashes([texts[k] for k in some]))
                for k, s, label in zip(some, distinct(h, begins), signatures(h, begins)):
                    sizes[k], labels[k] = len(s), label.tobytes()
            n_words = [t.count(b" ") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([key_of(t) for t in texts], pa.binary()), pa.array(sizes, pa.int64()), pa.array(labels, pa.binary()), pa.array(n_words, pa.int64()), *part.columns[2:]], ["doc_id", "key", "n", "labels", "n_words", *part.schema.names[2:]])


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = 2 * DEPTH
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            reps = part.column(0).to_numpy()
            labels = [x[t * width : (t + 1) * width] for x in part.column(1).to_pylist() for t in range(TREES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(reps))), pa.array(labels, pa.binary()), pa.array(np.repeat(reps, TREES))], ["tree", "label", "rep"])


def _common(tree: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How many hashes each leaf's label shares with the next one's, from its beginning; 0 in another tree."""
    same = label[1:] == label[:-1]
    return np.where(tree[1:] == tree[:-1], np.cumprod(same, axis=1).sum(axis=1), 0)


def _matched(least: int):
    """The sorted leaves whose match has a length of `least` or more, and a partition's first and last leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "label", "rep", "match"]
        held: pa.RecordBatch | None = None  # the last leaf so far, whose next one is unknown
        before, first = 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            tree = both.column(0).to_numpy()
            label = np.frombuffer(b"".join(both.column(1).to_pylist()), dtype=">u2").reshape(-1, DEPTH)
            common = _common(tree, label)
            match = np.maximum(np.concatenate([[before], common[:-1]]), common) if len(common) else np.zeros(0, dtype=np.int64)
            keep = match >= least
            if first and len(keep):
                keep[0], first = True, False
            at = pa.array(np.flatnonzero(keep))
            if len(at):
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in both.take(at).columns), pa.array(match[keep].astype(np.int32))], names)
            held, before = batch.slice(batch.num_rows - 1, 1), int(common[-1]) if len(common) else 0
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([before], pa.int32())], names)

    return run


def _ties(least: int):
    """Ties (a, b) of neighbours among a partition's sorted leaves, and its first and last leaf under their prefixes.

    Leaves come with the length that their text has settled on. A run that touches an end of the partition may go on in
    another one, so it is tied whatever its texts' lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        tree, rep, depth = (table.column(k).to_numpy() for k in (0, 2, 3))
        labels = table.column(1).to_pylist()
        depth = depth.copy()
        depth[[0, -1]] = least
        common = _common(tree, np.frombuffer(b"".join(labels), dtype=">u2").reshape(-1, DEPTH))
        tied = np.zeros(len(common), dtype=bool)
        for k in range(least, DEPTH + 1):
            run_of = np.concatenate([[0], np.cumsum(common < k)])
            shortest = np.minimum.reduceat(depth, np.flatnonzero(np.diff(run_of, prepend=-1)))
            tied |= (common >= k) & (shortest[run_of[1:]] <= k)
        at = np.flatnonzero(tied)
        names, kinds = ["tree", "prefix", "a", "b"], [pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary()), pa.array(rep[at]), pa.array(rep[at + 1])], names)
        ends = [(tree[i], labels[i][: 2 * least], rep[i], rep[i]) for i in (0, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ends), kinds)], names)

    return run


def ties(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct (a, b), a < b: neighbours in a trie that share a prefix of the length that one of their run needs."""
    least = least_depth(threshold)
    order = ("tree", "label", "rep")
    leaves = reps.select("rep", "labels").mapInArrow(_leaves, "tree int, label binary, rep long")
    ordered = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(ordered.mapInArrow(_matched(least), "tree int, label binary, rep long, match int"), "leaves")
    depth = F.lit(least)
    for k in range(least + 1, DEPTH + 1):
        depth = F.when(F.count_if(F.col("match") >= k) >= enough_matches(k, threshold), k).otherwise(depth)
    settled = found.groupBy("rep").agg(depth.alias("depth"))
    ordered = found.join(settled, "rep").select(*order, "depth").repartitionByRange(*order).sortWithinPartitions(*order)
    tied = materialize(ordered.mapInArrow(_ties(least), "tree int, prefix binary, a long, b long"), "ties")
    # runs that go on in another partition: all first and last leaves of a prefix are tied to the smallest of them
    ends = tied.where("tree is not null").select("tree", "prefix", "a")
    seams = ends.join(ends.groupBy("tree", "prefix").agg(F.min("a").alias("b")), ["tree", "prefix"])
    both = tied.where("tree is null").select("a", "b").unionByName(seams.select("a", "b")).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of the nodes under n is connected with, by the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        # all but the local minima among the roots that are left get another root, so at most half of them stay
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of the (a, b) edges."""
    rows = [b for b in batches if b.num_rows]
    if rows:
        a, b = (np.concatenate([r.column(k).to_numpy() for r in rows]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = connected(len(nodes), at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): one node that stands for each node's component, for all nodes of the (a, b) edges.

    One task connects up to FEW_EDGES edges. While there are more, rounds contract them. A round gives each node the smallest of itself and its neighbours, follows that one step further, and contracts:
    edges are renamed and those inside a contracted node go. All but the local minima vanish in a round, and so do most
    edges. Rounds are written to the shared folder, so a lost executor costs no more than the round it was in.
    """
    left = materialize(edges.select("a", "b"), "edges")
    known = None
    while (n := left.count()) > FEW_EDGES:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "up")
        hop = up.select(F.col("node").alias("n1"), F.col("up").alias("top"))
        up = materialize(up.join(hop, up["up"] == hop["n1"]).select("node", "top"), "tops")
        if known is None:
            known = up.select("node", F.col("top").alias("root"))
        else:
            step = up.select(F.col("node").alias("n1"), F.col("top").alias("next"))
            known = known.join(step, known["root"] == step["n1"], "left").select("node", F.coalesce("next", "root").alias("root"))
        known = materialize(known, "roots")
        # a top may itself have been contracted into another one
        of_a, of_b = up.select(F.col("node").alias("na"), F.col("top").alias("ta")), up.select(F.col("node").alias("nb"), F.col("top").alias("tb"))
        tops = up.where("node <> top").select("top").distinct()
        again = tops.join(of_a, tops["top"] == of_a["na"]).select(F.col("top").alias("ta"), F.col("ta").alias("tb"))
        renamed = left.join(of_a, left["a"] == of_a["na"]).join(of_b, F.col("b") == F.col("nb")).select("ta", "tb").unionByName(again).where("ta <> tb")
        left = materialize(renamed.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    if known is not None and n == 0:
        return known
    last = materialize(left.coalesce(1).mapInArrow(_connected, "node long, root long"), "roots")
    if known is None:
        return last
    step = last.select(F.col("node").alias("n1"), F.col("root").alias("next"))
    return materialize(known.join(step, known["root"] == step["n1"], "left").select("node", F.coalesce("next", "root").alias("root")), "roots")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, distinct shingle hashes) of the rows whose text has the key that is looked for."""
    for batch in batches:
        for part in _parts(batch, 2):
            reps, keys, texts = (c.to_pylist() for c in part.columns)
            texts = [plain(t) for t in texts]
            some = [k for k, t in enumerate(texts) if t and key_of(t) == keys[k]]
            sets = distinct(*shingles(*word_hashes([texts[k] for k in some]))) if some else []
            yield pa.RecordBatch.from_arrays([pa.array([reps[k] for k in some], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"])


def _links(sets: list[np.ndarray], left: int, threshold: float) -> np.ndarray:
    """Matrix of links between texts; with left > 0 only between the first `left` texts and the others."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    # columns that only one text has add nothing to an intersection
    number = np.cumsum(often > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    rows, cols = (slice(0, left), slice(left, n)) if left else (slice(0, n), slice(0, n))
    common = np.zeros((rows.stop - rows.start, cols.stop - cols.start), dtype=np.float32)
    width = max(256, min(COLUMNS, (1 << 22) // n))
    for start in range(0, int(number[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        dense = np.zeros((n, width), dtype=np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        common += dense[rows] @ dense[cols].T
    linked = np.empty(common.shape, dtype=bool)
    for a in range(0, len(common), 256):
        c = common[a : a + 256].astype(np.int64)
        # in whole numbers: common / union >= threshold
        linked[a : a + 256] = c * 1000 >= round(threshold * 1000) * (sizes[rows][a : a + 256, None] + sizes[cols][None, :] - c)
    if not left:
        np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray, left: int) -> np.ndarray:
    """Each text's smallest connected text."""
    a, b = np.nonzero(linked)
    return connected(len(linked) if not left else sum(linked.shape), a, b + left)


def _verified(threshold: float):
    """(rep, root, links) of the texts of each unit that have links; rows come in the order of units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def done() -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            rows.sort(key=lambda r: (r[0], r[1]))  # by side, then by text
            left = 0
            if unit[1:3] != unit[3:5]:  # two blocks
                left = sum(r[0] == 0 for r in rows)
                if left in (0, len(rows)):
                    return None
            linked = _links([np.frombuffer(r[3], dtype=np.uint64) for r in rows], left, threshold)
            copies = np.array([r[2] for r in rows], dtype=np.int64)
            links = np.concatenate([linked @ copies[left:], copies[:left] @ linked]) if left else linked @ copies
            # the smallest text of a component may be in either block
            root = _roots(linked, left)
            reps = np.array([r[1] for r in rows], dtype=np.int64)
            lowest = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(lowest, root, reps)
            some = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(lowest[root[some]]), pa.array(links[some].astype(np.int64))], ["rep", "root", "links"])

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(5)))
            for key, row in zip(keys, zip(*(batch.column(k).to_pylist() for k in range(5, 9)))):
                if key != unit:
                    if (out := done()) is not None:
                        yield out
                    unit, rows = key, []
                rows.append(row)
        if (out := done()) is not None:
            yield out

    return run


UNIT = ("cell", "low_band", "low_block", "high_band", "high_block")


def units(cells: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(UNIT, side, rep, copies): every unit of comparison that each text takes part in."""
    of = materialize(cells.select(F.col("node").alias("rep"), F.col("root").alias("cell")).join(reps.select("rep", "copies", "n"), "rep"), "cells")
    size = of.groupBy("cell").agg((F.count(F.lit(1)) > BLOCK).alias("many"), (F.sum("n") > BLOCK_SHINGLES).alias("much"))
    # sizes of similar sets differ by 1 / threshold at most, so by one band at most (the base leaves room for rounding)
    band = F.when(F.col("many") | F.col("much"), F.floor(F.log(F.col("n")) / math.log(1.01 / threshold))).otherwise(0).cast("int")
    of = of.join(size, "cell").select("rep", "cell", "copies", "n", band.alias("band"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    bands = materialize(of.groupBy("cell", "band").agg(blocks.alias("blocks")), "bands")
    beside = lambda by, name: bands.select("cell", (F.col("band") + by).alias("band"), F.col("blocks").alias(name))
    around = bands.join(beside(-1, "above"), ["cell", "band"], "left").join(beside(1, "below"), ["cell", "band"], "left")
    of = of.join(around, ["cell", "band"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def each(count: str, unit) -> F.Column:
        others = F.sequence(F.lit(0), F.greatest(F.coalesce(F.col(count), F.lit(0)), F.lit(1)) - 1)
        made = F.transform(others, lambda o: F.struct(*[c.cast("int").alias(n) for c, n in zip(unit(o), (*UNIT[1:], "side"))]))
        return F.when(F.col(count) > 0, made).otherwise(F.array().cast(f"array<struct<{','.join(f'{n}:int' for n in (*UNIT[1:], 'side'))}>>"))

    band, block = F.col("band"), F.col("block")
    own = each("blocks", lambda o: (band, F.least(block, o), band, F.greatest(block, o), F.when(block <= o, 0).otherwise(1)))
    above = each("above", lambda o: (band, block, band + 1, o, F.lit(0)))
    below = each("below", lambda o: (band - 1, o, band, block, F.lit(1)))
    return of.select("cell", "rep", "copies", F.explode(F.concat(own, above, below)).alias("u")).select("cell", "u.*", "rep", "copies")


def _bounded(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, to be broadcast while it is known to be short."""
    df = materialize(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def classes(docs: DataFrame, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, key, class_id, n_links, first, n_words of every row, and the columns to carry along, as strings.

    first: the row's id and text are those that stand for its class.
    """
    held = [f"carried_{k}" for k in range(len(carry))]
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(c).cast("string").alias(h) for c, h in zip(carry, held)])
    schema = ", ".join(["doc_id long, key binary, n long, labels binary, n_words long", *[f"{h} string" for h in held]])
    signed = materialize(docs.mapInArrow(_signed, schema), "signatures")
    grouped = signed.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    # numbers of the representatives are theirs alone; they are fixed once the table is written
    reps = materialize(grouped.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    cells = components(ties(reps, threshold))
    wanted = _bounded(cells.select(F.col("node").alias("rep")).join(reps.select("rep", "key", "least"), "rep"), "wanted")
    sets = docs.join(wanted, docs["doc_id"] == wanted["least"]).select("rep", "key", "text").mapInArrow(_sets, "rep long, shingles binary").dropDuplicates(["rep"])
    placed = units(cells, reps, threshold).join(sets, "rep").select(*UNIT, "side", "rep", "copies", "shingles")
    checked = placed.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(_verified(threshold), "rep long, root long, links long")
    checked = materialize(checked, "links")
    linked = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(checked.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct()).select(F.col("node").alias("rep"), "root")
    known = reps.select("key", "rep", "least", "copies").join(linked, "rep", "left").join(joined, "rep", "left").where("copies > 1 or links is not null")
    known = materialize(known.select("key", "least", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "linked")
    names = known.groupBy("root").agg(F.min(F.struct("least", "key")).alias("name"))
    known = known.join(names, "root").select(F.col("key").alias("k"), "name", "links")
    known = _bounded(known, "classes")
    rows = signed.select("doc_id", "key", "n_words", *held).join(known, F.col("key") == F.col("k"), "left")
    first = F.col("name").isNull() | ((F.col("doc_id") == F.col("name.least")) & (F.col("key") == F.col("name.key")))
    return rows.select("doc_id", "key", F.coalesce("name.least", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), first.alias("first"), "n_words", *[F.col(h).alias(c) for c, h in zip(carry, held)])


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links of every row: its class and how many other documents it is similar to."""
    return classes(docs, threshold).select("doc_id", "class_id", "n_links")


def _keyed(name: str):
    """Each row with the key of its text as a last column of this name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key_of(plain(t)) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, name])

    return run


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of the smallest id, with all its columns.

    Rows without an id and rows without words all stay. Ids without any row that stands for its class go; of an id with
    several rows, those stay that stand for a class, each text once.
    """
    rows = materialize(classes(docs, threshold).where("doc_id is not null"), "classes")
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("some"))
    gone = _bounded(ids.where("not some").select("doc_id"), "gone")
    twice = _bounded(ids.where("some and n > 1").select("doc_id"), "twice")
    kept = docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    single = kept.join(twice, docs["doc_id"] == twice["doc_id"], "left_anti")
    several = kept.join(twice, docs["doc_id"] == twice["doc_id"], "left_semi")
    # the key's column gets a name that no input has
    key = f"key_{uuid.uuid4().hex}"
    keyed = several.mapInArrow(_keyed(key), StructType([*several.schema.fields, StructField(key, BinaryType())]))
    firsts = rows.where("first and key is not null").select("doc_id", "key").distinct()
    stay = keyed.join(firsts, (keyed["doc_id"] == firsts["doc_id"]) & (keyed[key] == firsts["key"]), "left_semi").dropDuplicates(["doc_id", key])
    return single.unionByName(stay.drop(key)).unionByName(keyed.where(F.col(key).isNull()).drop(key))


def op6_jaccard_join(spark, sf_dir) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents"))
