"""Factorizations of documents: a document is one row, so each is parsed in one pass, without a shuffle.

The functions here parse one text and say what each factorizer does; tables are parsed by those of lists, many texts at once.

A factor is a literal (len 0, src NULL) or a reference (src, len) to earlier text; it covers max(len, 1) bytes from pos.
Texts are UTF-8 bytes. Overlapping references copy what they write. Every factorizer's output decodes to its input.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from .sketch import AugmentedSketch
from .textindex import previous_matches

FACTORS = "doc_id long, seq long, pos long, src long, len long, literal smallint"
Factor = tuple[int, int]  # (source, length); a literal has length 0 and its byte as source


def literals(t: bytes) -> list[Factor]:
    return [(c, 0) for c in t]


def lz77(t: bytes, threshold: int = 2) -> list[Factor]:
    """Exact greedy parsing: at each place the longest match that begins earlier, from `threshold` bytes on.

    In suffix order, the best earlier place for i is the nearest one before or after i's suffix that lies before i in the
    text; of equally long matches the one before in suffix order is taken.
    """
    n = len(t)
    if n < 2:
        return literals(t)
    _, left, right, by_left, by_right = previous_matches(t)
    source, length = np.where(by_left >= by_right, left, right).tolist(), np.maximum(by_left, by_right).tolist()
    out, i = [], 0
    while i < n:
        if length[i] >= threshold:
            out.append((source[i], length[i]))
            i += length[i]
        else:
            out.append((t[i], 0))
            i += 1
    return out


def _agree(t: bytes, a: int, b: int, most: int) -> int:
    """How far the text from a and from b agrees, up to most."""
    n = 0
    step = 32
    while n < most:
        k = min(step, most - n)
        if t[a + n : a + n + k] == t[b + n : b + n + k]:
            n += k
            step *= 2
        elif k == 1:
            break
        else:
            step = k // 2
            most = n + k - 1
    return n


#: Fixed values of the deflate-style parser: shortest and longest match, window, chain steps, good match, farthest match of three.
MIN_MATCH, MAX_MATCH, WINDOW, CHAIN, GOOD, TOO_FAR = 3, 258, 1 << 15, 4096, 32, 4096


def gzip_style(t: bytes) -> list[Factor]:
    """Lazy parsing with chains of earlier places of three bytes: a match waits one place for a longer one."""
    n, chains, out = len(t), {}, []

    def best(i: int, beat: int) -> tuple[int, int]:
        most = min(MAX_MATCH, n - i)
        if most < MIN_MATCH:
            return 0, 0
        places = chains.get(t[i : i + MIN_MATCH], ())
        length, source = beat, -1
        for j in places[: -(CHAIN // 4 if beat >= GOOD else CHAIN) - 1 : -1]:
            if i - j > WINDOW:
                break
            if length >= most:
                break
            if t[j + length] == t[i + length] and t[j : j + length] == t[i : i + length]:
                length = _agree(t, j, i, most)
                source = j
        return (source, length) if source >= 0 and not (length == MIN_MATCH and i - source > TOO_FAR) else (0, 0)

    def enter(i: int) -> None:
        if i + MIN_MATCH <= n:
            chains.setdefault(t[i : i + MIN_MATCH], []).append(i)

    i, held = 0, (0, 0)
    while i < n:
        now = best(i, held[1]) if held[1] < MAX_MATCH else (0, 0)
        if held[1] >= MIN_MATCH and now[1] <= held[1]:
            out.append(held)  # the match of the place before
            for k in range(i, i - 1 + held[1]):
                enter(k)
            i, held = i - 1 + held[1], (0, 0)
            continue
        if held[1]:
            out.append((t[i - 1], 0))
        enter(i)
        if now[1] >= MIN_MATCH:
            held = now
        else:
            out.append((t[i], 0))
            held = (0, 0)
        i += 1
    if held[1]:
        out.append(held)
    return out


def sliding_window(t: bytes, window: int = 1024, extend: bool = False, long_term_q: int = 0) -> list[Factor]:
    """The longest match that begins at most `window` bytes back, of at most `window` bytes; the nearest of equals.

    extend lets a match of full length go on; long_term_q > 0 also offers the last earlier place, at any distance, of the
    next long_term_q bytes, taken where it gives a longer match. Matches of one byte are literals.
    """
    n, out, i, far = len(t), [], 0, {}
    entered = 0
    while i < n:
        length, source, low = 0, -1, max(0, i - window)
        most = min(window, n - i)
        while length < most:
            at = t.rfind(t[i : i + length + 1], low, i + length)
            if at < 0:
                break
            source, length = at, length + 1
            length = max(length, _agree(t, source, i, most))
        if extend and length == window:
            length = _agree(t, source, i, n - i)
        if long_term_q:
            while entered < i:
                far[t[entered : entered + long_term_q]] = entered
                entered += 1
            j = far.get(t[i : i + long_term_q], -1)
            if j >= 0 and n - i >= long_term_q and (k := _agree(t, j, i, n - i)) > length:
                source, length = j, k
        if length >= 2:
            out.append((source, length))
            i += length
        else:
            out.append((t[i], 0))
            i += 1
    return out


def fingerprints(t: bytes, low: int = 3, high: int = 5, allowed: Callable[[int, bytes], bool] | None = None) -> list[Factor]:
    """Blocks of 2**high to 2**low bytes, longest first: a window that equals an earlier aligned block refers to its latest place."""
    n, out, i = len(t), [], 0
    sizes = [1 << e for e in range(high, low - 1, -1)]
    seen: dict[bytes, int] = {}
    entered = dict.fromkeys(sizes, 0)
    while i < n:
        for size in sizes:
            while entered[size] < i and entered[size] + size <= n:
                block = t[entered[size] : entered[size] + size]
                if allowed is None or allowed(size, block):
                    seen[block] = entered[size]
                entered[size] += size
        hit = next((s for s in sizes if i + s <= n and t[i : i + s] in seen), 0)
        if hit:
            out.append((seen[t[i : i + hit]], hit))
            i += hit
        else:
            out.append((t[i], 0))
            i += 1
    return out


def top_fingerprints(t: bytes, low: int = 3, high: int = 5, least: int = 256, most: int = 1024, width: int = 1024, height: int = 2) -> list[Factor]:
    """As fingerprints, with only the frequent blocks of each size remembered; smaller blocks have the larger filters."""
    sketches = {1 << e: AugmentedSketch(max(least, most >> (e - low)), width, height) for e in range(low, high + 1)}

    def frequent(size: int, block: bytes) -> bool:
        key = hash_bytes(block)
        sketches[size].count(key)
        return key in sketches[size].filter.count

    return fingerprints(t, low, high, frequent)


def hash_bytes(block: bytes) -> int:
    import zlib

    return zlib.crc32(block) << 32 | zlib.adler32(block)


def sketched(t: bytes, q: int = 8, size: int = 1024, width: int = 1024, height: int = 2) -> list[Factor]:
    """The longest frequent prefix, of 2 to q bytes, of the text ahead refers to its last place; prefixes are counted in a sketch.

    The last q - 1 bytes are literals.
    """
    n, out, i = len(t), [], 0
    sketch, last, entered = AugmentedSketch(size, width, height), {}, 0
    while i < n:
        while entered < i and entered + q <= n:
            for k in range(2, q + 1):
                piece = t[entered : entered + k]
                key = hash_bytes(piece)
                sketch.count(key, piece)
                if key not in sketch.filter.count:
                    break  # longer prefixes are no more frequent
                last[piece] = entered
            entered += 1
        if len(last) > 4 * size * q:
            kept = {sketch.value[k] for k in sketch.filter.count}
            last = {p: j for p, j in last.items() if p in kept}
        hit = next((k for k in range(q, 1, -1) if i + q <= n and t[i : i + k] in last), 0)
        if hit:
            out.append((last[t[i : i + hit]], hit))
            i += hit
        else:
            out.append((t[i], 0))
            i += 1
    return out


def qgram_table(t: bytes, q: int = 8, bits: int = 0) -> list[Factor]:
    """q-grams refer to their last place and references that go on are joined; bits > 0 keeps a table of 2**bits places."""
    n, out, i, seen = len(t), [], 0, {}
    slot = (lambda g: hash_bytes(g) & ((1 << bits) - 1)) if bits else (lambda g: g)
    entered = 0
    while i < n:
        while entered < i and entered + q <= n:
            seen[slot(t[entered : entered + q])] = entered
            entered += 1
        j = seen.get(slot(t[i : i + q]), -1) if i + q <= n else -1
        if j >= 0 and t[j : j + q] == t[i : i + q]:
            k = _agree(t, j, i, n - i)
            out.append((j, k))
            i += k
        else:
            out.append((t[i], 0))
            i += 1
    return out


def qgram_order(t: bytes, q: int = 8) -> list[Factor]:
    """The neighbours in sorted order of the q bytes ahead, among those of earlier places, offer the match; longer wins."""
    n, out, i, entered = len(t), [], 0, 0
    keys: list[tuple[bytes, int]] = []
    last: dict[bytes, int] = {}
    while i < n:
        while entered < i:
            g = t[entered : entered + q]
            if g not in last:
                keys.insert(bisect_left(keys, g), g)
            last[g] = entered
            entered += 1
        g = t[i : i + q]
        at = bisect_left(keys, g)
        best = max(((_agree(t, last[k], i, min(q, n - i)), -s, last[k]) for s, k in enumerate([*keys[max(0, at - 1) : at], *keys[at : at + 1]])), default=(0, 0, 0))
        if best[0] >= 2:
            out.append((best[2], best[0]))
            i += best[0]
        else:
            out.append((t[i], 0))
            i += 1
    return out


#: Factorizers by name.
ALGORITHMS: dict[str, Callable[..., list[Factor]]] = {
    "noop": literals, "lz77": lz77, "gzip": gzip_style, "sliding_window": sliding_window, "fingerprints": fingerprints,
    "top_fingerprints": top_fingerprints, "sketch": sketched, "qgram": qgram_table, "qgram_order": qgram_order,
}


def factorize(docs: DataFrame, algorithm: str = "lz77", **params) -> DataFrame:
    """Factor rows of every document's text (or `content`, if it has that column). Empty and null texts have none."""
    from .lists import factor_lists, factor_rows

    content = F.col("content") if "content" in docs.columns else F.encode(F.col("text"), "UTF-8")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), content.alias("content"))
    return factor_rows(factor_lists(rows.where(F.length("content") > 0), algorithm, **params), FACTORS)


def lz78_phrases(t: bytes) -> list[tuple[int, int | None]]:
    """(node, byte) pairs; the root is 0 and nodes count up; a last pair without a byte ends an unfinished phrase."""
    trie: dict[tuple[int, int], int] = {}
    out: list[tuple[int, int | None]] = []
    node = 0
    for c in t:
        step = trie.get((node, c))
        if step is None:
            out.append((node, c))
            trie[node, c] = len(trie) + 1
            node = 0
        else:
            node = step
    if node:
        out.append((node, None))
    return out


def _lz78_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if text:
                phrases = lz78_phrases(text)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(phrases), pa.int64()), pa.array(range(len(phrases)), pa.int64()), pa.array([p for p, _ in phrases], pa.int64()), pa.array([c for _, c in phrases], pa.int16())], ["doc_id", "seq", "node", "ch"])


def lz78(docs: DataFrame) -> DataFrame:
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.encode(F.col("text"), "UTF-8").alias("content"))
    return rows.mapInArrow(_lz78_rows, "doc_id long, seq long, node long, ch smallint")


def lz78_decode(pairs: list[tuple[int, int | None]]) -> bytes:
    phrases, out = [b""], []
    for node, c in pairs:
        out.append(phrases[node] + (b"" if c is None else bytes([c])))
        phrases.append(out[-1])
    return b"".join(out)


def _candidates(size: int, kinds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).to_pylist()):
                text, latest, at, src = text or "", {}, [], []
                for i in range(len(text) - size + 1):
                    g = text[i : i + size]
                    if (block := latest.get(g)) is not None:
                        at.append(i)
                        src.append(block)
                    if i % size == 0:
                        latest[g] = i
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(at), kinds), pa.array(at, pa.int64()), pa.array(src, pa.int64())], ["doc_id", "pos", "src"])

    return run


def block_candidates(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, pos, src): for each place whose next `size` characters equal an earlier aligned block, its latest place.

    A document is one row and carries its blocks with it: one pass over its characters, nothing is shuffled. Memory
    follows the longest document, at one block in `size` characters.
    """
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("pos", LongType()), StructField("src", LongType())])
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_candidates(size, to_arrow_type(schema["doc_id"].dataType)), schema)
