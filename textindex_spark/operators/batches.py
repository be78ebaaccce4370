"""Many texts end to end in one array, so that numpy's steps serve all of them at once.

Sorting places by their next bytes finds repeats: the latest earlier place of the same gram, the suffix order, the nearest
earlier places on both sides in that order, and how far texts agree there. Nothing crosses from one text into another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are worked on at once, or one longer text.
PART = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Texts:
    """`data` holds the bytes of all texts, text k those from bounds[k] to bounds[k + 1]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds.astype(np.int64)
        self.n = len(data)
        lengths = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        self.begin, self.end = np.repeat(self.bounds[:-1], lengths), np.repeat(self.bounds[1:], lengths)
        self.bytes = data.tobytes()
        self._words, self.known = None, {}

    @classmethod
    def of(cls, texts: list[bytes]) -> Texts:
        return cls(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))

    def words(self) -> np.ndarray:
        """The eight bytes from each place on as a number; beyond the end of a text there are zeros."""
        if self._words is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            out = np.zeros(self.n, np.uint64)
            for k in range(8):
                out = out << np.uint64(8) | padded[k : k + self.n]
            rest = self.end - np.arange(self.n)
            short = np.flatnonzero(rest < 8)
            cut = ((8 - rest[short]) * 8).astype(np.uint64)
            out[short] = out[short] >> cut << cut
            self._words = out
        return self._words


def parts(content: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """(from, to, texts) of a binary array, PART bytes or one text at a time; null texts are empty."""
    if content.null_count:
        content = content.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(content.type) else np.int32
    _, offsets, data = content.buffers()
    bounds = np.frombuffer(offsets, kind)[content.offset : content.offset + len(content) + 1].astype(np.int64) if len(content) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(content):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + PART, "right")) - 1)
        yield a, b, Texts(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        a = b


def mixed(keys: list[np.ndarray]) -> np.ndarray:
    h = keys[0] * _MIX
    for k in keys[1:]:
        h = (h ^ (h >> np.uint64(32)) ^ k) * _MIX
    return h


def grams(t: Texts, q: int, where: np.ndarray) -> list[np.ndarray]:
    """Numbers that hold the q bytes from each place on, q up to 8 or a multiple of 8; places have that many bytes ahead."""
    w = t.words()
    return [w[where] >> np.uint64(8 * (8 - q))] if q <= 8 else [w[where + k] for k in range(0, q, 8)]


def grouped(t: Texts, q: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): places of `where` (ascending) by gram, then place; new tells where another gram begins.

    Grams are sorted by a hash that leaves room for the place; if two different ones meet, they are sorted in full.
    """
    n = len(where)
    if n == 0:
        return where, np.zeros(0, bool)
    bits = max(1, int(where[-1]).bit_length())
    keys = grams(t, q, where)
    low = np.uint64((1 << bits) - 1)
    packed = np.sort((mixed(keys) & ~low) | where.astype(np.uint64))
    order = (packed & low).astype(np.int64)
    packed >>= np.uint64(bits)
    new = np.ones(n, bool)
    new[1:] = packed[1:] != packed[:-1]
    keys = grams(t, q, order)
    other = np.ones(n, bool)
    other[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    if (other & ~new).any():
        order = order[np.lexsort((order, *keys))]
        keys = grams(t, q, order)
        other[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return order, other
    return order, new


def latest(t: Texts, q: int, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place, repeated): the latest earlier place of the same q bytes in the same text (-1 for none) for all places, and
    the places, of `where`, whose gram a neighbour in the order shares: longer grams repeat only among these. `where`
    holds all places that repeat a shorter gram, so the answer is the same with or without it and is kept."""
    if q in t.known:
        return t.known[q]
    if where is None:
        where = np.arange(t.n)
    where = where[where + q <= t.end[where]]
    order, new = grouped(t, q, where)
    out = np.full(t.n, -1, np.int64)
    same = np.flatnonzero(~new[1:]) if len(order) else np.zeros(0, np.int64)
    a, b = order[same], order[same + 1]
    inside = a >= t.begin[b]
    out[b[inside]] = a[inside]
    kept = np.zeros(t.n, bool)
    kept[a[inside]] = kept[b[inside]] = True
    t.known[q] = out, np.flatnonzero(kept)
    return t.known[q]


def suffix_order(t: Texts) -> np.ndarray:
    """Places by text, then suffix. Sorted by eight bytes; groups that still tie are sorted by the rank of what follows,
    whose width doubles each time."""
    n, w = t.n, t.words()
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(w)
    doc = t.doc.astype(np.uint16) if len(t.bounds) < 1 << 16 else t.doc
    order = order[np.argsort(doc[order], kind="stable")]
    k, d = w[order], doc[order]
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    width = 8
    while len(open_):
        sub = order[open_]
        rest = t.end[sub] - sub
        second = np.where(rest > width, rank[np.minimum(sub + width, n - 1)], rest - width - 1)
        packed = (rank[sub] << 32) + (second + (1 << 31))
        by = np.argsort(packed)
        packed, sub = packed[by], sub[by]
        order[open_] = sub
        new = np.ones(len(sub), bool)
        new[1:] = packed[1:] != packed[:-1]
        rank[sub] = open_[np.maximum.accumulate(np.where(new, np.arange(len(sub)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
        width *= 2
    return order


#: Rounds in which all indexes jump at once; those that still look, in periodic texts, then climb one by one, in
#: order and from their neighbour on: what one has passed is then not met again.
ROUNDS = 16


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each index the nearest one before it whose value is smaller, -1 for none.

    All between an index and its candidate is larger, so a candidate that is larger itself hands on its own candidate.
    """
    n = len(values)
    out = np.arange(-1, n - 1)
    values = np.append(values, np.iinfo(np.int64).min)  # at -1
    looking = np.flatnonzero(values[out] > values[:-1])
    for _ in range(ROUNDS):
        if not len(looking):
            return out
        out[looking] = found = out[out[looking]]
        looking = looking[values[found] > values[looking]]
    found, value = memoryview(out), memoryview(values)
    for i in looking.tolist():
        k, v = i - 1, value[i]
        while value[k] > v:
            k = found[k]
        found[i] = k
    return out


def nearest_earlier(t: Texts, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest ones before and after it in the order (by text) that lie before it in its text, -1 for none."""
    sides, last = [], len(order) - 1
    # other texts, passed before, hold smaller values, so none looks beyond them
    for values, back in ((order, False), (order - t.begin[order] - t.doc[order] * (t.n + 1), True)):
        at = _smaller_before(values[::-1] if back else values)
        if back:
            at = np.where(at >= 0, last - at, -1)[::-1]
        near = np.where(at >= 0, order[at], -1)
        out = np.full(t.n, -1, np.int64)
        out[order] = np.where((near >= 0) & (t.doc[near] == t.doc[order]), near, -1)
        sides.append(out)
    return sides[0], sides[1]


def same_bytes(x: np.ndarray) -> np.ndarray:
    """How many leading bytes of a number are zero."""
    out = np.zeros(len(x), np.int64)
    for k in range(1, 9):
        out += x < np.uint64(1) << np.uint64(64 - 8 * k) if k < 8 else x == 0
    return out


def agree(data: bytes, a: int, b: int, most: int) -> int:
    """How far the bytes from a and from b agree, up to most."""
    n = 0
    step = 32
    while n < most:
        k = min(step, most - n)
        if data[a + n : a + n + k] == data[b + n : b + n + k]:
            n += k
            step *= 2
        elif k == 1:
            break
        else:
            step = k // 2
            most = n + k - 1
    return n


#: Steps of eight bytes that are compared for all places at once.
STEPS = 6


def agreement(t: Texts, other: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at each place and at `other` of the same text (-1 for none).

    `other` is such that an agreement of k bytes at a place means one of k - 1 at least at the next place, as for
    neighbours in suffix order. Long ones are found once for each run of places that go on together.
    """
    w = t.words()
    out = np.zeros(t.n, np.int64)
    here = np.flatnonzero(other >= 0)
    for k in range(STEPS):
        there = other[here] + 8 * k
        at = here + 8 * k
        most = t.end[here] - np.maximum(at, there)
        got = np.minimum(same_bytes(w[at] ^ w[there]), most)
        out[here] += got
        # a whole word agrees and both texts go on
        here = here[(got == 8) & (most > 8)]
    if len(here):
        gap = other[here] - here
        head = np.ones(len(here), bool)
        head[1:] = (here[1:] != here[:-1] + 1) | (gap[1:] != gap[:-1])
        place, known, ends = -2, 0, t.end
        lengths = []
        for i, j in zip(here[head].tolist(), other[here[head]].tolist()):
            k = max(8 * STEPS, known - (i - place))
            k += agree(t.bytes, i + k, j + k, int(ends[i]) - max(i, j) - k)
            lengths.append(k)
            place, known = i, k
        run = np.cumsum(head) - 1
        out[here] = np.array(lengths)[run] - (here - here[head][run])
    return out
