"""Hashes of whole texts, of many at once: sums over the bytes of all texts in numpy, no step for each byte."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import FNV_BASIS, FNV_PRIME, M32, MERSENNE61, ROLLING_BASE
from .batches import Texts, parts


def powers(base: int, modulus: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for k in range(n):
        out[k] = x
        x = x * base % modulus
    return out


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])[bounds])


def fnv1a(t: Texts, power: np.ndarray) -> np.ndarray:
    """FNV-1a, 32 bits; power holds those of the prime up to the longest text.

    A byte changes the low eight bits only, before the product, so the hash is a polynomial in these changes. The low
    bits follow from themselves: bit k before each byte is the parity of what lower bits and bytes before have sent there.
    """
    low, bit = np.zeros(t.n, np.uint32), t.data.astype(np.uint32)
    for k in range(8):
        below = (low ^ bit) & np.uint32((1 << k) - 1)
        sent = ((bit >> np.uint32(k)) ^ (below * np.uint32(FNV_PRIME & 0xFF) >> np.uint32(k))) & np.uint32(1)
        parity = np.concatenate([[0], np.bitwise_xor.accumulate(sent)]).astype(np.uint32)
        low |= (parity[:-1] ^ parity[t.begin] ^ np.uint32(FNV_BASIS >> k & 1)) << np.uint32(k)
    change = ((low ^ bit).astype(np.int64) - low).astype(np.uint64)
    total = _sums(change * power[t.end - np.arange(t.n)], t.bounds)
    return ((total + np.uint64(FNV_BASIS) * power[np.diff(t.bounds)]) & np.uint64(M32)).astype(np.int64)


def karp_rabin(t: Texts, power: np.ndarray) -> list[int]:
    """The value of the polynomial of the bytes at ROLLING_BASE modulo 2**61 - 1, from sums of three parts of 21 bits."""
    weight, data = power[t.end - 1 - np.arange(t.n)], t.data.astype(np.uint64)
    parted = [_sums(data * (weight >> np.uint64(21 * k) & np.uint64((1 << 21) - 1)), t.bounds).tolist() for k in range(3)]
    return [(a + (b << 21) + (c << 42)) % MERSENNE61 for a, b, c in zip(*parted)]


def hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, crc, fnv, fingerprint) of the UTF-8 bytes of every text that is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fnv, rolling = 0, None, None
        for batch in batches:
            for a, b, t in parts(batch.column("content")):
                longest = int(np.diff(t.bounds).max()) + 1
                if longest > known:
                    known = max(longest, 2 * known)
                    fnv, rolling = powers(FNV_PRIME, M32 + 1, known), powers(ROLLING_BASE, MERSENNE61, known)
                crc = [zlib.crc32(t.bytes[i:j]) for i, j in zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(crc, pa.int64()), pa.array(fnv1a(t, fnv)), pa.array(karp_rabin(t, rolling), pa.int64())], ["doc_id", "crc", "fnv", "fingerprint"])

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8").alias("content"))
    return rows.mapInArrow(run, "doc_id long, crc long, fnv long, fingerprint long")
