"""Factorizers as SQL table functions.

After register(spark), for example:

    SELECT d.doc_id, f.* FROM documents d, LATERAL lz77(d.text) f
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.factorize import ALGORITHMS, lz78_phrases

FACTOR = "seq: bigint, pos: bigint, src: bigint, len: bigint, literal: int"


def _factors(algorithm):
    class Factors:
        def eval(self, text: str):
            pos = 0
            for seq, (src, length) in enumerate(algorithm((text or "").encode())):
                yield (seq, pos, src, length, None) if length else (seq, pos, None, 0, src)
                pos += max(length, 1)

    return Factors


class Phrases:
    def eval(self, text: str):
        for seq, (node, c) in enumerate(lz78_phrases((text or "").encode())):
            yield seq, node, c


def register(spark: SparkSession) -> list[str]:
    """Register a table function for each factorizer, and lz78; their names are returned."""
    for name, algorithm in ALGORITHMS.items():
        spark.udtf.register(name, udtf(_factors(algorithm), returnType=FACTOR))
    spark.udtf.register("lz78", udtf(Phrases, returnType="seq: bigint, node: bigint, ch: int"))
    return [*ALGORITHMS, "lz78"]
