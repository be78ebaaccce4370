"""File sources and sinks: raw integers, integer lines, whole files, operation batches, CSV of RESULT lines."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .random import generate_operations

#: Opcodes of operation files.
OPCODES = ("I", "D", "Q")
#: Records of 2**20 values at most go into one row group of a result batch.
CHUNK = 1 << 20


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_integers(spark: SparkSession, path: str, width: int = 8) -> DataFrame:
    """(path, i, value) of files of little-endian unsigned integers; a rest shorter than a record is dropped.

    Eight-byte values from 2**63 on come out negative, as BIGINTs of the same bits.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                n = len(content) // width
                raw = np.frombuffer(content, dtype=np.uint8, count=n * width).reshape(n, width)
                for a in range(0, n, CHUNK):
                    wide = np.zeros((len(raw[a : a + CHUNK]), 8), dtype=np.uint8)
                    wide[:, :width] = raw[a : a + CHUNK]
                    yield pd.DataFrame({"path": path, "i": np.arange(a, a + len(wide)), "value": wide.reshape(-1).view("<i8")})

    return read_files(spark, path).select("path", "content").mapInPandas(unpack, "path string, i long, value long")


def read_integer_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of text files with a decimal integer a line; blank lines are skipped."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").cast("bigint").alias("value"))


def encode_operations(ops: list[tuple[str, list[int]]], universe: int) -> bytes:
    """An operation file: the universe, then for each batch an opcode byte, a count and the keys."""
    out = [struct.pack("<Q", universe)]
    for code, keys in ops:
        out += [struct.pack("<BI", OPCODES.index(code), len(keys)), np.array(keys, dtype="<u8").tobytes()]
    return b"".join(out)


def decode_operations(content: bytes) -> Iterator[tuple[int, int, str, int]]:
    """(op_seq, batch, opcode, key) of an operation file; a batch that is cut off ends it."""
    at, seq, batch = 8, 0, 0
    while at + 5 <= len(content):
        code, n = struct.unpack_from("<BI", content, at)
        at += 5
        if code >= len(OPCODES) or at + 8 * n > len(content):
            return
        for key in np.frombuffer(content, dtype="<u8", count=n, offset=at).tolist():
            yield seq, batch, OPCODES[code], key
            seq += 1
        at += 8 * n
        batch += 1


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    """(path, op_seq, batch, opcode, key) of operation files, by any store that Spark reaches."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = [*decode_operations(content)]
                yield pd.DataFrame(rows, columns=["op_seq", "batch", "opcode", "key"]).assign(path=path)[["path", "op_seq", "batch", "opcode", "key"]]

    return read_files(spark, path).select("path", "content").mapInPandas(unpack, "path string, op_seq long, batch long, opcode string, key long")


class OperationSource(DataSource):
    """spark.read.format("intops").option("seed", s).option("streams", n): generated operation streams, one a partition."""

    @classmethod
    def name(cls) -> str:
        return "intops"

    def schema(self) -> str:
        return "stream long, op_seq long, batch long, opcode string, key long"

    def reader(self, schema) -> DataSourceReader:
        return OperationReader(dict(self.options))


class OperationReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(int(self.options.get("streams", 1)))]

    def read(self, partition: InputPartition):
        o = self.options
        ops = generate_operations(int(o.get("seed", 147)) + partition.value, int(o.get("keys", 100)), int(o.get("universe", 1 << 32)), int(o.get("batch", 10)))
        seq = 0
        for b, (code, keys) in enumerate(ops):
            for key in keys:
                yield partition.value, seq, b, code, int(key)
                seq += 1


def write_nothing(df: DataFrame) -> None:
    """Run a plan in full and drop its rows."""
    df.write.format("noop").mode("overwrite").save()


def parse_results(lines: DataFrame) -> DataFrame:
    """(line, kv): the key=value pairs of lines that begin with RESULT."""
    body = F.substring("value", 8, 1 << 30)
    return lines.where(F.col("value").startswith("RESULT ")).select("value", F.call_function("str_to_map", F.trim(body), F.lit(" "), F.lit("=")).alias("kv"))


def result_table(lines: DataFrame, key: str | None, columns: list[str], op: str = "avg") -> DataFrame:
    """RESULT lines as a table of columns, or, with a key, one row for each of its values with averages or medians."""
    kv = parse_results(lines)
    if key is None:
        return kv.select(*[F.col("kv")[c].alias(c) for c in columns])
    number = lambda c: F.col("kv")[c].try_cast("double")
    agg = {"avg": F.avg, "median": F.median}[op]
    return kv.groupBy(F.col("kv")[key].alias(key)).agg(*[agg(number(c)).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
