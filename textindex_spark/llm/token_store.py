"""Token ids in byte-aligned variable-length codes with separate control bytes.

Ids are replaced by their rank of frequency over the whole corpus (the most frequent is rank 0), and a rank takes one to
four bytes. The lengths stand apart, two bits a rank and four ranks a control byte, so a reader finds every code's place
by a table lookup on control bytes and a running sum, without a branch: numpy decodes a frame in a few array operations.

A store is a folder with two tables: `vocab` (rank, id, n) and `frames` (shard, frame, first doc, document ids, counts,
control, data). Frames hold up to FRAME_DOCS documents in ascending doc_id order; shards are ranges of doc_id in
ascending order. Frames are written by Spark, so any store that Spark reaches will do, and a lost executor costs the
repetition of its tasks.

Encoding runs the tokenizers library on the pieces of a text that begin at a blank followed by a non-blank character.
The byte-level pre-tokenizer always starts a token there, so the ids of the pieces in a row are the ids of the text;
pieces recur, and each worker keeps the ids of pieces it has met (a bounded memory). Where a text breaks the rule (blank
runs, blanks at a line's ends), the line or text is encoded whole. Tests compare with encoding whole texts.

Defined results: a null or empty text has no ids but the end id; a null doc_id sorts first; repeated rows and ids are
stored as often as they come, ties in the order of their ids' bytes; an empty table gives an empty store; extra columns
are ignored.
"""

from __future__ import annotations

import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read_table

FRAME_DOCS = 256
FRAME_IDS = 1 << 20
END_ID = 0
CACHE_PIECES = 1_500_000

#: Characters that are neither letter, digit nor blank and begin no contraction: after a letter they start a token.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Latin, Greek and Cyrillic end here.
PLAIN_UNTIL = "\u0530"

#: How byte-level vocabularies write bytes: printable ones of Latin-1 as themselves, the others from U+0100 on.
BYTES = {b: b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
BYTES |= {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(BYTES)))}
BLANK = chr(BYTES[32])

#: For every control byte, the lengths of its four codes.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of an array of whole numbers below 2**32."""
    r = ranks.astype("<u4")
    most = next(k for k in (1, 2, 3, 4) if k == 4 or not len(r) or int(r.max()) < 1 << 8 * k)
    size = np.ones(len(r), dtype=np.uint8)
    for k in range(1, most):
        size += r >= 1 << 8 * k
    raw = r.view(np.uint8).reshape(-1, 4)[:, :most]
    data = raw[np.arange(most, dtype=np.uint8) < size[:, None]]
    codes = np.zeros(-(-len(r) // 4) * 4, dtype=np.uint8)
    codes[: len(r)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    end = np.cumsum(size, dtype=np.int32)  # a frame is far shorter
    start = end - size
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = raw[start].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Words(dict):
    """Ids of words as bytes; a word that is not there yet is learned when it is first asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes | None:
        ids = self[word] = self.learn(self, word)
        return ids


class Encoder:
    """Ids of texts as little-endian 16- or 32-bit numbers, through a memory of words.

    `after` holds the ids of words with a blank before them, `first` of those without.
    """

    def __init__(self, path: str, capacity: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.capacity = capacity
        self.after = Words(self._after_blank)
        self.first = Words(self._at_start)
        self.feed = self._raw(["\n"])[0]
        # a word of letters is one token of the byte-level pre-tokenizer, so the library's model can take it as it is
        self.model = self.tokenizer.model if type(self.tokenizer.model).__name__ == "BPE" and self.tokenizer.normalizer is None else None

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, blank: str, word: str) -> bytes:
        # letters of alphabets that all libraries class alike
        if self.model is not None and word.isalpha():
            if word.isascii():
                return array(self.code, [t.id for t in self.model.tokenize(BLANK + word if blank else word)]).tobytes()
            if max(word) < PLAIN_UNTIL:
                return array(self.code, [t.id for t in self.model.tokenize((blank + word).encode().decode("latin-1").translate(BYTES))]).tobytes()
        return self._raw([blank + word])[0]

    def _parts(self, known: Words, blank: str, word: str) -> bytes:
        stem = word.rstrip(MARKS)
        if len(stem) < len(word) and stem[-1:].isalpha():
            return known[stem] + self.first[word[len(stem) :]]
        return self._word(blank, word)

    def _after_blank(self, known: Words, word: str) -> bytes | None:
        # a blank alone, or before another, belongs to what stands beside it
        return None if not word or word[0].isspace() else self._parts(known, " ", word)

    def _at_start(self, known: Words, word: str) -> bytes:
        return self._parts(known, "", word) if word else b""

    def _lines(self, text: str) -> list[tuple[str, list[str]]] | None:
        """The first and the other words of each line, or None where a line feed does not stand alone between characters."""
        lines = text.split("\n")
        for k, line in enumerate(lines):
            if not line or (k and line[0].isspace()) or (k + 1 < len(lines) and line[-1].isspace()):
                return None
        return [(w[0], w[1:]) for w in [line.split(" ") for line in lines]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        for known in (self.after, self.first):
            if len(known) > self.capacity:  # short words recur most
                kept = {w: ids for w, ids in known.items() if len(w) <= 5}
                known.clear()
                known.update(kept if len(kept) < self.capacity // 2 else {})
        first, after = self.first.__getitem__, self.after.__getitem__
        out: list[bytes | None] = []
        whole: list[int] = []
        for k, text in enumerate(texts):
            lines = self._lines(text)
            try:
                out.append(self.feed.join([first(head) + b"".join(map(after, tail)) for head, tail in lines]))
            except TypeError:  # the text, or a word of it, has no boundaries of its own
                out.append(None)
                whole.append(k)
        for k, raw in zip(whole, self._raw([texts[k] for k in whole])):
            out[k] = raw
        return out


#: Module of a worker that holds its encoders by path; functions of this package come anew with every task.
STATE = "textindex_spark_worker"


def held_encoder(path: str) -> Encoder:
    """This worker's encoder: it and the words it knows outlive a task."""
    held = sys.modules.setdefault(STATE, types.ModuleType(STATE)).__dict__.setdefault("encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def _encoded(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_encoder(path)
        end = b"" if end_id is None else array(encoder.code, [end_id]).tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 64):
                ids = [x + end for x in encoder.encode([t or "" for t in texts[a : a + 64]])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 64), pa.array([len(x) // encoder.width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def _counted(width: int):
    """Counts of ids of a whole partition: one row for each id that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            counts = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=f"<u{width}"), minlength=len(total))
            counts[: len(total)] += total
            total = counts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return run


def _framed(width: int, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, frame, docs, size = TaskContext.get().partitionId(), 0, [], 0
        rank = ranks.value

        def flush() -> pa.RecordBatch:
            control, data = encode_ranks(rank[np.frombuffer(b"".join(x[1] for x in docs), dtype=f"<u{width}")])
            counts = [len(x[1]) // width for x in docs]
            return pa.RecordBatch.from_pylist([{"shard": shard, "frame": frame, "n_ids": sum(counts), "doc_ids": [x[0] for x in docs], "counts": counts, "control": control, "data": data}], schema=FRAMES)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append((doc_id, raw))
                size += len(raw) // width
                if len(docs) == FRAME_DOCS or size >= FRAME_IDS:
                    yield flush()
                    frame, size = frame + 1, 0
                    docs.clear()
        if docs:
            yield flush()

    return run


FRAMES = pa.schema([("shard", pa.int32()), ("frame", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
FRAMES_DDL = "shard int, frame int, n_ids long, doc_ids array<long>, counts array<long>, control binary, data binary"


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = END_ID) -> None:
    """Encode (doc_id, text) rows and write a store at path.

    The first pass writes plain ids, since ranks need the counts of the whole corpus. The rank table has a row for each
    id of the vocabulary at most; it is what is collected and broadcast.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    width = Encoder(tokenizer, 0).width
    raw = f"{path}/raw"
    docs.mapInArrow(_encoded(tokenizer, end_id), "doc_id long, n_tokens long, ids binary").write.option("compression", "zstd").parquet(raw)
    ids = spark.read.schema("doc_id long, n_tokens long, ids binary").parquet(raw)
    counts = ids.select("ids").mapInArrow(_counted(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values(["n", "id"], ascending=[False, True])
    rank = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, dtype=np.uint32)
    rank[counts["id"].to_numpy()] = np.arange(len(counts), dtype=np.uint32)
    spark.createDataFrame([(i, int(x), int(n)) for i, (x, n) in enumerate(zip(counts["id"], counts["n"]))], "rank int, id long, n long").coalesce(1).write.parquet(f"{path}/vocab")
    shared = spark.sparkContext.broadcast(rank)
    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.select("doc_id", "ids").mapInArrow(_framed(width, shared), FRAMES_DDL).write.option("compression", "none").parquet(f"{path}/frames")
    _remove(spark, raw)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _digested(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = table.value[decode_ranks(row["control"], row["data"], row["n_ids"])].astype("<u4")
                ends = np.cumsum(row["counts"], dtype=np.int64)
                starts = ends - np.asarray(row["counts"], dtype=np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"]), pa.array(row["counts"], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_store(spark: SparkSession, path: str, decode=_digested, out: str = "doc_id long, start long, n_tokens long, ids_crc32 long") -> DataFrame:
    """Rows made from the decoded frames; decode gets the broadcast table of ids by rank and rows with `start`.

    `start`, the number of ids before a frame, comes from one running sum over shards (a row for each file) and one
    inside each shard.
    """
    from pyspark.sql import Window

    vocab = spark.read.schema("rank int, id long, n long").parquet(f"{path}/vocab").orderBy("rank").toPandas()
    frames = spark.read.schema(FRAMES_DDL).parquet(f"{path}/frames")
    sizes = frames.select("shard", "frame", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard").select("shard", "frame", (F.col("base") + F.col("inside")).alias("start"))
    table = spark.sparkContext.broadcast(vocab["id"].to_numpy(dtype=np.uint32))
    return frames.join(starts, ["shard", "frame"]).select("start", "n_ids", "doc_ids", "counts", "control", "data").mapInArrow(decode(table), out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_store(spark, sf_dir) -> DataFrame:
    path = new_path(spark, "token-store")
    write_store(read_table(spark, sf_dir, "documents"), default_tokenizer(), path)
    return read_store(spark, path)
