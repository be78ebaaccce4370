"""Chat formatting with loss masks aligned by offsets.

A whole conversation is rendered as one string, encoded once, and the character spans of the turns to learn are
intersected with the tokens' character spans by binary search. A turn is rendered as

    <|turn|> role <|body|> text <|end|>     (without the blanks)

where the three markers are added tokens, so a token never straddles a marker and the mask of a span is exact. In roles
and texts a backslash is put behind every "<" that is followed by backslashes, or none, and "|"; so no marker can occur
in them, and taking one backslash out of every "<", backslashes, "|" restores them: the escape is reversible.

The output has a row for each conversation: the formatted string, ids, the mask as runs of token positions, and the
masked characters' spans.

Defined results: a null text or role is empty; a null conversation id is one conversation; turns are ordered by turn,
role, text, nulls first, so ties and repeated rows have a fixed order and are all kept; an empty text still has its
markers; an empty table gives no rows; extra columns are ignored. A conversation must fit a worker's memory, since it is
one row of the output; a worker holds one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
LEARNED_ROLE = "assistant"
OUT = "conv_id long, n_turns long, formatted string, ids array<int>, mask_starts array<int>, mask_ends array<int>, loss_starts array<int>, loss_ends array<int>"


def escape(s: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def unescape(s: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation, and where the texts of learned turns begin and end in it."""
    out, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        if role == LEARNED_ROLE:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.removesuffix(END).partition(BODY)
        turns.append((unescape(role), unescape(text)))
    return turns


def make_tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, BODY, END)])
    return tokenizer


def align(starts: list[int], ends: list[int], offsets: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Runs of tokens inside each span, and the characters that they cover. Spans and token offsets are sorted."""
    first = np.searchsorted(offsets[:, 0], starts, side="left")
    last = np.searchsorted(offsets[:, 1], ends, side="right")
    some = last > first
    first, last = first[some], last[some]
    return first.tolist(), last.tolist(), offsets[first, 0].tolist(), offsets[last - 1, 1].tolist()


def _formatted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make_tokenizer(path)
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), *((x, pa.list_(pa.int32())) for x in ("ids", "mask_starts", "mask_ends", "loss_starts", "loss_ends"))])

        def rows(done: list) -> pa.RecordBatch:
            rendered = [render(turns) for _, turns in done]
            out = []
            for (conv, turns), (text, starts, ends), e in zip(done, rendered, tokenizer.encode_batch([x[0] for x in rendered], add_special_tokens=False)):
                spans = align(starts, ends, np.array(e.offsets, dtype=np.int64).reshape(-1, 2))
                out.append(dict(zip(schema.names, (conv, len(turns), text, e.ids, *spans))))
            return pa.RecordBatch.from_pylist(out, schema=schema)

        done: list = []
        current, held = None, 0
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current[0] != conv:
                    if current:
                        done.append(current)
                    if held >= 1 << 20:
                        yield rows(done)
                        done, held = [], 0
                    current = (conv, [])
                current[1].append((role or "", text or ""))
                held += len(text or "")
        if current:
            yield rows([*done, current])

    return run


def format_chats(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, turn, role, text) rows to one formatted, encoded and masked row for each conversation."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_formatted(tokenizer), OUT)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            turns = parse(row["formatted"])
            loss = "".join(unescape(row["formatted"][a:b]) for a, b in zip(row["loss_starts"], row["loss_ends"]))
            digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
            out.append({"conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": digest("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(loss), "loss_sha256": digest(loss), "formatted_chars": len(row["formatted"]), "n_ids": len(row["ids"]), "n_loss_ids": sum(row["mask_ends"]) - sum(row["mask_starts"])})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(k, pa.string() if "sha" in k else pa.int64()) for k in DIGEST]))


DIGEST = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids", "n_loss_ids")


def op3_chat(spark, sf_dir) -> DataFrame:
    from .token_store import default_tokenizer

    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select(*extra.columns).unionByName(extra)
    stored = materialize(format_chats(rows, default_tokenizer()), "chats")
    return stored.mapInArrow(_digests, ", ".join(f"{k} {'string' if 'sha' in k else 'long'}" for k in DIGEST))
