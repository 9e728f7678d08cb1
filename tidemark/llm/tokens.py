"""Encoding of whole texts with a public byte-level BPE tokenizer, and back.

Texts stream through the tokenizers library in Arrow batches; a task loads the vocabulary
once. A vocabulary entry spells its bytes in printable characters, so the table from
entry to bytes is reversed for decoding and gives each token's place in bytes; a
token may hold part of a character, and its place in characters then covers the whole one.
"""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# Texts longer than this are encoded in pieces, and a call of the library gets no more than this at once.
PIECE = 1 << 16


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file; what looks like a special token is ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def byte_characters() -> dict[str, int]:
    """The byte that each character of a vocabulary entry stands for.

    Printable Latin-1 bytes stand for themselves, the others for the code points from 256 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def byte_table(path: str) -> dict[int, bytes]:
    """The bytes of every id of the vocabulary."""
    stands = byte_characters()
    table = {}
    for entry, number in load(path).get_vocab(with_added_tokens=True).items():
        table[number] = bytes(stands[c] for c in entry) if all(c in stands for c in entry) else entry.encode()
    return table


def pieces(text: str, size: int = PIECE) -> list[str]:
    """A long text in pieces that are encoded as they would be within it.

    A piece starts at a single space between two other characters. There the
    tokenizer's word pattern always starts a new word, so no merge crosses it. A stretch
    without such a place stays whole.
    """
    out, at = [], 0
    while len(text) - at > size:
        to = at + size
        while (to := text.find(" ", to)) != -1:
            if to + 1 < len(text) and not text[to - 1].isspace() and not text[to + 1].isspace():
                break
            to += 1
        if to == -1:
            break
        out.append(text[at:to])
        at = to
    out.append(text[at:])
    return out


def encode(texts: list[str], path: str = TOKENIZER, size: int = PIECE) -> Iterator[np.ndarray]:
    """The ids of each text, without special tokens; an empty text has none."""
    tokenizer = load(path)
    waiting: list[tuple[int, str]] = []
    parts: list[list] = []
    held, first = 0, 0

    def flush() -> Iterator[np.ndarray]:
        nonlocal held, first, parts
        for (which, _), found in zip(waiting, tokenizer.encode_batch_fast([t for _, t in waiting], add_special_tokens=False), strict=True):
            parts[which - first].append(np.array(found.ids, np.int32))
        for own in parts:
            yield np.concatenate(own) if own else np.zeros(0, np.int32)
        first += len(parts)
        parts, held = [], 0
        waiting.clear()

    for k, text in enumerate(texts):
        parts.append([])
        for piece in pieces(text, size) if text else ():
            waiting.append((k, piece))
            held += len(piece)
            if held >= size and len(waiting) >= 64 or held >= 16 * size:
                # Encoded now, so that one very long text is not held by the library as a whole.
                for (which, _), found in zip(waiting, tokenizer.encode_batch_fast([t for _, t in waiting], add_special_tokens=False), strict=True):
                    parts[which - first].append(np.array(found.ids, np.int32))
                waiting.clear()
                held = 0
        if not waiting and len(parts) >= 64:
            yield from flush()
    yield from flush()


def decode(ids: list[int], path: str = TOKENIZER) -> str:
    """The text of a list of ids. Bytes that end within a character become U+FFFD; unknown ids are left out."""
    table = byte_table(path)
    return b"".join(table.get(i, b"") for i in ids).decode("utf-8", "replace")


def decode_stream(ids: list[int], path: str = TOKENIZER) -> list[str]:
    """What each id adds to the text; a character split over several ids comes with the last of them."""
    table, decoder = byte_table(path), codecs.getincrementaldecoder("utf-8")("replace")
    return [decoder.decode(table.get(i, b""), final=k == len(ids) - 1) for k, i in enumerate(ids)]


def spans(text: str, ids: np.ndarray, path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """The first character of each token and the one after its last."""
    if not len(ids):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    table = byte_table(path)
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum([len(table[i]) for i in ids.tolist()])
    starts = np.concatenate([[0], ends[:-1]])
    return character[starts].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)


def _texts(column: pa.Array) -> list[str]:
    return [(b or b"").decode("utf-8", "replace") for b in column.to_pylist()]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _mapped(documents: DataFrame, keep: list[str], shape: str, make) -> DataFrame:
    """``keep`` and what ``make(texts)`` gives of each batch; only these columns and the text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A batch may hold many long texts: its result is handed on in parts of bounded size.
            sizes, at = np.array([len(b or b"") for b in (x.as_py() for x in batch.column(len(keep)))]), 0
            while at < batch.num_rows:
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 64 * PIECE, side="right")))
                part = batch.slice(at, to - at)
                columns = make(_texts(part.column(len(keep))))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns.values()], names=[*keep, *columns])
                at = to

    source = documents.select(*keep, F.col("text").cast("binary").alias("text"))
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), shape]))


def encode_corpus(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids`` of every row; null and empty texts have an empty list.

    Bytes that are not UTF-8 count as U+FFFD. Other columns are not read.
    """
    return _mapped(documents, ["doc_id"], "ids array<int>", lambda texts: {"ids": _lists(list(encode(texts, path)))})


def encode_with_offsets(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids, starts, ends`` with each token's characters, counted in code points."""

    def make(texts: list[str]) -> dict:
        ids = list(encode(texts, path))
        places = [spans(t, i, path) for t, i in zip(texts, ids, strict=True)]
        return {"ids": _lists(ids), "starts": _lists([a for a, _ in places]), "ends": _lists([b for _, b in places])}

    return _mapped(documents, ["doc_id"], "ids array<int>, starts array<int>, ends array<int>", make)


def count_tokens(documents: DataFrame, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of ids of the text."""
    return _mapped(documents, keep, "tokens bigint", lambda texts: {"tokens": pa.array([len(i) for i in encode(texts, path)], pa.int64())})


def decode_corpus(encoded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids``; a null list is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(ids or [], path) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, tokens, whole``: whether decoding gives back the text, and its places join to it."""

    def make(texts: list[str]) -> dict:
        counts, whole = [], []
        for text, ids in zip(texts, encode(texts, path), strict=True):
            starts, ends = spans(text, ids, path)
            joined = len(ids) == 0 and not text or len(ids) > 0 and starts[0] == 0 and ends[-1] == len(text) and bool((starts[1:] <= ends[:-1]).all())
            counts.append(len(ids))
            whole.append(joined and decode(ids.tolist(), path) == text and "".join(decode_stream(ids.tolist(), path)) == text)
        return {"tokens": pa.array(counts, pa.int64()), "whole": pa.array(whole, pa.bool_())}

    return _mapped(documents, ["doc_id"], "tokens bigint, whole boolean", make)
