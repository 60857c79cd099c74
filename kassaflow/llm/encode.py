"""Encoding of a corpus by a public tokenizer, and back.

The tokenizer is a file of the ``tokenizers`` library; its path is a
parameter. Texts travel in Arrow batches; each Python worker task loads the
file once. Nothing is shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public tokenizers lie; a parameter of every operator here.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: Texts handed to the tokenizer at once hold about this many characters.
CHUNK_CHARS = 2_000_000


def byte_table() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others, in order, follow at 256.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # the special tokens' strings in a text are ordinary text
    t.no_truncation()
    t.no_padding()
    return t


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _lists(ids: Iterable[list[int]]) -> pa.ListArray:
    """Lists of ids as one array of offsets and one of values; a list is let go once it is copied."""
    parts = [np.array(x, np.int32) for x in ids]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens.

    Null and empty texts have the empty list. Every row gives one row, texts
    are encoded whole, repeated ones as often as they stand there. Other
    columns, whatever their names, play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(e.ids for part in _chunks(texts) for e in t.encode_batch_fast(part, add_special_tokens=False))], [doc_id, "ids"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")


def token_bytes(t) -> dict[int, bytes]:
    """The bytes that each id stands for."""
    table = byte_table()
    raw = {i: bytes(table[c] for c in s) for s, i in t.get_vocab().items() if all(c in table for c in s)}
    return raw | {i: s.content.encode() for i, s in t.get_added_tokens_decoder().items()}


def spans(text: str, sizes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each token, given by its number of bytes: first byte, first character, and the character behind its last.

    A token that begins or ends inside a character covers the whole character,
    so the tokens of a split character share it.
    """
    at, starts = 0, []
    for n in sizes:
        starts.append(at)
        at += n
    if text.isascii():
        return starts, starts, [*starts[1:], at] if starts else []
    char_of, n = [0] * (at + 1), 0
    i = 0
    for c in text:
        w = len(c.encode("utf-8"))
        char_of[i : i + w] = [n] * w
        i += w
        n += 1
    char_of[at] = n
    ends = [*starts[1:], at] if starts else []
    return starts, [char_of[s] for s in starts], [char_of[e - 1] + 1 if e > s else char_of[s] for s, e in zip(starts, ends)]


def encode_with_offsets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """``encode`` with, per token, byte_start, char_start and char_end in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        size = {i: len(x) for i, x in token_bytes(t).items()}
        ints = pa.list_(pa.int32())
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            out: list[list] = [[], [], [], []]
            for part in _chunks(texts):
                for x, e in zip(part, t.encode_batch_fast(part, add_special_tokens=False)):
                    got = (e.ids, *spans(x, [size[i] for i in e.ids]))
                    for col, v in zip(out, got):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, ints) for c in out]], [doc_id, "ids", "byte_start", "char_start", "char_end"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>, byte_start array<int>, char_start array<int>, char_end array<int>")


def _text(data: bytes) -> tuple[str, int]:
    """The text of bytes, U+FFFD for each incomplete character, and the number of bytes of those."""
    try:
        return data.decode("utf-8"), 0
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace"), len(data) - len(data.decode("utf-8", "ignore").encode("utf-8"))


def decode(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str = BYTE_BPE) -> DataFrame:
    """(doc_id, text, broken): ids back to text by the reversed byte table.

    A run of ids that was cut inside a character decodes to the whole
    characters, with U+FFFD for each incomplete one; ``broken`` counts the
    bytes concerned. Null and empty lists give the empty text; an unknown id
    raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = token_bytes(load(path))
        for b in batches:
            texts, broken = [], []
            for x in b.column(1).to_pylist():
                back, bad = _text(b"".join(raw[i] for i in x or []))
                texts.append(back)
                broken.append(bad)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(broken, pa.int32())], [doc_id, "text", "broken"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, ids).mapInArrow(run, f"`{doc_id}` {kind}, text string, broken int")


def round_trip(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(doc_id, n_tokens, broken, same): each text encoded, decoded again and compared, in one pass.

    Null texts count as empty ones, which have no tokens and are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        raw = token_bytes(t)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n, broken, same = [], [], []
            for part in _chunks(texts):
                for x, e in zip(part, t.encode_batch_fast(part, add_special_tokens=False)):
                    back, bad = _text(b"".join(map(raw.__getitem__, e.ids)))
                    n.append(len(e.ids))
                    broken.append(bad)
                    same.append(back == x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(broken, pa.int32()), pa.array(same, pa.bool_())], [doc_id, "n_tokens", "broken", "same"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens int, broken int, same boolean")
