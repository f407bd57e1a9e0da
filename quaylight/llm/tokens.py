"""Encoding of a corpus with a public tokenizer.

The vocabulary is read from a file (``TOKENIZER_DIR`` by default, a parameter
everywhere); each Python worker loads it once.  Encoding streams over Arrow
batches without a shuffle, so any corpus is one narrow stage.

A byte-level vocabulary writes each byte as a printable character.  The table from
those characters back to bytes gives every token's bytes, hence its length; running
lengths over a text give byte offsets, and counting the leading bytes of the UTF-8
form turns them into character offsets.  A token that holds only part of a
character gets that character's whole span.

Defined results: null and empty texts both give empty lists; blank texts are
encoded like any other; special tokens are never added and their names inside a text
are ordinary text; lone surrogates can't occur in Spark strings.  Rows are
independent: repeated rows give repeated results, other columns pass untouched.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = f"{TOKENIZER_DIR}/byte_bpe_50k.json"
RANKS_50K = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text encoded in one call of the library.
CHUNK_CHARS = 1_000_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=4)
def _ranks(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_table() -> dict[str, int]:
    """Printable stand-in of each byte: itself if printable, else the next free code point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table, vocab = byte_table(), spec["model"]["vocab"]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    out = [b""] * (max(vocab.values()) + 1)
    for s, i in vocab.items():
        out[i] = s.encode() if s in special else bytes(table[c] for c in s)
    return out


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield texts[lo:]


def encode_texts(texts: list[str | None], path: str = BYTE_BPE_50K) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the bounds of each text in it.

    A text that recurs within the batch is encoded once.
    """
    t = _tokenizer(path)
    distinct = {x: None for x in texts if x}
    for part in _chunks(list(distinct)):
        for x, e in zip(part, t.encode_batch_fast(part, add_special_tokens=False)):
            distinct[x] = np.array(e.ids, np.int32)
    none = np.empty(0, np.int32)
    per = [distinct[x] if x else none for x in texts]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(p) for p in per], out=bounds[1:])
    return (np.concatenate(per) if per else none), bounds


def char_spans(text: str, ids: np.ndarray, path: str = BYTE_BPE_50K) -> tuple[np.ndarray, np.ndarray]:
    """Character span of each token of ``text``: first character, and one past the last."""
    size = np.array([len(b) for b in token_bytes(path)])[ids]
    end = np.cumsum(size)
    raw = np.frombuffer(text.encode(), np.uint8)
    char_no = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    return char_no[end - size].astype(np.int32), char_no[end - 1].astype(np.int32) + 1


def encode(df: DataFrame, text: str, key: list[str], path: str = BYTE_BPE_50K, spans: bool = False) -> DataFrame:
    """The ``key`` columns and ``ids``, with ``starts`` and ``ends`` in characters if ``spans``."""
    kept = T.StructType([df.schema[k] for k in key])
    fields = [T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in (["ids", "starts", "ends"] if spans else ["ids"])]
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(n).to_pylist()
            ids, bounds = encode_texts(texts, path)
            at = pa.array(bounds.astype(np.int32))
            cols = [pa.ListArray.from_arrays(at, pa.array(ids))]
            if spans:
                both = [char_spans(t, ids[bounds[i] : bounds[i + 1]], path) if t else (np.empty(0, np.int32),) * 2 for i, t in enumerate(texts)]
                cols += [pa.ListArray.from_arrays(at, pa.array(np.concatenate([x[k] for x in both]) if both else np.empty(0, np.int32))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *cols], names=[*key, *(f.name for f in fields)])

    return df.select(*key, F.col(text).cast("string").alias("__text")).mapInArrow(run, T.StructType([*kept.fields, *fields]))


def decode(ids: Column, path: str = BYTE_BPE_50K) -> Column:
    """Text of a list of ids; bytes of a character that the list cuts become U+FFFD. Null stays null."""

    @F.pandas_udf("string")
    def run(col):
        table = token_bytes(path)
        return col.map(lambda x: None if x is None else b"".join(table[i] for i in x).decode("utf-8", "replace"))

    return run(ids)


def token_counts(df: DataFrame, text: str, key: list[str], ranks: str = RANKS_50K) -> DataFrame:
    """The ``key`` columns and ``n_tokens``; null and empty texts have 0.

    Counting needs no ids out of the worker; the rank form of the same vocabulary is
    read by the faster library.
    """
    kept = T.StructType([*(df.schema[k] for k in key), T.StructField("n_tokens", T.LongType())])
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _ranks(ranks)
        for b in batches:
            seen: dict[str, int] = {}
            out = []
            for t in b.column(n).to_pylist():
                if t and t not in seen:
                    seen[t] = len(e.encode_ordinary(t))
                out.append(seen[t] if t else 0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(out, pa.int64())], names=kept.names)

    return df.select(*key, F.col(text).cast("string").alias("__text")).mapInArrow(run, kept)
