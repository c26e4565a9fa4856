"""Token ids of whole texts by a public byte-level vocabulary.

The vocabulary file is a parameter (a path, or a name among the installed public tokenizers) and is read by each
Python worker. Special tokens' strings in a text are ordinary text. Long texts are encoded in pieces that are cut where
the splitting pattern always begins a new piece: before white space that follows something else, and after a letter
before a mark. Encoding the pieces one by one therefore gives the ids of the whole text.

Edge cases: null and empty texts give an empty list; texts of any length are encoded whole, with memory following the
piece size; repeated ids give repeated rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifthall.llm.chars import chunks

VOCABULARY = "byte_bpe_50k.tiktoken"
PIECE = 1 << 16
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}\p{N}])")


def vocabulary_path(vocabulary: str) -> str:
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


@cache
def encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only where it is safe; a stretch without a safe place stays whole."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, vocabulary: str = VOCABULARY) -> list[int]:
    if not text:
        return []
    enc = encoding(vocabulary)
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def decode(ids: list[int], vocabulary: str = VOCABULARY) -> bytes:
    """The bytes of ``ids``; as bytes, since a cut list of ids may end within a character."""
    return b"".join(encoding(vocabulary).decode_tokens_bytes(list(ids)))


def _run(vocabulary: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, texts in chunks(batch.column(1)):
                lists = [np.array(encode(t, vocabulary), dtype=np.int32) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), values], names=["doc_id", "ids"])

    return run


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids), one row per row of ``docs``."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run(vocabulary), "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, same): whether the ids' bytes are the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                coded = [encode(t, vocabulary) for t in texts]
                raw = [(t or "").encode() for t in texts]
                same = [decode(i, vocabulary) == b for i, b in zip(coded, raw, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(x) for x in coded], pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "n_bytes", "same"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, n_bytes bigint, same boolean")
