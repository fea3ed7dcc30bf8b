"""Encoding of texts with a public byte-level BPE vocabulary.

Method: the tiktoken library with a local rank file. Long texts are cut before encoding at places where the
vocabulary's pattern always starts a new piece, so that no call holds a huge text and the ids stay those of the whole
text; a stretch without such a place (one run of letters, say) goes to the library whole, which merges it in n log n. Ids are
turned back into texts by their raw bytes. The driver ships the rank file to the executors, which needn't have it.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files where no parameter and no setting names another.
DEFAULT_FOLDER = "/opt/tokenizers"
#: The pattern that splits text before the merges of the byte-level vocabularies (public, see the vocabularies' README).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters up to which a text goes to the library whole.
WHOLE_TEXT = 100_000


def rank_file(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("TOKENIZER_DIR", DEFAULT_FOLDER), f"{name}.tiktoken")


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def _safe_cut():
    import regex

    return regex.compile(r"(?<=\S) (?=\S)")


def cut_long(text: str, size: int = WHOLE_TEXT) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut only before a single blank between two other characters."""
    blank, at = _safe_cut(), 0
    while len(text) - at > size:
        m = blank.search(text, at + size - 1)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str | None, path: str) -> list[int]:
    """Ids of a text; a null or empty text has none."""
    if not text:
        return []
    if len(text) <= WHOLE_TEXT:
        return encoding(path).encode_ordinary(text)
    return [i for part in cut_long(text) for i in encoding(path).encode_ordinary(part)]


def decode(ids: list[int], path: str) -> bytes:
    """The bytes that ids stand for: those of the text, whole, even where single ids cut through a character."""
    return encoding(path).decode_bytes(ids)


def _shipped(rows: DataFrame, path: str) -> str:
    rows.sparkSession.sparkContext.addFile(path)
    return path


def _encoded(shipped: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(os.path.basename(shipped))
        for b in batches:
            got = [encode(t, path) for t in b.column(1).to_pylist()]
            if counts:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, got), pa.int64())], ["key", "tokens"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], ["key", "ids"])

    return run


def token_ids(texts: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>): one row for each row of the table, ids without special tokens, of the text exactly as stored.

    Defined cases: a null text and an empty one both have the empty list; texts of any length are encoded whole; the strings of special
    tokens are ordinary text; repeated rows and null keys are kept as they are; other columns are ignored. No shuffle takes place.
    """
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(_shipped(rows, rank_file(tokenizer, folder)), False), f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>")


def token_counts(texts: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, tokens BIGINT): the number of ids of each text, with ``token_ids``'s cases."""
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(_shipped(rows, rank_file(tokenizer, folder)), True), f"key {rows.schema['key'].dataType.simpleString()}, tokens bigint")
