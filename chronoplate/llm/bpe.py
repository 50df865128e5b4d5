"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are encoded in Arrow batches. A text longer than `LONG` characters is cut first at safe boundaries: places where a
blank follows a non-blank. No alternative of the split pattern matches a non-blank followed by a blank, so a match always
ends there, and the look-ahead of the pattern only looks past blanks; the parts give the ids of the whole text.

Null and empty texts give an empty list of ids. Special tokens are never produced; their strings are plain text. Decoding
joins the raw bytes of the ids, so that it returns the UTF-8 bytes of the text even if an id ends inside a character.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoplate.llm.common import arrow_map

LONG = 65_536
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


def default_ranks() -> tuple[str, str]:
    """Path of the 50k rank file, and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@functools.lru_cache(4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file; made once in each worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = LONG) -> Iterator[str]:
    """Pieces of about `size` characters, cut at safe boundaries only (so longer where there is none)."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for part in parts(text) for i in enc.encode_ordinary(part)]


def _encoded(enc, texts: pa.Array) -> pa.ListArray:
    lists = [np.array(encode_text(enc, t), dtype=np.int32) for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _decoded(enc, ids: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """(packed, decoded) of lists of ids."""
    values = [np.asarray(x.values if x.is_valid else [], dtype="<u4") for x in ids]
    return pa.array([v.tobytes() for v in values], pa.binary()), pa.array([enc.decode_bytes(v.tolist()) for v in values], pa.binary())


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """`key` and `ids` array<int> of every whole text. Repeated and null keys are kept as they are; other columns don't pass."""
    given = default_ranks()
    rank_file, pattern = rank_file or given[0], pattern or given[1]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), _encoded(encoding(rank_file, pattern), batch.column(1))], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(docs[key].alias("key"), docs[text].alias("text")), "text", f"key {kind}, ids array<int>", work).withColumnRenamed("key", key)


def decode(coded: DataFrame, key: str = "doc_id", ids: str = "ids", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """`key`, `ids`, `packed` binary (ids as little-endian unsigned 32-bit integers) and `decoded` binary (raw bytes of the ids). Null ids decode to no bytes; an unknown id raises KeyError."""
    given = default_ranks()
    rank_file, pattern = rank_file or given[0], pattern or given[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([*batch.columns, *_decoded(enc, batch.column(1))], names=["key", "ids", "packed", "decoded"])

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(coded[key].alias("key"), coded[ids].alias("ids")).mapInArrow(run, f"key {kind}, ids array<int>, packed binary, decoded binary").withColumnRenamed("key", key)


def encode_and_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """What decode(encode(docs)) returns, by one Python worker a task instead of two that each hold the ranks."""
    given = default_ranks()
    rank_file, pattern = rank_file or given[0], pattern or given[1]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(rank_file, pattern)
        ids = _encoded(enc, batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), ids, *_decoded(enc, ids)], names=["key", "ids", "packed", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(docs[key].alias("key"), docs[text].alias("text")), "text", f"key {kind}, ids array<int>, packed binary, decoded binary", work).withColumnRenamed("key", key)
