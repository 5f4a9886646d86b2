"""BPE encoding and decoding over a DataFrame (operator 2).

``encode`` keeps each text's ids as little-endian unsigned 32-bit integers in a
binary column, ``decode`` turns such a column back into text.  The work is
narrow: no shuffle, one trie for each group of texts inside a task (see
``wordbpe``).

Defined cases: a null text is empty; an empty text has no ids and decodes to
the empty string; strings of special tokens inside a text become their ids, as
the library does by default; repeated rows give repeated results; a null id is
kept; columns beyond id and text are ignored, whatever their names.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from . import wordbpe
from .common import arrow_batches, by_size, emit, id_and_text


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (binary)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        bpe = wordbpe.load(path)
        for t in by_size(batches):
            yield from emit({"doc_id": t["doc_id"], "ids": bpe.encode_group(t["text"].to_pylist())}, schema)

    arrow_batches(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of ``encode``: doc_id, ids, decoded (the text of the ids, special tokens kept)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        bpe = wordbpe.load(path)
        for t in by_size(batches, "ids"):
            texts = []
            for ids in t["ids"].to_pylist():
                numbers = array("I")
                numbers.frombytes(ids or b"")
                texts.append(bpe.decode(numbers))
            yield from emit({"doc_id": t["doc_id"], "ids": t["ids"], "decoded": texts}, schema)

    arrow_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass through Python."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        bpe = wordbpe.load(path)
        for t in by_size(batches, limit=6_000_000):
            ids = bpe.encode_group(t["text"].to_pylist())
            for k in range(0, len(ids), 256):
                part = ids[k : k + 256]
                yield from emit({"doc_id": t["doc_id"].slice(k, len(part)), "ids": part, "decoded": [bpe.decode(array("I", x)) for x in part]}, schema)

    arrow_batches(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")
