"""Packing documents into sequences of bounded length (operator 7).

Each text is tokenised and closed with the end id.  Whatever fills a sequence
alone is cut off its front, so every piece is at most ``limit`` long.  Pieces,
a few numbers each, are dealt by a hash of their place into groups of bounded size, and every
group runs first-fit decreasing by itself: pieces in falling length go to the
first bin with room, found by descending a tournament tree whose nodes hold
the most room below them.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed each for itself; a null id is kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbpe
from .common import arrow_batches, by_size, durable, emit, id_and_text

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
_PLACED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pieces_of(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        bpe = wordbpe.load(path)
        for t in by_size(batches):
            ids, counts = bpe.encode_flat(t["text"].combine_chunks())
            tokens = counts + 1
            many = -(-tokens // limit)
            row = np.repeat(np.arange(len(many)), many)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * limit
            length = np.minimum(tokens[row] - start, limit)
            at = (np.cumsum(counts) - counts)[row] + start
            last = start + length == tokens[row]
            raw = memoryview(ids).cast("B")
            # The end id of a document is never stored, its checksum goes on from that of the ids before it.
            crc = [crc32(end, c) if z else c for c, z in zip((crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length - last).tolist())), last.tolist())]
            yield from emit({"doc_id": t["doc_id"].combine_chunks().take(pa.array(row)), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": tokens[row]}, _PIECE)

    arrow_batches(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECE)


class Tournament:
    """Bins of equal capacity; the winner of every match is the one with more room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first bin with that much room, which then has so much less."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        chosen = node - self.leaves
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return chosen


def first_fit_decreasing(lengths: list[int], limit: int) -> list[int]:
    """The bin of each length; lengths in falling order."""
    tree = Tournament(max(1, len(lengths)), limit)
    return [tree.first(n) for n in lengths]


def _place(table: pa.Table, group: int, limit: int) -> pa.Table:
    rows = sorted(table.select(_PIECE.names).to_pylist(), key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids_crc32"]))
    bins = first_fit_decreasing([r["length"] for r in rows], limit)
    filled = [0] * (max(bins, default=-1) + 1)
    for r, b in zip(rows, bins):
        r["sequence_id"], r["offset"] = (group << 32) + b, filled[b]
        filled[b] += r["length"]
    return pa.Table.from_pylist(rows, schema=_PLACED)


def pack(pieces: DataFrame, limit: int = 4096, group_pieces: int = 16_384, seed: int = 7) -> DataFrame:
    """The pieces with sequence_id and offset; ``pieces`` must be cheap to read twice."""
    groups = -(-pieces.count() // group_pieces) or 1
    # By the row's place, as equal rows without id have nothing else that differs.
    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))

    def run(key, table):
        return _place(table, key[0].as_py(), limit)

    return dealt.groupBy("bin_group").applyInArrow(run, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 2, group_pieces: int = 16_384) -> DataFrame:
    """Tokenise, cut and pack; the pieces are kept in the shared folder between the two passes."""
    return pack(durable(pieces_of(docs, path, limit, end_id)), limit, group_pieces)
