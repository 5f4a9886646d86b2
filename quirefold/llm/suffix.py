"""Repeated passages by a sparse suffix array (operator 10).

A text is its words.  Of every window of ``WINDOW`` runs of ``GRAM`` words the
run with the smallest hash is a minimiser; only suffixes that begin at
minimisers are kept, and equal passages keep the same ones.  Suffixes whose
first run occurs in one text only can have no partner and go.

A passage of ``LEAST`` words belongs to the suffix at its own smallest run,
which lies at the same place in every holder.  Each suffix carries ``LEAST``
words to either side and is sorted over the cluster; passages that agree to the
right lie together, and those that agree to the left as well are the same one,
whatever follows it.  It is a repeated stretch of all its documents, and its
words are removable in all but the smallest.  Where another passage overlaps it
there, a still smaller document may keep those words, so each word stays, though
not each passage in one piece.  Stretches that touch and fare alike are joined.

Exact copies are one text in the sorting; each copy is a repeat as a whole.
Sorting is by range with the document as the last key, so a passage that very
many documents share is spread over tasks.  Passages whose words to the right
are those at the border of a batch or a task may go on beyond it: of each, the
occurrences in the batch's smallest document are grouped over the cluster.
Seeds that very many suffixes have do not meet in one task (``common.join_keys``).

Defined cases: a null or empty text, or one of fewer than ``LEAST`` words, has
no repeat; rows with the same id are one document, of which one text takes
part; rows without id take no part; a passage repeated only inside one
document is no repeat; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, by_size, durable, emit, id_and_text, join_keys
from .words import grams, mix, signed, word_hashes

LEAST, GRAM, WINDOW = 50, 10, 32


def minimisers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes of the runs that begin there), positions rising."""
    if len(hashes) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = grams(hashes, GRAM)
    if len(runs) <= WINDOW:
        at = np.array([runs.argmin()])
    else:
        at = np.unique(sliding_window_view(runs, WINDOW).argmin(1) + np.arange(len(runs) - WINDOW + 1))
    return at, runs[at]


def owned(at: np.ndarray, runs: np.ndarray, n_words: int) -> tuple[list[int], list[int]]:
    """Of each minimiser, the first and last place where a passage starts whose smallest run, of equals the first, it is; last < first where there is none."""
    at, runs = at.tolist(), runs.tolist()
    span = LEAST - GRAM + 1
    first = [0] * len(at)
    last = [min(p, n_words - LEAST) for p in at]
    smaller: list[int] = []
    for i, p in enumerate(at):
        while smaller and runs[smaller[-1]] > runs[i]:
            k = smaller.pop()
            last[k] = min(last[k], p - span)
        first[i] = max(0, p - span + 1, at[smaller[-1]] + 1 if smaller else 0)
        smaller.append(i)
    return first, last


def contexts(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words to the right and, nearest first, to the left of each position; 0 beyond the text."""
    own = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    padded = np.concatenate([np.zeros(LEAST, np.uint32), own, np.zeros(LEAST, np.uint32)])
    view = sliding_window_view(padded, LEAST)
    return view[at + LEAST], view[at][:, ::-1]


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading words that agree, row by row."""
    return np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(axis=1)


_MATCH = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("other", pa.int64())])
_OUT = pa.schema([*_MATCH, ("left", pa.int64()), ("right", pa.int64())])


def _prefixes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the first 0 to n words of each row."""
    out = np.zeros((n + 1, len(words)), np.uint64)
    for k in range(n):
        out[k + 1] = mix(out[k] ^ words[:, k].astype(np.uint64))
    return out


def _unpack(t: pa.Table, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(t[column].to_pylist()), ">u4").astype(np.uint32).reshape(-1, LEAST)


def _pack(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(rows).astype(">u4")]


def _repeats(t: pa.Table) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Repeated stretches among sorted suffixes; passages that may go on beyond them."""
    right, left = _unpack(t, "right"), _unpack(t, "left")
    docs, at, first, last = (t[c].to_numpy() for c in ("doc_id", "at", "first", "last"))
    many = last - first + 1
    row = np.repeat(np.arange(len(docs)), many)
    start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    before = at[row] - start
    doc = docs[row]
    to_left, to_right = _prefixes(left, LEAST - GRAM)[before, row], _prefixes(right, LEAST)[LEAST - before, row]
    key = mix(to_left ^ mix(to_right))
    order = np.lexsort((doc, key))
    key, by = key[order], doc[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(key))))
    smallest = by[head][group] == by
    second = head + np.add.reduceat(smallest, head)
    shared = second < np.append(head[1:], len(key))
    other = np.where(smallest, by[np.minimum(second, len(key) - 1)][group], by[head][group])
    partner, found, least = np.empty_like(other), np.empty(len(key), bool), np.empty(len(key), bool)
    partner[order], found[order], least[order] = other, shared[group], smallest

    edge = LEAST - before <= np.maximum(_same(right, right[:1]), _same(right, right[-1:]))[row]
    ask = edge & least
    asked = {"doc_id": doc[ask], "start": start[ask], "end": start[ask] + LEAST, "left": to_left[ask].view(np.int64), "right": to_right[ask].view(np.int64)}
    row, start, doc, partner = row[found], start[found], doc[found], partner[found]
    new = np.ones(len(row) + 1, bool)
    new[1:-1] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (partner[1:] != partner[:-1])
    a, b = np.flatnonzero(new)[:-1], np.flatnonzero(new)[1:] - 1
    return {"doc_id": doc[a], "start": start[a], "end": start[b] + LEAST, "other": partner[a]}, asked


def _scan(batches):
    for t in by_size(batches, "right", 4_000_000):
        found, asked = _repeats(t)
        for part in (found, asked):
            n = len(part["doc_id"])
            if n:
                yield from emit({name: pa.nulls(n, pa.int64()) for name in _OUT.names} | part, _OUT)


def _merge(doc_id: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches (start, end, smallest other document) without overlap, cut where that document turns larger or smaller than this.

    The partner is kept for each word, so a smaller one takes only the words it
    has, and the others stay in the smallest document that has them.
    """
    free = np.iinfo(np.int64).max
    least = np.full(max(e for _, e, _ in spans), free)
    for s, e, other in spans:
        np.minimum(least[s:e], other, out=least[s:e])
    state = (least < free).astype(np.int8) + (least < doc_id)
    cuts = np.flatnonzero(np.diff(state, prepend=0, append=0)).tolist()
    return [(s, e, int(least[s:e].min())) for s, e in zip(cuts, cuts[1:]) if state[s]]


_PASSAGE = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("other_doc_id", pa.int64()), ("removable", pa.bool_())])
PASSAGE = "doc_id long, start_word long, end_word long, other_doc_id long, removable boolean"


def _join_spans(batches):
    for t in by_size(batches, "weight", 1 << 17):
        out = {n: [] for n in _PASSAGE.names}
        for doc_id, spans in zip(t["doc_id"].to_pylist(), t["spans"].to_pylist()):
            for start, end, other in _merge(doc_id, [(x["start"], x["end"], x["other"]) for x in spans]):
                for n, v in zip(_PASSAGE.names, (doc_id, start, end, other, other < doc_id)):
                    out[n].append(v)
        yield from emit(out, _PASSAGE)


_SEEDS = pa.schema([("doc_id", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("n_words", pa.int64()), ("seeds", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32()))])


def _seed(batches):
    for t in by_size(batches, limit=2_000_000):
        out = {n: [] for n in _SEEDS.names}
        for doc_id, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist()):
            words = text.split()
            if len(words) < LEAST:
                continue
            h = np.frombuffer(xxhash.xxh3_128_digest(" ".join(words).encode()), ">i8")
            at, runs = minimisers(word_hashes(words))
            first, last = map(np.array, owned(at, runs, len(words)))
            some = first <= last
            places = (x[some].astype(np.int32) for x in (at, first, last))
            for n, v in zip(_SEEDS.names, (doc_id, int(h[0]), int(h[1]), len(words), signed(runs[some]), *places)):
                out[n].append(v)
        yield from emit(out, _SEEDS)


_CONTEXT = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("right", pa.binary()), ("left", pa.binary())])


def _context(batches):
    for t in by_size(batches, limit=500_000):
        out = {n: [] for n in _CONTEXT.names}
        for doc_id, text, places in zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), t["places"].to_pylist()):
            at, first, last = np.array(sorted((p["at"], p["first"], p["last"]) for p in places), dtype=np.int64).T
            right, left = contexts(word_hashes(text.split()), at)
            out["doc_id"] += [doc_id] * len(at)
            for n, v in zip(("at", "first", "last"), (at, first, last)):
                out[n] += v.tolist()
            out["right"] += _pack(right)
            out["left"] += _pack(left)
        yield from emit(out, _CONTEXT)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The passages of ``LEAST`` words or more that another document has too, cut where ``removable`` changes.

    Columns: doc_id, start_word, end_word (white-space separated words, end
    excluded), other_doc_id (the smallest document it was found in),
    removable (that one is smaller).  A document without repeats has no row.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = id_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    if not texts.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    seeded = durable(texts.mapInArrow(_seed, "doc_id long, high long, low long, n_words long, seeds array<long>, at array<int>, first array<int>, last array<int>"))
    same = seeded.groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("copy"), F.min_by(F.struct("seeds", "at", "first", "last"), "doc_id").alias("s"), F.count(F.lit(1)).alias("n"))
    suffixes = same.select("rep", F.explode(F.arrays_zip("s.seeds", "s.at", "s.first", "s.last")).alias("x")).select("rep", F.col("x.seeds").alias("seed"), "x.at", "x.first", "x.last")
    suffixes = durable(suffixes)
    shared = suffixes.groupBy("seed").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("seed", "n")
    wanted = join_keys(suffixes, shared, ["seed"], suffixes.count()).groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list(F.struct("at", "first", "last")).alias("places"))
    rows = texts.join(wanted, "doc_id").mapInArrow(_context, "doc_id long, at long, first long, last long, right binary, left binary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(tasks, "right", "doc_id", "at").sortWithinPartitions("right", "doc_id", "at")
    found = durable(ordered.mapInArrow(_scan, "doc_id long, start long, end long, other long, left long, right long"))
    asked = found.where("left IS NOT NULL")
    alike = asked.groupBy("left", "right").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    asked = join_keys(asked, alike, ["left", "right"], asked.count())
    beyond = asked.withColumn("other", F.when(F.col("doc_id") == F.col("least"), F.col("most")).otherwise(F.col("least")))
    matches = found.where("left IS NULL").select(*_MATCH.names).union(beyond.select(*_MATCH.names))

    groups = same.where("rep < copy").select("high", "low", "rep", "copy", "n")
    whole = join_keys(seeded.select("doc_id", "high", "low", "n_words"), groups, ["high", "low"], seeded.count())
    whole = whole.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.when(F.col("doc_id") == F.col("rep"), F.col("copy")).otherwise(F.col("rep")).alias("other"))
    spans = matches.union(whole).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "other")).alias("spans"))
    return spans.select("doc_id", "spans", F.lit("x" * 64).alias("weight")).mapInArrow(_join_spans, PASSAGE)


def cut_passages(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given runs of words."""
    import re

    words = list(re.finditer(r"\S+", text))
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at : words[start].start()])
        at = words[end - 1].end()
    return "".join([*out, text[at:]])
