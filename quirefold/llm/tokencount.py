"""Token counts without token ids (operator 9).

First pass: the distinct pre-tokens with the number of (document, chunk) pairs
that hold them, a chunk being what stands between white space.  Each is cut
into pieces once.  Second pass: every document's pre-token frequencies meet the
piece counts and are summed.  A pre-token that is in a share of at least
1/``common`` of all those pairs goes to the tasks as a broadcast: by counting
there can be no more than ``common`` of those, and none longer than ``LONG``
bytes is sent.  All other pairs meet their
counts in a shuffled join.  No ids are made in the second pass.

Defined cases: a null or empty text has 0 bytes and 0 tokens; strings of
special tokens count as one token each, as in the library; repeated rows are
counted each for itself; a null id is kept; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbpe
from .common import arrow_batches, by_size, durable, emit, id_and_text

#: Bytes of the longest pre-token that is broadcast.
LONG = 64


class _Cutter:
    """Pre-tokens of chunks, remembered up to a bound."""

    def __init__(self, path: str, kept: int = 300_000):
        self.bpe, self.kept = wordbpe.load(path), kept
        self.known: dict[str, tuple[str, ...]] = {}

    def __call__(self, chunk: str) -> tuple[str, ...]:
        found = self.known.get(chunk)
        if found is None:
            found = tuple(self.bpe.texts[w] if w.__class__ is int else w.decode() for w in self.bpe.pieces(chunk))
            if len(self.known) < self.kept and len(chunk) <= 40:
                self.known[chunk] = found
        return found


def pretoken_counts(docs: DataFrame, path: str, flush: int = 300_000, flush_chars: int = 64_000_000) -> DataFrame:
    """Distinct pre-tokens: word, n_held (pairs of document and chunk that hold it), n_pieces (tokens of one occurrence)."""
    seen = pa.schema([("word", pa.string()), ("n_held", pa.int64())])

    def gather(batches):
        cut, held, size = _Cutter(path), Counter(), 0

        def words():
            out: dict[str, int] = {}
            for chunk, n in held.items():
                for w in set(cut(chunk)):
                    out[w] = out.get(w, 0) + n
            return emit({"word": list(out), "n_held": list(out.values())}, seen)

        for t in by_size(batches, limit=2_000_000):
            for text in t["text"].to_pylist():
                held.update(set(wordbpe.chunks(text)))
                size += len(text)
            if len(held) > flush or size > flush_chars:
                yield from words()
                held, size = Counter(), 0
        yield from words()

    counted = pa.schema([("word", pa.string()), ("n_held", pa.int64()), ("n_pieces", pa.int32())])

    def count(batches):
        bpe = wordbpe.load(path)
        for t in by_size(batches, "word", 1_000_000):
            words = [w.encode() for w in t["word"].to_pylist()]
            special = {k.encode() for k in bpe.special}
            ids = bpe.traverse(w for w in words if w not in special)
            yield from emit({"word": t["word"], "n_held": t["n_held"], "n_pieces": [len(ids[w]) // 4 if w in ids else 1 for w in words]}, counted)

    arrow_batches(docs.sparkSession)
    distinct = docs.select("text").mapInArrow(gather, "word string, n_held long").groupBy("word").agg(F.sum("n_held").alias("n_held"))
    return distinct.mapInArrow(count, "word string, n_held long, n_pieces int")


def count_tokens(docs: DataFrame, path: str, common: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens."""
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    pieces = durable(pretoken_counts(texts, path))
    pairs = pieces.agg(F.sum("n_held")).first()[0] or 0
    least = pairs // common + 1  # fewer than ``common`` words can be in so many documents
    frequent = (F.col("n_held") >= least) & (F.octet_length("word") <= LONG)
    sent = spark.sparkContext.broadcast(dict(pieces.where(frequent).select("word", "n_pieces").collect()))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))])

    def run(batches):
        cut, known = _Cutter(path), sent.value
        whole: dict[str, int] = {}  # tokens of chunks that hold broadcast pre-tokens alone
        for t in by_size(batches, limit=2_000_000):
            size, sums, words, times = [], [], [], []
            for text in t["text"].to_pylist():
                freq = Counter(wordbpe.chunks(text))
                total, rest = 0, {}
                for chunk in set(freq).difference(whole):
                    n, here, all_known = freq.pop(chunk), 0, True
                    for w in cut(chunk):
                        if (p := known.get(w)) is not None:
                            here += p
                        else:
                            rest[w] = rest.get(w, 0) + n
                            all_known = False
                    total += here * n
                    if all_known and len(chunk) <= LONG and len(whole) < cut.kept:
                        whole[chunk] = here
                total += sum(map(mul, freq.values(), map(whole.__getitem__, freq)))
                size.append(len(text.encode()))
                sums.append(total)
                words.append(list(rest))
                times.append(list(rest.values()))
            yield from emit({"row": t["row"], "doc_id": t["doc_id"], "n_bytes": size, "known": sums, "words": words, "times": times}, schema)

    arrow_batches(spark)
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_bytes long, known long, words array<string>, times array<int>")
    # A row of its own carries what is known already; no pre-token holds a space, so its key meets nothing.
    own = F.array(F.struct(F.concat(F.lit(" "), F.col("row").cast("string")).alias("words"), F.lit(None).cast("int").alias("times")))
    entries = rows.select("row", "doc_id", "n_bytes", "known", F.explode(F.concat(own, F.arrays_zip("words", "times"))).alias("e"))
    entries = entries.select("row", "doc_id", "n_bytes", F.when(F.col("e.times").isNull(), F.col("known")).alias("known"), F.col("e.words").alias("word"), F.col("e.times").alias("n"))
    rare = pieces.where(~frequent).select("word", "n_pieces")
    joined = entries.join(rare, "word", "left")
    total = F.sum(F.coalesce("known", F.col("n").cast("long") * F.col("n_pieces")))
    return joined.groupBy("row", "doc_id", "n_bytes").agg(total.alias("n_tokens")).select("doc_id", "n_bytes", "n_tokens")
