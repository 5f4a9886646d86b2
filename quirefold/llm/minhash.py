"""Near duplicates by DartMinHash (operator 4).

A text is the multiset of its runs of five words.  For every element, hashed
darts fall on the plane of weight and rank as a Poisson process of unit rate.
The plane is cut into regions, dyadic in weight and of equal area in rank, and
each region's darts come from its own hash, so texts that share an element
share its darts.  A dart counts if it lies below the element's weight; each
dart belongs to one of the signature's coordinates, and a coordinate keeps its
earliest dart.  Two texts agree in a coordinate with the probability of their
weighted Jaccard similarity.  A text with repeated runs has a second signature,
in which every weight is 1; the others' weights are 1 already, so their one
signature meets both kinds.

Signatures are banded.  Exact copies are one representative from the start.
In every bucket one member, the one with most company in all its buckets, is
compared with the rest, and the accepted links make classes.  A bucket of one
class, however large, is then done.  Buckets that still hold several classes
are mostly texts around one common passage.  Their members are searched
exactly: texts of similarity 0.8 share one of their rarest runs, of each the
fifth that is rarest among these members, and at the first one they share
enough of both must still follow.  So members are grouped by those runs, and
pairs of different classes that pass are compared, with more members in each
round, until none is left.  No candidate is dropped.  Comparisons are exact: a link needs a Jaccard similarity of 0.8 or more,
either of the sets or of the multisets of five-word runs.

With 40 bands of 6, a pair at exactly 0.8, of the sets or the multisets, shares
no bucket with probability 5e-6.  Texts meet pairs in sorted joins at every
size; very common buckets do not meet in one task (``common.join_keys``).

Defined cases: a null or empty text, or one without words, is alone in its
class; a text of fewer than five words is one run; rows with the same id are
one document, which has the class of its smallest text hash; rows without id
take no part; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, by_size, durable, emit, id_and_text, join_keys
from .components import components
from .words import GOLDEN, grams, mix, signed, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
#: Area of a region in rank: darts of one region come one after another, so it bounds the steps.
_AREA = 8.0


def weighted_set(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of words and how often each occurs."""
    return np.unique(grams(word_hashes(text.split()), words), return_counts=True)


def _throw(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, bound: np.ndarray, k: int, best: np.ndarray, found: np.ndarray) -> None:
    """Throw the darts of rank below ``bound`` (by owner) and keep the earliest of each owner's coordinates."""
    region = np.zeros(len(elements), np.int64)
    low, width = np.zeros(len(elements)), np.ones(len(elements))
    at = np.arange(len(elements))
    level = 0
    while len(at):
        seeds = mix(elements[at] ^ mix(np.full(len(at), level, np.uint64)))
        own, limit = owner[at], bound[owner[at]]
        height = _AREA / width[at]
        cells = np.ceil(limit / height).astype(np.int64)
        rep = np.repeat(np.arange(len(at)), cells)
        cell = np.arange(len(rep)) - np.repeat(np.cumsum(cells) - cells, cells)
        state = mix(seeds[rep] ^ mix(cell.astype(np.uint64)))
        rank = cell * height[rep]
        stop = np.minimum(rank + height[rep], limit[rep])
        lows, widths, weight, own = low[at][rep], width[at][rep], weights[at][rep], own[rep]
        while len(state):
            state = mix(state)
            rank = rank - np.log((np.right_shift(state, np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / widths
            alive = rank < stop
            if not alive.all():
                state, rank, stop, lows, widths, weight, own = (x[alive] for x in (state, rank, stop, lows, widths, weight, own))
            second = mix(state ^ GOLDEN)
            spot = lows + widths * ((second & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
            hit = spot < weight
            key = own[hit] * k + ((second[hit] >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            ranks, darts = rank[hit], state[hit]
            np.minimum.at(best, key, ranks)
            first = ranks == best[key]
            found[key[first]] = darts[first]
        level += 1
        low = np.full(len(elements), 2.0 ** (level - 1))
        width = low
        at = np.flatnonzero(weights > 2.0 ** (level - 1))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = BANDS * ROWS) -> np.ndarray:
    """[n, k] earliest darts; sets must not be empty."""
    n = len(sets)
    best, found = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    elements = np.concatenate([e for e, _ in sets])
    weights = np.concatenate([w for _, w in sets]).astype(np.float64)
    owner = np.repeat(np.arange(n), [len(e) for e, _ in sets])
    bound = k * (math.log(k) + 3) / np.bincount(owner, weights, n)
    open_ = np.ones(n, bool)
    while open_.any():
        part = open_[owner]
        _throw(elements[part], weights[part], owner[part], bound, k, best, found)
        open_ = np.isinf(best).reshape(n, k).any(1)
        bound = np.where(open_, 2 * bound, bound)
    return found.reshape(n, k)


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(sig), 1))
    parts = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        out = mix(out ^ parts[:, :, r])
    return out


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> bool:
    """Jaccard of the sets or of the multisets at ``least`` or more."""
    (ea, wa), (eb, wb) = a, b
    if not len(ea) or not len(eb):
        return False
    _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    shared = len(ia)
    if shared >= least * (len(ea) + len(eb) - shared) - 1e-9:
        return True
    low = int(np.minimum(wa[ia], wb[ib]).sum())
    return low >= least * (int(wa.sum()) + int(wb.sum()) - low) - 1e-9


_SIGNED = pa.schema([("doc_id", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(batches):
    for t in by_size(batches, limit=1_000_000):
        ids, highs, lows, sets = [], [], [], []
        for doc_id, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist()):
            words = text.split()
            if not words:
                continue
            h = np.frombuffer(xxhash.xxh3_128_digest(" ".join(words).encode()), ">i8")
            ids.append(doc_id)
            highs.append(int(h[0]))
            lows.append(int(h[1]))
            sets.append(np.unique(grams(word_hashes(words), WORDS), return_counts=True))
        if ids:
            bands = list(signed(band_hashes(signatures(sets))))
            again = [k for k, (_, w) in enumerate(sets) if w.max() > 1]
            if again:
                flat = signed(band_hashes(signatures([(sets[k][0], np.ones_like(sets[k][1])) for k in again])))
                for k, own in zip(again, flat):
                    bands[k] = np.concatenate([bands[k], own])
            yield from emit({"doc_id": ids, "high": highs, "low": lows, "bands": bands}, _SIGNED)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def run(batches):
        last, own = None, None
        for t in by_size(batches, "text_b", 1_000_000):
            keep = []
            for a, ta, tb in zip(t["a"].to_pylist(), t["text_a"].to_pylist(), t["text_b"].to_pylist()):
                if a != last:
                    last, own = a, weighted_set(ta)
                keep.append(similar(own, weighted_set(tb)))
            yield from t.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).to_batches()

    # Sorted joins whatever the size, so that cost grows in proportion.
    first = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")).join(pairs.hint("merge"), "b")
    both = first.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _only(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The texts of these members, kept in the shared folder."""
    return durable(texts.join(members.select("rep").distinct().hint("merge"), "rep", "left_semi"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, class_id (the smallest id of its class)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = id_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    signed_docs = durable(texts.mapInArrow(_sign, "doc_id long, high long, low long, bands array<long>"))
    # A document that comes in several rows takes part with one of them.
    single = signed_docs.groupBy("doc_id").agg(F.min(F.struct("high", "low", "bands")).alias("s")).select("doc_id", "s.*") if _repeats(signed_docs) else signed_docs
    reps = durable(single.groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")))
    entries = reps.select("rep", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = reps.agg(F.sum(F.size("bands"))).first()[0] or 0
    entries = durable(join_keys(entries, shared.withColumn("held", F.col("n")), ["bucket"], members))
    # What has most company in its buckets is nearest to the middle of its group and links most of it.
    central = entries.groupBy("rep").agg(F.sum("held").alias("company"))
    entries = durable(entries.join(central, "rep").select("bucket", "rep", F.struct(-F.col("company"), F.xxhash64("rep"), F.col("rep")).alias("draw")))

    rep_texts = texts.withColumnRenamed("doc_id", "rep")
    if _repeats(signed_docs):
        rep_texts = rep_texts.groupBy("rep").agg(F.min("text").alias("text"))
    rep_texts = _only(rep_texts, entries)
    order = entries.select("rep", "draw").distinct()
    links = labels = None
    done, leaders = 0, 1
    entries = entries.select("bucket", "rep", "draw", F.lit(0).alias("n"), F.lit(0).alias("follow"))
    open_ = entries.withColumn("label", F.col("rep"))
    exact = False
    while True:
        # The first ``leaders`` members of a bucket are compared with all after them.
        enough = F.least("a_follow", "follow") >= SIMILARITY / (1 + SIMILARITY) * (F.col("a_n") + F.col("n")) - 1e-9
        pairs = _met(open_, done, leaders).where((F.col("draw") > F.col("a_draw")) & (F.col("label") != F.col("a_label")) & enough)
        pairs = durable(pairs.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct())
        if links is None or not pairs.isEmpty():
            new = durable(_verified(pairs, rep_texts))
            if links is None or not new.isEmpty():
                links = new if links is None else durable(links.union(new))
                labels = components(links)
        open_ = durable(_mixed(entries, labels, leaders + 1))
        if open_.isEmpty():
            break
        if exact:
            done, leaders = leaders, 16 * leaders
        else:
            exact = True
            rep_texts = _only(rep_texts, open_)
            entries = durable(_rare_runs(rep_texts).join(order, "rep").select("bucket", "rep", "draw", "n", "follow"))
            open_ = durable(_mixed(entries, labels, 1))
            if open_.isEmpty():
                break
    classes = labels.withColumnRenamed("v", "rep")
    of_text = reps.select("high", "low", "rep").join(classes, "rep", "left").select("high", "low", F.coalesce("label", "rep").alias("class_id"))
    found = single.select("doc_id", "high", "low").join(of_text, ["high", "low"]).select("doc_id", "class_id")
    return texts.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _mixed(entries: DataFrame, labels: DataFrame, more_than: int) -> DataFrame:
    """Members, with their labels, of the buckets that hold different labels and more than so many members."""
    known = durable(entries.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("bucket", "rep", "draw", F.col("n").alias("size"), "follow", F.coalesce("label", "rep").alias("label")))
    mixed = known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where((F.col("x") != F.col("y")) & (F.col("n") > more_than))
    return join_keys(known, mixed.select("bucket", "n"), ["bucket"], known.count()).withColumnRenamed("size", "n")


_RUNS = pa.schema([("rep", pa.int64()), ("kind", pa.int32()), ("first", pa.int32()), ("runs", pa.list_(pa.int64()))])


def _runs(batches):
    """Each text's runs as a set (kind 0) and, numbered by occurrence, as a multiset (kind 1)."""
    for t in by_size(batches, limit=500_000):
        out = {n: [] for n in _RUNS.names}
        for rep, text in zip(t["rep"].to_pylist(), t["text"].to_pylist()):
            e, w = weighted_set(text)
            which = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            numbered = mix(np.repeat(e, w) ^ mix(which.astype(np.uint64) + np.uint64(1)))
            for kind, runs in ((0, e), (1, numbered)):
                out["rep"].append(rep)
                out["kind"].append(kind)
                out["first"].append(len(runs) - math.ceil(SIMILARITY * len(runs) - 1e-9) + 1)
                out["runs"].append(signed(runs))
        yield from emit(out, _RUNS)


def _rare_runs(texts: DataFrame) -> DataFrame:
    """(bucket, rep, n, follow) for the runs, shared with another text, among the rarest fifth of each text's.

    Sets that share 0.8 of their union have one in common whatever order all
    texts use; here it is by the number of texts that hold the run.  ``follow``
    counts the runs from this one on, of ``n``.
    """
    each = durable(texts.mapInArrow(_runs, "rep long, kind int, first int, runs array<long>"))
    rows = each.select("rep", "kind", "first", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    shared = rows.groupBy("kind", "run").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    held = rows.join(shared, ["kind", "run"]).groupBy("rep", "kind", "first", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "run"))).alias("runs"))
    # Runs of this text alone come first in its order and meet nothing.
    left = F.col("first") - (F.col("n") - F.size("runs"))
    rarest = held.where(left > 0).select("rep", "kind", "n", F.size("runs").alias("held"), F.posexplode(F.slice("runs", F.lit(1), left)).alias("at", "x"))
    return rarest.select(F.xxhash64("kind", "x.run").alias("bucket"), "rep", "n", (F.col("held") - F.col("at")).alias("follow"))


def _met(members: DataFrame, done: int, leaders: int) -> DataFrame:
    """All members of each bucket beside its members ``done`` to ``leaders`` in its order."""
    named = {"rep": "a", "draw": "a_draw", "label": "a_label", "n": "a_n", "follow": "a_follow"}
    if leaders == 1:  # an aggregate combines before the shuffle, and the heads of very common buckets are few
        first = members.groupBy("bucket").agg(F.min_by(F.struct(*named), "draw").alias("x"), F.count(F.lit(1)).alias("n"))
        heads = first.select("bucket", "n", *[F.col(f"x.{c}").alias(name) for c, name in named.items()])
        return join_keys(members.withColumnRenamed("n", "size"), heads, ["bucket"], members.count()).withColumnRenamed("size", "n")
    at = Window.partitionBy("bucket").orderBy("draw")
    heads = members.withColumn("place", F.row_number().over(at)).where((F.col("place") > done) & (F.col("place") <= leaders))
    return members.join(heads.select("bucket", *[F.col(c).alias(name) for c, name in named.items()]), "bucket")


def _repeats(docs: DataFrame) -> bool:
    return docs.count() != docs.select("doc_id").distinct().count()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows, all their columns, of one document of each class; rows without id stay."""
    kept = near_duplicate_classes(docs).where("doc_id = class_id").select("doc_id")
    chosen = docs.join(kept, "doc_id", "left_semi")
    if _repeats(docs.where("doc_id IS NOT NULL").select("doc_id")):
        chosen = chosen.dropDuplicates(["doc_id"])
    return chosen.unionByName(docs.where("doc_id IS NULL"))
