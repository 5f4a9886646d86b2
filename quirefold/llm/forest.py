"""Approximate nearest neighbours by a hash-prefix forest (operator 5).

Vectors are dealt to blocks of bounded size.  A block's index is a forest: each
tree is the block in the order of long hash strings, the signs of the products
with random directions.  A query descends every tree to the entries that share
the longest prefix with its own string, then all trees ascend together, one
bit of prefix at a time, until the union of their ranges holds the wanted
share of the block.  Those candidates are compared exactly, and the blocks'
nearest are merged.

Queries are dealt to blocks as well; every block of vectors meets every block
of queries, so neither side is collected or broadcast.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part on either side; vectors of another length are no
candidates; components of any finite size are compared, as each vector is
brought into range by a power of two; equal vectors tie and the smaller id
goes first; rows with the same id are separate rows; a query with fewer candidates than ``k`` returns
all of them; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TREES, BITS, SHARE = 32, 64, 0.6
BLOCK, QUERY_BLOCK = 8192, 2048

_FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def hash_strings(x: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """[trees, n] strings of 64 bits as integers, first bit highest."""
    rng = np.random.default_rng(seed)
    out = np.empty((trees, len(x)), np.uint64)
    for k in range(trees):
        bits = x @ rng.standard_normal((x.shape[1], BITS)) > 0
        out[k] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


class Forest:
    """Sorted hash strings of one block of vectors."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = 5):
        self.x, self.trees, self.seed = x, trees, seed
        strings = hash_strings(x, trees, seed)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For every tree and query the sorted entries that share ``depth`` leading bits."""
        if not depth:
            return np.zeros(strings.shape, np.int64), np.full(strings.shape, len(self.x))
        rest = np.uint64((1 << (BITS - depth)) - 1)
        low = np.stack([np.searchsorted(s, q & ~rest, "left") for s, q in zip(self.sorted, strings)])
        high = np.stack([np.searchsorted(s, q | rest, "right") for s, q in zip(self.sorted, strings)])
        return low, high

    def candidates(self, queries: np.ndarray, wanted: int) -> list[np.ndarray]:
        """Positions for each query, at least ``wanted`` where there are so many."""
        strings = hash_strings(queries, self.trees, self.seed)
        n = len(self.x)
        out: list[np.ndarray | None] = [None] * len(queries)
        open_ = np.arange(len(queries))
        masks = {int(q): np.zeros(n, bool) for q in open_}
        for depth in range(BITS, -1, -1):
            low, high = self.ranges(strings[:, open_], depth)
            # While all ranges together are too few, there is nothing to gather yet.
            enough = (high - low).sum(0) >= min(wanted, n)
            still = []
            for i, q in enumerate(open_):
                if enough[i]:
                    mask = masks[int(q)]
                    for tree in range(self.trees):
                        mask[self.order[tree, low[tree, i] : high[tree, i]]] = True
                    if mask.sum() >= min(wanted, n) or not depth:
                        out[q] = np.flatnonzero(mask)
                        del masks[int(q)]
                        continue
                still.append(q)
            open_ = np.array(still, dtype=np.int64)
            if not len(open_):
                break
        return out


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def in_range(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component into [0.5, 1).

    The cosine stays the same and no square of a large component overflows.
    """
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -exponent[:, None])


def _search(vectors: pa.Table, queries: pa.Table, k: int, trees: int, share: float) -> pa.Table:
    if not vectors.num_rows or not queries.num_rows:
        return _FOUND.empty_table()
    unpack = lambda t: np.array(t["vector"].to_pylist(), dtype=np.float64)
    x, q = in_range(unpack(vectors)), in_range(unpack(queries))
    ids, rows = vectors["vec_id"].to_numpy(), vectors["vec_row"].to_numpy()
    q_ids, q_rows = queries["vec_id"].to_numpy(), queries["vec_row"].to_numpy()
    forest = Forest(x, trees)
    nx, nq = _norms(x), _norms(q)
    out = {n: [] for n in _FOUND.names}
    wanted = max(int(np.ceil(share * len(x))), 2 * k)
    for i, near in enumerate(forest.candidates(q, wanted)):
        near = near[rows[near] != q_rows[i]]
        # A row's products are summed in one fixed order, so equal vectors get equal scores.
        score = (x[near] * q[i]).sum(axis=1) / (nx[near] * nq[i])
        best = np.lexsort((ids[near], -score))[:k]
        for n, v in zip(_FOUND.names, (np.full(len(best), q_rows[i]), np.full(len(best), q_ids[i]), ids[near[best]], score[best])):
            out[n].append(v)
    return pa.table({n: np.concatenate(v) for n, v in out.items()}, schema=_FOUND)


def usable(vector: Column) -> Column:
    """Not null, and every component finite, and one of them not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, share: float = SHARE) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score; ``is_query`` is a condition on ``vec_id``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.withColumn("vec_row", F.monotonically_increasing_id()).withColumn("length", F.size("vector"))
    n = rows.count()
    blocks = max(1, -(-n // BLOCK))
    query_blocks = max(1, -(-rows.where(is_query).count() // QUERY_BLOCK))
    spread = lambda count, salt: F.pmod(F.xxhash64("vec_row", F.lit(salt)), F.lit(count))
    left = rows.withColumn("block", spread(blocks, 1)).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>")))
    right = rows.where(is_query).withColumn("query_block", spread(query_blocks, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    keys = ["length", "block", "query_block"]

    def run(a, b):
        return _search(a, b, k, trees, share)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
