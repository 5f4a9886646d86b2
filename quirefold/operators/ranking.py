"""Top-k, fusion and grouping of search candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot

#: Rows a query side may have to be broadcast; beyond it the product is a shuffled one by blocks.
BROADCAST_QUERIES = 10_000


def score_all(vectors: DataFrame, queries: DataFrame, keep: list[str]) -> DataFrame:
    """Every query against every vector: query_id, ``keep`` and the rounded score.

    Only ids and vectors travel.  A small query set, by its count, is
    broadcast; a larger one meets the vectors block by block.
    """
    q = queries.select("query_id", F.col("embedding").alias("query_vector"))
    v = vectors.select(*keep, "embedding")
    if q.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        pairs = v.crossJoin(F.broadcast(q))
    else:
        blocks = 64
        q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        pairs = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).join(q, "block").drop("block")
    return pairs.select("query_id", *keep, F.round(dot(F.col("query_vector"), F.col("embedding")), 6).alias("score"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, offset: int = 0, name: str = "rank") -> DataFrame:
    """Rows ``offset`` to ``offset + k`` of each group, with their 0-based rank."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    kept = ranked.where(F.col(name) < offset + k)
    return kept.where(F.col(name) >= offset) if offset else kept


def best_first(score: str, key: str) -> list[Column]:
    return [F.desc(score), F.asc(key)]


def fuse(candidates: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, evidence_id, rank, score, arrival).

    Contributions 1/(k + rank + 1) add up; the score kept is the highest raw
    one, of equals the first to arrive.  Order: fused, score, id.
    """
    fused = candidates.groupBy("query_id", "evidence_id").agg(
        F.round(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)), 9).alias("fused"),
        F.max("score").alias("score"),
        F.count(F.lit(1)).alias("n_lists"),
    )
    order = [F.desc("fused"), F.desc("score"), F.asc("evidence_id")]
    return fused.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)


def group_documents(evidence: DataFrame) -> DataFrame:
    """Documents rebuilt from accepted evidence (query_id, book_id, job_id, position, score, page_start, page_end)."""
    return evidence.groupBy("query_id", "book_id", "job_id").agg(
        F.max("score").alias("score"),
        F.min(F.when(F.col("page_start") > 0, F.col("page_start"))).alias("page_start"),
        F.max("page_end").alias("page_end"),
        F.count(F.lit(1)).alias("n_evidence"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "evidence_id"))), lambda x: x["evidence_id"]), ",").alias("evidence_ids"),
    )


def merge_metadata(documents: DataFrame, authoritative: DataFrame) -> DataFrame:
    """Chunk count and pages of the authoritative table win; the higher score stays."""
    a = authoritative.select("query_id", "job_id", "chunk_count", F.col("page_start").alias("a_start"), F.col("page_end").alias("a_end"), F.col("score").alias("a_score"))
    return documents.join(a, ["query_id", "job_id"], "left").select(
        "query_id", "book_id", "job_id",
        F.greatest("score", F.coalesce("a_score", "score")).alias("score"),
        F.when(F.col("a_start") > 0, F.col("a_start")).otherwise(F.col("page_start")).alias("page_start"),
        F.when(F.col("a_end") > 0, F.col("a_end")).otherwise(F.col("page_end")).alias("page_end"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "n_evidence", "evidence_ids",
    )


def active_jobs(jobs: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Jobs whose generation is visible: indexed, pointed to, and the book active or being reindexed."""
    live = lifecycle.where(F.col("state").isin("active", "reindexing")).select("book_id", F.col("active_job_id").alias("job_id"))
    return jobs.where("state = 'indexed'").join(live, ["book_id", "job_id"], "left_semi").select("book_id", "job_id")


def metadata_filter(df: DataFrame, author: str | None = None, tags: list[str] = (), years: tuple[int, int] | None = None) -> DataFrame:
    """Author equality, every tag, years inclusive; what is not given is not tested."""
    if author is not None:
        df = df.where(F.col("author_norm") == author)
    for t in tags:
        df = df.where(F.array_contains("tags_norm", t))
    return df.where(F.col("year").between(*years)) if years else df


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Unit sum vector of each key; summed by position, so partial sums combine before the shuffle."""
    sums = vectors.select(key, F.posexplode("embedding").alias("pos", "x")).groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return sums.select(key, "pos", F.try_divide(F.col("x"), length).alias("x"))
