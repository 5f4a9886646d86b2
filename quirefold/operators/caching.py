"""The assessment cache: exact hits, then negative hits by meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine

EXACT = ["profile", "question_hash", "passage_hash"]
NEGATIVE = ["profile", "passage_hash", "topic_hash", "guard_hash"]


def entries(stored: DataFrame, ttl: int) -> DataFrame:
    """What ``stored(entry_id, asked_at, relevant, embedding, keys)`` leaves: the first of each exact key, kept for ``ttl``.

    Ties in time go to the smaller id.
    """
    keys = [*EXACT, *[k for k in NEGATIVE if k not in EXACT]]
    # A window, as its unused columns are not read; embeddings in an aggregate would travel for exact hits too.
    first = F.row_number().over(Window.partitionBy(*EXACT).orderBy("asked_at", "entry_id"))
    kept = stored.withColumn("nth", first).where("nth = 1").select(*EXACT, "entry_id", "asked_at", "relevant", "embedding", *keys[3:])
    return kept.withColumnRenamed("asked_at", "stored_at").withColumn("expires_at", F.col("stored_at") + ttl)


def lookup(requests: DataFrame, cached: DataFrame, minimum_cosine: float = 0.985) -> DataFrame:
    """(request_id, entry_id, outcome) of each of ``requests(request_id, asked_at, embedding, keys)``.

    Only entries stored before a request and not yet expired count.  An equal
    exact key is a ``hit``.  Without one, an entry that was not relevant and has
    equal negative keys is a ``negative_hit`` where its embedding is as near as
    asked, the newest of several (of equals the larger id), and a
    ``semantic_mismatch`` where none is.  All else, null keys included, is a
    ``miss``.  Every candidate is compared; there is no limit on them.
    """
    alive = (F.col("stored_at") < F.col("asked_at")) & (F.col("expires_at") > F.col("asked_at"))
    exact = requests.select("request_id", "asked_at", *EXACT).join(cached.select(*EXACT, "stored_at", "expires_at", "entry_id"), EXACT).where(alive)
    exact = exact.groupBy("request_id").agg(F.min("entry_id").alias("hit_id"))
    other = cached.where("NOT relevant AND embedding IS NOT NULL").select(*NEGATIVE, "stored_at", "expires_at", F.col("entry_id").alias("near_id"), F.col("embedding").alias("kept"))
    near = requests.select("request_id", "asked_at", "embedding", *NEGATIVE).join(other, NEGATIVE).where(alive)
    fits = cosine(F.col("embedding"), F.col("kept")) >= minimum_cosine
    near = near.groupBy("request_id").agg(F.max(F.when(fits, F.struct("stored_at", "near_id"))).alias("best"), F.lit(True).alias("compared"))
    found = requests.select("request_id").join(exact, "request_id", "left").join(near, "request_id", "left")
    outcome = F.when(F.col("hit_id").isNotNull(), "hit").when(F.col("best").isNotNull(), "negative_hit").when(F.col("compared"), "semantic_mismatch").otherwise("miss")
    return found.select("request_id", F.coalesce("hit_id", "best.near_id").alias("entry_id"), outcome.alias("outcome"))
