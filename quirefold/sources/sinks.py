"""Sinks: shards with their manifest, and vectors by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(chunks: DataFrame, path: str, per_shard: int = 256, max_bytes: int = 4 << 20, folders: int = 64) -> DataFrame:
    """Chunks with their shard under ``path/shards``, then the manifest, last, under ``path/manifest``.

    A shard holds ``per_shard`` chunks and ``max_bytes`` of passages at most,
    but one chunk at least.  Files lie in ``folders`` folders by a hash of the
    book, so their number does not grow with the books.  The manifest has a row
    for each shard: orders, count, bytes and a digest of the ids in order, read
    from what was written, so a reader can tell a partial write.
    """
    sized = chunks.withColumn("size", F.octet_length("passage"))
    lists = sized.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("chunk_order", "size"))).alias("c"))
    start = F.struct(F.array().cast("array<int>").alias("shards"), F.lit(-1).alias("shard"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes"))

    def place(a, x):
        full = (a["shard"] < 0) | (a["n"] >= per_shard) | (a["bytes"] + x["size"] > max_bytes)
        shard = F.when(full, a["shard"] + 1).otherwise(a["shard"])
        return F.struct(F.concat(a["shards"], F.array(shard)).alias("shards"), shard.alias("shard"), F.when(full, 1).otherwise(a["n"] + 1).alias("n"), F.when(full, x["size"].cast("long")).otherwise(a["bytes"] + x["size"]).alias("bytes"))

    placed = lists.select("book_id", F.explode(F.arrays_zip(F.col("c.chunk_order").alias("chunk_order"), F.aggregate("c", start, place, lambda a: a["shards"]).alias("shard"))).alias("x"))
    sharded = chunks.join(placed.select("book_id", "x.chunk_order", "x.shard"), ["book_id", "chunk_order"]).withColumn("folder", F.pmod(F.xxhash64("book_id"), F.lit(folders)))
    sharded.sortWithinPartitions("folder", "book_id", "chunk_order").write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(f"{path}/shards")
    written = chunks.sparkSession.read.parquet(f"{path}/shards")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_order", "chunk_id"))), lambda x: x["chunk_id"]), "\n")
    manifest = written.groupBy("book_id", "shard").agg(
        F.min("chunk_order").alias("first_order"), F.max("chunk_order").alias("last_order"), F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.octet_length("passage")).alias("n_bytes"), F.sha2(ids.cast("binary"), 256).alias("digest"),
    )
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return chunks.sparkSession.read.parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of ``write_shards`` checked against their manifest: book_id, shard, reason (null where whole).

    Reasons: missing (no chunk was found), unknown (not in the manifest), count, bytes, order, digest.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_order", "chunk_id"))), lambda x: x["chunk_id"]), "\n")
    found = spark.read.parquet(f"{path}/shards").groupBy("book_id", "shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("passage")).alias("size"), F.min("chunk_order").alias("low"), F.max("chunk_order").alias("high"), F.sha2(ids.cast("binary"), 256).alias("own")
    )
    both = spark.read.parquet(f"{path}/manifest").join(found, ["book_id", "shard"], "full")
    reason = (
        F.when(F.col("n").isNull(), "missing").when(F.col("n_chunks").isNull(), "unknown").when(F.col("n") != F.col("n_chunks"), "count").when(F.col("size") != F.col("n_bytes"), "bytes")
        .when((F.col("low") != F.col("first_order")) | (F.col("high") != F.col("last_order")) | (F.col("high") - F.col("low") + 1 != F.col("n")), "order").when(F.col("own") != F.col("digest"), "digest")
    )
    return both.select("book_id", "shard", reason.alias("reason"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows with the incoming ones in place of those of the same key; repeating it changes nothing.

    Of incoming rows with one key the largest in the order of their other columns stays.
    """
    rest = [c for c in incoming.columns if c not in keys]
    new = incoming.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("x")).select(*keys, "x.*") if rest else incoming.distinct()
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)
