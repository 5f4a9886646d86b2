"""Streaming twins of the batch state queries; each runs over what is there and stops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import ORACLE, QUERIES, with_views
from ..sources import tables as V


def _scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/quirefold-stream/{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> V.Table:
    """Tables as file streams; the schema is that of the files."""

    def table(name: str) -> DataFrame:
        path = f"{sf_dir}/{name}.parquet"
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")

    return table


def run(df: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's output so far as a table; idempotent by batch, as every batch overwrites its own folder."""
    spark, at = df.sparkSession, _scratch(df.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{at}/out" if mode == "complete" else f"{at}/out/batch={number}"
        batch.write.mode("overwrite").parquet(folder)

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out") if mode == "complete" else spark.read.parquet(f"{at}/out").select(*df.columns)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First delivery of every event id; one that comes again within an hour is dropped, and ids are forgotten after that."""
    events = _stream(spark, sf_dir)("events").select(F.concat(F.lit("ev-"), (F.col("event_id") - F.col("event_id") % 3).cast("string")).alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    return run(events.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"))


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furthest stage and number of facts of every book and version."""
    from ..plans.lifecycle import STAGES

    stage = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in STAGES.items()], F.lit(0))
    return run(V.facts(_stream(spark, sf_dir)).groupBy("book_id", "lifecycle_version").agg(F.max(stage).alias("stage"), F.count(F.lit(1)).alias("n")), "complete")


def stream_two_fact_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an upload and an index fact of one book and version, whichever came first, at most 400 days apart.

    The bound and the watermarks let both sides forget facts that can meet nothing any more.
    """

    def side(kind: str, prefix: str) -> DataFrame:
        f = V.facts(_stream(spark, sf_dir)).where(F.col("kind") == kind)
        return f.select(F.col("book_id").alias(f"{prefix}_book"), F.col("lifecycle_version").alias(f"{prefix}_version"), F.col("event_id").alias(f"{prefix}_id"), F.col("occurred_at").cast("timestamp").alias(f"{prefix}_at")).withWatermark(f"{prefix}_at", "1 day")

    near = F.expr("indexed_at BETWEEN uploaded_at - INTERVAL 400 DAYS AND uploaded_at + INTERVAL 400 DAYS")
    both = side("uploaded", "uploaded").join(side("indexed", "indexed"), near & F.expr("uploaded_book = indexed_book AND uploaded_version = indexed_version"))
    return run(both.select(F.col("uploaded_book").alias("book_id"), F.col("uploaded_version").alias("lifecycle_version"), "uploaded_id", "indexed_id"))


QUERIES |= {f.__name__: f for f in (stream_dedup, stream_state, stream_two_fact_join)}
ORACLE |= {
    "stream_dedup": "SELECT DISTINCT concat('ev-', event_id - event_id % 3) AS event_id FROM events",
    "stream_state": with_views("SELECT book_id, lifecycle_version, max(CASE kind WHEN 'uploaded' THEN 1 WHEN 'started' THEN 2 WHEN 'chunks_ready' THEN 3 WHEN 'indexed' THEN 4 ELSE 0 END) AS stage, count(*) AS n FROM v_facts GROUP BY ALL"),
    "stream_two_fact_join": with_views("SELECT a.book_id, a.lifecycle_version, a.event_id AS uploaded_id, b.event_id AS indexed_id FROM v_facts a JOIN v_facts b ON b.book_id = a.book_id AND b.lifecycle_version = a.lifecycle_version AND a.kind = 'uploaded' AND b.kind = 'indexed' AND b.occurred_at BETWEEN a.occurred_at - INTERVAL 400 DAYS AND a.occurred_at + INTERVAL 400 DAYS"),
}
