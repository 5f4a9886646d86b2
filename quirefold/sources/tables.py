"""Tables by name, and the library's derived views over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Table = Callable[[str], DataFrame]


def tables(spark: SparkSession, sf_dir: str) -> Table:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def books(t: Table) -> DataFrame:
    created = F.timestamp_micros((F.lit(1704067200) + F.floor(F.col("doc_id") / 3) * 60) * 1_000_000)
    return t("documents").select(
        _id("book-", "doc_id").alias("book_id"), _id("Title ", "doc_id").alias("title"), F.col("source").alias("author"),
        F.lower(F.trim("source")).alias("author_norm"), (F.lit(1990) + F.col("doc_id") % 35).cast("int").alias("year"),
        F.array("lang", F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string"))).alias("tags_norm"),
        F.when(F.col("doc_id") % 2 == 0, "application/pdf").otherwise("application/epub+zip").alias("media_type"),
        created.alias("created_at"), F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"), F.col("doc_id").alias("book_no"),
    )


def pages(t: Table, lines: int = 4) -> DataFrame:
    """Pages of a few lines, with headings at fixed page numbers; built inside the row, without a shuffle."""
    split = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(split) - 1) / lines).cast("int"))
    rows = t("documents").select("doc_id", "source", F.posexplode(F.transform(starts, lambda k: F.array_join(F.slice(split, k * lines + 1, lines), "\n"))).alias("pos", "body"))
    no = F.col("pos") + 1
    head = F.when(no % 5 == 1, F.concat(F.lit("Chapter "), (F.floor((no - 1) / 5) + 1).cast("string"), F.lit(": "), F.col("source"), F.lit("\n")))
    head = head.when(no % 5 == 3, F.concat(F.lit("Section "), no.cast("string"), F.lit(". "), F.col("source"), F.lit("\n"))).otherwise("")
    return rows.select(_id("book-", "doc_id").alias("book_id"), no.alias("page_no"), F.concat(head, "body").alias("text"))


def index_jobs(t: Table) -> DataFrame:
    d = t("documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("v")).where("v = 1 OR doc_id % 4 = 0")
    state = F.when((F.col("doc_id") % 13 == 0) & (F.col("v") == 2), "pending").when(F.col("doc_id") % 17 == 0, "failed").otherwise("indexed")
    return d.select(F.concat(_id("job-", "doc_id"), F.lit("-v"), F.col("v").cast("string")).alias("job_id"), _id("book-", "doc_id").alias("book_id"), F.col("v").cast("long").alias("lifecycle_version"), state.alias("state"))


def book_lifecycle(t: Table) -> DataFrame:
    best = index_jobs(t).groupBy("book_id").agg(F.max(F.when(F.col("state") == "indexed", F.col("lifecycle_version"))).alias("v"), F.max("lifecycle_version").alias("latest"))
    number = F.substring("book_id", 6, 20)
    return best.select(
        "book_id", F.col("latest").alias("lifecycle_version"),
        F.when(F.col("v").isNotNull(), F.concat(F.lit("job-"), number, F.lit("-v"), F.col("v").cast("string"))).alias("active_job_id"),
        F.when(number.cast("long") % 10 == 0, "deleting").when(F.col("v") < F.col("latest"), "reindexing").otherwise("active").alias("state"),
    )


def evidence(t: Table) -> DataFrame:
    p, j, b = pages(t), index_jobs(t).select("book_id", "job_id"), books(t)
    return p.join(j, "book_id").join(b, "book_id").select(
        F.concat("job_id", F.lit(":p"), F.col("page_no").cast("string")).alias("evidence_id"), F.concat(F.lit("p"), F.col("page_no").cast("string")).alias("chunk_id"),
        "job_id", "book_id", "title", "author", "author_norm", "year", "tags_norm", F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"), F.col("text").alias("passage"),
    )


def generations(t: Table, p: DataFrame) -> DataFrame:
    """Rows of pages (book_id, page_no, more) once for each evidence that the page is: with its evidence_id."""
    j, b = index_jobs(t).select("book_id", "job_id"), books(t).select("book_id")
    return p.join(j, "book_id").join(b, "book_id").withColumn("evidence_id", F.concat("job_id", F.lit(":p"), F.col("page_no").cast("string")))


def chunk_evidence_id(label: str, vec_id: str):
    return F.concat(F.lit("vjob-"), F.col(label).cast("string"), F.lit(":c"), F.col(vec_id).cast("string"))


def chunk_vectors(t: Table) -> DataFrame:
    return t("embeddings").select(
        chunk_evidence_id("label", "vec_id").alias("evidence_id"), _id("c", "vec_id").alias("chunk_id"),
        _id("vjob-", "label").alias("job_id"), _id("vbook-", "label").alias("book_id"), F.concat(F.lit("author "), (F.col("label") % 3).cast("string")).alias("author_norm"),
        (F.lit(2000) + F.col("vec_id") % 25).cast("int").alias("year"), F.array(F.concat(F.lit("t"), (F.col("vec_id") % 2).cast("string")), F.concat(F.lit("u"), (F.col("vec_id") % 3).cast("string"))).alias("tags_norm"),
        (F.col("vec_id") % 40 + 1).cast("int").alias("page_start"), (F.col("vec_id") % 40 + 2).cast("int").alias("page_end"), "vec_id", "label", "embedding",
    )


def query_vectors(t: Table) -> DataFrame:
    return t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def facts(t: Table) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "uploaded").when(F.col("event_type") == "view", "started").when(F.col("event_type") == "click", "chunks_ready").when(F.col("event_type") == "purchase", "indexed").otherwise("failed")
    return t("events").select(_id("ev-", "event_id").alias("event_id"), _id("book-", "user_id").alias("book_id"), F.col("ts").alias("occurred_at"), kind.alias("kind"), (F.lit(1) + F.col("event_id") % 3).cast("long").alias("lifecycle_version"), F.sha2(F.col("props").cast("binary"), 256).alias("payload_digest"))


def deliveries(t: Table) -> DataFrame:
    """Facts as they arrive: some twice, some of those with another payload."""
    f = facts(t).withColumn("n", F.substring("event_id", 4, 20).cast("long"))
    again = f.where("n % 10 = 0").withColumn("payload_digest", F.when(F.col("n") % 100 == 0, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.col("payload_digest")))
    return f.unionByName(again).drop("n")


def outbox(t: Table) -> DataFrame:
    return t("lineitem").select(
        F.concat(_id("ob-", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("event_id"), F.col("l_orderkey").alias("aggregate_id"), F.col("l_linenumber").alias("sequence"),
        F.col("l_shipdate").alias("next_attempt_at"), (F.col("l_linestatus") == "F").alias("published"), (F.col("l_quantity").cast("long") % 6).alias("attempts"),
    )


def questions(t: Table) -> DataFrame:
    return t("conversations").where("role = 'user'").select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("question"))
