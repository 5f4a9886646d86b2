"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    out = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import forest

    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linededup

    out = linededup.drop_shared_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    out = media.read_frames(media.store_as_gif(table(spark, sf_dir, "documents")))
    bins = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), media.BINS), lambda a, f: F.zip_with(a, f["histogram"], lambda x, y: x + y))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.to_json(F.struct(F.size("frames").alias("frames"), F.aggregate("frames", F.lit(0), lambda a, f: a + f["delay_ms"]).alias("ms"), bins.alias("colours"))).alias("feature"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokencount

    out = tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_bpe_round_trip,
        op3_pii_surrogates,
        op4_near_duplicates,
        op5_nearest_vectors,
        op6_line_dedup,
        op7_pack_documents,
        op8_gif_media,
        op9_token_counts,
        op10_repeated_passages,
    )
}

#: White space that a line's key loses at both ends.
_EDGE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {
    "op6_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, {_EDGE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
held AS (
  SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.doc_id, l.pos, l.line, h.key IS NOT NULL AND l.doc_id <> h.keeper AS gone
  FROM lines l LEFT JOIN held h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
