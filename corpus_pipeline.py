"""A corpus from raw documents to packed sequences: five stages, each of one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read back as the next stage's documents.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import linededup, minhash, packing, pii, quality
from quirefold.llm.common import durable
from quirefold.llm.queries import table, tokenizer_path


def _with_text(docs: DataFrame, text: DataFrame) -> DataFrame:
    """The columns of documents with another text and its length."""
    return text.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has."""
    return _with_text(docs, linededup.drop_shared_lines_in_place(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return minhash.one_of_each(docs).select(*docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data."""
    return _with_text(docs, pii.replace_entities(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("pii", replace_pii),
    ("packing", pack),
]

#: The classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
