"""Lines that many documents share (operator 6).  SQL functions only.

A text is split at line feeds.  A line's key is the line without ASCII white
space at both ends, A-Z in lower case; keys shorter than ``least`` code points
take no part.  Lines are exploded with their positions, and keys travel as
128-bit hashes, made once and kept in the shared folder.  An aggregate that
combines before its shuffle finds how many documents hold a key (for two, that
the smallest and the largest differ) and the smallest of them; keys in
``threshold`` documents or more lose their lines everywhere but there.  The
positions that a row loses are gathered, and its text is put together again
from the other positions, in order.

Very common keys do not meet in one task: see ``common.join_keys``.

Defined cases: a null or empty text is one empty line; a key repeated inside
one document counts once, and all its lines share one fate; documents with the
same id count as one document; documents whose id is null neither lose lines
nor cause others to; other columns are passed through or ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, join_keys

_EDGE = " \t\n\x0b\x0c\r"
COUNTS = ("n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(_EDGE))
    plain = F.octet_length(key) == F.length(key)
    return F.when(plain, F.lower(key)).otherwise(F.translate(key, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def line_hashes(docs: DataFrame, least: int = 10) -> DataFrame:
    """Per line that takes part: doc_id, text_hash, pos (from 0), high, low."""
    lines = docs.where("doc_id IS NOT NULL AND text <> ''").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.where(F.length("line") >= least).select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    # The second hash starts from another state, so the two are independent.
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("high"), F.xxhash64(F.lit(1), "key").alias("low"))


def lost_lines(docs: DataFrame, least: int = 10, threshold: int = 2) -> DataFrame:
    """Per lost line: doc_id, text_hash, pos."""
    keys = durable(line_hashes(docs, least))
    if threshold == 2:
        held = keys.groupBy("high", "low").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other"), F.count(F.lit(1)).alias("n")).where("keeper < other")
    else:
        # Distinct documents: one combined pass over (key, document), another over keys.
        each = keys.groupBy("high", "low", "doc_id").agg(F.count(F.lit(1)).alias("lines"))
        held = each.groupBy("high", "low").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("holders"), F.sum("lines").alias("n")).where(F.col("holders") >= threshold)
    met = join_keys(keys, held.select("high", "low", "keeper", "n"), ["high", "low"], keys.count())
    return met.where("doc_id <> keeper").select("doc_id", "text_hash", "pos")


def _without(text: Column, lost: Column) -> Column:
    """The lines of ``text`` at positions that are not in ``lost``, joined."""

    def build(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    # Binding the lines to a variable splits the text once, not once a position.
    return F.element_at(F.transform(F.array(F.split(text, "\n", -1)), build), 1)


def drop_shared_lines_in_place(docs: DataFrame, least: int = 10, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all their columns, with the lines that stay, n_lines (before) and n_dropped.

    Columns of those two names in the input are replaced.
    """
    names = [c for c in docs.columns if c not in COUNTS]
    # Under one struct no column of the input can clash with those added here.
    rows = docs.select(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == text_col else F.col(c) for c in names]).alias("row"))
    own, text = F.col(f"row.{id_col}").cast("long"), F.col(f"row.{text_col}")
    lost = lost_lines(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), least, threshold)
    lost = lost.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("lost"))
    joined = rows.withColumns({"doc_id": own, "text_hash": F.xxhash64(text)}).join(lost, ["doc_id", "text_hash"], "left").select("row", "lost")
    kept = F.when(F.col("lost").isNull(), text).otherwise(_without(text, F.col("lost")))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    columns = [kept.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in names]
    return joined.select(*columns, n_lines.cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"))


def drop_shared_lines(docs: DataFrame, least: int = 10, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text (the lines that stay), n_lines (before), n_dropped."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return drop_shared_lines_in_place(docs, least, threshold)
