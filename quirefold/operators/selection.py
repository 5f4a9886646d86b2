"""Content selection: layout rules, evidence votes, coalesced ranges, failing open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The rule cascade's patterns.
PROTECTED = r"(?i)^(chapter\b|part\b|prologue\b|epilogue\b|introduction\b|preface\b|foreword\b|abstract\b)"
TOC = r"(?i)^(table of contents|contents)$"
FIGURES = r"(?i)^list of (figures|tables|illustrations)$"
INDEX = r"(?i)^(general )?index$"
COPYRIGHT = r"(?i)(copyright|all rights reserved|isbn\b|published by)"
CATALOG = r"(?i)^(other books|books by|also available|from the publisher)$"
ALSO_BY = r"(?i)^also by\b"
COLOPHON = r"(?i)^(colophon|typeface|printed (and bound )?by)"
DEDICATION = r"(?i)^(for|to)\s+[A-Za-z][A-Za-z .'’-]{0,80}$"


def classify(items: DataFrame, only: tuple[int, ...] | None = None) -> DataFrame:
    """Candidates of ``items(book_id, ordinal, pos, label, layer, text)``: book_id, ordinal, reason, signals, keep.

    The first of the ten rules that holds decides; ``only`` names rules by their place, from 0, if not all apply.
    """
    words = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0))
    body = (F.col("layer") == "body") & F.col("label").isin("paragraph", "text", "list_item")
    shown = F.trim("text")
    flag = lambda c: F.bool_or(c)
    place = items.groupBy("book_id", "ordinal").agg(
        F.sum(F.when(body, words).otherwise(0)).alias("body_words"),
        F.count_if(body & (words >= 12)).alias("body_blocks"),
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(shown != "").alias("n_texts"),
        F.min_by(shown, F.when(shown != "", F.col("pos"))).alias("first"),
        F.bool_or(shown.rlike(COPYRIGHT)).alias("copyright"),
        flag(F.col("label") == "title").alias("title"),
        flag(F.col("label").isin("title", "section_header")).alias("heading"),
        flag(F.col("label") == "document_index").alias("index"),
        flag(F.col("label").isin("picture", "caption")).alias("picture"),
        flag(F.col("layer") == "furniture").alias("furniture"),
    )
    place = place.withColumn("total", F.max("ordinal").over(Window.partitionBy("book_id"))).withColumn("first", F.coalesce("first", F.lit("")))
    c, first = F.col, F.col("first")
    early, late, sparse = c("ordinal") <= 12, c("ordinal") + 12 > c("total"), (c("body_words") <= 80) & (c("n_items") <= 24)
    protected = first.rlike(PROTECTED)
    rules = [
        (first.rlike(TOC) & c("index") & early, "table_of_contents", "hierarchy,layout,position"),
        (first.rlike(FIGURES) & c("index"), "list_of_figures_tables", "hierarchy,layout"),
        (first.rlike(INDEX) & c("index") & late, "index", "hierarchy,layout,position"),
        (c("copyright") & early & sparse, "copyright", "content_shape,position,layout"),
        (first.rlike(ALSO_BY) & (early | late) & sparse, "also_by", "hierarchy,position,layout"),
        (first.rlike(CATALOG) & (early | late) & sparse, "publisher_catalog", "hierarchy,position,layout"),
        (first.rlike(COLOPHON) & late & sparse, "colophon", "hierarchy,position,layout"),
        (first.rlike(DEDICATION) & early & sparse & (c("picture") | c("heading")), "dedication_ornamental", "content_shape,position,layout"),
        (c("title") & early & sparse & (c("n_texts") <= 4) & ~protected, "title", "hierarchy,position,layout"),
        (c("furniture") & sparse & (early | late) & c("copyright"), "copyright", "layout,content_shape,position"),
    ]
    rules = rules if only is None else [rules[i] for i in only]
    choose = lambda k: F.coalesce(*[F.when(r[0], F.lit(r[k])) for r in rules])
    keep = protected | (c("body_words") >= 180) | (c("body_blocks") >= 3)
    return place.select("book_id", "ordinal", choose(1).alias("reason"), choose(2).alias("signals"), keep.alias("keep")).where("reason IS NOT NULL")


def votes(candidates: DataFrame) -> DataFrame:
    """Per place of ``candidates(book_id, ordinal, reason, signal, keep)``: whether the evidence excludes it."""
    v = candidates.groupBy("book_id", "ordinal").agg(F.count_distinct("reason").alias("n_reasons"), F.count_distinct("signal").alias("n_signals"), F.bool_or("keep").alias("keep"), F.min("reason").alias("reason"))
    return v.withColumn("excluded", ~F.col("keep") & (F.col("n_reasons") == 1) & (F.col("n_signals") >= 2))


def ranges(excluded: DataFrame) -> DataFrame:
    """Neighbouring ordinals of one reason as (book_id, reason, start, end)."""
    island = F.col("ordinal") - F.row_number().over(Window.partitionBy("book_id", "reason").orderBy("ordinal"))
    return excluded.withColumn("island", island).groupBy("book_id", "reason", "island").agg(F.min("ordinal").alias("start"), F.max("ordinal").alias("end")).drop("island")


def fail_open(found: DataFrame, totals: DataFrame, max_ranges: int, max_ratio: float) -> DataFrame:
    """Per book: ranges, excluded places and the fallback; any fallback discards all its exclusions."""
    sums = found.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_ranges"), F.sum(F.col("end") - F.col("start") + 1).alias("n_excluded"))
    r = totals.join(sums, "book_id", "left").withColumn("n_ranges", F.coalesce("n_ranges", F.lit(0))).withColumn("n_excluded", F.coalesce("n_excluded", F.lit(0)))
    return r.withColumn("fallback", F.when(F.col("n_ranges") > max_ranges, "range_limit").when(F.col("n_excluded") > F.floor(F.col("total") * max_ratio), "excluded_ratio").otherwise("none"))


def retained(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages outside all ranges.  Ranges are unrolled to places, so this is an equi-join and no range join."""
    gone = found.select("book_id", F.explode(F.sequence("start", "end")).alias("page_no"))
    return pages.join(gone, ["book_id", "page_no"], "left_anti")


def first_reason(checks: list[tuple[Column, str]]) -> Column:
    """The name of the first check that fails, in order."""
    return F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in checks])
