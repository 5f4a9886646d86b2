"""Token windows over pages, with structure, overlap and page bounds.

A book is cut into segments: a page that opens with a heading starts one, and an
excluded page ends one and clears the headings in force.  Token places are
running totals over a book.  Inside a segment a window begins at a place and
reaches as far as ``tokens`` and the first ``pages`` page numbers from its own
page allow; the next one begins ``overlap`` tokens before that end, or at the
end where the window is not longer than the overlap.  A window that would end
no later than the one before is left out, and none crosses a segment.

Only page numbers and token places are gathered by segment; the words meet their
windows in a join on the page, so a book of any length is spread over tasks.

Defined cases: a page whose text is null is excluded; one that is empty after
normalisation has no place; a book without words has no chunks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .selection import first_reason

#: Part of every chunk's identity; raised when the rules change.
VERSION = "windows-2"


@dataclass(frozen=True)
class Policy:
    tokens: int = 64
    overlap: int = 8
    pages: int = 2

    @property
    def label(self) -> str:
        return f"{self.tokens}/{self.overlap}/{self.pages}"


@dataclass(frozen=True)
class Tokenizer:
    """How a page becomes tokens, what joins them again, and the tokens between two pages of a segment."""

    split: Callable[[Column], Column]
    glue: str
    between: tuple[str, ...] = ()


TOKENIZERS: dict[str, Tokenizer] = {
    "word": Tokenizer(lambda text: F.regexp_extract_all(text, F.lit(r"\S+"), 0), " "),
    "char": Tokenizer(lambda text: F.filter(F.split(text, ""), lambda c: c != ""), "", ("\n",)),
}


def window_bounds(starts: list[int], numbers: list[int], ends: list[int], policy: Policy) -> list[tuple[int, int]]:
    """[start, end) of the windows of one segment, whose pages lie at ``starts`` to ``ends`` and have rising ``numbers``."""
    out, begin, told = [], starts[0], starts[0]
    while told < ends[-1]:
        page = numbers[bisect_right(ends, begin)]
        end = min(begin + policy.tokens, ends[bisect_left(numbers, page + policy.pages) - 1])
        if end > told:
            out.append((begin, end))
            told = end
            begin = end - policy.overlap if end - begin > policy.overlap else end
        else:
            begin = end
    return out


_PIECES = pa.list_(pa.struct([("page_no", pa.int32()), ("skip", pa.int32()), ("take", pa.int32()), ("lead", pa.bool_())]))
_WINDOW = pa.schema([("book_id", pa.string()), ("chapter", pa.string()), ("section", pa.string()), ("token_start", pa.int64()), ("token_end", pa.int64()), ("pieces", _PIECES)])
WINDOW = "book_id string, chapter string, section string, token_start long, token_end long, pieces array<struct<page_no:int,skip:int,take:int,lead:boolean>>"


def _windows(policy: Policy):
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                starts, numbers, ends = ([p[k] for p in r["places"]] for k in ("start", "page_no", "end"))
                for a, b in window_bounds(starts, numbers, ends, policy):
                    first, last = bisect_right(ends, a), bisect_left(ends, b)
                    pieces = [{"page_no": numbers[k], "skip": max(a - starts[k], 0), "take": min(b, ends[k]) - max(a, starts[k]), "lead": r["places"][k]["lead"]} for k in range(first, last + 1)]
                    rows.append({"book_id": r["book_id"], "chapter": r["chapter"], "section": r["section"], "token_start": a, "token_end": b, "pieces": pieces})
            yield from pa.Table.from_pylist(rows, schema=_WINDOW).to_batches()

    return run


def _normal(pages: DataFrame) -> DataFrame:
    # The Arrow function comes last, so its result is a column and the patterns before it run once, however often the text is used.
    return pages.select("book_id", F.col("page_no").cast("int").alias("page_no"), T.nfc()(T.normalize(F.col("text"))).alias("text"))


def placed_pages(pages: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Pages that hold words, without these: book_id, page_no, segment, chapter, section, start, end, lead (it begins with the tokens between pages)."""
    text = F.col("text")
    # Numbers and headings only go through the windows.
    own = _normal(pages).where("text IS NULL OR text <> ''").select("book_id", "page_no", text.isNull().alias("excluded"), F.coalesce(F.size(tokenizer.split(text)), F.lit(0)).alias("n"), T.heading(F.substring_index(text, "\n", 1)).alias("h"))
    chapter, section, excluded = F.col("h.chapter"), F.col("h.section"), F.col("excluded")
    in_order = Window.partitionBy("book_id").orderBy("page_no")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(in_order)
    opens = excluded | chapter.isNotNull() | section.isNotNull()
    own = own.withColumns({"segment": count(opens), "island": count(excluded | chapter.isNotNull()), "lead": ~(opens | F.coalesce(F.lag("excluded").over(in_order), F.lit(True)))})
    island = Window.partitionBy("book_id", "island")
    none = F.lit("")
    own = own.withColumns({"chapter": F.coalesce(F.max(chapter).over(island), none), "section": F.coalesce(F.last(section, ignorenulls=True).over(island.orderBy("page_no")), none)})
    size = F.col("n") + F.when(F.col("lead"), len(tokenizer.between)).otherwise(0)
    own = own.withColumn("n", F.when(excluded, 0).otherwise(size)).withColumn("end", F.sum("n").over(in_order))
    return own.where(~excluded & (F.col("n") > 0)).select("book_id", "page_no", "segment", "chapter", "section", (F.col("end") - F.col("n")).alias("start"), "end", "lead")


def chunk_windows(pages: DataFrame, policy: Policy = Policy(), tokenizer: str = "word") -> DataFrame:
    """Chunks of all books of ``pages(book_id, page_no, text)``."""
    how = TOKENIZERS[tokenizer]
    placed = placed_pages(pages, how)
    segments = placed.groupBy("book_id", "segment", "chapter", "section").agg(F.sort_array(F.collect_list(F.struct("start", "page_no", "end", "lead"))).alias("places"))
    windows = segments.select("book_id", "chapter", "section", "places").mapInArrow(_windows(policy), WINDOW)
    windows = windows.withColumn("chunk_order", (F.row_number().over(Window.partitionBy("book_id").orderBy("token_start")) - 1).cast("int"))
    numbers = F.transform("pieces", lambda p: p["page_no"])
    pieces = windows.select("book_id", "chunk_order", "chapter", "section", "token_start", "token_end", F.element_at(numbers, 1).alias("page_start"), F.element_at(numbers, -1).alias("page_end"), F.explode("pieces").alias("piece"))
    pieces = pieces.select("*", F.col("piece.page_no").alias("page_no"))
    met = pieces.join(_normal(pages).where("text <> ''").select("book_id", "page_no", how.split(F.col("text")).alias("tokens")), ["book_id", "page_no"])
    tokens = F.col("tokens")
    if how.between:
        tokens = F.when(F.col("piece.lead"), F.concat(F.array(*map(F.lit, how.between)), tokens)).otherwise(tokens)
    part = F.struct("page_no", F.slice(tokens, F.col("piece.skip") + 1, F.col("piece.take")).alias("tokens"))
    whole = met.groupBy("book_id", "chunk_order", "chapter", "section", "token_start", "token_end", "page_start", "page_end").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    passage = F.btrim(F.array_join(F.flatten(F.transform("parts", lambda p: p["tokens"])), how.glue), F.lit(" \t\n"))
    chunks = whole.withColumn("passage", passage)
    return chunks.select("book_id", "chunk_order", chunk_id(policy).alias("chunk_id"), "page_start", "page_end", "token_start", "token_end", "chapter", "section", "passage")


def chunk_id(policy: Policy) -> Column:
    """The first half of a digest of all that makes a chunk what it is, its text and the rules included."""
    places = [F.col(c).cast("string") for c in ("chunk_order", "page_start", "page_end", "token_start", "token_end")]
    identity = F.concat_ws("\0", "book_id", *places, "chapter", "section", F.sha2(F.col("passage").cast("binary"), 256), F.lit(policy.label), F.lit(VERSION))
    return F.substring(F.sha2(identity.cast("binary"), 256), 1, 32)


def shards(chunks: DataFrame, per_shard: int = 256) -> DataFrame:
    """Shard number of every chunk by count."""
    return chunks.withColumn("shard", F.floor(F.col("chunk_order") / per_shard).cast("int"))


def pack_shards(sizes: list[int], per_shard: int, max_bytes: int) -> list[int]:
    """Greedy shards by count and bytes, in order: a record opens a new shard when it would overfill the current one."""
    out, shard, count, filled = [], 0, 0, 0
    for n in sizes:
        if count and (count >= per_shard or filled + n > max_bytes):
            shard, count, filled = shard + 1, 0, 0
        out.append(shard)
        count, filled = count + 1, filled + n
    return out


# Why a chunk is refused, in the order in which it is looked for.
CHUNK_REASONS = [
    "book_mismatch", "invalid_chunk_id", "empty_text", "invalid_text_utf8", "invalid_chapter_utf8", "invalid_section_utf8", "content_sha256_mismatch",
    "invalid_page_start", "invalid_page_range", "page_end_exceeds_manifest", "unexpected_order", "invalid_token_range", "token_span_exceeds_maximum",
    "extraction_version_mismatch", "normalization_version_mismatch", "tokenizer_version_mismatch", "chunking_version_mismatch", "structure_version_mismatch",
]
#: The versions that a chunk and its batch have to share.
VERSIONS = ["extraction", "normalization", "tokenizer", "chunking", "structure"]


def chunk_reasons(chunks: DataFrame, work: DataFrame) -> DataFrame:
    """Per chunk: batch_id, line, chunk_id, reason; null where the chunk is sound.

    ``chunks`` has batch_id, line (its place in the batch, from 0), book_id,
    chunk_id, chunk_order, text, chapter, section, content_sha256 (hex),
    page_start, page_end, token_start, token_end and ``VERSIONS``; ``work`` has
    one row for each batch: batch_id, book_id, first_order, manifest_pages,
    maximum_tokens and ``VERSIONS``.  Texts are judged where they lie; only
    verdicts and numbers meet the batch in the join.

    Defined cases: a null text is empty, a null chapter or section is sound; any
    other null fails the check that needs it; a chunk of an unknown batch is
    ``book_mismatch``; other columns are ignored.
    """
    sound = lambda c: F.is_valid_utf8(F.coalesce(c, F.lit("")))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    kept = ["batch_id", "line", "chunk_id", "chunk_order", "page_start", "page_end", "token_start", "token_end", F.col("book_id").alias("own_book")]
    texts = [(F.coalesce("text", F.lit("")) == "").alias("empty"), (F.lower("content_sha256") == digest).alias("same_digest"), *[sound(c).alias(f"sound_{c}") for c in ("text", "chapter", "section")]]
    slim = chunks.select(*kept, *texts, *[F.col(v).alias(f"own_{v}") for v in VERSIONS])
    both = slim.join(work.select("batch_id", "book_id", "first_order", "manifest_pages", "maximum_tokens", *VERSIONS), "batch_id", "left")
    c = F.col
    holds = [
        c("own_book") == c("book_id"), c("chunk_id").rlike(r"\A[A-Za-z0-9_:-]{1,256}\z"), ~c("empty"), c("sound_text"), c("sound_chapter"), c("sound_section"), c("same_digest"),
        c("page_start") >= 1, c("page_end") >= c("page_start"), c("page_end") <= c("manifest_pages"), c("chunk_order") == c("first_order") + c("line"),
        c("token_end") > c("token_start"), c("token_end") - c("token_start") <= c("maximum_tokens"), *[c(f"own_{v}") == c(v) for v in VERSIONS],
    ]
    checks = [(~F.coalesce(ok, F.lit(False)), name) for ok, name in zip(holds, CHUNK_REASONS, strict=True)]
    return both.select("batch_id", "line", "chunk_id", first_reason(checks).alias("reason"))
