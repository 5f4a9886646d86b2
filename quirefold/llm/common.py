"""What the operators share: durable intermediate tables and groups of texts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; few, as a row may hold a very long text.
BATCH_ROWS = 256


_owner: list = []


def claim(free) -> None:
    """What a worker keeps between tasks belongs to one operator; ``free`` drops it when another one comes.

    Workers are used again by later stages, so caches would add up.
    """
    if _owner and _owner[0] == free:
        return
    if _owner:
        _owner.pop()()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # a C library without it keeps its pages
            pass
    _owner.append(free)


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.quirefold.scratch", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quirefold-")
        spark.conf.set("spark.quirefold.scratch", found)
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read back.

    This cuts the lineage: a lost executor costs the reading of files, not the
    work that led to them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quirefold/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator reads; a null text is an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def by_size(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 8_000_000) -> Iterator[pa.Table]:
    """Consecutive rows in tables of about ``limit`` bytes of text, a single row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = 0
        for i, n in enumerate(lengths):
            size += n
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i + 1
        if start < len(lengths):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def emit(columns: dict[str, object], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from pa.table([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name] for f in schema], schema=schema).to_batches(max_chunksize=BATCH_ROWS * 8)


#: Keys that are sent to every task: no more can each hold a 1/COMMON share of the rows.
COMMON = 1 << 16


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], n_rows: int) -> DataFrame:
    """``rows`` joined with distinct ``keys``, whose column ``n`` says how many rows each meets; ``n`` goes.

    Keys with a ``COMMON``-th of all rows or more are broadcast, at most
    ``COMMON`` by counting; their rows are joined where they lie.  Only the
    other rows are shuffled, and of those no key has many.  Both inputs must be
    cheap to read twice; keys are kept in the shared folder.
    """
    keys = durable(keys)
    often = F.col("n") >= n_rows // COMMON + 1
    hot = F.broadcast(keys.where(often).drop("n"))
    rest = rows.join(hot.select(*on), on, "left_anti").join(keys.where(~often).drop("n"), on)
    return rows.join(hot, on).unionByName(rest)
