"""Vectors as arrays: products, norms, centroids, and a model-free embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; -1 for empty, unequal, zero or non-finite vectors."""
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    bad = (F.size(a) != F.size(b)) | (F.size(a) == 0) | value.isNull() | F.isnan(value)
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(-1.0)).otherwise(value)


def unit(a: Column) -> Column:
    """L2-normalised; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: F.try_divide(x.cast("double"), n)))


def hashed_embedding(value: Column, dimensions: int) -> Column:
    """Bag of words: FNV-1a of each word picks a dimension; unit norm; the first axis for no words."""
    from .text import words

    def fnv(w: Column) -> Column:
        hexed = F.hex(F.encode(w, "UTF-8"))
        places = F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1)
        byte = lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
        return F.aggregate(places, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))

    at = F.transform(words(value), lambda w: F.pmod(fnv(w), F.lit(dimensions)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.size(F.filter(at, lambda x: x == k)).cast("double"))
    axis = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.when(k == 0, 1.0).otherwise(0.0))
    return F.coalesce(unit(counts), axis)
