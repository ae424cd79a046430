"""Vector expressions in double precision, and a portable embedder without a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is worked out once a row, however often the body, or a lambda in it, names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(a: Column) -> Column:
    return let(a.cast("array<double>"), lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def similarity_score(distance: Column) -> Column:
    """Cosine distance as a score from 0 to 1."""
    return 1 - distance / 2


def trigram_embedding(text: Column, dim: int = 64) -> Column:
    """Unit vector of hashed character trigrams: deterministic, without a model."""
    cut = lambda low: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.pmod(F.crc32(F.substr(low, i, F.lit(3)).cast("binary")), F.lit(dim)))
    grams = let(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), cut)
    count = lambda g: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(g, lambda x: x == k)).cast("double"))
    return unit(let(grams, count))
