"""Dense and sparse vectors as Column expressions over arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays of one length; others raise."""
    a, b = _c(a), _c(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors differ in length")))


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def dense_similarity(a: str | Column, b: str | Column) -> Column:
    """(inner product + 1) / 2 within [0, 1], for vectors of length 1; 0 for null."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(a, b) + 1) / 2)), F.lit(0.0))


def sparse_dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two map<key, weight>."""
    a, b = _c(a), _c(b)
    return F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.coalesce(a[k] * b[k], F.lit(0.0)))


def max_sim(query: str | Column, doc: str | Column) -> Column:
    """Sum over the query's vectors of the best inner product with one of the document's (late interaction)."""
    best = F.transform(_c(query), lambda q: F.array_max(F.transform(_c(doc), lambda d: F.aggregate(F.zip_with(q, d, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def bigram_features(tokens: str | Column) -> Column:
    """The tokens and the pairs of neighbours, joined by _."""
    t = _c(tokens)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.concat_ws("_", F.element_at(t, i), F.try_element_at(t, i + 1)))
    return F.when(F.size(t) > 1, F.concat(t, pairs)).otherwise(t)


def feature_slot(feature: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(feature), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def feature_sign(feature: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(feature), 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
