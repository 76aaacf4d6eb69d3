"""Vector expressions over array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

NORM_FLOOR = 1e-12
WIDE = 96  # beyond this, one vector buffer beats one column per dimension


def as_doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def l2_normalize(v: Column) -> Column:
    """Unit length with a floor on the norm, so that zero vectors stay zero."""
    length = F.greatest(norm(v), F.lit(NORM_FLOOR))
    return F.transform(v, lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    """Null when one side has no direction."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def l2_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def axpy(scale: Column, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: scale * p + q)


def vector_size(df: DataFrame, column: str) -> int:
    """Dimension of an array column, read from one row."""
    row = df.where(F.col(column).isNotNull()).select(F.size(column)).first()
    return int(row[0]) if row else 0


def sum_vectors(df: DataFrame, keys: list[str], column: str, dim: int, out: str, *extra: Column) -> DataFrame:
    """Element-wise sum per key with map-side partial sums; one buffer per key, whatever the group size."""
    if dim > WIDE:
        total = vector_to_array(Summarizer.sum(array_to_vector(column)))
    else:
        total = F.array(*[F.sum(F.col(column).getItem(i)) for i in range(dim)])
    return df.groupBy(*keys).agg(total.alias(out), *extra)


def mean_vectors(df: DataFrame, keys: list[str], column: str, dim: int, out: str, weight: str | None = None) -> DataFrame:
    """(Weighted) mean vector per key: the sum of the weighted vectors over the sum of the weights, for any width and sign.

    Rows without a weight or a vector, or whose vector has a gap, take no part, at any width. Null where the weights add up to 0."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    whole = df.where(w.isNotNull() & F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull()))
    scaled = whole.withColumn("_scaled", F.transform(F.col(column).cast("array<double>"), lambda x: x * w))
    scaled = sum_vectors(scaled, keys, "_scaled", dim, "_sum", F.sum(w).alias("_weight"))
    mean = F.when(F.col("_weight") != 0, F.transform("_sum", lambda x: x / F.col("_weight")))
    return scaled.select(*keys, mean.alias(out))
