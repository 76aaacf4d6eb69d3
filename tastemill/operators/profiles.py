"""Vectors of users and features, made from item vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tastemill.functions.vectors import l2_normalize, mean_vectors, sum_vectors
from tastemill.plans.skew import blocks_of, dealt_by_user, positions

TASK_NUMBERS = 1 << 24
#: Numbers of the vectors that are looked up at a time.
PIECE = 1 << 23


def mean_profile(inter: DataFrame, item_vectors: DataFrame, dim: int) -> DataFrame:
    """Unweighted mean of the vectors of a user's items; items without a vector are left out."""
    return mean_vectors(inter.join(item_vectors, "item_id"), ["user_id"], "vector", dim, "vector")


def _block_sums(dim: int, schema: pa.Schema):
    """Sum and number of the vectors of each user's items in a block; an item may have several vectors."""

    def run(rows: pa.Table, items: pa.Table) -> pa.Table:
        if not rows.num_rows or not items.num_rows:
            return schema.empty_table()
        vectors = items["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        names = items["name"].combine_chunks().dictionary_encode()
        order = np.argsort(names.indices.to_numpy(), kind="stable")
        many = np.bincount(names.indices.to_numpy())
        if len(many) < len(order):
            vectors = np.add.reduceat(vectors[order], np.cumsum(many) - many)
        else:
            vectors = vectors[order]
        at = positions(names.dictionary, rows["item_id"])
        known = np.flatnonzero(at >= 0)
        if not len(known):
            return schema.empty_table()
        users = rows["user_id"].combine_chunks().dictionary_encode()
        code = users.indices.to_numpy()[known]
        order = np.argsort(code, kind="stable")
        at, code = at[known][order], code[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        of = np.cumsum(np.diff(code, prepend=-1) != 0) - 1
        sums, step = np.zeros((len(starts), dim)), max(1, PIECE // dim)
        for lo in range(0, len(at), step):
            hi = min(lo + step, len(at))
            first, last = of[lo], of[hi - 1] + 1
            sums[first:last] += np.add.reduceat(vectors[at[lo:hi]], np.maximum(starts[first:last] - lo, 0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int64) * dim, pa.int32()), pa.array(sums.ravel()))
        columns = [users.dictionary.take(pa.array(code[starts])), lists.cast(schema.field("sum").type), pa.array(np.add.reduceat(many[at].astype(np.float64), starts))]
        return pa.table(columns, schema=schema)

    return run


def mean_profile_by_blocks(inter: DataFrame, item_vectors: DataFrame, dim: int) -> DataFrame:
    """The same for users that are not null, from a stored ``inter``: rows are dealt to blocks of users that hold each item vector once, so that no vector is stored,
    sorted or shuffled per row. The sums of a user too large for a block are added up."""
    blocks, heavy = blocks_of(inter, dim, 2)  # a row names a vector and may make one
    rows = dealt_by_user(inter.select("user_id", "item_id"), "item_id", blocks, heavy)
    whole = item_vectors.select(F.col("item_id").alias("name"), F.col("vector").cast("array<double>").alias("vector"))
    whole = whole.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    named = rows.select(F.col("part").alias("of"), F.col("item_id").alias("asked")).distinct().join(whole, F.col("asked") == F.col("name")).drop("asked")
    out = T.StructType([T.StructField("user_id", inter.schema["user_id"].dataType), T.StructField("sum", T.ArrayType(T.DoubleType())), T.StructField("weight", T.DoubleType())])
    sums = rows.groupBy("part").cogroup(named.groupBy("of")).applyInArrow(_block_sums(dim, to_arrow_schema(out)), out)
    if heavy is not None:
        sums = sum_vectors(sums, ["user_id"], "sum", dim, "sum", F.sum("weight").alias("weight"))
    return sums.select("user_id", F.transform("sum", lambda x: x / F.col("weight")).alias("vector"))


def weighted_profile(inter: DataFrame, item_vectors: DataFrame, dim: int) -> DataFrame:
    """Mean weighted by strength, scaled to unit length."""
    mean = mean_vectors(inter.join(item_vectors, "item_id"), ["user_id"], "vector", dim, "vector", weight="strength")
    return mean.withColumn("vector", l2_normalize(F.col("vector")))


def lookup_vectors(ids: DataFrame, vectors: DataFrame, key: str = "item_id") -> DataFrame:
    """Vectors of known ids; unknown ids give no row."""
    return ids.join(vectors, key)


def lookup_vectors_zero(ids: DataFrame, vectors: DataFrame, dim: int, key: str = "item_id") -> DataFrame:
    """A zero vector stands for an unknown id."""
    zero = F.array_repeat(F.lit(0.0).cast(vectors.schema["vector"].dataType.elementType), dim)
    return ids.join(vectors, key, "left").withColumn("vector", F.coalesce("vector", zero))


def first_available(ids: DataFrame, sources: list[tuple[str, DataFrame]], key: str = "item_id", fallback_dim: int | None = None) -> DataFrame:
    """The vector of the first source that has one, with the source's name; ``missing`` when none has.

    ``fallback_dim`` asks for a hash-seeded unit-range vector in place of a missing one. It carries no taste and only
    keeps callers running that demand a vector.
    """
    result = ids
    names, columns = [], []
    for i, (name, vectors) in enumerate(sources):
        result = result.join(vectors.select(key, F.col("vector").alias(f"_v{i}")), key, "left")
        names.append(F.when(F.col(f"_v{i}").isNotNull(), F.lit(name)))
        columns.append(F.col(f"_v{i}"))
    result = result.withColumn("vector_source", F.coalesce(*names, F.lit("missing")))
    if fallback_dim:
        seeded = F.transform(
            F.sequence(F.lit(1), F.lit(fallback_dim)),
            lambda i: F.pmod(F.xxhash64(F.col(key).cast("string"), i), F.lit(1_000_000)) / 1_000_000.0,
        )
        columns.append(seeded.cast("array<double>"))
    return result.withColumn("vector", F.coalesce(*columns)).drop(*[f"_v{i}" for i in range(len(sources))])


def feature_sums(entity_features: DataFrame, embeddings: DataFrame, dim: int, entity: str = "item_id") -> DataFrame:
    """Representation of an entity as the sum of its feature vectors and biases.

    ``entity_features(entity, feature, weight)``, ``embeddings(feature, vector, bias)``. Few or large splits are dealt
    anew by entity, so that the sums of a task's entities stay below ``TASK_NUMBERS`` numbers whatever the size of the table.
    """
    parts = -(-entity_features.count() * dim // TASK_NUMBERS)
    if parts > entity_features.rdd.getNumPartitions():
        entity_features = entity_features.repartition(parts, entity)
    joined = entity_features.join(embeddings, "feature").withColumn("_v", F.transform("vector", lambda x: x * F.col("weight")))
    return sum_vectors(joined, [entity], "_v", dim, "vector", F.sum(F.col("bias") * F.col("weight")).alias("bias"))


def label_means(vectors: DataFrame, label: str, dim: int) -> DataFrame:
    return mean_vectors(vectors, [label], "vector", dim, "vector")


def normalised_weights(weights: DataFrame) -> DataFrame:
    """Component weights scaled to sum 1 (one row per component model)."""
    return weights.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy()))
