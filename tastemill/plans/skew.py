"""Balance: joins with hot keys, and row work behind few large files."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastemill.session import checkpointed

BLOCK_NUMBERS = 1 << 25  # entries of a block of users times the numbers of a vector
LEAST_ENTRIES = 1 << 17  # a block is not made smaller for the sake of more tasks


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt_by: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join with the rows of each ``left`` key spread over ``salts`` tasks by a hash of ``salt_by``.

    Meant for joins on a popular item, where the result keeps the key's partitioning and adaptive splitting cannot
    step in. ``right`` must hold few rows per key, because each of them is repeated once per salt.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join keeps the left side whole: inner or left only")
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Rows of a plain scan over at least as many tasks as there are cores, placed by a unique ``key``.

    For heavy work per row (text, parsing) behind a few unsplittable files. With more input splits than cores, as on
    large data, nothing happens.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def blocks_of(history: DataFrame, dim: int, per_row: int = 1) -> tuple[int, DataFrame | None]:
    """Number of blocks for the rows of ``history(user_id, ...)``, each making ``per_row`` entries that name vectors of ``dim`` numbers,
    and the users too large for one block, or None."""
    most = max(1, BLOCK_NUMBERS // (dim * per_row))
    sizes = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("_h"))
    n, n_heavy = sizes.agg(F.coalesce(F.sum("_h"), F.lit(0)), F.count_if(F.col("_h") > most // 4)).first()
    cores = history.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // most), min(cores, n * per_row // LEAST_ENTRIES))
    return blocks, checkpointed(sizes.where((F.col("_h") > most // 4) & F.col("user_id").isNotNull()).select("user_id")) if n_heavy else None


def dealt_by_user(rows: DataFrame, item: str, blocks: int, heavy: DataFrame | None, mark: str | None = None) -> DataFrame:
    """``rows`` with the ``part`` of their user; those of a heavy user are dealt by their item, and told by the column ``mark``. Rows without a user or an item are left out."""
    rows = rows.where(F.col("user_id").isNotNull() & F.col(item).isNotNull())
    marked = rows.withColumn("_heavy", F.lit(False)) if heavy is None else rows.join(heavy.withColumn("_heavy", F.lit(True)), "user_id", "left")
    dense = F.coalesce("_heavy", F.lit(False))
    marked = marked.withColumn("part", F.pmod(F.when(dense, F.xxhash64("user_id", item)).otherwise(F.xxhash64("user_id")), F.lit(blocks)).cast("int"))
    return (marked.withColumn(mark, dense) if mark else marked).drop("_heavy")


def parts_of_users(users: DataFrame, blocks: int, heavy: DataFrame | None) -> DataFrame:
    """``users`` with every part ``of`` that ``dealt_by_user`` may give their rows."""
    own = F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")
    users = users.where(F.col("user_id").isNotNull())
    if heavy is None:
        return users.withColumn("of", own)
    marked = users.join(heavy.withColumn("_heavy", F.lit(True)), "user_id", "left")
    return marked.withColumn("of", F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array(own)))).drop("_heavy")


def positions(names: pa.ChunkedArray, asked: pa.ChunkedArray) -> np.ndarray:
    """Places of the asked ids among distinct names, -1 for an unknown one."""
    return pd.Index(names.to_pandas()).get_indexer(pd.Index(asked.to_pandas()))
