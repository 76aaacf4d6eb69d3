"""Ordered computations that never put one whole key into one task.

A plain window over a user would sort all rows of that user in one task. Here a key is cut into chunks by a monotone
function of the order (a day, a block of ranks). Windows run inside (key, chunk); what must cross chunk edges is carried
by a table with one row per (key, chunk), made with partial aggregation.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastemill.session import checkpointed

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def chunk_scan(
    df: DataFrame,
    keys: list[str],
    chunk: str,
    order: list[str],
    position: str | None = None,
    following: str | None = None,
    preceding: str | None = None,
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """1-based ``position`` within the key and structs with the ``following`` and ``preceding`` row of the key.

    ``order`` is a total order and never goes back from one chunk to the next. The structs hold ``order`` and
    ``columns`` and are null at the ends of a key. The edges of the chunks are taken from the same sorted rows, so a
    ``df`` that holds nothing but keys, order and columns is read and shuffled once.
    """
    row = F.struct(*order, *[c for c in columns if c not in order])
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    along = Window.partitionBy(*keys).orderBy(chunk)
    # A row without a place in the order is an error, not a row to lose; without a key it belongs to no sequence.
    placed = F.coalesce(F.col(chunk), F.raise_error(F.lit(f"a row has no {chunk} to be ordered by")).cast(df.schema[chunk].dataType))
    known = reduce(and_, [F.col(c).isNotNull() for c in keys])  # stated here, so that both uses stay one shuffle
    rows = df.where(known).withColumn(chunk, placed).withColumn("_scan_local", F.row_number().over(inside))
    rows = rows.withColumn("_scan_next", F.lead(row).over(inside)).withColumn("_scan_prev", F.lag(row).over(inside))
    ends = rows.where(F.col("_scan_next").isNull() | F.col("_scan_prev").isNull())  # at most two rows per chunk
    edges = ends.groupBy(*keys, chunk).agg(F.max("_scan_local").alias("_scan_n"), F.min(row).alias("_scan_first"), F.max(row).alias("_scan_last"))
    before = F.coalesce(F.sum("_scan_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(
        *keys, chunk, before.alias("_scan_before"),
        F.lead("_scan_first").over(along).alias("_scan_next_first"), F.lag("_scan_last").over(along).alias("_scan_prev_last"),
    )
    result = rows.join(edges, [*keys, chunk])
    if position:
        result = result.withColumn(position, F.col("_scan_before") + F.col("_scan_local"))
    if following:
        result = result.withColumn(following, F.coalesce("_scan_next", "_scan_next_first"))
    if preceding:
        result = result.withColumn(preceding, F.coalesce("_scan_prev", "_scan_prev_last"))
    return result.drop(*[c for c in result.columns if c.startswith("_scan_")])


def dense_index(df: DataFrame, order: list[Column | str], out: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in the given total order, by a range-partitioned sort instead of one global window.

    The sorted rows are written first, because a row number is only meaningful for one fixed partitioning.
    """
    fixed = checkpointed(df.orderBy(*order).withColumn("_seq", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("_part", F.shiftright("_seq", _ROW_BITS)).withColumn("_row", F.col("_seq").bitwiseAND((1 << _ROW_BITS) - 1))
    counts = fixed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition of the sort: bounded by the partition count, so a single-task window and a broadcast are safe
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    numbered = fixed.join(F.broadcast(starts), "_part")
    return numbered.withColumn(out, F.col("_first") + F.col("_row") + F.lit(start)).drop("_seq", "_part", "_row", "_first")
