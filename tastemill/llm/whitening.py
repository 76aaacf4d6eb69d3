"""Whitening of vectors with distributed block matrices.

Every entry c becomes the integer x = floor(1024 * c) + 100000, so sums and deviations are exact. All usable vectors are fitted.

1. The usable rows are stored with the task that wrote them and their place in it; with the number of rows of each task this gives every row an
   index without a sort. Sums per dimension are added up with map-side combine.
2. The centred rows become MLlib's ``IndexedRowMatrix`` and from it a ``BlockMatrix`` of ``ROWS`` rows a block. Its transpose times itself is the
   scatter matrix; the long dimension of that product is split, so a task holds few blocks whatever the number of rows.
3. The scatter matrix, as wide as a vector, is decomposed on the driver. The block matrix times the whitening matrix (eigenvectors over the
   roots of their eigenvalues) projects all rows; the projections are stored, and their covariance is measured on them.

Defined cases: vectors that are null or hold a null or non-finite entry take no part, nor do vectors of another length than the most frequent one (of
equally frequent lengths the longest), nor empty ones. Repeated rows and null ids are rows like any other. Fewer dimensions than components give as many components as dimensions. A
component whose eigenvalue is zero within rounding has a null in place of a whitened value and is left out of the identity error; if all are, the error is null.
Without spread the explained share is null. An empty table, or one without usable vectors, gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F

from tastemill.session import checkpointed

COMPONENTS = 8
#: Rows and columns of a block, and blocks of a split of the long dimension.
ROWS, COLUMNS, BLOCKS = 2048, 1024, 8
EXACT = "decimal(38,0)"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part; a stored table with the row's index as ``i``."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    common = sound.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("many"), F.desc("d")).first()
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * 1024) + 100000)
    kept = sound.where(F.size("embedding") == (common.d if common else 0)).select("vec_id", whole.alias("x"))
    # The number that Spark gives a row holds the task above bit 33 and the place in it below.
    stored = checkpointed(kept.withColumn("at", F.monotonically_increasing_id()))
    tasks = stored.groupBy(F.expr("at >> 33").alias("task")).agg(F.count(F.lit(1)).alias("many"))
    before = tasks.select("task", (F.sum("many").over(Window.orderBy("task")) - F.col("many")).alias("before"))
    return stored.join(F.broadcast(before), F.expr("at >> 33") == F.col("task")).select("vec_id", "x", (F.col("before") + F.expr("at & 8589934591L")).alias("i"))


def totals(rows: DataFrame) -> list[int]:
    """The sum of every dimension."""
    sums = rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s"))
    return [int(s) for _, s in sorted(sums.collect())]


def numbers(values, kind: str) -> Column:
    """A constant array."""
    return F.array(*(F.lit(str(v)) for v in values)).cast(f"array<{kind}>")


def blocks_of(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """The rows ``i``, ``v`` (arrays of doubles) as a block matrix. Made from a DataFrame, so the rows do not pass through Python."""
    indexed = MLUtils.convertVectorColumnsFromML(rows.select("i", array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(callMLlibFunc("createIndexedRowMatrix", indexed, n, d)).toBlockMatrix(ROWS, COLUMNS)


def scatter(centred: BlockMatrix) -> np.ndarray:
    """The transpose of a tall matrix times the matrix, in splits of ``BLOCKS`` blocks of the long dimension."""
    splits = -(-centred.numRowBlocks // BLOCKS)
    # Python's ``multiply`` lacks the number of splits, without which the product of two such matrices is one task.
    product = centred.transpose()._java_matrix_wrapper._java_model.multiply(centred._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, COLUMNS, COLUMNS).toLocalMatrix().toArray()


def projected(centred: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """(i, w): every row times the matrix; a stored table."""
    spark, width = centred._java_matrix_wrapper._sc, matrix.shape[1]
    parts = [((k, 0), Matrices.dense(len(m), width, m.ravel(order="F"))) for k, m in enumerate(matrix[s : s + COLUMNS] for s in range(0, len(matrix), COLUMNS))]
    product = centred.multiply(BlockMatrix(spark.parallelize(parts, 1), COLUMNS, width, len(matrix), width))
    rows = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return checkpointed(rows.select(F.col("index").alias("i"), vector_to_array("vector").alias("w")))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation (a 38-digit decimal), whitened, explained and identity_error of every usable row and component."""
    rows = usable(vectors)
    n, sums = rows.count(), totals(rows)
    if not n:
        empty = vectors.select("vec_id").limit(0)
        return empty.select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in (
            ("component", "int"), ("n", "bigint"), ("deviation", EXACT), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))
    mean = numbers((s / n for s in sums), "double")
    centred = blocks_of(rows.select("i", F.zip_with("x", mean, lambda x, m: x - m).alias("v")), n, len(sums))
    values, axes = np.linalg.eigh(scatter(centred) / n)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    k, trace = min(components, len(sums)), float(values.sum())
    sound = [bool(values[c] > len(sums) * np.finfo(float).eps * values[0]) for c in range(k)]
    scale = np.array([values[c] ** -0.5 if sound[c] else 0.0 for c in range(k)])
    white = projected(centred, axes[:, :k] * scale)

    held = [c for c in range(k) if sound[c]]
    gaps = [F.abs(F.covar_pop(F.col("w")[a], F.col("w")[b]) - float(a == b)) for a in held for b in held if a <= b]
    error = white.agg(F.array_max(F.array(*gaps))).first()[0] if gaps else None
    gap = F.zip_with(F.transform("x", lambda x: x.cast(EXACT) * F.lit(n).cast("decimal(18,0)")), numbers(sums, EXACT), lambda x, s: (x - s).cast("decimal(19,0)"))
    deviation = F.aggregate(gap, F.lit(0).cast(EXACT), lambda total, g: (total + g * g).cast(EXACT))
    fixed = F.array(*(F.struct(F.lit(c + 1).alias("component"), F.lit(sound[c]).alias("sound"), F.lit(float(values[c]) / trace if trace else None).cast("double").alias("explained")) for c in range(k)))
    out = rows.select("i", "vec_id", deviation.alias("deviation")).join(white, "i")
    return out.select("vec_id", "deviation", "w", F.inline(fixed)).select(
        "vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", F.when(F.col("sound"), F.element_at("w", F.col("component"))).alias("whitened"),
        "explained", F.lit(error).cast("double").alias("identity_error"))
