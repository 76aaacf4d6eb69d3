"""Vector index: exact and cell-probed search, appends, and the stored form."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.functions.vectors import l2_normalize, mean_vectors, vector_size
from tastemill.plans.topk import METRICS, blocked_topk, top_k
from tastemill.sources.tables import read_text, write_text

# The index kinds and the defaults of the coarse cells.
INDEX_TYPES = ("Flat", "IVF_Flat", "IVF_HNSW")
DEFAULT_NLIST = 100
DEFAULT_NPROBE = 10
CELL_ROWS = 10  # vectors needed per cell
CELL_FILES = 4  # most files of a cell in one write

MAX_CELLS = 65_536


def _doubles(df: DataFrame, column: str = "vector") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("array<double>"))


def as_queries(df: DataFrame, key: str = "item_id", vector: str = "vector") -> DataFrame:
    return df.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("query_vector"))


def as_items(df: DataFrame, key: str = "item_id", vector: str = "vector") -> DataFrame:
    return df.select(F.col(key).alias("item_id"), F.col(vector).cast("array<double>").alias("item_vector"))


def flat_search(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "inner_product", seen: DataFrame | None = None) -> DataFrame:
    """Exact top-k per query; an unknown metric name means squared Euclidean distance."""
    hits = blocked_topk(queries, as_items(vectors), k, metric if metric in METRICS else "l2", seen)
    return hits if metric in ("inner_product", "cosine") else hits.withColumn("score", -F.col("score"))


def nearest_cells(points: DataFrame, centroids: DataFrame, vector: str, nprobe: int) -> DataFrame:
    """``points`` once per cell for its nprobe nearest cells by Euclidean distance, equal distances by cell number.

    The centroid table is the one thing sent to all tasks; it has at most ``MAX_CELLS`` rows.
    """
    table = centroids.orderBy("cell").limit(MAX_CELLS + 1).collect()
    if len(table) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    cells = np.array([r["cell"] for r in table], dtype=np.int32)
    centers = np.array([r["vector"] for r in table], dtype=np.float64)
    probes = min(nprobe, len(cells))

    @F.pandas_udf("array<int>")
    def near(column: pd.Series) -> pd.Series:
        p = np.stack(column.to_numpy()).astype(np.float64)
        gap = (p * p).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2.0 * (p @ centers.T)
        return pd.Series(list(cells[np.argsort(gap, axis=1, kind="stable")[:, :probes]]))

    return points.withColumn("cell", F.explode(near(vector)))


class VectorIndex:
    """Item vectors with their cell and the centroids of the cells; ``Flat`` has no cells. Vectors in cells have unit length for cosine,
    those of ``Flat`` stay as given and get it in the blocks, because given numbers often travel as floats."""

    def __init__(self, vectors: DataFrame, centroids: DataFrame | None, index_type: str, metric: str, nprobe: int):
        self.vectors, self.centroids, self.index_type, self.metric, self.nprobe = vectors, centroids, index_type, metric, nprobe

    @classmethod
    def build(cls, vectors: DataFrame, index_type: str = "IVF_Flat", metric: str = "inner_product", nlist: int = DEFAULT_NLIST, nprobe: int = DEFAULT_NPROBE, seed: int = 42) -> VectorIndex:
        """``vectors(item_id, vector)``. Cells come from distributed k-means; both IVF kinds share them, because the coarse
        step over a few thousand centroids is exact here."""
        if index_type not in INDEX_TYPES:
            raise ValueError(f"unknown index type {index_type}; one of {', '.join(INDEX_TYPES)}")
        metric = metric if metric in METRICS else "l2"
        vectors = _doubles(vectors)
        if index_type == "Flat":
            return cls(vectors, None, index_type, metric, nprobe)
        if metric == "cosine":
            vectors = vectors.withColumn("vector", l2_normalize(F.col("vector")))
        cells = max(1, min(nlist, vectors.count() // CELL_ROWS))
        if cells == 1:
            centroids = mean_vectors(vectors.withColumn("cell", F.lit(0)), ["cell"], "vector", vector_size(vectors, "vector"), "vector")
            return cls(vectors.withColumn("cell", F.lit(0)), centroids, index_type, metric, nprobe)
        points = vectors.withColumn("features", array_to_vector("vector"))
        model = KMeans(k=cells, seed=seed, featuresCol="features", predictionCol="cell", maxIter=10).fit(points)
        centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        centroids = vectors.sparkSession.createDataFrame(centers, "cell int, vector array<double>")
        return cls(model.transform(points).drop("features"), centroids, index_type, metric, nprobe)

    @classmethod
    def from_cells(cls, vectors: DataFrame, centroids: DataFrame, metric: str, nprobe: int) -> VectorIndex:
        """An index over given cells: ``vectors(item_id, vector, cell)``, ``centroids(cell, vector)``."""
        return cls(_doubles(vectors), _doubles(centroids), "IVF_Flat", metric, nprobe)

    def search(self, queries: DataFrame, k: int = 10, seen: DataFrame | None = None) -> DataFrame:
        """Top-k per row of ``queries(query_id, query_vector)``; a query with fewer hits has fewer rows."""
        items, metric = as_items(self.vectors), self.metric
        if self.centroids is not None:
            if metric == "cosine":
                queries, metric = queries.withColumn("query_vector", l2_normalize(F.col("query_vector"))), "inner_product"
            queries = nearest_cells(queries, self.centroids, "query_vector", self.nprobe)
            items = self.vectors.select("item_id", F.col("vector").alias("item_vector"), "cell")
        hits = blocked_topk(queries, items, k, metric, seen)
        return hits.withColumn("score", -F.col("score")) if metric == "l2" else hits

    def add(self, new: DataFrame) -> VectorIndex:
        """Append ``new(item_id, vector)``; an id that is there already takes the new vector."""
        new = _doubles(new.select("item_id", "vector"))
        if self.metric == "cosine" and self.centroids is not None:
            new = new.withColumn("vector", l2_normalize(F.col("vector")))
        if self.centroids is not None:
            new = nearest_cells(new, self.centroids, "vector", 1)
        kept = self.vectors.join(new.select("item_id"), "item_id", "left_anti")
        return VectorIndex(kept.unionByName(new), self.centroids, self.index_type, self.metric, self.nprobe)

    def save(self, path: str) -> None:
        spark = self.vectors.sparkSession
        if self.centroids is None:
            self.vectors.write.parquet(f"{path}/vectors")
        else:
            # dealt by cell, a cell over a few tasks: else every task would write a file for every cell
            self.vectors.repartition("cell", F.pmod(F.xxhash64("item_id"), F.lit(CELL_FILES))).write.partitionBy("cell").parquet(f"{path}/vectors")
            self.centroids.write.parquet(f"{path}/centroids")
        write_text(spark, f"{path}/index.json", json.dumps({"index_type": self.index_type, "metric": self.metric, "nprobe": self.nprobe}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        meta = json.loads(read_text(spark, f"{path}/index.json"))
        vectors = spark.read.parquet(f"{path}/vectors")
        centroids = None if meta["index_type"] == "Flat" else spark.read.parquet(f"{path}/centroids")
        return cls(vectors, centroids, meta["index_type"], meta["metric"], meta["nprobe"])


def similar_items(vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest other items of every item."""
    hits = flat_search(as_queries(vectors), vectors, k + 1, metric)
    others = hits.where(F.col("query_id") != F.col("item_id")).drop("rank")
    order = F.desc("score") if metric in ("inner_product", "cosine") else F.asc("score")
    return top_k(others, ["query_id"], [order, F.asc("item_id")], k)


def pair_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Given id pairs with both vectors attached, for scores on chosen pairs only."""
    la = left.select(F.col("item_id").alias(a), F.col("vector").cast("array<double>").alias("va"))
    rb = right.select(F.col("item_id").alias(b), F.col("vector").cast("array<double>").alias("vb"))
    return pairs.join(la, a).join(rb, b)


def vectors_of(df: DataFrame, features: str) -> DataFrame:
    """MLlib vector column as an array column named ``vector``."""
    return df.withColumn("vector", vector_to_array(features))
