"""Reranking of recommendation lists and the texts that explain them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastemill.functions.scalars import min_max
from tastemill.session import checkpointed

#: Rows of lists that are ordered in one task.
PART_ROWS = 1 << 20

# Default component weights of the two request kinds.
RECOMMEND_WEIGHTS = {"diversity": 0.2, "novelty": 0.2, "popularity": 0.2, "relevance": 0.4}
SIMILAR_WEIGHTS = {"diversity": 0.3, "novelty": 0.1, "popularity": 0.2, "relevance": 0.4}
STRATEGIES = ("diversity", "novelty", "popularity", "hybrid")


def _scaled(column: Column, by: str) -> Column:
    group = Window.partitionBy(by)
    return min_max(column, F.min(column).over(group), F.max(column).over(group))


def components(lists: DataFrame, item_stats: DataFrame, n_users: int, by: str = "user_id") -> DataFrame:
    """Component scores in [0, 1] per list row.

    ``lists(by, item_id, score, category)`` are bounded lists; ``item_stats(item_id, n_users)``. Diversity falls with the
    place of the item among those of its category in the list, novelty is the surprise of the item, popularity its
    damped audience, relevance the given score.
    The rows are stored and counted: lists of popular items compress so well that the optimizer would put far too many of them in one task.
    """
    rows = lists.join(item_stats.select("item_id", F.col("n_users").alias("_n")), "item_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rows = checkpointed(rows)
    parts = -(-rows.count() // PART_ROWS)
    if parts > 1:
        rows = rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism), by)
    same = Window.partitionBy(by, "category").orderBy(F.desc("score"), F.asc("item_id"))
    surprise = -F.log2(F.greatest(F.col("_n"), F.lit(1)) / F.lit(float(n_users)))
    rows = rows.withColumn("_surprise", surprise).withColumn("_audience", F.log2(1.0 + F.col("_n")))
    rows = rows.withColumn("diversity", 1.0 / F.row_number().over(same)).withColumn("novelty", _scaled(F.col("_surprise"), by))
    rows = rows.withColumn("popularity", _scaled(F.col("_audience"), by)).withColumn("relevance", _scaled(F.col("score"), by))
    return rows.drop("_n", "_surprise", "_audience")


def rerank(rows: DataFrame, strategy: str = "hybrid", weights: dict[str, float] | None = None, by: str = "user_id") -> DataFrame:
    """New order of each list by one component or by the weighted sum; ``rerank_score`` and ``new_rank`` are added."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; one of {', '.join(STRATEGIES)}")
    if strategy == "hybrid":
        weights = weights or RECOMMEND_WEIGHTS
        score = sum((F.lit(w) * F.col(name) for name, w in weights.items()), F.lit(0.0))
    else:
        score = F.col(strategy)
    scored = rows.withColumn("rerank_score", score)
    order = Window.partitionBy(by).orderBy(F.desc(F.round("rerank_score", 9)), F.desc("score"), F.asc("item_id"))
    return scored.withColumn("new_rank", F.row_number().over(order))


def explain_rows(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """A sentence for the component that contributes most; equal contributions go to the first in the order below."""
    weights = weights or RECOMMEND_WEIGHTS
    part = {name: F.round(F.lit(w) * F.col(name), 9) for name, w in weights.items()}
    top = F.greatest(*part.values())
    # The first two sentences.
    text = (
        F.when(part["relevance"] == top, F.lit("Recommended based on your interests"))
        .when(part["diversity"] == top, F.concat(F.lit("Adding variety with this "), F.coalesce("category", F.lit("other")), F.lit(" item")))
        .when(part["popularity"] == top, F.lit("Popular with other shoppers"))
        .otherwise(F.lit("Something new to discover"))
    )
    return rows.withColumn("explanation", text)
