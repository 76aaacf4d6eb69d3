"""Fusion of component lists with weights that react to short histories."""

from __future__ import annotations

import json
import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tastemill.functions.scalars import min_max
from tastemill.models.base import Recommender, load_model, register
from tastemill.operators.interactions import user_history_size
from tastemill.operators.profiles import first_available
from tastemill.plans.topk import top_k
from tastemill.sources.tables import write_text

log = logging.getLogger(__name__)

# Model groups, limits and shares of the fusion.
CONTENT_MODELS = ("text_embedding", "lightfm", "item2vec")
COLLABORATIVE_MODELS = ("als", "bpr", "ease")
MIN_WEIGHT = 0.001
POOL_FACTOR = 3
MOVED_SHARE = 0.7
COLD_START_THRESHOLD = 5


def normalise(weights: list[float]) -> list[float]:
    total = sum(weights)
    return [w / total for w in weights] if total > 0 else list(weights)


def base_weights(models: list[str], weights: list[float] | None) -> list[float]:
    """Given weights scaled to sum 1; equal ones when their number does not match the models."""
    if not weights or len(weights) != len(models):
        return [1.0 / len(models)] * len(models)
    return normalise(weights)


def cold_weights(models: list[str], weights: list[float], strategy: str = "content_boost", content=CONTENT_MODELS, collaborative=COLLABORATIVE_MODELS) -> list[float]:
    """The weights of a user with a short history."""
    is_content = [m in content for m in models]
    is_collaborative = [m in collaborative and m not in content for m in models]
    if strategy == "content_only" and any(is_content):
        return normalise([float(c) for c in is_content])
    if strategy == "content_boost" and any(is_content) and any(is_collaborative):
        given = sum(w for w, c in zip(weights, is_collaborative) if c) * MOVED_SHARE
        receiving = sum(w for w, c in zip(weights, is_content) if c)
        gain = 1.0 + given / receiving if receiving > 0 else 1.0
        return normalise([w * (1.0 - MOVED_SHARE) if col else w * gain if con else w for w, con, col in zip(weights, is_content, is_collaborative)])
    return normalise(weights)


def user_weights(users: DataFrame, history_size: DataFrame, models: list[str], weights: list[float], threshold: int = COLD_START_THRESHOLD, strategy: str = "content_boost", **groups) -> DataFrame:
    """(user_id, model, weight): warm or cold weights by the number of items in the history (cold below the threshold)."""

    def table(values: list[float]):
        return F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(w)).alias("weight")) for m, w in zip(models, values)])

    sized = users.select("user_id").distinct().join(history_size, "user_id", "left")
    is_cold = F.coalesce(F.col("n_items"), F.lit(0)) < threshold
    chosen = F.when(is_cold, table(cold_weights(models, weights, strategy, **groups))).otherwise(table(weights))
    return sized.select("user_id", is_cold.alias("is_cold"), F.explode(chosen).alias("w")).select("user_id", "is_cold", "w.model", "w.weight")


def fuse(lists: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Scale each component list to [0, 1], weight it, keep the best weighted score per item, cut to k.

    ``lists(user_id, model, item_id, score)``, ``weights(model, weight)`` or ``weights(user_id, model, weight)``.
    """
    # A user's lists are dealt out once, by the user: the windows, the join, the groups and the last cut all stand on that.
    lists = lists.repartition("user_id") if "user_id" in weights.columns else lists
    pool = top_k(lists, ["user_id", "model"], [F.desc("score"), F.asc("item_id")], k * POOL_FACTOR, "_r").drop("_r")
    per_list = Window.partitionBy("user_id", "model")  # at most POOL_FACTOR * k rows
    scaled = pool.withColumn("_s", min_max(F.col("score"), F.min("score").over(per_list), F.max("score").over(per_list)))
    heavy = weights.where(F.col("weight") > MIN_WEIGHT)
    if "user_id" in weights.columns:
        # one row per user, so that the join is by the user alone
        own = heavy.where(F.col("model").isNotNull()).groupBy("user_id", "model").agg(F.max("weight").alias("weight"))
        own = own.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("model", "weight"))).alias("_w"))
        weighted = scaled.join(own, "user_id").withColumn("weight", F.col("_w")[F.col("model")]).where("weight IS NOT NULL")
    else:
        weighted = scaled.join(heavy, "model")
    best = weighted.groupBy("user_id", "item_id").agg(F.max(F.col("_s") * F.col("weight")).alias("score"))
    return top_k(best, ["user_id"], [F.desc("score"), F.asc("item_id")], k)


@register
class HybridModel(Recommender):
    model_type = "hybrid"

    def __init__(self, weights: list[float] | None = None, dynamic_weighting: bool = True, cold_start_threshold: int = COLD_START_THRESHOLD,
                 cold_start_strategy: str = "content_boost", content_models: list[str] | None = None, collaborative_models: list[str] | None = None):
        super().__init__(
            weights=weights, dynamic_weighting=dynamic_weighting, cold_start_threshold=cold_start_threshold, cold_start_strategy=cold_start_strategy,
            content_models=list(content_models or CONTENT_MODELS), collaborative_models=list(collaborative_models or COLLABORATIVE_MODELS),
        )
        self.components: list[Recommender] = []

    def with_components(self, components: list[Recommender]) -> HybridModel:
        self.components = components
        return self

    def fit(self, inter: DataFrame, items: DataFrame | None = None) -> HybridModel:
        for component in self.components:
            component.fit(inter, items)
        return self

    def weights_for(self, users: DataFrame, history: DataFrame) -> DataFrame:
        p = self.params
        names = [c.model_type for c in self.components]
        base = base_weights(names, p["weights"])
        threshold = p["cold_start_threshold"] if p["dynamic_weighting"] else 0
        groups = {"content": p["content_models"], "collaborative": p["collaborative_models"]}
        return user_weights(users, user_history_size(history), names, base, threshold, p["cold_start_strategy"], **groups).drop("is_cold")

    def recommend(self, users: DataFrame, history: DataFrame, k: int = 10, exclude_seen: bool = True) -> DataFrame:
        if not self.components:
            raise RuntimeError("the hybrid has no components")
        pool = k * POOL_FACTOR
        lists = [
            c.recommend(users, history, pool, exclude_seen).select("user_id", F.lit(c.model_type).alias("model"), "item_id", F.col("score").cast("double"))
            for c in self.components
        ]
        return fuse(reduce(DataFrame.unionByName, lists), self.weights_for(users, history), k)

    def vectors_for(self, ids: DataFrame) -> DataFrame:
        """Item vectors of the first content component that has one, then of any other component."""
        ordered = sorted(self.components, key=lambda c: c.model_type not in self.params["content_models"])
        sources = [(c.model_type, c.item_vectors().withColumn("vector", F.col("vector").cast("array<double>"))) for c in ordered if c.item_vectors() is not None]
        return first_available(ids, sources)

    def save(self, path: str) -> None:
        if not self.components:
            raise RuntimeError("the hybrid has no components")
        names = []
        for i, component in enumerate(self.components):
            names.append(f"component-{i}")
            component.save(f"{path}/{names[-1]}")
        spark = next(iter(self.components[0].tables.values())).sparkSession
        write_text(spark, f"{path}/model.json", json.dumps({"model_type": self.model_type, "params": self.params, "tables": [], "components": names}))


def load_hybrid(spark: SparkSession, path: str) -> HybridModel:
    model = load_model(spark, path)
    if not isinstance(model, HybridModel):
        raise ValueError(f"the model at {path} is no hybrid")
    return model


def compose(spark: SparkSession, model_dirs: list[str], **params) -> HybridModel:
    """A hybrid of stored models, tied together by raw ids; unreadable ones are logged and left out."""
    found = []
    for path in model_dirs:
        try:
            found.append(load_model(spark, path))
        except Exception as problem:  # a bad directory must not stop the others
            log.warning("model at %s left out: %s", path, problem)
    if not found:
        raise ValueError("no readable component model")
    weights = params.pop("weights", None)
    if weights is not None and len(weights) != len(found):
        log.warning("%d weights for %d models: equal weights are used", len(weights), len(found))
        weights = None
    return HybridModel(weights=weights, **params).with_components(found)
