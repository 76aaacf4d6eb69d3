"""The contract of all models, their registry and their stored form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.operators.ann import as_items, as_queries
from tastemill.plans.topk import blocked_topk
from tastemill.sources.tables import path_exists, read_text, write_text


class Recommender:
    """Fitted state is a set of tables; nothing of the size of the data lives on the driver.

    ``fit(inter, items=None)`` takes one row per user and item with ``strength`` and ``last_ts``.
    ``recommend(users, history, k)`` returns ``user_id, item_id, score, rank`` for all given users at once.
    """

    model_type = ""

    def __init__(self, **params):
        self.params = params
        self.tables: dict[str, DataFrame] = {}

    def fit(self, inter: DataFrame, items: DataFrame | None = None) -> Recommender:
        raise NotImplementedError

    def recommend(self, users: DataFrame, history: DataFrame, k: int = 10, exclude_seen: bool = True) -> DataFrame:
        raise NotImplementedError

    def item_vectors(self) -> DataFrame | None:
        return self.tables.get("item_vectors")

    def user_vectors(self) -> DataFrame | None:
        return self.tables.get("user_vectors")

    def forget(self, deleted: DataFrame | None) -> Recommender:
        """The model without the rows of deleted users (``user_id``); they get no vectors and, passed as users, no list."""
        if deleted is not None:
            self.tables = {name: t.join(deleted.select("user_id"), "user_id", "left_anti") if "user_id" in t.columns else t for name, t in self.tables.items()}
        return self

    def _require_fit(self) -> None:
        if not self.tables:
            raise RuntimeError(f"the {self.model_type} model is not fitted")

    def save(self, path: str) -> None:
        self._require_fit()
        spark = next(iter(self.tables.values())).sparkSession
        for name, table in self.tables.items():
            table.write.parquet(f"{path}/{name}")
        write_text(spark, f"{path}/model.json", json.dumps({"model_type": self.model_type, "params": self.params, "tables": sorted(self.tables)}))


def vector_topk(users: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, history: DataFrame | None, k: int, metric: str = "inner_product") -> DataFrame:
    """Top items by vector score for the given users; seen pairs are masked inside the scoring blocks."""
    queries = as_queries(users.select("user_id").distinct().join(user_vectors, "user_id"), "user_id")
    seen = None
    if history is not None:
        seen = history.select(F.col("user_id").alias("query_id"), "item_id").join(users.select(F.col("user_id").alias("query_id")), "query_id", "left_semi")
    return blocked_topk(queries, as_items(item_vectors), k, metric, seen).withColumnRenamed("query_id", "user_id")


_REGISTRY: dict[str, type[Recommender]] = {}


def register(cls: type[Recommender]) -> type[Recommender]:
    _REGISTRY[cls.model_type.lower()] = cls
    return cls


def model_names() -> list[str]:
    return sorted(_REGISTRY)


def model_class(name: str) -> type[Recommender]:
    found = _REGISTRY.get(name.lower())
    if found is None:
        raise ValueError(f"unknown model {name}; one of {', '.join(model_names())}")
    return found


def create_model(name: str, **params) -> Recommender:
    return model_class(name)(**params)


def load_model(spark: SparkSession, path: str) -> Recommender:
    if not path_exists(spark, f"{path}/model.json"):
        raise FileNotFoundError(f"no model at {path}")
    meta = json.loads(read_text(spark, f"{path}/model.json"))
    model = create_model(meta["model_type"], **meta["params"])
    model.tables = {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}
    return model.with_components([load_model(spark, f"{path}/{name}") for name in meta["components"]]) if "components" in meta else model
