"""Sequence model: item-to-item transitions within sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastemill.models.base import Recommender, register
from tastemill.operators.sequences import last_items, next_item_pairs, predict_next, transition_probabilities
from tastemill.plans.topk import rank_lists, unseen_heads
from tastemill.session import checkpointed


@register
class TransitionModel(Recommender):
    """First-order transitions scored from the last item of a user, in place of a recurrent network."""

    model_type = "gru4rec"

    def __init__(self, gap_seconds: int = 21600, smoothing: float = 1.0):
        super().__init__(gap_seconds=gap_seconds, smoothing=smoothing)

    def fit(self, events: DataFrame, items: DataFrame | None = None) -> TransitionModel:
        """``events(event_id, user_id, item_id, ts)``."""
        pairs = next_item_pairs(events, self.params["gap_seconds"])
        n_items = events.agg(F.countDistinct("item_id")).first()[0]
        self.tables = {"transitions": checkpointed(transition_probabilities(pairs, n_items, self.params["smoothing"]))}
        return self

    def predict_next_items(self, last: DataFrame, k: int = 10) -> DataFrame:
        self._require_fit()
        return predict_next(last, self.tables["transitions"], k)

    def recommend(self, users: DataFrame, history: DataFrame, k: int = 10, exclude_seen: bool = False) -> DataFrame:
        """``history`` are events. Items of the session may come back, unless seen ones are excluded."""
        self._require_fit()
        own = history.join(users.select("user_id").distinct(), "user_id", "left_semi")
        if not exclude_seen:
            found = self.predict_next_items(last_items(own), k)
            return found.select("user_id", F.col("next_item").alias("item_id"), F.col("probability").alias("score"), "rank")
        lists = self.tables["transitions"].select(F.col("prev_item").alias("list_id"), F.col("next_item").alias("item_id"), F.col("probability").alias("score"))
        readers = last_items(own).withColumnRenamed("last_item", "list_id")
        return unseen_heads(readers, own.select("user_id", "item_id").distinct(), rank_lists(lists), k).select("user_id", "item_id", "score", "rank")
