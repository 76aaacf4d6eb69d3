"""Item vectors from sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastemill.models import skipgram
from tastemill.models.base import Recommender, register
from tastemill.operators.ann import as_items, as_queries
from tastemill.operators.profiles import lookup_vectors_zero, mean_profile_by_blocks
from tastemill.plans.ordered import chunk_scan
from tastemill.plans.topk import blocked_topk
from tastemill.session import checkpointed


def history_places(inter: DataFrame) -> DataFrame:
    """A user's items in time order as one session."""
    rows = inter.withColumn("_day", F.to_date("last_ts"))
    placed = chunk_scan(rows, ["user_id"], "_day", ["last_ts", "item_id"], position="_pos")
    return placed.select(F.col("user_id").alias("session"), F.col("_pos").alias("pos"), F.col("item_id").alias("item"))


@register
class Item2VecModel(Recommender):
    """Skip-gram vectors of items with negative sampling, trained in tiles (models/skipgram.py)."""

    model_type = "item2vec"

    def __init__(self, vector_size: int = 128, window: int = 5, min_count: int = 1, epochs: int = 5, seed: int = 42, negative: int = 5, sg: int = 1, **unused):
        if sg != 1:
            raise ValueError("only skip-gram (sg=1) is built")
        if set(unused) - {"partitions"}:  # stored with models of an earlier version
            raise TypeError(f"unknown parameters {sorted(unused)}")
        super().__init__(vector_size=vector_size, window=window, min_count=min_count, epochs=epochs, seed=seed, negative=negative, sg=sg)

    def fit(self, inter: DataFrame, items: DataFrame | None = None, sentences: DataFrame | None = None, sessions: DataFrame | None = None) -> Item2VecModel:
        """Trains on ``sessions(user_id, session_no, pos, item_id)`` or ``sentences(sentence array<string>)``; without them each user's history is a session."""
        p, item_type = self.params, inter.schema["item_id"].dataType
        if sentences is not None:
            sentences = sentences.select("sentence")
            pairs = skipgram.sentence_pairs(sentences, p["window"])
            words = sentences.select(F.explode("sentence").alias("item"))
        else:
            places = history_places(inter) if sessions is None else sessions.select(F.struct("user_id", "session_no").alias("session"), "pos", F.col("item_id").alias("item"))
            places = checkpointed(places)  # read for the centres, the contexts and the counts
            pairs = skipgram.window_pairs(places, p["window"])
            words = places
        counts = words.groupBy("item").agg(F.count(F.lit(1)).alias("many"))
        vectors, losses = skipgram.skipgram(pairs, counts, p["vector_size"], p["epochs"], p["min_count"], p["negative"], seed=p["seed"])
        self.tables = {"item_vectors": vectors.select(F.col("item").cast(item_type).alias("item_id"), "vector"), "losses": losses}
        return self

    def vectors_for(self, ids: DataFrame) -> DataFrame:
        """Vectors of the given ids, zero for unknown ones."""
        self._require_fit()
        return lookup_vectors_zero(ids, self.tables["item_vectors"], self.params["vector_size"])

    def recommend(self, users: DataFrame, history: DataFrame, k: int = 10, exclude_seen: bool = True) -> DataFrame:
        self._require_fit()
        return profile_recommend(users, history, self.tables["item_vectors"], self.params["vector_size"], k, exclude_seen)


def profile_recommend(users: DataFrame, history: DataFrame, item_vectors: DataFrame, dim: int, k: int, exclude_seen: bool = True) -> DataFrame:
    """Cosine of the mean vector of a user's items to every unseen item. Histories and profiles are stored, because the search reads its queries twice."""
    own = checkpointed(history.join(users.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item_id"))
    profiles = checkpointed(mean_profile_by_blocks(own, item_vectors, dim))
    seen = own.select(F.col("user_id").alias("query_id"), "item_id") if exclude_seen else None
    return blocked_topk(as_queries(profiles, "user_id"), as_items(item_vectors), k, "cosine", seen).withColumnRenamed("query_id", "user_id")
