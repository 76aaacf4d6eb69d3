"""From events to interactions, dense ids and the statistics that stand on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastemill.functions.scalars import stable_hash
from tastemill.plans.ordered import dense_index


def interactions(events: DataFrame) -> DataFrame:
    """Strength per user and item: the summed quantity, with the time of the last event."""
    return events.groupBy("user_id", "item_id").agg(
        F.sum("qty").cast("double").alias("strength"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events")
    )


def distinct_entities(events: DataFrame) -> DataFrame:
    """Users and items with at least one event, one row each."""
    users = events.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"))
    items = events.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"))
    return users.distinct().unionByName(items.distinct())


def item_universe(events: DataFrame, items: DataFrame, universe: str = "events") -> DataFrame:
    """Items with events, or the whole catalog with items nobody bought."""
    if universe == "events":
        return events.select("item_id").distinct()
    if universe == "catalog":
        return items.select("item_id").distinct()
    raise ValueError("universe is events or catalog")


def entity_index(df: DataFrame, id_column: str, out: str) -> DataFrame:
    """Dense numbers 0..n-1 in id order, one row per distinct id."""
    return dense_index(df.select(id_column).where(F.col(id_column).isNotNull()).distinct(), [F.asc(id_column)], out)


def encode(inter: DataFrame, user_index: DataFrame, item_index: DataFrame) -> DataFrame:
    """Raw ids to numbers; rows with an unmapped id drop out. Runs on aggregated rows, so a hot user is at most one row per item."""
    return inter.join(user_index, "user_id").join(item_index, "item_id")


def decode(df: DataFrame, index: DataFrame, idx: str, raw: str) -> DataFrame:
    """Numbers to raw ids; a number without an id becomes unknown_<number>."""
    named = df.join(index.select(idx, F.col(raw).cast("string").alias(raw)), idx, "left")
    return named.withColumn(raw, F.coalesce(F.col(raw), F.concat(F.lit("unknown_"), F.col(idx).cast("string"))))


def matrix_stats(inter: DataFrame) -> DataFrame:
    shape = inter.agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"), F.count("*").alias("nnz"))
    return shape.withColumn("density", F.col("nnz") / (F.col("n_users").cast("double") * F.col("n_items")))


def user_history_size(inter: DataFrame) -> DataFrame:
    return inter.groupBy("user_id").agg(F.count("item_id").alias("n_items"))


def events_per_user(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count("*").alias("n_events"))


def item_popularity(inter: DataFrame) -> DataFrame:
    """Total strength and number of users per item; ``inter`` has one row per user and item."""
    return inter.groupBy("item_id").agg(F.sum("strength").alias("score"), F.count("user_id").alias("n_users"))


def unseen(candidates: DataFrame, inter: DataFrame) -> DataFrame:
    return candidates.join(inter.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def new_items(events: DataFrame, known: DataFrame) -> DataFrame:
    return events.select("item_id").distinct().join(known.select("item_id"), "item_id", "left_anti")


def negative_triples(inter: DataFrame, item_index: DataFrame, n_items: int, per_positive: int = 1, seed: int = 42) -> DataFrame:
    """(user, positive, negative) by a hash of the pair; a candidate that the user has is dropped, exactly."""
    draw = F.explode(F.sequence(F.lit(1), F.lit(per_positive)))
    drawn = inter.select("user_id", F.col("item_id").alias("pos_item"), draw.alias("draw"))
    drawn = drawn.withColumn("item_idx", stable_hash(F.col("user_id"), F.col("pos_item"), F.col("draw"), seed=seed) % n_items)
    named = drawn.join(item_index, "item_idx").select("user_id", "pos_item", "draw", "item_id")
    return unseen(named, inter).withColumnRenamed("item_id", "neg_item")
