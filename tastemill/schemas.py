"""Explicit schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("qty", T.IntegerType()),
])

ITEMS = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("img_url", T.StringType()),
])

ITEM_METADATA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("img_url", T.StringType()),
    T.StructField("description", T.StringType()),
])

MESSAGE = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("qty", T.IntegerType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
])

DELETED_USERS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("deletion_timestamp", T.LongType()),
])
