"""The logical tables over the given parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.operators.interactions import interactions
from tastemill.plans.skew import spread
from tastemill.session import checkpointed


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def purchases(spark: SparkSession, root: str) -> DataFrame:
    """Order lines as events: the customer bought a quantity of a part on the order date."""
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("int").alias("qty"),
        F.col("o_orderdate").alias("ts"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
    )


def purchase_interactions(spark: SparkSession, root: str) -> DataFrame:
    return interactions(purchases(spark, root))


def stored_interactions(spark: SparkSession, root: str) -> DataFrame:
    """The interactions written once, for queries that read them several times."""
    return checkpointed(purchase_interactions(spark, root))


def items(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"),
    )


def users(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(F.col("c_custkey").alias("user_id"))


def clicks(spark: SparkSession, root: str) -> DataFrame:
    """The event stream; the item is the number k in the properties."""
    return table(spark, root, "events").select(
        "event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), "event_type", "value", F.lit(1).alias("qty")
    )


def click_interactions(spark: SparkSession, root: str) -> DataFrame:
    return interactions(clicks(spark, root))


def item_vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def item_documents(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "documents").select(F.col("doc_id").alias("item_id"), "text", "lang", "source"), "item_id")


# The same tables in SQL, as common table expressions.
SQL_PURCHASES = """purchases AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(l_quantity AS INTEGER) AS qty, o_orderdate AS ts,
         l_orderkey AS order_id, l_linenumber AS line_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SQL_INTERACTIONS = SQL_PURCHASES + """, inter AS (
  SELECT user_id, item_id, CAST(sum(qty) AS DOUBLE) AS strength, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS n_events
  FROM purchases GROUP BY user_id, item_id)"""
SQL_ITEMS = """items AS (
  SELECT p_partkey AS item_id, p_name AS title, p_type AS category, p_brand AS brand, p_retailprice AS price FROM part)"""
SQL_USERS = "users AS (SELECT c_custkey AS user_id FROM customer)"
SQL_CLICKS = """clicks AS (
  SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, event_type, value, 1 AS qty FROM events)"""
SQL_CLICK_INTER = SQL_CLICKS + """, cinter AS (
  SELECT user_id, item_id, CAST(sum(qty) AS DOUBLE) AS strength, max(ts) AS last_ts FROM clicks GROUP BY user_id, item_id)"""
SQL_VECTORS = "vectors AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings)"
SQL_POPULARITY = SQL_INTERACTIONS + """, popularity AS (
  SELECT item_id, sum(strength) AS score, CAST(count(*) AS BIGINT) AS n_users FROM inter GROUP BY item_id)"""
SQL_UNSEEN = """ranked AS (
  SELECT u.user_id, p.item_id, p.score, row_number() OVER (PARTITION BY u.user_id ORDER BY p.score DESC, p.item_id) AS rank
  FROM users u CROSS JOIN {source} p
  WHERE NOT EXISTS (SELECT 1 FROM inter i WHERE i.user_id = u.user_id AND i.item_id = p.item_id)
  QUALIFY rank <= {k})"""
