"""Queries over requests whose filters work before the list is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.catalog import bindings as b
from tastemill.catalog.registry import query
from tastemill.catalog.serving import FILTERS, SQL_FILTERS
from tastemill.catalog.vectors import SQL_COS
from tastemill.functions.scalars import rounded
from tastemill.operators import requests as ops, rerank as rr
from tastemill.operators.interactions import item_popularity

LIST, NEAR = 30, 12

_SQL_ASKED = """requests AS (SELECT c_custkey AS user_id, 1 + c_nationkey % 3 AS asked, 4 + c_nationkey % 2 AS page_size,
  CASE WHEN c_mktsegment = 'BUILDING' THEN ['SMALL', 'LARGE'] WHEN c_mktsegment = 'FURNITURE' THEN ['PROMO'] END AS categories,
  CASE WHEN c_nationkey % 5 = 2 THEN ['Brand#3', 'Brand#17', 'Brand#21'] END AS brands,
  CASE WHEN c_nationkey % 4 = 1 THEN 920.0::DOUBLE END AS min_price, CASE WHEN c_acctbal < 0 THEN 970.0::DOUBLE END AS max_price,
  CASE WHEN c_nationkey = 7 THEN range(1, 61) END AS exclude_items, CASE WHEN c_nationkey = 3 THEN range(11, 141) END AS include_items FROM customer)"""
_SQL_PASSES = """(categories IS NULL OR list_contains(categories, category)) AND (brands IS NULL OR list_contains(brands, brand))
  AND (min_price IS NULL OR price >= min_price) AND (max_price IS NULL OR price <= max_price)
  AND (include_items IS NULL OR list_contains(include_items, item_id)) AND (exclude_items IS NULL OR NOT list_contains(exclude_items, item_id))"""


def asked_of(spark: SparkSession, d: str) -> DataFrame:
    """One request per customer with filters from segment, nation and balance."""
    customer = b.table(spark, d, "customer")
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    words = lambda *values: F.array(*map(F.lit, values))
    numbers = lambda first, last: F.sequence(F.lit(first), F.lit(last)).cast("array<bigint>")
    return customer.select(
        F.col("c_custkey").alias("user_id"), (1 + nation % 3).alias("page"), (4 + nation % 2).alias("page_size"),
        F.when(segment == "BUILDING", words("SMALL", "LARGE")).when(segment == "FURNITURE", words("PROMO")).alias("categories"),
        F.when(nation % 5 == 2, words("Brand#3", "Brand#17", "Brand#21")).alias("brands"),
        F.when(nation % 4 == 1, F.lit(920.0)).alias("min_price"), F.when(F.col("c_acctbal") < 0, F.lit(970.0)).alias("max_price"),
        F.when(nation == 7, numbers(1, 60)).alias("exclude_items"), F.when(nation == 3, numbers(11, 140)).alias("include_items"),
    )


@query("recommend_filtered_batch", f"""WITH {b.SQL_POPULARITY}, {b.SQL_ITEMS}, {_SQL_ASKED},
ranked AS (SELECT r.user_id, r.asked, r.page_size, p.item_id, p.score, i.category, i.brand, i.price, row_number() OVER (PARTITION BY r.user_id ORDER BY p.score DESC, p.item_id) AS rank
  FROM requests r CROSS JOIN popularity p JOIN items i ON i.item_id = p.item_id
  WHERE {_SQL_PASSES.replace("item_id)", "p.item_id)")} AND NOT EXISTS (SELECT 1 FROM inter x WHERE x.user_id = r.user_id AND x.item_id = p.item_id) QUALIFY rank <= {LIST}),
sized AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS total, CAST(ceil(count(*) OVER (PARTITION BY user_id) / CAST(page_size AS DOUBLE)) AS BIGINT) AS total_pages FROM ranked),
clamped AS (SELECT *, greatest(1, least(asked, total_pages)) AS page FROM sized)
SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank, score, category, brand, price, CAST(total AS BIGINT) AS total, CAST(page AS BIGINT) AS page, total_pages, page < total_pages AS has_next
FROM clamped WHERE rank > (page - 1) * page_size AND rank <= page * page_size""")
def recommend_filtered_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's page of the best items that pass their own filters."""
    inter = b.stored_interactions(spark, d)
    shown = ops.answer(asked_of(spark, d), inter, b.items(spark, d), item_popularity(inter), LIST)
    return shown.select("user_id", "item_id", "rank", "score", "category", "brand", "price", "total", "page", "total_pages", "has_next")


_SQL_NEAR = f"""WITH {b.SQL_VECTORS}, {b.SQL_ITEMS}, {b.SQL_CLICK_INTER}, stats AS (SELECT item_id, count(*) AS n_users FROM cinter GROUP BY item_id),
allowed AS (SELECT v.* FROM vectors v JOIN items USING (item_id) WHERE {SQL_FILTERS}),
near AS (SELECT a.item_id AS query_id, b.item_id, {SQL_COS} AS score FROM vectors a CROSS JOIN allowed b WHERE a.item_id <> b.item_id
  QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY {SQL_COS} DESC, b.item_id) <= {NEAR}),
raw AS (SELECT n.*, i.category, 1.0::DOUBLE / row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, n.item_id) AS diversity,
  -log2(greatest(coalesce(n_users, 0), 1) / (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) FROM cinter)) AS surprise, log2(1.0::DOUBLE + coalesce(n_users, 0)) AS audience
  FROM near n JOIN items i ON i.item_id = n.item_id LEFT JOIN stats s ON s.item_id = n.item_id),
comp AS (SELECT *, CASE WHEN max(surprise) OVER w > min(surprise) OVER w THEN (surprise - min(surprise) OVER w) / (max(surprise) OVER w - min(surprise) OVER w) ELSE 1.0::DOUBLE END AS novelty,
  CASE WHEN max(audience) OVER w > min(audience) OVER w THEN (audience - min(audience) OVER w) / (max(audience) OVER w - min(audience) OVER w) ELSE 1.0::DOUBLE END AS popularity,
  CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0::DOUBLE END AS relevance
  FROM raw WINDOW w AS (PARTITION BY query_id)),
mixed AS (SELECT *, 0.3::DOUBLE * diversity + 0.1::DOUBLE * novelty + 0.2::DOUBLE * popularity + 0.4::DOUBLE * relevance AS rerank_score FROM comp),
listed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, score DESC, item_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM mixed)"""


def near_of(spark: SparkSession, d: str) -> DataFrame:
    vectors, history = b.item_vectors(spark, d).select("item_id", "vector"), b.click_interactions(spark, d)
    people = history.select("user_id").distinct().count()
    return ops.similar(vectors, vectors, b.items(spark, d), FILTERS, NEAR, stats=item_popularity(history), n_users=people, strategy="hybrid")


@query("similar_filtered", f"""{_SQL_NEAR} SELECT query_id, item_id, rank, round(score, 6) + 0.0 AS score, round(rerank_score, 6) + 0.0 AS rerank_score, category, CAST(total AS BIGINT) AS total,
(SELECT count(*) FROM vectors) - 1 AS original_count, (SELECT count(*) FROM allowed) - (SELECT count(*) FROM allowed x WHERE x.item_id = query_id) AS filtered_count FROM listed WHERE rank <= 5""")
def similar_filtered(spark: SparkSession, d: str) -> DataFrame:
    """First page of reranked neighbours of every item, all of which pass the filters."""
    shown = ops.similar_page(near_of(spark, d), 1, 5)
    scores = [rounded(F.col(c)).alias(c) for c in ("score", "rerank_score")]
    return shown.select("query_id", "item_id", "rank", *scores, "category", "total", "original_count", "filtered_count")


@query("similar_rerank_echo", f"""{_SQL_NEAR}, shares AS (SELECT query_id, category, count(*) AS n FROM listed GROUP BY query_id, category)
SELECT query_id, 'hybrid' AS strategy, true AS applied, 'diversity=0.3,novelty=0.1,popularity=0.2,relevance=0.4' AS weights,
string_agg(category || '=' || n, ',' ORDER BY category) AS category_distribution FROM shares GROUP BY query_id""")
def similar_rerank_echo(spark: SparkSession, d: str) -> DataFrame:
    """Strategy, weights and categories of every list, maps as text."""
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    echo = ops.rerank_echo(near_of(spark, d), "hybrid", rr.SIMILAR_WEIGHTS, "query_id")
    return echo.select("query_id", "strategy", "applied", text("weights"), text("category_distribution"))
