"""Queries over recommendation lists: filters, pages, requests, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.catalog import bindings as b
from tastemill.catalog.registry import query
from tastemill.catalog.vectors import SQL_COS, SQL_MEAN
from tastemill.functions import vectors as v
from tastemill.functions.scalars import min_max, rounded
from tastemill.models.base import vector_topk
from tastemill.models.ease import identity_recommend
from tastemill.operators import ann, profiles, recommend as ops, rerank as rr
from tastemill.operators.interactions import item_popularity

FILTERS = ops.Filters(categories=["ECONOMY", "PROMO"], min_price=905.0, max_price=985.0)
SQL_FILTERS = "category IN ('ECONOMY', 'PROMO') AND price BETWEEN 905.0 AND 985.0"
LIST = 30

SQL_LISTS = f"{b.SQL_POPULARITY}, {b.SQL_USERS}, {b.SQL_ITEMS}, " + b.SQL_UNSEEN.format(source="popularity", k=LIST)
SQL_PAGE = """counted AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank) AS INTEGER) AS position, count(*) OVER (PARTITION BY user_id) AS total FROM {source}),
sized AS (SELECT *, greatest(1, CAST(ceil(total / {size}.0) AS BIGINT)) AS total_pages FROM counted),
clamped AS (SELECT *, greatest(1, least({page}, total_pages)) AS page FROM sized),
shown AS (SELECT *, page < total_pages AS has_next, page > 1 AS has_prev FROM clamped WHERE position > (page - 1) * {size} AND position <= page * {size})"""


def popularity_of(spark: SparkSession, d: str) -> DataFrame:
    return item_popularity(b.purchase_interactions(spark, d))


def lists_of(spark: SparkSession, d: str, k: int = LIST) -> DataFrame:
    """Unseen popular items per customer: user_id, item_id, score, n_users, rank."""
    inter = b.stored_interactions(spark, d)
    return ops.popular_unseen(b.users(spark, d), inter, item_popularity(inter), k)


def enriched_of(spark: SparkSession, d: str, k: int = LIST) -> DataFrame:
    return ops.with_metadata(lists_of(spark, d, k), b.items(spark, d))


def _filtered(filters: ops.Filters):
    return lambda spark, d: ops.apply_filters(b.items(spark, d), filters)


query("filter_category", f"WITH {b.SQL_ITEMS} SELECT * FROM items WHERE category IN ('ECONOMY', 'LARGE')")(_filtered(ops.Filters(categories=["ECONOMY", "LARGE"])))
query("filter_brand", f"WITH {b.SQL_ITEMS} SELECT * FROM items WHERE brand IN ('Brand#3', 'Brand#17')")(_filtered(ops.Filters(brands=["Brand#3", "Brand#17"])))


@query("filter_price", f"WITH {b.SQL_ITEMS}, p AS (SELECT * REPLACE (CASE WHEN category = 'PROMO' THEN NULL ELSE price END AS price) FROM items) SELECT * FROM p WHERE price >= 910.5 AND price <= 970.0")
def filter_price(spark: SparkSession, d: str) -> DataFrame:
    """Promotional parts have no price here and fail any bound."""
    rows = b.items(spark, d).withColumn("price", F.when(F.col("category") != "PROMO", F.col("price")))
    return ops.apply_filters(rows, ops.Filters(min_price=910.5, max_price=970.0))


@query("filter_exclude", f"WITH {b.SQL_ITEMS}, {b.SQL_CLICKS} SELECT * FROM items WHERE item_id NOT IN (SELECT item_id FROM clicks) AND item_id NOT IN (150, 151)")
def filter_exclude(spark: SparkSession, d: str) -> DataFrame:
    return ops.apply_filters(b.items(spark, d), ops.Filters(exclude_items=[150, 151]), exclude=b.clicks(spark, d).select("item_id").distinct())


@query("filter_include", f"WITH {b.SQL_ITEMS}, {b.SQL_CLICKS} SELECT * FROM items WHERE item_id IN (SELECT item_id FROM clicks WHERE event_type = 'purchase') AND item_id NOT IN (5, 6)")
def filter_include(spark: SparkSession, d: str) -> DataFrame:
    """Exclusion beats inclusion."""
    bought = b.clicks(spark, d).where("event_type = 'purchase'").select("item_id").distinct()
    return ops.apply_filters(b.items(spark, d), ops.Filters(exclude_items=[5, 6]), include=bought)


@query("filter_info", f"""WITH {SQL_LISTS} SELECT user_id, CAST(count(*) AS BIGINT) AS original_count, CAST(count(*) FILTER ({SQL_FILTERS}) AS BIGINT) AS filtered_count
FROM ranked JOIN items USING (item_id) GROUP BY user_id""")
def filter_info(spark: SparkSession, d: str) -> DataFrame:
    return ops.filter_info(enriched_of(spark, d), FILTERS)


@query("recommend_enriched", f"WITH {SQL_LISTS} SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, score, title, category, brand, price FROM ranked LEFT JOIN items USING (item_id)")
def recommend_enriched(spark: SparkSession, d: str) -> DataFrame:
    return enriched_of(spark, d).select("user_id", "rank", "item_id", "score", "title", "category", "brand", "price")


@query("paginate", f"WITH {SQL_LISTS}, " + SQL_PAGE.format(source="ranked", size=7, page=9) + """
SELECT user_id, item_id, position, CAST(total AS BIGINT) AS total, CAST(page AS BIGINT) AS page, CAST(7 AS BIGINT) AS page_size, total_pages, has_next, has_prev FROM shown""")
def paginate(spark: SparkSession, d: str) -> DataFrame:
    """Page 9 of lists with 5 pages: clamped to the last one."""
    shown = ops.paginate(lists_of(spark, d), 9, 7)
    return shown.select("user_id", "item_id", "position", "total", "page", "page_size", "total_pages", "has_next", "has_prev")


_SQL_FILTERED = f"{b.SQL_POPULARITY}, {b.SQL_USERS}, {b.SQL_ITEMS}, allowed AS (SELECT p.* FROM popularity p JOIN items USING (item_id) WHERE {SQL_FILTERS}), " + b.SQL_UNSEEN.format(source="allowed", k="{k}")


@query("filtered_topk", f"WITH {_SQL_FILTERED.format(k=10)} SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM ranked")
def filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    inter = b.stored_interactions(spark, d)
    allowed = item_popularity(inter).join(ops.apply_filters(b.items(spark, d), FILTERS).select("item_id"), "item_id")
    return ops.popular_unseen(b.users(spark, d), inter, allowed, 10).select("user_id", "item_id", "score", "rank")


@query("filtered_topk_buffered", f"""WITH {SQL_LISTS}, kept AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank
FROM ranked JOIN items USING (item_id) WHERE {SQL_FILTERS}) SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM kept WHERE rank <= 10""")
def filtered_topk_buffered(spark: SparkSession, d: str) -> DataFrame:
    """The compatibility mode: three times the list, then the filter; lists may stay short."""
    rows = ops.apply_filters(enriched_of(spark, d, ops.buffered_k(10, FILTERS)), FILTERS)
    return ops.paginate(rows, 1, 10).select("user_id", "item_id", "score", F.col("position").alias("rank"))


@query("recommend_request", f"WITH {_SQL_FILTERED.format(k=25)}, rich AS (SELECT * FROM ranked JOIN items USING (item_id)), " + SQL_PAGE.format(source="rich", size=10, page=2) + """
SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, score, title, category, brand, price, CAST(total AS BIGINT) AS total, CAST(page AS BIGINT) AS page, total_pages, has_next, has_prev FROM shown""")
def recommend_request(spark: SparkSession, d: str) -> DataFrame:
    """Every customer asks for page 2 of 25 filtered items never bought before."""
    inter = b.stored_interactions(spark, d)
    shown = ops.recommend_request(b.users(spark, d), inter, b.items(spark, d), item_popularity(inter), FILTERS, 25, 2, 10)
    return shown.select("user_id", "rank", "item_id", "score", "title", "category", "brand", "price", "total", "page", "total_pages", "has_next", "has_prev")


_SQL_REQUESTS = """requests AS (SELECT c_custkey AS user_id, 1 + c_nationkey % 2 AS page, 5 AS page_size,
  CASE WHEN c_mktsegment = 'BUILDING' THEN ['SMALL', 'LARGE'] WHEN c_mktsegment = 'FURNITURE' THEN ['PROMO'] END AS categories,
  CASE WHEN c_acctbal < 0 THEN 940.0::DOUBLE END AS max_price, CASE WHEN c_nationkey = 7 THEN [1, 2, 3, 4, 5, 6, 7, 8, 9, 10] END AS exclude_items FROM customer)"""


@query("recommend_request_batch", f"WITH {SQL_LISTS}, {_SQL_REQUESTS}, rich AS (SELECT * FROM ranked JOIN items USING (item_id) JOIN requests USING (user_id) "
       "WHERE (categories IS NULL OR list_contains(categories, category)) AND (max_price IS NULL OR price <= max_price) AND (exclude_items IS NULL OR NOT list_contains(exclude_items, item_id))), "
       """counted AS (SELECT * EXCLUDE (page), page AS asked, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank) AS INTEGER) AS position, count(*) OVER (PARTITION BY user_id) AS total FROM rich),
sized AS (SELECT *, greatest(1, CAST(ceil(total / 5.0) AS BIGINT)) AS total_pages FROM counted), clamped AS (SELECT *, greatest(1, least(asked, total_pages)) AS page FROM sized)
SELECT user_id, item_id, position, CAST(total AS BIGINT) AS total, CAST(page AS BIGINT) AS page, total_pages FROM clamped WHERE position > (page - 1) * 5 AND position <= page * 5""")
def recommend_request_batch(spark: SparkSession, d: str) -> DataFrame:
    """Each customer with own page and filters, taken from segment, balance and nation."""
    customer = b.table(spark, d, "customer")
    segment = F.col("c_mktsegment")
    requests = customer.select(
        F.col("c_custkey").alias("user_id"), (1 + F.col("c_nationkey") % 2).alias("page"), F.lit(5).alias("page_size"),
        F.when(segment == "BUILDING", F.array(F.lit("SMALL"), F.lit("LARGE"))).when(segment == "FURNITURE", F.array(F.lit("PROMO"))).alias("categories"),
        F.lit(None).cast("array<string>").alias("brands"), F.lit(None).cast("double").alias("min_price"),
        F.when(F.col("c_acctbal") < 0, F.lit(940.0)).alias("max_price"),
        F.when(F.col("c_nationkey") == 7, F.sequence(F.lit(1), F.lit(10)).cast("array<bigint>")).alias("exclude_items"),
        F.lit(None).cast("array<bigint>").alias("include_items"),
    )
    shown = ops.answer_requests(requests, lists_of(spark, d), b.items(spark, d))
    return shown.select("user_id", "item_id", "position", "total", "page", "total_pages")


@query("similar_request", f"""WITH {b.SQL_VECTORS}, {b.SQL_ITEMS}, scored AS (SELECT a.item_id AS query_id, b.item_id, {SQL_COS} AS s FROM vectors a CROSS JOIN vectors b WHERE a.item_id <> b.item_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM scored QUALIFY rank <= 30),
rich AS (SELECT query_id AS user_id, item_id, s, rank, category, price FROM top LEFT JOIN items USING (item_id) WHERE {SQL_FILTERS}), {SQL_PAGE.format(source="rich", size=3, page=1)}
SELECT user_id AS query_id, item_id, round(s, 6) + 0.0 AS score, position, category, price, CAST(total AS BIGINT) AS total, total_pages, has_next FROM shown""")
def similar_request(spark: SparkSession, d: str) -> DataFrame:
    """First page of filtered neighbours of every item vector."""
    hits = ann.similar_items(b.item_vectors(spark, d).select("item_id", "vector"), ops.buffered_k(10, FILTERS))
    rows = ops.apply_filters(ops.with_metadata(hits, b.items(spark, d)), FILTERS)
    shown = ops.paginate(rows, 1, 3, "query_id")
    return shown.select("query_id", "item_id", rounded(F.col("score")).alias("score"), "position", "category", "price", "total", "total_pages", "has_next")


@query("recommend_index", f"""WITH {SQL_MEAN}, {b.SQL_ITEMS}, scored AS (SELECT a.user_id, b.item_id, {SQL_COS} AS s FROM profiles a CROSS JOIN vectors b
WHERE NOT EXISTS (SELECT 1 FROM cinter c WHERE c.user_id = a.user_id AND c.item_id = b.item_id))
SELECT user_id, item_id, round(s, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS INTEGER) AS rank, title, brand
FROM scored LEFT JOIN items USING (item_id) QUALIFY rank <= 10""")
def recommend_index(spark: SparkSession, d: str) -> DataFrame:
    """User vector, index search without seen items, metadata."""
    rows, history = b.item_vectors(spark, d).select("item_id", "vector"), b.click_interactions(spark, d)
    users = profiles.mean_profile(history, rows, v.vector_size(rows, "vector"))
    index = ann.VectorIndex.build(rows, "Flat", "cosine")
    hits = index.search(ann.as_queries(users, "user_id"), 10, history.select(F.col("user_id").alias("query_id"), "item_id"))
    rich = ops.with_metadata(hits.withColumnRenamed("query_id", "user_id"), b.items(spark, d))
    return rich.select("user_id", "item_id", rounded(F.col("score")).alias("score"), "rank", "title", "brand")


@query("recommend_index_with_seen", f"""WITH {SQL_MEAN}, scored AS (SELECT a.user_id, b.item_id, list_dot_product(a.vector, b.vector) AS s FROM profiles a CROSS JOIN vectors b)
SELECT user_id, item_id, round(s, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 10""")
def recommend_index_with_seen(spark: SparkSession, d: str) -> DataFrame:
    """The index path that keeps seen items."""
    rows, history = b.item_vectors(spark, d).select("item_id", "vector"), b.click_interactions(spark, d)
    users = profiles.mean_profile(history, rows, v.vector_size(rows, "vector"))
    found = vector_topk(history.select("user_id"), users, rows, None, 10)
    return found.select("user_id", "item_id", rounded(F.col("score")).alias("score"), "rank")


@query("unknown_ids", f"""WITH {b.SQL_CLICKS} SELECT CAST(event_id AS VARCHAR) AS id, 'user not found' AS kind FROM clicks WHERE event_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT DISTINCT CAST(item_id * 50 AS VARCHAR), 'item not found' FROM clicks WHERE item_id * 50 NOT IN (SELECT p_partkey FROM part)""")
def unknown_ids(spark: SparkSession, d: str) -> DataFrame:
    asked_users = b.clicks(spark, d).select(F.col("event_id").alias("user_id"))
    asked_items = b.clicks(spark, d).select((F.col("item_id") * 50).alias("item_id"))
    missing = ops.unknown_ids(asked_users, b.users(spark, d), "user_id", "user not found")
    return missing.unionByName(ops.unknown_ids(asked_items, b.items(spark, d), "item_id", "item not found"))


@query("recommend_nested", f"""WITH {SQL_LISTS} SELECT user_id, CAST(count(*) AS BIGINT) AS n_items, string_agg(item_id, ',' ORDER BY rank) AS item_list,
string_agg(coalesce(brand, ''), ',' ORDER BY rank) AS brand_list FROM ranked LEFT JOIN items USING (item_id) WHERE rank <= 10 GROUP BY user_id""")
def recommend_nested(spark: SparkSession, d: str) -> DataFrame:
    """The nested answer, unpacked again from its JSON."""
    rows = enriched_of(spark, d, 10)
    nested = ops.nested_response(rows, ["item_id", "score", "title", "category", "brand", "price"])
    answer = F.from_json("response", "struct<recommendations:array<struct<rank:int,item_id:bigint,brand:string>>>")["recommendations"]
    return nested.select("user_id", F.size(answer).cast("bigint").alias("n_items"), F.array_join(answer["item_id"].cast("array<string>"), ",").alias("item_list"), F.array_join(answer["brand"], ",").alias("brand_list"))


@query("category_distribution", f"WITH {SQL_LISTS} SELECT user_id, category, CAST(count(*) AS BIGINT) AS n FROM ranked LEFT JOIN items USING (item_id) GROUP BY user_id, category")
def category_distribution(spark: SparkSession, d: str) -> DataFrame:
    return ops.category_distribution(enriched_of(spark, d))


@query("ease_identity_compat", f"""WITH {b.SQL_INTERACTIONS}, {b.SQL_USERS}, catalog AS (SELECT DISTINCT item_id, 1.0::DOUBLE AS score FROM inter), {b.SQL_UNSEEN.format(source="catalog", k=10)}
SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM ranked""")
def ease_identity_compat(spark: SparkSession, d: str) -> DataFrame:
    inter = b.stored_interactions(spark, d)
    return identity_recommend(b.users(spark, d), inter, inter, 10)


# ---------------------------------------------------------------------------------------------------------------------

SQL_COMPONENTS = SQL_LISTS + """, rich AS (SELECT r.user_id, r.item_id, r.score, i.category, p.n_users FROM ranked r JOIN items i USING (item_id) JOIN popularity p USING (item_id)),
raw AS (SELECT *, 1.0::DOUBLE / row_number() OVER (PARTITION BY user_id, category ORDER BY score DESC, item_id) AS diversity,
  -log2(greatest(n_users, 1) / (SELECT CAST(count(*) AS DOUBLE) FROM users)) AS surprise, log2(1.0::DOUBLE + n_users) AS audience FROM rich),
comp AS (SELECT user_id, item_id, score, category, diversity,
  CASE WHEN max(surprise) OVER w > min(surprise) OVER w THEN (surprise - min(surprise) OVER w) / (max(surprise) OVER w - min(surprise) OVER w) ELSE 1.0::DOUBLE END AS novelty,
  CASE WHEN max(audience) OVER w > min(audience) OVER w THEN (audience - min(audience) OVER w) / (max(audience) OVER w - min(audience) OVER w) ELSE 1.0::DOUBLE END AS popularity,
  CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0::DOUBLE END AS relevance
  FROM raw WINDOW w AS (PARTITION BY user_id)),
parts AS (SELECT *, 0.2::DOUBLE * diversity AS wd, 0.2::DOUBLE * novelty AS wn, 0.2::DOUBLE * popularity AS wp, 0.4::DOUBLE * relevance AS wr FROM comp)"""


def components_of(spark: SparkSession, d: str) -> DataFrame:
    inter = b.stored_interactions(spark, d)
    stats = item_popularity(inter)
    rows = ops.with_metadata(ops.popular_unseen(b.users(spark, d), inter, stats, LIST), b.items(spark, d))
    return rr.components(rows.select("user_id", "item_id", "score", "category"), stats, b.users(spark, d).count())


def _sql_rerank(score: str) -> str:
    return f"""WITH {SQL_COMPONENTS} SELECT user_id, item_id, round({score}, 6) + 0.0 AS rerank_score,
CAST(row_number() OVER (PARTITION BY user_id ORDER BY round({score}, 9) DESC, score DESC, item_id) AS INTEGER) AS new_rank FROM parts"""


def _rerank(strategy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = rr.rerank(components_of(spark, d), strategy)
        return rows.select("user_id", "item_id", rounded(F.col("rerank_score")).alias("rerank_score"), "new_rank")

    return run


query("rerank_diversity", _sql_rerank("diversity"))(_rerank("diversity"))
query("rerank_novelty", _sql_rerank("novelty"))(_rerank("novelty"))
query("rerank_popularity", _sql_rerank("popularity"))(_rerank("popularity"))
query("rerank_hybrid", _sql_rerank("0.0::DOUBLE + wd + wn + wp + wr"))(_rerank("hybrid"))


@query("explanations", f"""WITH {SQL_COMPONENTS}, r AS (SELECT user_id, item_id, category, round(wd, 9) AS wd, round(wn, 9) AS wn, round(wp, 9) AS wp, round(wr, 9) AS wr FROM parts),
t AS (SELECT *, greatest(wd, wn, wp, wr) AS top FROM r)
SELECT user_id, item_id, CASE WHEN wr = top THEN 'Recommended based on your interests' WHEN wd = top THEN 'Adding variety with this ' || category || ' item'
WHEN wp = top THEN 'Popular with other shoppers' ELSE 'Something new to discover' END AS explanation FROM t""")
def explanations(spark: SparkSession, d: str) -> DataFrame:
    return rr.explain_rows(components_of(spark, d)).select("user_id", "item_id", "explanation")


@query("minmax_norm", f"""WITH {SQL_LISTS} SELECT user_id, item_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END, 6) + 0.0 AS scaled
FROM ranked WINDOW w AS (PARTITION BY user_id)""")
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = lists_of(spark, d)
    bounds = rows.groupBy("user_id").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = min_max(F.col("score"), F.col("low"), F.col("high"))
    return rows.join(bounds, "user_id").select("user_id", "item_id", rounded(scaled).alias("scaled"))
