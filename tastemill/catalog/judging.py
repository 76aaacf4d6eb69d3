"""Queries over evaluation, splits, item-item weights, hybrid fusion, privacy and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.catalog import bindings as b
from tastemill.catalog.registry import query
from tastemill.functions.scalars import rounded
from tastemill.models.hybrid import base_weights, fuse, normalise, user_weights
from tastemill.operators import evaluation as ev, gram, privacy, recommend as rec
from tastemill.operators.interactions import interactions, item_popularity, user_history_size
from tastemill.operators.profiles import normalised_weights
from tastemill.plans.topk import rank_items, rank_lists, top_k, unseen_heads
from tastemill.session import checkpointed, work_path

HOLD = 3
TOP = 20

SQL_SPLIT = b.SQL_INTERACTIONS + f""", aged AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, item_id) AS age FROM inter),
train AS (SELECT * FROM aged WHERE age > {HOLD}), test AS (SELECT * FROM aged WHERE age <= {HOLD})"""
SQL_RECS = SQL_SPLIT + f""", pop AS (SELECT item_id, sum(strength) AS score FROM train GROUP BY item_id),
recs AS (SELECT u.user_id, p.item_id, p.score, row_number() OVER (PARTITION BY u.user_id ORDER BY p.score DESC, p.item_id) AS rank
  FROM (SELECT DISTINCT user_id FROM test) u CROSS JOIN pop p
  WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = p.item_id) QUALIFY rank <= {TOP})"""
SQL_METRICS = SQL_RECS + f""", truth AS (SELECT user_id, count(*) AS n_true FROM test GROUP BY user_id),
returned AS (SELECT user_id, count(*) AS n_returned FROM recs GROUP BY user_id),
found AS (SELECT r.user_id, count(*) AS hits, sum(1.0::DOUBLE / log2(r.rank + 1)) AS dcg FROM recs r JOIN test t ON t.user_id = r.user_id AND t.item_id = r.item_id GROUP BY r.user_id),
metrics AS (SELECT user_id, CAST(n_true AS BIGINT) AS n_true, CAST(coalesce(n_returned, 0) AS BIGINT) AS n_returned, CAST(coalesce(hits, 0) AS BIGINT) AS hits,
  CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hr,
  CASE WHEN hits > 0 THEN dcg / list_sum([1.0::DOUBLE / log2(i + 1) FOR i IN range(1, least(n_true, {TOP}, n_returned) + 1)]) ELSE 0.0::DOUBLE END AS ndcg
  FROM truth LEFT JOIN returned USING (user_id) LEFT JOIN found USING (user_id))"""


def baseline_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(test, recommendations) of the popularity baseline on the last items of each user."""
    train, test = (checkpointed(part) for part in ev.leave_last_out(b.stored_interactions(spark, d), HOLD))
    ranking = rank_items(train.groupBy("item_id").agg(F.sum("strength").alias("score")))
    recs = unseen_heads(test.select("user_id").distinct(), train, ranking, TOP)
    return test, recs


def metrics_of(spark: SparkSession, d: str) -> DataFrame:
    test, recs = baseline_of(spark, d)
    return ev.user_metrics(test, recs, TOP)


@query("leave_last_out", f"WITH {SQL_SPLIT} SELECT user_id, item_id, 'test' AS part FROM test UNION ALL SELECT user_id, item_id, 'train' FROM train")
def leave_last_out(spark: SparkSession, d: str) -> DataFrame:
    train, test = ev.leave_last_out(b.stored_interactions(spark, d), HOLD)
    return test.select("user_id", "item_id", F.lit("test").alias("part")).unionByName(train.select("user_id", "item_id", F.lit("train").alias("part")))


def _sql_hash(key: str) -> str:
    return f"CAST('0x' || substr(md5('42:' || {key}), 1, 8) AS BIGINT) % 100 < 20"


@query("split_by_user", f"WITH {b.SQL_INTERACTIONS} SELECT user_id, item_id, {_sql_hash('user_id')} AS is_test FROM inter")
def split_by_user(spark: SparkSession, d: str) -> DataFrame:
    return ev.split_by_hash(b.purchase_interactions(spark, d), ["user_id"]).select("user_id", "item_id", "is_test")


_PAIR_KEY = "user_id || ':' || item_id"


@query("split_by_interaction", f"WITH {b.SQL_INTERACTIONS} SELECT user_id, item_id, {_sql_hash(_PAIR_KEY)} AS is_test FROM inter")
def split_by_interaction(spark: SparkSession, d: str) -> DataFrame:
    return ev.split_by_hash(b.purchase_interactions(spark, d), ["user_id", "item_id"]).select("user_id", "item_id", "is_test")


@query("hash_sample", f"WITH {b.SQL_INTERACTIONS} SELECT user_id, item_id, strength FROM inter WHERE {_sql_hash(_PAIR_KEY)}")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampling operator itself."""
    return ev.hash_sample(b.purchase_interactions(spark, d), ["user_id", "item_id"], 20).select("user_id", "item_id", "strength")


@query("hit_rate", f"WITH {SQL_METRICS} SELECT user_id, n_true, n_returned, hits, hr FROM metrics")
def hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return metrics_of(spark, d).drop("ndcg")


@query("ndcg", f"WITH {SQL_METRICS} SELECT user_id, round(ndcg, 6) + 0.0 AS ndcg FROM metrics")
def ndcg(spark: SparkSession, d: str) -> DataFrame:
    return metrics_of(spark, d).select("user_id", rounded(F.col("ndcg")).alias("ndcg"))


@query("eval_user_mean", f"WITH {SQL_METRICS} SELECT CAST(count(*) AS BIGINT) AS n_users, round(avg(ndcg), 6) + 0.0 AS ndcg FROM metrics")
def eval_user_mean(spark: SparkSession, d: str) -> DataFrame:
    return ev.mean_metric(metrics_of(spark, d), "ndcg").withColumn("ndcg", rounded(F.col("ndcg")))


@query("eval_interaction_mean", f"WITH {SQL_METRICS} SELECT CAST(count(*) AS BIGINT) AS n_users, round(sum(ndcg * n_true) / sum(n_true), 6) + 0.0 AS ndcg FROM metrics")
def eval_interaction_mean(spark: SparkSession, d: str) -> DataFrame:
    return ev.mean_metric(metrics_of(spark, d), "ndcg", "interaction").withColumn("ndcg", rounded(F.col("ndcg")))


@query("evaluate_popularity_baseline", f"WITH {SQL_METRICS} SELECT CAST(count(*) AS BIGINT) AS n_users, round(avg(hr), 6) + 0.0 AS hr, round(avg(ndcg), 6) + 0.0 AS ndcg, CAST(sum(hits) AS BIGINT) AS hits FROM metrics")
def evaluate_popularity_baseline(spark: SparkSession, d: str) -> DataFrame:
    return metrics_of(spark, d).agg(F.count("*").alias("n_users"), rounded(F.avg("hr")).alias("hr"), rounded(F.avg("ndcg")).alias("ndcg"), F.sum("hits").alias("hits"))


@query("catalog_coverage", f"WITH {SQL_RECS} SELECT CAST(count(DISTINCT item_id) AS BIGINT) AS recommended, (SELECT CAST(count(*) AS BIGINT) FROM part) AS catalog, round(count(DISTINCT item_id) / (SELECT CAST(count(*) AS DOUBLE) FROM part), 6) + 0.0 AS coverage FROM recs")
def catalog_coverage(spark: SparkSession, d: str) -> DataFrame:
    _, recs = baseline_of(spark, d)
    return ev.catalog_coverage(recs, b.items(spark, d)).withColumn("coverage", rounded(F.col("coverage")))


@query("list_diversity", f"""WITH {SQL_RECS}, per AS (SELECT user_id, count(DISTINCT p_type) / CAST(count(*) AS DOUBLE) AS share FROM recs JOIN part ON p_partkey = item_id GROUP BY user_id)
SELECT CAST(count(*) AS BIGINT) AS n_lists, round(avg(share), 6) + 0.0 AS diversity FROM per""")
def list_diversity(spark: SparkSession, d: str) -> DataFrame:
    _, recs = baseline_of(spark, d)
    return ev.list_diversity(rec.with_metadata(recs, b.items(spark, d))).withColumn("diversity", rounded(F.col("diversity")))


# ---------------------------------------------------------------------------------------------------------------------


@query("item_gram", f"""WITH {b.SQL_PURCHASES}, base AS (SELECT order_id, item_id, CAST(sum(qty) AS DOUBLE) AS x FROM purchases GROUP BY ALL)
SELECT a.item_id AS item_i, c.item_id AS item_j, sum(a.x * c.x) AS product, CAST(count(*) AS BIGINT) AS n_users
FROM base a JOIN base c ON a.order_id = c.order_id AND a.item_id <= c.item_id GROUP BY ALL""")
def item_gram(spark: SparkSession, d: str) -> DataFrame:
    """Items bought in the same order."""
    baskets = interactions(b.purchases(spark, d).withColumn("user_id", F.col("order_id")))
    return gram.item_gram(baskets)


_SQL_COSINE = b.SQL_INTERACTIONS + """, norms AS (SELECT item_id, sqrt(sum(strength * strength)) AS norm FROM inter GROUP BY item_id),
pairs AS (SELECT a.item_id, c.item_id AS other_id, sum(a.strength * c.strength) AS product FROM inter a JOIN inter c ON a.user_id = c.user_id AND a.item_id <> c.item_id GROUP BY ALL),
near AS (SELECT p.item_id, other_id, product / (CASE WHEN p.item_id < other_id THEN n.norm * m.norm ELSE m.norm * n.norm END) AS score FROM pairs p JOIN norms n ON n.item_id = p.item_id JOIN norms m ON m.item_id = other_id),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, other_id) AS rank FROM near QUALIFY rank <= 10)"""


@query("item_cosine_topm", f"WITH {_SQL_COSINE} SELECT item_id, other_id, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM top")
def item_cosine_topm(spark: SparkSession, d: str) -> DataFrame:
    rows = gram.cosine_neighbours(b.stored_interactions(spark, d), 10)
    return rows.withColumn("score", rounded(F.col("score")))


@query("itemknn_recommend", f"""WITH {_SQL_COSINE}, scored AS (SELECT i.user_id, t.other_id AS item_id, sum(i.strength * t.score) AS s FROM inter i JOIN top t ON t.item_id = i.item_id GROUP BY ALL),
open AS (SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM inter i WHERE i.user_id = s.user_id AND i.item_id = s.item_id))
SELECT user_id, item_id, round(s, 5) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) AS INTEGER) AS rank FROM open QUALIFY rank <= 10""")
def itemknn_recommend(spark: SparkSession, d: str) -> DataFrame:
    inter = b.stored_interactions(spark, d)
    weights = gram.cosine_neighbours(inter, 10).withColumnRenamed("score", "weight")
    scored = gram.neighbour_scores(inter, weights).withColumn("score", F.round("score", 9))
    found = top_k(scored, ["user_id"], [F.desc("score"), F.asc("item_id")], 10)
    return found.select("user_id", "item_id", rounded(F.col("score"), 5).alias("score"), "rank")


# ---------------------------------------------------------------------------------------------------------------------

MODELS = ["als", "item2vec", "text_embedding", "gru4rec"]
WEIGHTS = [0.4, 0.2, 0.2, 0.2]
THRESHOLD = 40


def _sql_cold(strategy: str) -> str:
    adjusted = "CASE WHEN model = 'als' THEN w * 0.3 WHEN model IN ('item2vec', 'text_embedding') THEN w + 0.4 * 0.7 * w / 0.4 ELSE w END" if strategy == "content_boost" else "CASE WHEN model IN ('item2vec', 'text_embedding') THEN 1.0 ELSE 0.0 END"
    return f"""base(model, w) AS (VALUES ('als', 0.4::DOUBLE), ('item2vec', 0.2::DOUBLE), ('text_embedding', 0.2::DOUBLE), ('gru4rec', 0.2::DOUBLE)),
cold AS (SELECT model, w, {adjusted} AS a FROM base), sizes AS (SELECT user_id, count(*) AS n FROM inter GROUP BY user_id),
weights AS (SELECT u.user_id, coalesce(n, 0) < {THRESHOLD} AS is_cold, model, CASE WHEN coalesce(n, 0) < {THRESHOLD} THEN a / (SELECT sum(a) FROM cold) ELSE w / (SELECT sum(w) FROM base) END AS weight
FROM users u LEFT JOIN sizes USING (user_id) CROSS JOIN cold)"""


def _cold(strategy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        sizes = user_history_size(b.purchase_interactions(spark, d))
        rows = user_weights(b.users(spark, d), sizes, MODELS, base_weights(MODELS, WEIGHTS), THRESHOLD, strategy)
        return rows.withColumn("weight", rounded(F.col("weight")))

    return run


for _strategy, _name in (("content_boost", "cold_start_weights"), ("content_only", "cold_start_content_only")):
    query(_name, f"WITH {b.SQL_INTERACTIONS}, {b.SQL_USERS}, {_sql_cold(_strategy)} SELECT user_id, is_cold, model, round(weight, 6) + 0.0 AS weight FROM weights")(_cold(_strategy))


@query("hybrid_weights", "SELECT event_type AS model, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM events), 6) + 0.0 AS weight FROM events GROUP BY event_type")
def hybrid_weights(spark: SparkSession, d: str) -> DataFrame:
    """Event types stand for component models, their counts for raw weights."""
    raw = b.clicks(spark, d).groupBy(F.col("event_type").alias("model")).agg(F.count("*").cast("double").alias("weight"))
    return normalised_weights(raw).withColumn("weight", rounded(F.col("weight")))


_SQL_FAVOURITE = """spent AS (SELECT user_id, category, sum(strength) AS s FROM inter JOIN items USING (item_id) GROUP BY ALL),
favourite AS (SELECT user_id, arg_max(category, (s, category)) AS category FROM spent GROUP BY user_id),
favlists AS (SELECT f.user_id, p.item_id, CAST(p.n_users AS DOUBLE) AS score, row_number() OVER (PARTITION BY f.user_id ORDER BY p.n_users DESC, p.item_id) AS rank
  FROM favourite f JOIN items i ON i.category = f.category JOIN popularity p ON p.item_id = i.item_id
  WHERE NOT EXISTS (SELECT 1 FROM inter x WHERE x.user_id = f.user_id AND x.item_id = p.item_id) QUALIFY rank <= 30)"""


def favourites_of(inter: DataFrame, catalog: DataFrame, popularity: DataFrame, k: int) -> DataFrame:
    """Unseen items of each user's favourite category by number of buyers: one ranking per category."""
    # dealt by the user at once: a user's rows are few to begin with, and both groupings stand on that
    spent = inter.join(catalog.select("item_id", "category"), "item_id").select("user_id", "category", "strength").repartition("user_id")
    spent = spent.groupBy("user_id", "category").agg(F.sum("strength").alias("s"))
    readers = spent.groupBy("user_id").agg(F.max(F.struct("s", "category")).alias("top")).select("user_id", F.col("top.category").alias("list_id"))
    scored = popularity.join(catalog, "item_id").select(F.col("category").alias("list_id"), "item_id", F.col("n_users").cast("double").alias("score"))
    return unseen_heads(readers, inter, rank_lists(scored), k)


@query("favourite_category_topk", f"WITH {b.SQL_POPULARITY}, {b.SQL_ITEMS}, {_SQL_FAVOURITE} SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM favlists")
def favourite_category_topk(spark: SparkSession, d: str) -> DataFrame:
    inter = b.stored_interactions(spark, d)
    return favourites_of(inter, b.items(spark, d), item_popularity(inter), 30).select("user_id", "item_id", "score", "rank")


@query("hybrid_fuse", f"""WITH {b.SQL_POPULARITY}, {b.SQL_USERS}, {b.SQL_ITEMS}, {b.SQL_UNSEEN.format(source="popularity", k=30)}, {_SQL_FAVOURITE}, {_sql_cold("content_boost")},
lists AS (SELECT user_id, 'als' AS model, item_id, score FROM ranked UNION ALL SELECT user_id, 'text_embedding', item_id, score FROM favlists),
scaled AS (SELECT user_id, model, item_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0::DOUBLE END AS s FROM lists WINDOW w AS (PARTITION BY user_id, model)),
fused AS (SELECT user_id, item_id, max(s * weight) AS s FROM scaled JOIN weights USING (user_id, model) WHERE weight > 0.001 GROUP BY ALL)
SELECT user_id, item_id, round(s, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) AS INTEGER) AS rank FROM fused QUALIFY rank <= 10""")
def hybrid_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Popular items in the role of the collaborative list, the favourite category in the role of the content list."""
    inter = b.stored_interactions(spark, d)
    popularity = checkpointed(item_popularity(inter))
    popular = rec.popular_unseen(b.users(spark, d), inter, popularity, 30)
    lists = popular.select("user_id", F.lit("als").alias("model"), "item_id", "score")
    lists = lists.unionByName(favourites_of(inter, b.items(spark, d), popularity, 30).select("user_id", F.lit("text_embedding").alias("model"), "item_id", "score"))
    weights = user_weights(b.users(spark, d), user_history_size(inter), MODELS, normalise(WEIGHTS), THRESHOLD)
    found = fuse(lists, weights.select("user_id", "model", "weight"), 10)
    return found.select("user_id", "item_id", rounded(F.col("score")).alias("score"), "rank")


# ---------------------------------------------------------------------------------------------------------------------

_SQL_ERASE = "requests AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < 0)"


def _erase(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a negative balance stand for the erasure requests."""
    return b.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))


@query("gdpr_export", f"""WITH {b.SQL_PURCHASES}, {b.SQL_ITEMS} SELECT user_id, 'event' AS kind, item_id, ts, qty, NULL AS category, NULL AS brand, NULL::DOUBLE AS price FROM purchases
UNION ALL SELECT user_id, 'item', item_id, NULL, NULL, category, brand, price FROM (SELECT DISTINCT user_id, item_id FROM purchases) JOIN items USING (item_id)""")
def gdpr_export(spark: SparkSession, d: str) -> DataFrame:
    """Events and touched items of every customer."""
    rows = privacy.export_rows(b.purchases(spark, d), b.items(spark, d), b.users(spark, d))
    return rows.select("user_id", "kind", "item_id", "ts", "qty", "category", "brand", "price")


@query("gdpr_export_documents", f"""WITH {b.SQL_CLICKS}, p AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // {privacy.EXPORT_PART} AS part FROM clicks)
SELECT user_id, CAST(part AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT item_id) AS BIGINT) AS n_items, string_agg(item_id, ',' ORDER BY ts, event_id) AS item_list FROM p GROUP BY user_id, part""")
def gdpr_export_documents(spark: SparkSession, d: str) -> DataFrame:
    """The JSON parts of every user's clicks, summed up."""
    events = b.clicks(spark, d).withColumn("_day", F.to_date("ts"))
    parts = privacy.export_documents(events, b.items(spark, d), events.select("user_id").distinct(), "_day", ["ts", "event_id"])
    listed = F.array_join(F.transform("events", lambda e: e["item_id"].cast("string")), ",")
    return parts.select("user_id", "part", F.size("events").cast("bigint").alias("n_events"), F.size("items").cast("bigint").alias("n_items"), listed.alias("item_list"))


@query("gdpr_delete", f"WITH {b.SQL_PURCHASES}, {_SQL_ERASE} SELECT user_id, item_id, qty, ts FROM purchases WHERE user_id NOT IN (SELECT user_id FROM requests)")
def gdpr_delete(spark: SparkSession, d: str) -> DataFrame:
    return privacy.without_users(b.purchases(spark, d).select("user_id", "item_id", "qty", "ts"), _erase(spark, d))


@query("tombstones", f"WITH {b.SQL_PURCHASES}, {_SQL_ERASE} SELECT user_id, CAST(count(*) AS BIGINT) AS deleted_events FROM purchases WHERE user_id IN (SELECT user_id FROM requests) GROUP BY user_id")
def tombstones(spark: SparkSession, d: str) -> DataFrame:
    return privacy.tombstones(b.purchases(spark, d), _erase(spark, d))


@query("apply_tombstones", f"WITH {b.SQL_CLICK_INTER}, {_SQL_ERASE} SELECT user_id, item_id, strength FROM cinter WHERE user_id NOT IN (SELECT user_id FROM requests)")
def apply_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return privacy.without_users(b.click_interactions(spark, d), _erase(spark, d)).select("user_id", "item_id", "strength")


def _erased(spark: SparkSession, d: str) -> str:
    """The folder of stored purchases after the erasure requests, the second of which repeats the first."""
    root = work_path(spark, "erasure")
    privacy.store_events(b.purchases(spark, d).select("user_id", "item_id", "qty", "ts"), root)
    requests = _erase(spark, d)
    for _ in range(2):
        privacy.delete_users(spark, root, requests, confirm=True, key="balance")
    return root


@query("erase_stored", f"WITH {b.SQL_PURCHASES}, {_SQL_ERASE} SELECT user_id, item_id, qty, ts FROM purchases WHERE user_id NOT IN (SELECT user_id FROM requests)")
def erase_stored(spark: SparkSession, d: str) -> DataFrame:
    """All rows in all files that the deletion leaves."""
    return privacy.stored_events(spark, _erased(spark, d))


@query("erase_tombstones", f"WITH {b.SQL_PURCHASES}, {_SQL_ERASE} SELECT user_id, CAST(count(*) AS BIGINT) AS deleted_events FROM purchases WHERE user_id IN (SELECT user_id FROM requests) GROUP BY user_id")
def erase_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """One tombstone per user with events, although the request was run twice."""
    return spark.read.parquet(f"{_erased(spark, d)}/deleted_users").select("user_id", "deleted_events")


@query("audit_trail", f"WITH {_SQL_ERASE} SELECT user_id, 'DELETE' AS action, 'done' AS status FROM requests")
def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    return privacy.audit_rows(_erase(spark, d), "DELETE", "done").select("user_id", "action", "status")


@query("retention", f"WITH {b.SQL_PURCHASES} SELECT user_id, item_id, qty, ts FROM purchases WHERE ts >= (SELECT max(ts) FROM purchases) - INTERVAL 180 DAY")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return privacy.retain(b.purchases(spark, d), 180).select("user_id", "item_id", "qty", "ts")


