"""Queries over sources, filters and interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tastemill import schemas
from tastemill.catalog import bindings as b
from tastemill.catalog.registry import query
from tastemill.functions.scalars import epoch_seconds, from_epoch, parse_id, rounded
from tastemill.operators import interactions as ops
from tastemill.plans.topk import top_k
from tastemill.session import work_path
from tastemill.sources import ingest, messages
from tastemill.sources.tables import VersionedTable


@query("ingest_events", f"WITH {b.SQL_PURCHASES} SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, CAST(epoch(ts) AS BIGINT) AS ts, qty FROM purchases")
def ingest_events(spark: SparkSession, d: str) -> DataFrame:
    rows = b.purchases(spark, d).withColumn("ts", epoch_seconds(F.col("ts")))
    table = VersionedTable(spark, work_path(spark, "events"))
    table.create_if_absent(ingest.align(rows, schemas.EVENTS))
    table.create_if_absent(ingest.align(rows, schemas.EVENTS))  # a second ingest changes nothing
    return table.read()


@query("append_by_name", f"""WITH {b.SQL_CLICKS}
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(item_id AS BIGINT) AS item_id, ts, CAST(qty AS INTEGER) AS qty FROM clicks
UNION ALL SELECT user_id, item_id, ts, NULL FROM clicks""")
def append_by_name(spark: SparkSession, d: str) -> DataFrame:
    base = b.clicks(spark, d).select("user_id", "item_id", "ts", "qty")
    other_order = b.clicks(spark, d).select("value", "ts", "item_id", "user_id")
    return ingest.append_by_name(base, other_order)


_PROPS = T.StructType([T.StructField("k", T.LongType()), T.StructField("session", T.StringType())])


@query("decode_messages", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, json_extract_string(props, '$.session') AS session, props IS NULL AS is_corrupt FROM events")
def decode_messages(spark: SparkSession, d: str) -> DataFrame:
    raw = b.table(spark, d, "events").withColumn("value", F.col("props"))
    decoded = messages.decode(raw.select("event_id", F.col("props").alias("value")), "value", _PROPS)
    return decoded.select("event_id", F.col("message.k").alias("item_id"), F.col("message.session").alias("session"), F.col("corrupt").isNotNull().alias("is_corrupt"))


@query("validate_events", """SELECT event_id,
  CASE WHEN u IS NULL THEN 'missing user_id' WHEN i IS NULL THEN 'missing item_id' ELSE 'ok' END AS verdict
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS u,
             CASE WHEN event_type = 'signup' THEN NULL ELSE json_extract_string(props, '$.k') END AS i FROM events)""")
def validate_events(spark: SparkSession, d: str) -> DataFrame:
    """Error events carry no user and sign-ups no item here, so both reject reasons occur."""
    rows = b.clicks(spark, d)
    user = F.when(F.col("event_type") != "error", F.col("user_id"))
    item = F.when(F.col("event_type") != "signup", F.col("item_id"))
    return rows.select("event_id", F.coalesce(messages.reject_reason(user, item), F.lit("ok")).alias("verdict"))


@query("queue_defaults", "SELECT event_id, CAST(coalesce(CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS INTEGER) END, 1) AS INTEGER) AS qty, FALSE AS ts_missing FROM events")
def queue_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Only purchases send a quantity; the others get 1, and every event a time."""
    rows = b.clicks(spark, d).withColumn("qty", F.when(F.col("event_type") == "purchase", F.floor("value").cast("int")))
    filled = messages.with_defaults(rows.drop("ts").withColumn("timestamp", F.lit(None).cast("string")))
    return filled.select("event_id", "qty", F.col("ts").isNull().alias("ts_missing"))


@query("new_events_since", """SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events
WHERE (ts, event_id) > (SELECT (ts, event_id) FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 1)
ORDER BY ts, event_id LIMIT 1000""")
def new_events_since(spark: SparkSession, d: str) -> DataFrame:
    """The next update batch after the first sign-up."""
    rows = b.clicks(spark, d)
    cursor = rows.where(F.col("event_type") == "signup").agg(F.min(F.struct("ts", "event_id")).alias("c")).first()["c"]
    return ingest.new_events_since(rows, "ts", "event_id", (cursor["ts"], cursor["event_id"]), 1000).select("event_id", "ts", "user_id", "item_id")


@query("event_cursor", "SELECT max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events")
def event_cursor(spark: SparkSession, d: str) -> DataFrame:
    return ingest.cursor_after(b.clicks(spark, d), "ts", "event_id")


@query("data_quality", f"""WITH {b.SQL_PURCHASES} SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
CAST(count(DISTINCT item_id) AS BIGINT) AS items, CAST(count(*) FILTER (user_id IS NULL) AS BIGINT) AS null_users,
CAST(count(*) FILTER (item_id IS NULL) AS BIGINT) AS null_items, CAST(count(*) FILTER (qty <= 0) AS BIGINT) AS bad_qty FROM purchases""")
def data_quality(spark: SparkSession, d: str) -> DataFrame:
    return ingest.data_quality(b.purchases(spark, d))


@query("duplicate_keys", "SELECT l_orderkey AS order_id, l_linenumber AS line_no, CAST(count(*) AS BIGINT) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    lines = b.table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("item_id"))
    return ingest.duplicate_keys(lines).select(F.col("item_id.l_orderkey").alias("order_id"), F.col("item_id.l_linenumber").alias("line_no"), "copies")


@query("union_events", f"WITH {b.SQL_PURCHASES}, {b.SQL_CLICKS} SELECT user_id, item_id, ts, qty FROM purchases UNION ALL SELECT user_id, item_id, ts, qty FROM clicks")
def union_events(spark: SparkSession, d: str) -> DataFrame:
    columns = ["user_id", "item_id", "ts", "qty"]
    return b.purchases(spark, d).select(*columns).unionByName(b.clicks(spark, d).select(*columns))


@query("schema_template", "SELECT event_id, ts, user_id, event_type FROM events WHERE FALSE")
def schema_template(spark: SparkSession, d: str) -> DataFrame:
    return ingest.schema_template(b.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"))


@query("preview", """SELECT * FROM (SELECT 'lineitem' AS name, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events)""")
def preview(spark: SparkSession, d: str) -> DataFrame:
    result = None
    for name in ("lineitem", "orders", "part", "customer", "events"):
        row = b.table(spark, d, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        result = row if result is None else result.unionByName(row)
    return result


@query("preview_rows", f"WITH {b.SQL_ITEMS} SELECT * FROM items ORDER BY item_id LIMIT 5")
def preview_rows(spark: SparkSession, d: str) -> DataFrame:
    return b.items(spark, d).orderBy("item_id").limit(5)


@query("epoch_convert", """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch,
make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS back FROM events""")
def epoch_convert(spark: SparkSession, d: str) -> DataFrame:
    rows = b.clicks(spark, d).select("event_id", epoch_seconds(F.col("ts")).alias("epoch"))
    return rows.withColumn("back", from_epoch(F.col("epoch")))


@query("parse_ids", "SELECT s_suppkey, TRY_CAST(s_name AS BIGINT) AS whole, TRY_CAST(split_part(s_name, '#', 2) AS BIGINT) AS number FROM supplier")
def parse_ids(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("s_name")
    return b.table(spark, d, "supplier").select("s_suppkey", parse_id(name).alias("whole"), parse_id(F.split_part(name, F.lit("#"), F.lit(2))).alias("number"))


# ---------------------------------------------------------------------------------------------------------------------


@query("interactions", f"WITH {b.SQL_INTERACTIONS} SELECT user_id, item_id, strength, last_ts, n_events FROM inter")
def interactions(spark: SparkSession, d: str) -> DataFrame:
    return b.purchase_interactions(spark, d)


@query("delta_interactions", f"""WITH {b.SQL_CLICKS} SELECT user_id, item_id, CAST(sum(qty) AS DOUBLE) AS strength, CAST(count(*) AS BIGINT) AS n_events
FROM (SELECT * FROM clicks WHERE event_type IN ('purchase', 'click')) GROUP BY user_id, item_id""")
def delta_interactions(spark: SparkSession, d: str) -> DataFrame:
    delta = ops.interactions(b.clicks(spark, d).where(F.col("event_type").isin("purchase", "click")))
    return delta.drop("last_ts")


@query("distinct_entities", f"WITH {b.SQL_PURCHASES} SELECT DISTINCT 'user' AS kind, user_id AS id FROM purchases UNION ALL SELECT DISTINCT 'item', item_id FROM purchases")
def distinct_entities(spark: SparkSession, d: str) -> DataFrame:
    return ops.distinct_entities(b.purchases(spark, d))


@query("item_universe", f"""WITH {b.SQL_PURCHASES} SELECT 'events' AS universe, item_id FROM (SELECT DISTINCT item_id FROM purchases)
UNION ALL SELECT 'catalog', p_partkey FROM part""")
def item_universe(spark: SparkSession, d: str) -> DataFrame:
    events, catalog = b.purchases(spark, d), b.items(spark, d)
    both = [ops.item_universe(events, catalog, u).select(F.lit(u).alias("universe"), "item_id") for u in ("events", "catalog")]
    return both[0].unionByName(both[1])


@query("user_index", "SELECT o_custkey AS user_id, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS user_idx FROM (SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")
def user_index(spark: SparkSession, d: str) -> DataFrame:
    return ops.entity_index(b.purchases(spark, d), "user_id", "user_idx")


@query("item_index", "SELECT l_partkey AS item_id, CAST(dense_rank() OVER (ORDER BY l_partkey) - 1 AS BIGINT) AS item_idx FROM (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def item_index(spark: SparkSession, d: str) -> DataFrame:
    return ops.entity_index(b.purchases(spark, d), "item_id", "item_idx")


_SQL_ENCODED = b.SQL_INTERACTIONS + """, uidx AS (SELECT user_id, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS BIGINT) AS user_idx FROM (SELECT DISTINCT user_id FROM inter)),
iidx AS (SELECT item_id, CAST(dense_rank() OVER (ORDER BY item_id) - 1 AS BIGINT) AS item_idx FROM (SELECT DISTINCT item_id FROM inter))"""


@query("encode_interactions", f"WITH {_SQL_ENCODED} SELECT user_idx, item_idx, strength FROM inter JOIN uidx USING (user_id) JOIN iidx USING (item_id)")
def encode_interactions(spark: SparkSession, d: str) -> DataFrame:
    inter = b.purchase_interactions(spark, d)
    events = b.purchases(spark, d)
    coded = ops.encode(inter, ops.entity_index(events, "user_id", "user_idx"), ops.entity_index(events, "item_id", "item_idx"))
    return coded.select("user_idx", "item_idx", "strength")


@query("encode_known_only", f"""WITH {b.SQL_CLICK_INTER}, cidx AS (SELECT c_custkey AS user_id, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS user_idx FROM customer WHERE c_acctbal > 0),
iidx AS (SELECT p_partkey AS item_id, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS item_idx FROM part WHERE p_retailprice < 905)
SELECT user_idx, item_idx, strength FROM cinter JOIN cidx USING (user_id) JOIN iidx USING (item_id)""")
def encode_known_only(spark: SparkSession, d: str) -> DataFrame:
    """Clicks of customers in credit on cheap items; everything else is not mapped."""
    good = b.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    cheap = b.items(spark, d).where("price < 905")
    coded = ops.encode(b.click_interactions(spark, d), ops.entity_index(good, "user_id", "user_idx"), ops.entity_index(cheap, "item_id", "item_idx"))
    return coded.select("user_idx", "item_idx", "strength")


@query("decode_ids", f"""WITH {b.SQL_CLICK_INTER}, iidx AS (SELECT p_partkey AS item_id, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS item_idx FROM part WHERE p_retailprice < 905)
SELECT user_id, c.item_id AS item_idx, coalesce(CAST(x.item_id AS VARCHAR), 'unknown_' || c.item_id) AS item_id FROM cinter c LEFT JOIN iidx x ON c.item_id = x.item_idx""")
def decode_ids(spark: SparkSession, d: str) -> DataFrame:
    numbers = b.click_interactions(spark, d).select("user_id", F.col("item_id").alias("item_idx"))
    index = ops.entity_index(b.items(spark, d).where("price < 905"), "item_id", "item_idx")
    return ops.decode(numbers, index, "item_idx", "item_id")


@query("matrix_stats", f"""WITH {b.SQL_INTERACTIONS} SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS n_users, CAST(count(DISTINCT item_id) AS BIGINT) AS n_items,
CAST(count(*) AS BIGINT) AS nnz, round(count(*) / (CAST(count(DISTINCT user_id) AS DOUBLE) * count(DISTINCT item_id)), 9) AS density FROM inter""")
def matrix_stats(spark: SparkSession, d: str) -> DataFrame:
    return ops.matrix_stats(b.purchase_interactions(spark, d)).withColumn("density", rounded(F.col("density"), 9))


@query("user_history_size", f"WITH {b.SQL_INTERACTIONS} SELECT user_id, CAST(count(*) AS BIGINT) AS n_items FROM inter GROUP BY user_id")
def user_history_size(spark: SparkSession, d: str) -> DataFrame:
    return ops.user_history_size(b.purchase_interactions(spark, d))


@query("events_per_user", f"WITH {b.SQL_PURCHASES} SELECT user_id, CAST(count(*) AS BIGINT) AS n_events FROM purchases GROUP BY user_id")
def events_per_user(spark: SparkSession, d: str) -> DataFrame:
    return ops.events_per_user(b.purchases(spark, d))


@query("item_popularity", f"WITH {b.SQL_POPULARITY} SELECT item_id, score, n_users FROM popularity")
def item_popularity(spark: SparkSession, d: str) -> DataFrame:
    return ops.item_popularity(b.purchase_interactions(spark, d))


@query("unseen_candidates", f"""WITH {b.SQL_INTERACTIONS}, {b.SQL_CLICK_INTER} SELECT user_id, item_id, strength FROM cinter c
WHERE NOT EXISTS (SELECT 1 FROM inter i WHERE i.user_id = c.user_id AND i.item_id = c.item_id)""")
def unseen_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Clicked but never bought."""
    return ops.unseen(b.click_interactions(spark, d), b.purchase_interactions(spark, d)).select("user_id", "item_id", "strength")


@query("new_items", f"WITH {b.SQL_PURCHASES}, {b.SQL_CLICKS} SELECT DISTINCT item_id FROM purchases WHERE item_id NOT IN (SELECT item_id FROM clicks)")
def new_items(spark: SparkSession, d: str) -> DataFrame:
    return ops.new_items(b.purchases(spark, d), b.clicks(spark, d).select("item_id").distinct())


@query("bpr_triples", f"""WITH {_SQL_ENCODED}, drawn AS (
  SELECT user_id, item_id AS pos_item, CAST('0x' || substr(md5('42:' || user_id || ':' || item_id || ':1'), 1, 8) AS BIGINT) % (SELECT count(*) FROM iidx) AS item_idx FROM inter)
SELECT d.user_id, d.pos_item, CAST(1 AS INTEGER) AS draw, x.item_id AS neg_item FROM drawn d JOIN iidx x USING (item_idx)
WHERE NOT EXISTS (SELECT 1 FROM inter i WHERE i.user_id = d.user_id AND i.item_id = x.item_id)""")
def bpr_triples(spark: SparkSession, d: str) -> DataFrame:
    inter = b.purchase_interactions(spark, d)
    index = ops.entity_index(inter, "item_id", "item_idx")
    return ops.negative_triples(inter, index, index.count()).select("user_id", "pos_item", "draw", "neg_item")


@query("topk_per_user", f"""WITH {b.SQL_INTERACTIONS} SELECT user_id, item_id, strength, CAST(row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, item_id) AS INTEGER) AS rank
FROM inter QUALIFY rank <= 10""")
def topk_per_user(spark: SparkSession, d: str) -> DataFrame:
    return top_k(b.purchase_interactions(spark, d).select("user_id", "item_id", "strength"), ["user_id"], [F.desc("strength"), F.asc("item_id")], 10)


@query("topk_global", f"WITH {b.SQL_POPULARITY} SELECT item_id, score, n_users FROM popularity ORDER BY score DESC, item_id LIMIT 20")
def topk_global(spark: SparkSession, d: str) -> DataFrame:
    return ops.item_popularity(b.purchase_interactions(spark, d)).orderBy(F.desc("score"), "item_id").limit(20)
