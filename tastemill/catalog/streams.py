"""Queries that run a stream over all available data and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.catalog import bindings as b
from tastemill.catalog.registry import query
from tastemill.functions.scalars import epoch_seconds, rounded
from tastemill.models.als import ALSModel
from tastemill.operators.interactions import interactions
from tastemill.session import checkpointed, work_path
from tastemill.sources.messages import queue_stream
from tastemill.sources.tables import VersionedTable, write_text
from tastemill.streaming import feeds, windows
from tastemill.streaming.worker import UpdateWorker

DAY = 86400


def click_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events file as a stream with an event time fit for watermarks."""
    schema = b.table(spark, d, "events").schema
    raw = feeds.event_files(spark, d, schema, glob="events.parquet")
    item = F.get_json_object("props", "$.k").cast("bigint")
    return feeds.as_timestamp(raw).select("event_id", "ts", "user_id", item.alias("item_id"), "event_type", "value")


def _written(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    root = work_path(spark, name)
    feeds.finish(feeds.stream_to_parquet(stream, f"{root}/out", f"{root}/state"))
    return spark.read.parquet(f"{root}/out")


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Zone-less timestamps, as the oracle has them."""
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query("stream_ingest", f"WITH {b.SQL_CLICKS} SELECT event_id, ts, user_id, item_id, event_type, value FROM clicks")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    return _plain(_written(spark, click_stream(spark, d), "ingest"), "ts")


@query("stream_ingest_isolated", f"WITH {b.SQL_CLICKS} SELECT event_id, ts, user_id, event_type FROM clicks")
def stream_ingest_isolated(spark: SparkSession, d: str) -> DataFrame:
    """The feed that survives bad files, over a copy of the events and a file that is no parquet."""
    root = work_path(spark, "isolated")
    b.table(spark, d, "events").write.parquet(f"{root}/in")
    write_text(spark, f"{root}/in/broken.parquet", "not a parquet file")
    table, quarantine = VersionedTable(spark, f"{root}/events"), VersionedTable(spark, f"{root}/quarantine")
    schema = b.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type").schema
    feeds.finish(feeds.isolated_event_files(spark, f"{root}/in", table, quarantine, f"{root}/state", schema))
    return table.read()


@query("stream_queue", f"""WITH {b.SQL_CLICKS} SELECT user_id, item_id, qty, n FROM (
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, CAST(1 AS INTEGER) AS qty, CAST(count(*) AS BIGINT) AS n FROM clicks WHERE event_type <> 'error' GROUP BY ALL)
UNION ALL SELECT 'rejected', CASE WHEN event_type = 'error' THEN 'missing user_id' END, NULL, CAST(count(*) AS BIGINT) FROM clicks WHERE event_type = 'error' GROUP BY ALL""")
def stream_queue(spark: SparkSession, d: str) -> DataFrame:
    """Events as queue messages in a landing folder; those of type error lost their user."""
    root = work_path(spark, "queue")
    rows = b.clicks(spark, d).withColumn("user_id", F.when(F.col("event_type") != "error", F.col("user_id").cast("string")))
    body = F.struct("user_id", F.col("item_id").cast("string").alias("item_id"), "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    rows.select(F.to_json(body).alias("value")).write.text(f"{root}/landing")
    stream = queue_stream(spark, "rabbitmq", {"path": f"{root}/landing", "maxFilesPerTrigger": "50"})
    feeds.finish(feeds.queue_to_tables(stream, f"{root}/events", f"{root}/dead", f"{root}/state"))
    good = spark.read.parquet(f"{root}/events").groupBy("user_id", "item_id", "qty").agg(F.count("*").alias("n"))
    dead = spark.read.parquet(f"{root}/dead").groupBy("reason").agg(F.count("*").alias("n"))
    return good.unionByName(dead.select(F.lit("rejected").alias("user_id"), F.col("reason").alias("item_id"), F.lit(None).cast("int").alias("qty"), "n"))


@query("late_events", f"WITH {b.SQL_CLICKS} SELECT event_id, user_id, item_id FROM clicks")
def late_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event is delivered twice; within the watermark one of them goes."""
    twice = click_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _written(spark, windows.distinct_events(twice, "2 days"), "late").select("event_id", "user_id", "item_id")


@query("stream_popularity", f"""WITH {b.SQL_CLICKS}, w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, item_id, value FROM clicks)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, item_id, CAST(count(*) AS BIGINT) AS n_events, round(sum(value), 4) + 0.0 AS value FROM w
WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM clicks) GROUP BY window_start, item_id""")
def stream_popularity(spark: SparkSession, d: str) -> DataFrame:
    """Daily item counts of all days the watermark has passed."""
    rows = _written(spark, windows.windowed_popularity(click_stream(spark, d), "1 hour", "1 day"), "popularity")
    return _plain(rows, "window_start", "window_end").withColumn("value", rounded(F.col("value"), 4))


@query("stream_sessions", f"""WITH {b.SQL_CLICKS}, marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM clicks WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM marked), closed AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, CAST(count(*) AS BIGINT) AS n_events FROM numbered GROUP BY user_id, no)
SELECT * FROM closed WHERE session_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM clicks)""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions the watermark has closed."""
    rows = _written(spark, windows.session_counts(click_stream(spark, d), "1 hour", "6 hours"), "sessions")
    return _plain(rows, "session_start", "session_end")


@query("stream_foldin", f"WITH {b.SQL_CLICKS} SELECT DISTINCT user_id, TRUE AS same FROM clicks")
def stream_foldin(spark: SparkSession, d: str) -> DataFrame:
    """Users refitted batch by batch from two deliveries (purchases, then the rest) equal a refit from all events at once."""
    root = work_path(spark, "worker")
    clicks = b.clicks(spark, d).withColumn("ts", epoch_seconds(F.col("ts")))
    columns = ["user_id", "item_id", "ts", "qty"]
    events, bought = clicks.select(*columns), F.col("event_type") == "purchase"
    clicks.where(bought).select(*columns).write.mode("append").parquet(f"{root}/feed")
    inter = checkpointed(interactions(events))
    model = ALSModel(factors=8, regularization=0.05, iterations=3).fit(inter)
    worker = UpdateWorker(spark, root, model.item_vectors(), 8, 0.05, 1.0, buckets=8)
    schema = events.schema

    def run() -> None:
        feeds.finish(worker.run(feeds.event_files(spark, f"{root}/feed", schema), f"{root}/state"))

    run()
    clicks.where(~bought).select(*columns).write.mode("append").parquet(f"{root}/feed")
    run()
    joined = worker.users.read().join(model.fold_in(inter).withColumnRenamed("vector", "batch_vector"), "user_id")
    gap = F.aggregate(F.zip_with("vector", "batch_vector", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: F.greatest(acc, x))
    return joined.select("user_id", (gap < 1e-6).alias("same"))


