"""Export, deletion, tombstones, audit and retention."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.plans.ordered import chunk_scan
from tastemill.session import checkpointed
from tastemill.sources.tables import path_exists, read_text, remove, write_text

EXPORT_PART = 1000
#: Partitions of the stored events, and the column that names them.
BUCKETS, BUCKET = 64, "user_bucket"


def export_rows(events: DataFrame, items: DataFrame, requests: DataFrame) -> DataFrame:
    """Events of the requested users and the items they touched, as rows of two kinds."""
    own = events.join(requests.select("user_id"), "user_id", "left_semi")
    touched = own.select("user_id", "item_id").distinct().join(items, "item_id")
    event_rows = own.select("user_id", F.lit("event").alias("kind"), "item_id", "ts", "qty")
    item_rows = touched.select("user_id", F.lit("item").alias("kind"), "item_id", "category", "brand", "price")
    return event_rows.unionByName(item_rows, allowMissingColumns=True)


def export_documents(events: DataFrame, items: DataFrame, requests: DataFrame, chunk: str, order: list[str]) -> DataFrame:
    """JSON export parts per user: ``user_id, part, export_timestamp, events[], items[]``.

    A part holds at most ``EXPORT_PART`` events and the items in them, so no export is gathered in one row.
    """
    own = events.join(requests.select("user_id"), "user_id", "left_semi")
    placed = chunk_scan(own, ["user_id"], chunk, order, position="_pos").withColumn("part", F.floor((F.col("_pos") - 1) / EXPORT_PART))
    joined = placed.join(items, "item_id", "left")
    event = F.struct("_pos", "item_id", "ts", "qty")
    item = F.when(F.col("category").isNotNull() | F.col("price").isNotNull(), F.struct("item_id", "category", "brand", "price"))
    parts = joined.groupBy("user_id", "part").agg(F.sort_array(F.collect_list(event)).alias("_events"), F.sort_array(F.collect_set(item)).alias("items"))
    bare = F.transform("_events", lambda e: F.struct(e["item_id"].alias("item_id"), e["ts"].alias("ts"), e["qty"].alias("qty")))
    return parts.select("user_id", "part", F.unix_timestamp(F.current_timestamp()).alias("export_timestamp"), bare.alias("events"), "items")


def write_export(documents: DataFrame, path: str) -> None:
    documents.write.partitionBy("user_id").json(path)


def without_users(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of all other users; also the way tombstones act on events, factors and requests."""
    return rows.join(requests.select("user_id"), "user_id", "left_anti")


def tombstones(events: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per requested user that has events, with the number deleted; a user without events has nothing to delete."""
    own = events.join(requests.select("user_id"), "user_id", "left_semi")
    return own.groupBy("user_id").agg(F.count("*").alias("deleted_events"))


def audit_rows(requests: DataFrame, action: str, status: str) -> DataFrame:
    return requests.select(F.current_timestamp().alias("ts"), F.lit(action).alias("action"), F.col("user_id"), F.lit(status).alias("status"))


def _bucket(user: str, buckets: int):
    return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")


def store_events(events: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Append to the plain parquet folder ``root/events``, partitioned by a hash of the user, so that a deletion touches few partitions.

    The number of buckets is fixed by the first call. Rows of a bucket are spread over tasks by a hash of the item."""
    spark, told = events.sparkSession, f"{root}/buckets"
    if not path_exists(spark, told):
        write_text(spark, told, str(buckets))
    rows = events.withColumn(BUCKET, _bucket("user_id", int(read_text(spark, told))))
    rows.repartition(BUCKET, F.pmod(F.xxhash64("item_id"), F.lit(4))).write.mode("append").partitionBy(BUCKET).parquet(f"{root}/events")


def stored_events(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/events").drop(BUCKET)


def deleted_users(spark: SparkSession, root: str) -> DataFrame | None:
    """``user_id`` of all tombstones, or None before the first deletion. Training, models and the update worker take it as ``deleted``."""
    path = f"{root}/deleted_users"
    return spark.read.parquet(path).select("user_id").distinct() if path_exists(spark, path) else None


def erase_rows(spark: SparkSession, path: str, requests: DataFrame, key: str, buckets: int, partitions: tuple[str, ...] = (BUCKET,)) -> None:
    """Rewrite the partitions of a parquet folder that hold rows of the requested users, without them; all other files stay as they are.

    What stays is first written beside the folder, then put in place by a dynamic partition overwrite. A stopped run goes on from there when it is repeated under
    its key, so nothing may be appended to the folder in between. Partitions that lose all their rows are removed.
    """
    pending = f"{path}.pending-{key}"
    rows = spark.read.parquet(path)
    requests = requests.select(F.col("user_id").cast(rows.schema["user_id"].dataType).alias("user_id"))
    numbers = [r[0] for r in requests.select(_bucket("user_id", buckets)).distinct().collect()]  # at most ``buckets``
    near = rows.where(F.col(BUCKET).isin(numbers))
    if not path_exists(spark, f"{pending}/_SUCCESS"):
        touched = checkpointed(near.join(requests, "user_id", "left_semi").select(*partitions).distinct())
        if touched.isEmpty():
            return
        kept = without_users(near.join(touched, list(partitions), "left_semi"), requests)
        kept.select(*rows.columns).write.mode("overwrite").partitionBy(*partitions).parquet(pending)
    kept = spark.read.schema(rows.schema).parquet(pending)
    if not kept.isEmpty():
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    emptied = spark.read.schema(rows.schema).parquet(path).where(F.col(BUCKET).isin(numbers)).join(requests, "user_id", "left_semi")
    for values in emptied.select(*partitions).distinct().collect():  # one row per partition
        remove(spark, "/".join([path, *(f"{name}={value}" for name, value in zip(partitions, values, strict=True))]))
    remove(spark, pending)


def delete_users(spark: SparkSession, root: str, requests: DataFrame, confirm: bool, key: str | None = None) -> int:
    """Delete users from the stored events, write tombstones and audit rows; returns the number of users that had events.

    ``key`` names the request (by default a digest of its users): tombstones and audit rows lie under it, so a repeated run replaces its own and counts nothing
    twice. Tombstones are written before the events go, so readers that honour them never see a half-deleted user.
    """
    if not confirm:
        return 0
    path = f"{root}/events"
    kind = spark.read.parquet(path).schema["user_id"].dataType
    asked = checkpointed(requests.select(F.col("user_id").cast(kind).alias("user_id")).where("user_id IS NOT NULL").distinct())
    if key is None:
        many, digest = asked.agg(F.count(F.lit(1)), F.sum(F.xxhash64("user_id").cast("decimal(38,0)"))).first()
        key = f"{many}-{digest or 0}"
    buckets = int(read_text(spark, f"{root}/buckets"))
    stones_path, audit_path = (f"{root}/{name}/request={key}" for name in ("deleted_users", "audit"))
    numbers = [r[0] for r in asked.select(_bucket("user_id", buckets)).distinct().collect()]  # at most ``buckets``
    own = spark.read.parquet(path).where(F.col(BUCKET).isin(numbers))
    stones = checkpointed(tombstones(own, asked).withColumn("deletion_timestamp", F.unix_timestamp(F.current_timestamp())))
    gone = stones.count()
    if gone:
        if path_exists(spark, f"{stones_path}/_SUCCESS"):
            # A run that was stopped: its own counts stand, except for users whose events it had not seen.
            before = spark.read.schema(stones.schema).parquet(stones_path)
            stones = checkpointed(before.unionByName(stones.join(before.select("user_id"), "user_id", "left_anti")))
        stones.write.mode("overwrite").parquet(stones_path)
    erase_rows(spark, path, asked, key, buckets)
    if gone or (path_exists(spark, stones_path) and not path_exists(spark, f"{audit_path}/_SUCCESS")):
        audit_rows(asked, "DELETE", "done").write.mode("overwrite").parquet(audit_path)
    return gone


def retain(events: DataFrame, days: int, ts: str = "ts") -> DataFrame:
    """Events of the last ``days`` days up to the newest one; the cut is a literal, so it is pushed into the scan."""
    newest = events.agg(F.max(ts)).first()[0]
    return events if newest is None else events.where(F.col(ts) >= F.lit(newest - timedelta(days=days)).cast(events.schema[ts].dataType))
