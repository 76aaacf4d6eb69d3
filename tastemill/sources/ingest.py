"""Batch ingestion: events, items, item metadata, appends by name and incremental scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tastemill import schemas
from tastemill.sources.tables import VersionedTable, path_exists


def align(df: DataFrame, schema: T.StructType, extra: str = "drop") -> DataFrame:
    """Columns by name in the order and types of ``schema``; a missing column is an error, not a shift."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    picked = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
    if extra == "keep":
        picked += [F.col(c) for c in df.columns if c not in schema.fieldNames()]
    return df.select(*picked)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return align(spark.read.parquet(path), schemas.EVENTS)


def read_items_csv(spark: SparkSession, path: str) -> DataFrame:
    """Items with a header; columns are matched by name, so their order in the file is free."""
    raw = spark.read.csv(path, header=True, schema=None, inferSchema=False)
    return align(raw, schemas.ITEMS, extra="keep")


def ingest(spark: SparkSession, events_path: str, items_path: str, root: str) -> dict[str, bool]:
    """Create the ``events`` and ``items`` tables; a table that is there already is left as it is."""
    return {
        "events": VersionedTable(spark, f"{root}/events").create_if_absent(read_events(spark, events_path)),
        "items": VersionedTable(spark, f"{root}/items").create_if_absent(read_items_csv(spark, items_path)),
    }


def schema_template(df: DataFrame) -> DataFrame:
    """An empty relation with the schema of ``df``."""
    return df.where(F.lit(False))


def append_by_name(table: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` under ``table``, matched by name: reordered columns are safe, missing ones null, extra ones dropped."""
    kept = new.select(*[c for c in new.columns if c in table.columns])
    return table.unionByName(kept, allowMissingColumns=True)


def read_item_metadata(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Item rows from one JSON object ``{item_id: {...}}`` in the first path that exists; a malformed file gives no rows.

    The object is one catalog file; large catalogs should arrive as JSON lines, which ``spark.read.json`` splits.
    """
    schema = T.MapType(T.StringType(), schemas.ITEM_METADATA)
    for path in paths:
        if path_exists(spark, path):
            whole = spark.read.text(path, wholetext=True)
            parsed = whole.select(F.from_json("value", schema).alias("m"))
            return parsed.select(F.explode("m").alias("item_id", "d")).select("item_id", "d.*")
    return spark.createDataFrame([], T.StructType([T.StructField("item_id", T.StringType()), *schemas.ITEM_METADATA.fields]))


def read_new_files(spark: SparkSession, path: str, modified_after: str | None, schema: T.StructType | None = None) -> DataFrame:
    """Rows of the files changed after a file time; data times are compared with the data cursor, never with file times."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.parquet(path)


def new_events_since(events: DataFrame, ts: str, event_id: str, cursor: tuple | None, limit: int | None = None) -> DataFrame:
    """Events after the cursor ``(ts, event_id)`` in order; rows that share the last time stamp are not lost at a limit."""
    if cursor is not None:
        last_ts, last_id = cursor
        events = events.where((F.col(ts) > F.lit(last_ts)) | ((F.col(ts) == F.lit(last_ts)) & (F.col(event_id) > F.lit(last_id))))
    ordered = events.orderBy(ts, event_id)
    return ordered if limit is None else ordered.limit(limit)


def cursor_after(events: DataFrame, ts: str, event_id: str) -> DataFrame:
    """One row with the largest ``(ts, event_id)``."""
    return events.agg(F.max(F.struct(ts, event_id)).alias("last")).select(f"last.{ts}", f"last.{event_id}")


def data_quality(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("events"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("item_id").alias("items"),
        F.count_if(F.col("user_id").isNull()).alias("null_users"),
        F.count_if(F.col("item_id").isNull()).alias("null_items"),
        F.count_if(F.col("qty") <= 0).alias("bad_qty"),
    )


def duplicate_keys(items: DataFrame, key: str = "item_id") -> DataFrame:
    """Keys that break uniqueness."""
    return items.groupBy(key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
