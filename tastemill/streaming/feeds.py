"""Streams of event files and queue messages into tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tastemill import schemas
from tastemill.sources.ingest import align
from tastemill.sources.messages import split_messages
from tastemill.sources.tables import VersionedTable, path_exists, read_text

POLL = "5 seconds"  # fixed value: poll interval of the feed


def _trigger(writer, once: bool, interval: str):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)


def event_files(spark: SparkSession, path: str, schema: T.StructType = schemas.EVENTS, max_files: int | None = None, glob: str = "*.parquet") -> DataFrame:
    """Stream of the parquet files of a folder, each read once; the folder must exist before the stream starts."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no folder {path}")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_to_parquet(stream: DataFrame, out: str, checkpoint: str, once: bool = True, interval: str = POLL, mode: str = "append", partition_by: list[str] | None = None):
    """Exactly-once append into a parquet folder by the file sink."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _trigger(writer, once, interval).start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of a checkpoint folder. A new folder, also one at an old place, has another id, so its batch numbers are its own."""
    return json.loads(read_text(spark, f"{checkpoint}/metadata"))["id"]


def isolated_event_files(spark: SparkSession, path: str, table: VersionedTable, quarantine: VersionedTable, checkpoint: str, schema: T.StructType = schemas.EVENTS,
                         max_files: int = 100, once: bool = True, interval: str = POLL):
    """As :func:`event_files`, but one bad file never stops the feed.

    The stream carries file names only (at most ``max_files`` per batch). A batch is read as a whole; only if that fails
    each of its files is tried alone, the bad ones go to the quarantine table and are tried again in the next batch.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no folder {path}")
    listing = "path string, modificationTime timestamp, length bigint, content binary"  # only the path is read
    names = spark.readStream.format("binaryFile").schema(listing).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", max_files).load(path).select("path")

    def append(files: list[str], key: str) -> None:
        table.append(align(spark.read.parquet(*files), schema), key)

    def batch(df: DataFrame, batch_id: int) -> None:
        fresh = [r.path for r in df.collect()]
        again = [r.path for r in quarantine.read().select("path").limit(max_files).collect()] if quarantine.exists() else []
        files, bad = fresh + again, []
        if not files:
            return
        key = f"{stream_id(spark, checkpoint)}/{batch_id}"
        try:
            append(files, key)
        except Exception:
            good = []
            for name in files:
                try:
                    align(spark.read.parquet(name), schema).write.format("noop").mode("overwrite").save()
                    good.append(name)
                except Exception as problem:
                    bad.append((name, str(problem).splitlines()[0][:500]))
            if good:
                append(good, key)
        if bad or again:
            waiting = quarantine.read().join(spark.createDataFrame([(f,) for f in files], "path string"), "path", "left_anti") if quarantine.exists() else None
            rows = spark.createDataFrame(bad, "path string, problem string")
            quarantine.replace(rows if waiting is None else waiting.unionByName(rows))

    writer = names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return _trigger(writer, once, interval).start()


def queue_to_tables(stream: DataFrame, good: str, rejected: str, checkpoint: str, once: bool = True, interval: str = POLL):
    """Decode a stream of ``value`` messages into an event folder and a dead-letter folder.

    Both folders carry the batch number and a batch is written under its own number, so a repeated batch replaces itself.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        df.persist()
        events, dead = split_messages(df)
        events.write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        dead.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        df.unpersist()

    return _trigger(stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), once, interval).start()


def finish(query) -> None:
    """Wait for a stream of available data and raise what stopped it."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def as_timestamp(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as needed for watermarks."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))
