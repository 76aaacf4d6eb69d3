"""Incremental model updates from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.functions.vectors import mean_vectors, sum_vectors
from tastemill.models.als import fold_in
from tastemill.operators.interactions import new_items
from tastemill.operators.privacy import deleted_users, erase_rows, without_users
from tastemill.session import checkpointed
from tastemill.sources.tables import path_exists

INTERVAL = "60 seconds"  # fixed value: update interval
USER_BUCKETS = 64


class InteractionLog:
    """Micro-batch sums of (user, item), stored by user bucket so that the history of a few users reads a few buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = USER_BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, user: str = "user_id"):
        return F.pmod(F.xxhash64(user), F.lit(self.buckets)).cast("int")

    def append(self, events: DataFrame, batch_id: int) -> None:
        """Repeating a batch replaces it."""
        delta = events.groupBy("user_id", "item_id").agg(F.sum("qty").cast("double").alias("strength"))
        # the bucket decides the file, a hash of the item splits a hot user over tasks
        spread = delta.withColumn("user_bucket", self._bucket()).repartition("user_bucket", F.pmod(F.xxhash64("item_id"), F.lit(4)))
        spread.write.mode("overwrite").partitionBy("user_bucket").parquet(f"{self.path}/batch={batch_id}")

    def history(self, users: DataFrame) -> DataFrame:
        """Full history of the given users, one row per item."""
        touched = [r[0] for r in users.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        rows = self.spark.read.parquet(self.path).where(F.col("user_bucket").isin(touched)).join(users.select("user_id"), "user_id", "left_semi")
        return rows.groupBy("user_id", "item_id").agg(F.sum("strength").alias("strength"))


class FactorLog:
    """Vectors written per batch; the newest batch of an id counts."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def append(self, vectors: DataFrame, batch_id: int) -> None:
        vectors.select(self.key, F.col("vector").cast("array<double>").alias("vector")).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows.groupBy(self.key).agg(F.max_by("vector", "batch").alias("vector"))


class UpdateWorker:
    """Per micro-batch: log the interactions, refit the touched users against the item vectors, add new items.

    A new item takes its content vector if ``content_vectors`` has one of the same space, else the mean vector of the
    items bought by the same users in the batch, else it waits in ``pending``. All outputs carry the batch number and are
    rewritten as a whole when a batch is repeated, so restarts do not count twice.

    With ``privacy_root`` (where ``delete_users`` keeps its tombstones) events of deleted users are left out of every batch, and ``erase`` takes what the
    worker already holds of them.
    """

    def __init__(self, spark: SparkSession, root: str, item_vectors: DataFrame, factors: int, regularization: float, alpha: float, content_vectors: DataFrame | None = None, buckets: int = USER_BUCKETS,
                 privacy_root: str | None = None):
        self.spark, self.root, self.privacy_root = spark, root, privacy_root
        self.factors, self.regularization, self.alpha = factors, regularization, alpha
        self.content = content_vectors
        self.log = InteractionLog(spark, f"{root}/interactions", buckets)
        self.users = FactorLog(spark, f"{root}/user_vectors", "user_id")
        self.items = FactorLog(spark, f"{root}/item_vectors", "item_id")
        if not path_exists(spark, f"{root}/item_vectors"):
            self.items.append(item_vectors, -1)

    def update(self, events: DataFrame, batch_id: int) -> None:
        deleted = deleted_users(self.spark, self.privacy_root) if self.privacy_root else None
        events = (events if deleted is None else without_users(events, deleted)).persist()
        try:
            if events.isEmpty():
                return
            self.log.append(events, batch_id)
            known = self._known_before(batch_id)
            fresh = new_items(events, known)
            vectors, pending = self._new_vectors(events, fresh, known)
            vectors = checkpointed(vectors)
            self.items.append(vectors, batch_id)
            pending.write.mode("overwrite").parquet(f"{self.root}/pending/batch={batch_id}")
            touched = events.select("user_id").distinct()
            history = self.log.history(touched)
            refit = fold_in(history, known.unionByName(vectors), self.factors, self.regularization, self.alpha)
            self.users.append(refit, batch_id)
        finally:
            events.unpersist()

    def erase(self, requests: DataFrame, key: str) -> None:
        """Remove users from the log and from the stored vectors, between two batches; a repeated run finds nothing more to do."""
        if path_exists(self.spark, self.log.path):
            erase_rows(self.spark, self.log.path, requests.select("user_id"), key, self.log.buckets, ("batch", "user_bucket"))
        if path_exists(self.spark, self.users.path):
            vectors = self.spark.read.parquet(self.users.path)
            touched = [r.batch for r in vectors.join(requests, "user_id", "left_semi").select("batch").distinct().collect()]  # one number per batch
            kept = checkpointed(without_users(vectors.where(F.col("batch").isin(touched)), requests))
            for batch in touched:
                kept.where(F.col("batch") == batch).drop("batch").write.mode("overwrite").parquet(f"{self.users.path}/batch={batch}")

    def _known_before(self, batch_id: int) -> DataFrame:
        rows = self.spark.read.parquet(self.items.path).where(F.col("batch") < batch_id)
        return rows.groupBy("item_id").agg(F.max_by("vector", "batch").alias("vector"))

    def _new_vectors(self, events: DataFrame, fresh: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        f = self.factors
        pairs = events.select("user_id", "item_id").distinct()
        # mean over the users of a new item of their mean known vector: sums per user first, so no item pairs arise
        per_user = sum_vectors(pairs.join(known, "item_id"), ["user_id"], "vector", f, "vector", F.count("*").alias("n"))
        buyers = pairs.join(fresh, "item_id", "left_semi").join(per_user, "user_id").withColumn("vector", F.transform("vector", lambda x: x / F.col("n")))
        near = mean_vectors(buyers, ["item_id"], "vector", f, "vector")
        found = fresh.join(near, "item_id", "left")
        if self.content is not None:
            found = found.withColumnRenamed("vector", "_near").join(self.content.select("item_id", "vector"), "item_id", "left")
            found = found.withColumn("vector", F.coalesce(F.col("vector").cast("array<double>"), F.col("_near"))).drop("_near")
        return found.where(F.col("vector").isNotNull()), found.where(F.col("vector").isNull()).select("item_id")

    def run(self, stream: DataFrame, checkpoint: str, once: bool = True, interval: str = INTERVAL):
        writer = stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
