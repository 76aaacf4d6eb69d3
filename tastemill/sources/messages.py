"""Queue messages: decoding, validation, defaults and the streaming sources that carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tastemill import schemas

QUEUE_KINDS = ("kafka", "rabbitmq")


def decode(df: DataFrame, value: str = "value", schema: T.StructType = schemas.MESSAGE) -> DataFrame:
    """The message as struct ``message`` and, for text that is no JSON object, its raw text in ``corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = df.withColumn("_m", F.from_json(F.col(value).cast("string"), full, options))
    return (
        parsed.withColumn("corrupt", F.when(F.col("_m").isNull(), F.col(value).cast("string")).otherwise(F.col("_m._corrupt")))
        .withColumn("message", F.struct(*[F.col(f"_m.{f.name}").alias(f.name) for f in schema]))
        .drop("_m")
    )


def reject_reason(user: Column, item: Column, corrupt: Column | None = None) -> Column:
    """Why a message cannot be an event; null for a good one."""
    reason = F.when(user.isNull(), "missing user_id").when(item.isNull(), "missing item_id")
    return reason if corrupt is None else F.when(corrupt.isNotNull(), "not decodable").otherwise(reason)


def with_defaults(df: DataFrame) -> DataFrame:
    """qty 1 and the current time where the message has none."""
    ts = F.coalesce(F.try_to_timestamp(F.col("timestamp")), F.current_timestamp())
    return df.withColumn("qty", F.coalesce("qty", F.lit(1))).withColumn("ts", ts).drop("timestamp")


def split_messages(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Good events and rejected messages with their reason (the dead-letter rows)."""
    decoded = decode(df, value)
    judged = decoded.withColumn("reason", reject_reason(F.col("message.user_id"), F.col("message.item_id"), F.col("corrupt")))
    good = with_defaults(judged.where(F.col("reason").isNull()).select("message.*"))
    rejected = judged.where(F.col("reason").isNotNull()).select(F.col(value).cast("string").alias("value"), "reason")
    return good, rejected


def queue_stream(spark: SparkSession, kind: str, config: dict[str, str]) -> DataFrame:
    """A streaming frame with a ``value`` column.

    ``kafka`` reads with the options given (``kafka.bootstrap.servers``, ``subscribe``, ``startingOffsets``,
    ``maxOffsetsPerTrigger``) and keeps its offsets in the stream checkpoint. Brokers without a Spark source deliver
    through a landing folder of text files: ``rabbitmq`` with ``path`` (and ``maxFilesPerTrigger``).
    """
    if kind not in QUEUE_KINDS:
        raise ValueError(f"unknown queue type {kind}; one of {', '.join(QUEUE_KINDS)}")
    if kind == "kafka":
        options = {"startingOffsets": "latest", **config}
        return spark.readStream.format("kafka").options(**options).load()
    options = dict(config)
    return spark.readStream.options(**{k: v for k, v in options.items() if k != "path"}).text(options["path"])
