"""Queries over sessions, pairs and transitions of the click stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.catalog import bindings as b
from tastemill.catalog.registry import query
from tastemill.functions.scalars import rounded
from tastemill.operators import sequences as ops

GAP = 6 * 3600
WINDOW = 2

SQL_SESSIONS = b.SQL_CLICKS + f""", marked AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL {GAP} SECOND THEN 1 ELSE 0 END AS starts
  FROM clicks WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), sessions AS (
  SELECT *, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM marked), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS BIGINT) AS pos FROM sessions)"""

SQL_PAIRS = SQL_SESSIONS + """, pairs AS (
  SELECT user_id, event_id, item_id AS prev_item, lead(item_id) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS next_item FROM sessions
  QUALIFY next_item IS NOT NULL)"""

SQL_TRANSITIONS = SQL_PAIRS + """, counts AS (SELECT prev_item, next_item, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY ALL), transitions AS (
  SELECT prev_item, next_item, n, CAST(sum(n) OVER (PARTITION BY prev_item) AS BIGINT) AS n_prev,
         (n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY prev_item) + 1.0::DOUBLE * (SELECT count(DISTINCT item_id) FROM clicks)) AS probability FROM counts)"""

SQL_LAST = "lasts AS (SELECT user_id, arg_max(item_id, (ts, event_id)) AS last_item FROM clicks GROUP BY user_id)"


def sessions_of(spark: SparkSession, d: str) -> DataFrame:
    return ops.sessionize(b.clicks(spark, d), GAP)


def transitions_of(spark: SparkSession, d: str) -> DataFrame:
    n_items = b.clicks(spark, d).agg(F.countDistinct("item_id")).first()[0]
    return ops.transition_probabilities(ops.next_item_pairs(b.clicks(spark, d), GAP), n_items, 1.0)


@query("sessions", f"""WITH {SQL_SESSIONS} SELECT user_id, session_no, min(ts) AS session_start, max(ts) AS session_end,
CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT item_id) AS BIGINT) AS n_items FROM sessions GROUP BY user_id, session_no""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return ops.session_summary(sessions_of(spark, d))


@query("session_positions", f"WITH {SQL_SESSIONS} SELECT event_id, user_id, session_no, pos, item_id FROM placed")
def session_positions(spark: SparkSession, d: str) -> DataFrame:
    return sessions_of(spark, d).select("event_id", "user_id", "session_no", "pos", "item_id")


@query("session_sentences", f"""WITH {SQL_SESSIONS} SELECT user_id, session_no, (pos - 1) // {ops.SENTENCE} AS part, string_agg(item_id, ' ' ORDER BY pos) AS words
FROM placed GROUP BY ALL""")
def session_sentences(spark: SparkSession, d: str) -> DataFrame:
    parts = ops.session_sentences(sessions_of(spark, d))
    return parts.select("user_id", "session_no", "part", F.array_join("sentence", " ").alias("words"))


@query("next_item_pairs", f"WITH {SQL_PAIRS} SELECT * FROM pairs")
def next_item_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ops.next_item_pairs(b.clicks(spark, d), GAP)


@query("context_pairs", f"""WITH {SQL_SESSIONS} SELECT a.item_id AS centre_item, c.item_id AS context_item, CAST(count(*) AS BIGINT) AS n
FROM placed a JOIN placed c ON a.user_id = c.user_id AND a.session_no = c.session_no AND a.pos <> c.pos AND abs(a.pos - c.pos) <= {WINDOW} GROUP BY ALL""")
def context_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ops.context_pairs(sessions_of(spark, d), WINDOW)


@query("transition_probs", f"WITH {SQL_TRANSITIONS} SELECT prev_item, next_item, n, n_prev, round(probability, 6) + 0.0 AS probability FROM transitions")
def transition_probs(spark: SparkSession, d: str) -> DataFrame:
    return transitions_of(spark, d).withColumn("probability", rounded(F.col("probability")))


@query("predict_next_items", f"""WITH {SQL_TRANSITIONS}, {SQL_LAST}
SELECT user_id, last_item, next_item, round(probability, 6) + 0.0 AS probability,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY t.probability DESC, next_item) AS INTEGER) AS rank
FROM lasts JOIN transitions t ON prev_item = last_item QUALIFY rank <= 5""")
def predict_next_items(spark: SparkSession, d: str) -> DataFrame:
    found = ops.predict_next(ops.last_items(b.clicks(spark, d)), transitions_of(spark, d), 5)
    return found.withColumn("probability", rounded(F.col("probability"))).select("user_id", "last_item", "next_item", "probability", "rank")


@query("sequence_recommend", f"""WITH {SQL_TRANSITIONS}, {SQL_LAST}
SELECT user_id, next_item AS item_id, round(probability, 6) + 0.0 AS score,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY t.probability DESC, next_item) AS INTEGER) AS rank
FROM lasts l JOIN transitions t ON prev_item = last_item
WHERE NOT EXISTS (SELECT 1 FROM clicks c WHERE c.user_id = l.user_id AND c.item_id = t.next_item) QUALIFY rank <= 5""")
def sequence_recommend(spark: SparkSession, d: str) -> DataFrame:
    """Next items the user has not touched yet."""
    from tastemill.models.transitions import TransitionModel

    events = b.clicks(spark, d)
    model = TransitionModel(gap_seconds=GAP, smoothing=1.0).fit(events)
    found = model.recommend(events.select("user_id").distinct(), events, 5, exclude_seen=True)
    return found.select("user_id", "item_id", rounded(F.col("score")).alias("score"), "rank")
