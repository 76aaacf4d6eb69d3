"""Sessions, next-item pairs, context pairs and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastemill.plans.ordered import chunk_scan
from tastemill.plans.skew import salted_join
from tastemill.plans.topk import top_k
from tastemill.session import checkpointed

ORDER = ["ts", "event_id"]
SENTENCE = 1000


def by_day(events: DataFrame) -> DataFrame:
    """Chunks of one user: days since 1970. An event without a time is an error."""
    day = F.unix_date(F.to_date("ts"))
    return events.withColumn("_chunk", F.coalesce(day, F.raise_error(F.lit("an event has no time")).cast("int")))


def _gap(seconds: int) -> Column:
    return F.make_dt_interval(secs=F.lit(seconds))


def sessionize(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Events with ``session_no`` (1.. per user) and ``pos`` (1.. per session).

    A pause of ``gap_seconds`` or more starts a new session. Pauses inside a day are found per (user, day); the table of
    days carries the last event, the number of sessions and the length of the open session over to the next day, so the
    longest user history is spread over its days.
    """
    gap = _gap(gap_seconds)
    day = Window.partitionBy("user_id", "_chunk").orderBy(*ORDER)
    upto = day.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("ts") - F.lag("ts").over(day) >= gap
    local = by_day(events)
    local = local.withColumn("_rn", F.row_number().over(day)).withColumn("_start", F.when(starts, F.col("_rn")))

    user = Window.partitionBy("user_id").orderBy("_chunk")
    earlier = user.rowsBetween(Window.unboundedPreceding, -1)
    days = local.groupBy("user_id", "_chunk").agg(
        F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.count("*").alias("_n"), F.count("_start").alias("_inner"), F.max("_start").alias("_last_start")
    )
    pause = F.col("_first") - F.lag("_last").over(user)
    days = days.withColumn("_head", F.when(pause.isNull() | (pause >= gap), 1).otherwise(0))
    sessions = F.col("_head") + F.col("_inner")
    days = days.withColumn("_base", F.coalesce(F.sum(sessions).over(earlier), F.lit(0)) + F.col("_head"))
    # the session open at the end of a day has _open events in that day; days without a start add to the one before
    opened = F.when(F.col("_inner") > 0, F.col("_n") - F.col("_last_start") + 1).otherwise(F.col("_n"))
    days = days.withColumn("_open", opened).withColumn("_run", F.sum(F.when(sessions > 0, 1).otherwise(0)).over(user))
    days = days.withColumn("_sum", F.sum("_open").over(Window.partitionBy("user_id", "_run").orderBy("_chunk")))
    days = days.withColumn("_carry", F.when(F.col("_head") == 1, 0).otherwise(F.coalesce(F.lag("_sum").over(user), F.lit(0))))
    days = days.select("user_id", "_chunk", "_base", "_carry")

    numbered = local.withColumn("_seen", F.count("_start").over(upto)).withColumn("_from", F.max("_start").over(upto)).join(days, ["user_id", "_chunk"])
    numbered = numbered.withColumn("session_no", F.col("_base") + F.col("_seen"))
    numbered = numbered.withColumn("pos", F.when(F.col("_from").isNotNull(), F.col("_rn") - F.col("_from") + 1).otherwise(F.col("_rn") + F.col("_carry")).cast("bigint"))
    return numbered.drop("_chunk", "_rn", "_start", "_seen", "_from", "_base", "_carry")


def session_summary(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user_id", "session_no").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("n_events"), F.countDistinct("item_id").alias("n_items")
    )


def session_sentences(sessions: DataFrame, item: str = "item_id") -> DataFrame:
    """Sessions as item arrays; a session longer than a sentence continues in the next row, so no array is unbounded."""
    rows = sessions.withColumn("part", F.floor((F.col("pos") - 1) / SENTENCE))
    listed = rows.groupBy("user_id", "session_no", "part").agg(F.sort_array(F.collect_list(F.struct("pos", F.col(item).cast("string").alias("w")))).alias("s"))
    return listed.select("user_id", "session_no", "part", F.col("s.w").alias("sentence"))


def next_item_pairs(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Each event with the item that follows it in the same session, that is within the pause."""
    slim = events.select("user_id", "ts", "event_id", "item_id")
    chunked = chunk_scan(by_day(slim), ["user_id"], "_chunk", ORDER, following="_next", columns=("item_id",))
    follows = chunked.where(F.col("_next.ts") - F.col("ts") < _gap(gap_seconds))
    return follows.select("user_id", "event_id", F.col("item_id").alias("prev_item"), F.col("_next.item_id").alias("next_item"))


def context_pairs(sessions: DataFrame, window: int) -> DataFrame:
    """Counts of (centre, context) items at most ``window`` positions apart.

    Later items are found by an equi-join on the position; the pairs seen from the other side are the same counts turned
    round.
    """
    centre = sessions.select("user_id", "session_no", F.col("pos").alias("_p"), F.col("item_id").alias("centre_item"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(window)))
    reached = centre.withColumn("_d", steps).withColumn("pos", F.col("_p") + F.col("_d"))
    context = sessions.select("user_id", "session_no", "pos", F.col("item_id").alias("context_item"))
    later = reached.join(context, ["user_id", "session_no", "pos"]).groupBy("centre_item", "context_item").agg(F.count("*").alias("n"))
    ends = F.array(F.struct("centre_item", "context_item"), F.struct(F.col("context_item").alias("centre_item"), F.col("centre_item").alias("context_item")))
    both = later.select(F.explode(ends).alias("e"), "n").select("e.centre_item", "e.context_item", "n")
    return both.groupBy("centre_item", "context_item").agg(F.sum("n").alias("n"))


def transition_probabilities(pairs: DataFrame, n_items: int, smoothing: float = 0.0) -> DataFrame:
    """P(next | prev) from pair counts with additive smoothing over the catalog."""
    counts = checkpointed(pairs.groupBy("prev_item", "next_item").agg(F.count("*").alias("n")))
    totals = counts.groupBy("prev_item").agg(F.sum("n").alias("n_prev"))
    joined = counts.join(totals, "prev_item")
    return joined.withColumn("probability", (F.col("n") + smoothing) / (F.col("n_prev") + smoothing * n_items))


def last_items(events: DataFrame, user: str = "user_id") -> DataFrame:
    return events.groupBy(user).agg(F.max(F.struct(*ORDER, "item_id")).alias("_l")).select(user, F.col("_l.item_id").alias("last_item"))


def predict_next(last: DataFrame, transitions: DataFrame, k: int, order: Column | None = None) -> DataFrame:
    """The k most probable next items after each user's last item. Lists are cut per item first, then handed to users."""
    heads = top_k(transitions, ["prev_item"], [F.desc("probability") if order is None else order, F.asc("next_item")], k)
    heads = heads.select(F.col("prev_item").alias("last_item"), "next_item", "probability", "rank")
    return salted_join(last, heads, ["last_item"], ["user_id"])
