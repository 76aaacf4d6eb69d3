"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded without negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def stable_hash(*parts: Column, seed: int = 42) -> Column:
    """A hash of 32 bits that does not depend on the engine or its version."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def parse_id(text: Column) -> Column:
    """Integer ids from text; anything else is null."""
    return text.try_cast("bigint")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, independent of the session zone."""
    return F.unix_date(F.to_date(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.expr(EPOCH))


def min_max(score: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1]; a list of equal scores becomes all ones."""
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(1.0))


def discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1)


def ideal_dcg(hits: Column) -> Column:
    """Discounted gain of ``hits`` relevant items at the head of a list."""
    return F.when(
        hits > 0,
        F.aggregate(F.sequence(F.lit(1), hits.cast("int")), F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r + 1)),
    ).otherwise(F.lit(0.0))


def page_count(total: Column, page_size: int | Column) -> Column:
    size = F.lit(page_size) if isinstance(page_size, int) else page_size
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint")
