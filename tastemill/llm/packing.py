"""Best-fit packing of documents into sequences of several permitted lengths.

A document of more tokens than the largest capacity is cut into full sequences and a rest. Rests are dealt into shards of about ``shard_items``
by a hash of their row number, so that the number of shards grows with the table, and each shard is packed by one task:

* pieces in order of falling length, each into the open bin that leaves the least room (the lowest set bit above the length in a mask of the rooms in use);
* where none fits, a new bin of the size with the least cost per token that can still be put into it: the cost over the smaller of the size and the
  tokens not yet placed. A sequence costs ``overhead + size + size**2 / attention``, so long ones are opened for pieces that need them, and towards
  the end of a shard the smallest that still fits;
* at last every bin shrinks to the smallest permitted size that holds its contents.

Defined cases: a null or empty text, or one without words, has no tokens and returns one row without a bin; repeated rows and null ids are pieces of
their own; ties keep the order of row numbers; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tastemill.llm.common import SPACES
from tastemill.session import checkpointed

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 32
ATTENTION = 16_384
SHARD_ITEMS = 20_000


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """Bin and start of each length (none above the largest capacity), and the final capacity of each bin."""
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left = sum(lengths)
    opened: list[int] = []  # size of each bin when opened
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    rooms = 0  # bit r: some open bin has exactly r left
    bins, starts = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        need = lengths[i]
        above = rooms >> need
        if above:
            r = need + (above & -above).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
        else:
            size = min((s for s in sizes if s >= need), key=lambda s: ((overhead + s + s * s / attention) / max(need, min(s, left)), s))
            b, r = len(room), size
            opened.append(size)
            room.append(size)
        bins[i], starts[i] = b, opened[b] - r
        room[b] = r = r - need
        left -= need
        by_room[r].append(b)
        rooms |= 1 << r
    final = [next(s for s in sizes if s >= opened[b] - room[b]) for b in range(len(room))]
    return bins, starts, final


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, shard_items: int = SHARD_ITEMS, length: str | None = None) -> DataFrame:
    """(doc_id, piece, piece_start, n_tokens, bin_id, bin_start, capacity), one row per piece of a document.

    Tokens are words unless the column ``length`` gives their number.
    """
    largest = max(capacities)
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACES), ""))
    n = F.coalesce(F.greatest(F.col(length), F.lit(0)), F.lit(0)) if length else words
    items = checkpointed(docs.select("doc_id", n.cast("bigint").alias("n")).withColumn("item", F.monotonically_increasing_id()))
    full = F.expr(f"n div {largest}")
    whole = items.where(F.col("n") >= largest).select("doc_id", "item", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * largest).alias("piece_start"), F.lit(largest).cast("bigint").alias("n_tokens"), F.format_string("w%d-%d", "item", "piece").alias("bin_id"), F.lit(0).cast("bigint").alias("bin_start"), F.lit(largest).alias("capacity"))
    rest = items.select("doc_id", "item", full.alias("piece"), (F.col("n") % largest).alias("n_tokens")).withColumn("piece_start", F.col("piece") * largest)
    none = rest.where((F.col("n_tokens") == 0) & (F.col("piece") == 0)).select("doc_id", "piece", "piece_start", "n_tokens", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("bigint").alias("bin_start"), F.lit(0).alias("capacity"))
    rest = rest.where(F.col("n_tokens") > 0)
    shards = max(1, -(-rest.count() // shard_items))
    sizes = tuple(capacities)

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("item", kind="stable")
        bins, starts, final = best_fit(part["n_tokens"].tolist(), sizes, overhead, attention)
        shard = int(part["shard"].iloc[0])
        return pd.DataFrame({
            "key": part["key"].array, "piece": part["piece"].array, "piece_start": part["piece_start"].array, "n_tokens": part["n_tokens"].array,
            "bin_id": [f"s{shard}-{b}" for b in bins], "bin_start": starts, "capacity": [final[b] for b in bins]})

    # Ids travel as text, because pandas has no whole numbers with nulls.
    dealt = rest.withColumn("key", F.col("doc_id").cast("string")).drop("doc_id").withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    fitted = dealt.groupBy("shard").applyInPandas(packed, "key string, piece bigint, piece_start bigint, n_tokens bigint, bin_id string, bin_start bigint, capacity int")
    fitted = fitted.withColumn("doc_id", F.col("key").cast(docs.schema["doc_id"].dataType)).drop("key")
    return whole.unionByName(fitted).unionByName(none)
