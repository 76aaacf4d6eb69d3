"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space between words: space, and the control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not use yet, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def text_key(text: Column) -> Column:
    """128 bits of the text, as one binary value; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sliced(batches, size_of: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose column ``size_of`` holds at most ``limit`` bytes, or one row that alone holds more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = flat_bytes(batch.column(batch.schema.get_field_index(size_of)))[1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and len(column) else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substring of a byte array from prefix sums: sum of R[byte] * B**position, modulo 2**64, with a
    table R of random numbers. Equal substrings have equal hashes wherever they stand."""

    BASE = np.uint64(0x9E3779B97F4A7C15 | 3)

    def __init__(self, fold_case: bool = False):
        self.table = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold_case:
            self.table[65:91] = self.table[97:123]
        self.inverse = np.uint64(pow(int(self.BASE), -1, 2**64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def prepare(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.powers) < n:
            steps = np.full(max(n, 2 * len(self.powers)), self.BASE, np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps)
            steps[1:] = self.inverse
            self.inverses = np.cumprod(steps)
        sums = np.zeros(n, np.uint64)
        np.cumsum(self.table[data] * self.powers[: n - 1], out=sums[1:])
        return sums

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.inverses[start])


SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the row it stands in; words never cross rows."""
    inside = ~SPACE_BYTES[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1
