"""Near-duplicate documents by SimHash fingerprints, compared exactly in tiles.

A document's words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, give its 3-word shingles, repeats included (with fewer words, the whole sequence as one). A
bit of the 64-bit fingerprint is set where it is set in more than half of the shingles' XXH64 hashes (seed 42). Documents whose fingerprints
differ in at most three bits are linked; the result names the connected component of each document.

1. One pass over the texts makes the fingerprints; equal ones form one class from there on.
2. The 64 bits are cut into five blocks. Three differing bits leave two blocks alike, so each fingerprint is dealt under the values of each of the ten
   pairs of blocks, and linked ones meet in at least one bucket. A bucket is cut by population count into tiles of at most ``2 * TILE``
   rows; tile pairs are compared by exclusive-or and bit counts, unless their population counts are further apart than the radius, as then no link can
   be among them. A crowded bucket becomes many tile pairs, spread over the tasks.
3. A task reports the links of a tile pair as one star per group that hangs together, never as pairs. A large-star, small-star iteration joins the stars.

Defined cases: null and empty texts, and texts without words, have the fingerprint zero and link like any other; a null id stands for no id, so the
smallest of the others names the component; repeated rows are copies; an empty table gives an empty result; further columns are ignored. Texts are
used whole, and every document and link counts.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tastemill.llm.common import flat_bytes, sliced
from tastemill.llm.links import components
from tastemill.plans.skew import spread
from tastemill.session import checkpointed

WIDTH, SEED, RADIUS = 3, 42, 3
SLICE = 1 << 20
TILE = 2048
#: Rows of a tile that are compared with the other tile at once.
STRIP = 256
#: Lowest bit of each block, and behind the last.
BLOCKS = (0, 13, 26, 39, 52, 64)
#: A fingerprint is hot from this share of all documents on; at most so many can be.
HOT = 1000


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of every shingle of a text, in order."""
    words = text.lower().split()  # of bytes: A-Z, and the white space from tab to carriage return
    joined = b" ".join(words)
    if len(words) < WIDTH:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = list(accumulate(len(w) + 1 for w in words))
    return [xxhash.xxh64_intdigest(joined[start : end - 1], SEED) for start, end in zip([0, *ends], ends[WIDTH - 1 :], strict=False)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest bit first."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return counts


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """The fingerprint of every text of a column."""
    data, offsets = flat_bytes(column)
    whole, out = data.tobytes(), np.zeros((len(column), 64), np.uint8)
    for row, (start, end) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        hashes = shingle_hashes(whole[start:end])
        if hashes:
            out[row] = 2 * majority(np.array(hashes, "<u8")) > len(hashes)
    return np.packbits(out, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f) of every document; a stored table."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches, "text", SLICE):
            prints = fingerprints_of(batch.column("text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "f"])

    return checkpointed(spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, f"doc_id {kind}, f bigint"))


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked places the same label: the smallest place of those that hang together."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def stars(x: np.ndarray, y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what hangs together among two tiles, or within one, by distances of at most ``RADIUS``."""
    nodes = x if y is None else np.concatenate([x, y])
    label = np.arange(len(nodes))
    others, first = (x, 0) if y is None else (y, len(x))
    for start in range(0, len(x), STRIP):
        behind = start if y is None else 0
        near = np.bitwise_count(x[start : start + STRIP, None] ^ others[None, behind:]) <= RADIUS
        i, j = np.nonzero(near)
        merge(label, i + start, j + first + behind)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def tiles(prints: DataFrame, tile: int) -> DataFrame:
    """(c, key, t, lo, hi, n, fs): the tiles of all buckets with two fingerprints or more; ``n`` is the size of the bucket. ``fs`` holds the bits as
    64-bit numbers, ``lo`` and ``hi`` their smallest and largest population count. A stored table."""
    masks = [sum(((1 << (BLOCKS[b + 1] - BLOCKS[b])) - 1) << BLOCKS[b] for b in pair) for pair in combinations(range(len(BLOCKS) - 1), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    places = F.array(*(F.struct(F.lit(c).cast("tinyint").alias("c"), F.col("f").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(signed)))
    dealt = prints.select("f", F.bit_count("f").alias("ones"), F.inline(places))
    # A bucket has at most 65 population counts, so the window is short.
    bucket = Window.partitionBy("c", "key")
    sizes = dealt.groupBy("c", "key", "ones").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.withColumn("n", F.sum("m").over(bucket)).withColumn("before", F.sum("m").over(bucket.orderBy("ones")) - F.col("m"))
    sizes = checkpointed(sizes.where("n > 1"))
    # Population counts of few rows share a tile; one of many rows is dealt over tiles of its own.
    part = F.when(F.col("m") <= tile, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("f"), F.ceil(F.col("m") / tile)))
    placed = dealt.join(sizes, ["c", "key", "ones"]).withColumn("t", F.struct(F.floor(F.col("before") / tile).alias("range"), part.cast("bigint").alias("part")))
    found = placed.groupBy("c", "key", "t", "n").agg(F.min("ones").alias("lo"), F.max("ones").alias("hi"), F.collect_list("f").alias("fs"))
    return checkpointed(found)


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b) links of distinct fingerprints ``f`` that join all that are connected by distances of at most ``RADIUS``."""
    found = tiles(prints, tile)
    alone = found.select("fs", F.lit(None).cast("array<bigint>").alias("gs"))
    crowded = found.where(F.col("n") > tile)
    left, right = (crowded.select(F.col("c"), F.col("key"), *(F.col(x).alias(f"{x}_{s}") for x in ("t", "lo", "hi", "fs"))) for s in "ab")
    near = (F.col("lo_b") - F.col("hi_a") <= RADIUS) & (F.col("lo_a") - F.col("hi_b") <= RADIUS)
    pairs = left.join(right, ["c", "key"]).where((F.col("t_a") < F.col("t_b")) & near).select(F.col("fs_a").alias("fs"), F.col("fs_b").alias("gs"))

    def run(batches):
        for batch in batches:
            (x, x_ends), (y, y_ends) = (flat_numbers(batch.column(k)) for k in range(2))
            lone, sizes = batch.column(1).is_null().to_numpy(zero_copy_only=False), np.diff(x_ends)
            # Most buckets hold two fingerprints; these are compared in one go.
            two = x_ends[:-1][lone & (sizes == 2)]
            two = two[np.bitwise_count(x[two] ^ x[two + 1]) <= RADIUS]
            found = [(x[two], x[two + 1])]
            for k in np.flatnonzero(~lone | (sizes > 2)):
                found.append(stars(x[x_ends[k] : x_ends[k + 1]], None if lone[k] else y[y_ends[k] : y_ends[k + 1]]))
            a, b = (np.concatenate(side).view(np.int64) for side in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return alone.unionByName(pairs).mapInArrow(run, "a bigint, b bigint")


def flat_numbers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a list column as unsigned ones, and the n + 1 offsets of its rows; null is empty."""
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count:
        sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def classify(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    hashed = fingerprints(docs)
    prints = checkpointed(hashed.groupBy("f").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("many")))
    found = components(links(prints.select("f"), tile))
    rooted = prints.join(found, F.col("f") == F.col("node"), "left").select("f", "first_id", "many", F.coalesce("root", "f").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = checkpointed(rooted.join(heads, "root").select("f", "many", "component_id"))
    # A fingerprint of very many documents would be one task of the join; the few that can exist are sent to all tasks.
    total = hashed.count()
    hot = F.broadcast(named.where(F.col("many") * HOT >= total).drop("many"))
    rest = named.where(F.col("many") * HOT < total).drop("many")
    rows = hashed.join(hot, "f").unionByName(hashed.join(hot.select("f"), "f", "left_anti").join(rest, "f"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
