"""Skip-gram vectors with negative sampling, trained in tiles.

Items are dealt over ``p`` blocks by a hash of their id. The pairs of a centre and a context within the window are counted once and lie in p x p tiles
(block of the centre, block of the context). An epoch has p rounds; in each, p tiles that share no block are trained side by side, one
per task, and hand on their two blocks of vectors. A task holds two blocks of at most ``BLOCK`` items and streams the pairs of its tile, so neither the
vocabulary nor the pairs are ever in one place. Every round is a stored table.

A pair at distance d counts (window + 1 - d) / window, which is what a window of random width up to ``window`` gives on average. Negatives are drawn from
the tile's block of contexts by count ** 0.75: blocks are dealt by a hash, so each is a sample of the vocabulary. Steps are AdaGrad steps by row.

Rows without an item are ignored. Items of fewer than ``min_count`` events have no vector; they keep their places in the window. Without any pair the
vectors are the starting ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tastemill.plans.skew import salted_join
from tastemill.session import checkpointed

#: Most items of a block, fewest blocks, pairs per row of the stored pairs, and negatives drawn for each such row.
BLOCK, BLOCKS, CHUNK, NEGATIVES = 32_768, 4, 2048, 64
NOISE = 0.75


def window_pairs(places: DataFrame, window: int) -> DataFrame:
    """(centre, context, n) over ``places(session, pos, item)``: both directions, weighted by distance. Pairs are found by an equi-join on the position,
    so a session may have any length."""
    places = places.where("item IS NOT NULL")
    reached = places.select("session", F.col("item").alias("centre"), "pos", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("d")).withColumn("pos", F.col("pos") + F.col("d"))
    met = reached.join(places.select("session", "pos", F.col("item").alias("context")), ["session", "pos"])
    later = met.groupBy("centre", "context").agg(F.sum(window + 1 - F.col("d")).alias("n"))
    ends = F.array(F.struct("centre", "context"), F.struct(F.col("context").alias("centre"), F.col("centre").alias("context")))
    return later.select(F.inline(ends), "n").groupBy("centre", "context").agg((F.sum("n") / window).alias("n"))


def sentence_pairs(sentences: DataFrame, window: int) -> DataFrame:
    """The same over arrays ``sentence``, without a join."""
    cut = lambda first, d: F.slice("sentence", first, F.greatest(F.size("sentence") - d, F.lit(0)))
    apart = lambda d: F.arrays_zip(cut(F.lit(1), d).alias("a"), cut(F.lit(1 + d), d).alias("b"), F.array_repeat(F.lit(window + 1 - d), F.greatest(F.size("sentence") - d, F.lit(0))).alias("n"))
    steps = [apart(d) for d in range(1, window + 1)]
    later = sentences.where("sentence IS NOT NULL").select(F.inline(F.concat(*steps))).where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n"))
    ends = F.array(F.struct(F.col("a").alias("centre"), F.col("b").alias("context")), F.struct(F.col("b").alias("centre"), F.col("a").alias("context")))
    return later.select(F.inline(ends), "n").groupBy("centre", "context").agg((F.sum("n") / window).alias("n"))


def vocabulary(counts: DataFrame, min_count: int) -> tuple[DataFrame, int]:
    """(item, many, block, slot) of the items that are frequent enough, and the number of blocks; a stored table."""
    counts = checkpointed(counts.where(F.col("item").isNotNull() & (F.col("many") >= min_count)))
    p = max(BLOCKS, -(-counts.count() // (BLOCK // 2)))  # half full on average: the hash does not deal evenly
    dealt = counts.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(p)).cast("int"))
    return checkpointed(dealt.withColumn("slot", F.row_number().over(Window.partitionBy("block").orderBy("item")) - 1)), p


def tiled(pairs: DataFrame, words: DataFrame, p: int) -> DataFrame:
    """(round, tile, c, o, n): the pairs of each tile in rows of about ``CHUNK``, as slots in the blocks of centre and context; stored by round."""
    end = lambda name, block, slot: words.select(F.col("item").alias(name), F.col("block").alias(block), F.col("slot").alias(slot))
    placed = salted_join(pairs, end("centre", "tile", "c"), ["centre"], ["context"])
    placed = salted_join(placed, end("context", "other", "o"), ["context"], ["centre"])
    placed = checkpointed(placed.select("tile", "c", "o", F.col("n").cast("float").alias("n"), F.pmod(F.col("other") - F.col("tile"), F.lit(p)).alias("round")))
    sizes = placed.groupBy("tile", "round").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = placed.join(sizes, ["tile", "round"]).withColumn("chunk", F.pmod(F.xxhash64("c", "o"), F.col("chunks")))
    packed = dealt.groupBy("round", "tile", "chunk").agg(F.sort_array(F.collect_list(F.struct("c", "o", "n"))).alias("s"))
    return checkpointed(packed.select("round", "tile", F.col("s.c").alias("c"), F.col("s.o").alias("o"), F.col("s.n").alias("n")))


def summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indexes and the sums of their rows."""
    order = np.argsort(index, kind="stable")
    start = np.flatnonzero(np.diff(index[order], prepend=-1))
    return index[order][start], np.add.reduceat(rows[order], start)


class Block:
    """Vectors of a block of items and, per row, the mean square of past gradients summed up."""

    def __init__(self, vectors: bytes, past: bytes, dim: int):
        self.vectors = np.frombuffer(vectors, np.float32).reshape(-1, dim).copy()
        self.past = np.frombuffer(past, np.float32).copy()

    def step(self, index: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        at, total = summed(index, gradient)
        self.past[at] += (total * total).mean(axis=1)
        self.vectors[at] += (rate / np.sqrt(self.past[at] + 1e-12))[:, None] * total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_chunk(u: Block, v: Block, c: np.ndarray, o: np.ndarray, n: np.ndarray, noise: np.ndarray, negative: int, rate: float, rng) -> float:
    """One step on the pairs of a chunk and shared negatives; returns the loss before the step."""
    drawn = np.searchsorted(noise, rng.random(NEGATIVES) * noise[-1], side="right")
    a, b, neg = u.vectors[c], v.vectors[o], v.vectors[drawn]
    near, far = sigmoid((a * b).sum(axis=1)), sigmoid(a @ neg.T)
    loss = -(n * np.log(near + 1e-9)).sum() - (n[:, None] * np.log(1 - far + 1e-9)).sum() * negative / NEGATIVES
    up, down = (n * (1 - near))[:, None], n[:, None] * far * np.float32(-negative / NEGATIVES)
    u.step(c, up * b + down @ neg, rate)
    v.step(np.concatenate([o, drawn]), np.concatenate([up * a, down.T @ a]), rate)
    return float(loss)


def trained(rows: DataFrame, dim: int, negative: int, rate: float, seed: int) -> DataFrame:
    """One round. ``rows(tile, kind, block, vectors, past, noise, c, o, n)`` come sorted by tile and kind: block of centres, block of contexts, pairs."""
    fields = "kind int, block int, vectors binary, past binary, loss double, weight double"

    def run(batches):
        tile, held, done, rng = None, {}, [0.0, 0.0], None

        def finished():
            kinds = sorted(held)
            parts = [(k, held[k][0], held[k][1].vectors.tobytes(), held[k][1].past.tobytes(), *(done if k == 0 else (0.0, 0.0))) for k in kinds]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64()), strict=True)], names)

        names = ["kind", "block", "vectors", "past", "loss", "weight"]
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda name: batch.column(batch.schema.get_field_index(name))[row]  # noqa: B023, E731
                if value("tile").as_py() != tile:
                    if held:
                        yield finished()
                    tile, held, done = value("tile").as_py(), {}, [0.0, 0.0]
                    rng = np.random.default_rng([seed, tile])
                kind = value("kind").as_py()
                if kind < 2:
                    held[kind] = value("block").as_py(), Block(value("vectors").as_py(), value("past").as_py(), dim)
                    if kind == 1:
                        noise = np.cumsum(value("noise").values.to_numpy())
                elif 0 in held and 1 in held:
                    c, o, n = (value(x).values.to_numpy() for x in "con")
                    done[0] += train_chunk(held[0][1], held[1][1], c, o, n, noise, negative, rate, rng)
                    done[1] += float(n.sum())
        if held:
            yield finished()

    return checkpointed(rows.mapInArrow(run, fields))


def skipgram(pairs: DataFrame, counts: DataFrame, dim: int, epochs: int, min_count: int = 1, negative: int = 5, rate: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(item, vector) of the items in ``counts(item, many)``, and (epoch, loss, weight) with the mean loss of a pair; ``pairs(centre, context, n)`` are
    weighted. The result depends on the data and the seed alone."""
    words, p = vocabulary(counts, min_count)
    chunks = tiled(pairs, words, p)
    blocks = words.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", "item", "many"))).alias("s"))
    blocks = checkpointed(blocks.select("block", F.col("s.item").alias("items"), F.transform("s.many", lambda m: F.pow(m.cast("double"), NOISE)).alias("noise")))

    def start(batches):
        for batch in batches:
            kinds, ids, vectors, past = [], [], [], []
            for block, size in zip(batch.column("block").to_pylist(), batch.column("size").to_pylist(), strict=True):
                first = (np.random.default_rng([seed, block]).random((size, dim), np.float32) - np.float32(0.5)) / np.float32(dim)
                kinds, ids, past = [*kinds, 0, 1], [*ids, block, block], [*past, *[np.zeros(size, np.float32).tobytes()] * 2]
                vectors += [first.tobytes(), np.zeros((size, dim), np.float32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(ids, pa.int32()), pa.array(vectors, pa.binary()), pa.array(past, pa.binary())], ["kind", "block", "vectors", "past"])

    state = checkpointed(blocks.select("block", F.size("items").alias("size")).mapInArrow(start, "kind int, block int, vectors binary, past binary"))
    none = lambda kind: F.lit(None).cast(kind)
    empty = (none("array<int>").alias("c"), none("array<int>").alias("o"), none("array<float>").alias("n"))
    losses = []
    for epoch in range(epochs):
        for step in range(p):
            tile = F.when(F.col("kind") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - step, F.lit(p)))
            held = state.join(blocks.select("block", "noise"), "block").select(
                tile.alias("tile"), "kind", "block", "vectors", "past", F.when(F.col("kind") == 1, F.col("noise")).alias("noise"), *empty)
            given = chunks.where(F.col("round") == step).select("tile", F.lit(2).alias("kind"), none("int").alias("block"), none("binary").alias("vectors"), none("binary").alias("past"), none("array<double>").alias("noise"), "c", "o", "n")
            rows = held.unionByName(given).repartition(2 * p, "tile").sortWithinPartitions("tile", "kind", F.xxhash64("c", F.lit(epoch)))
            state = trained(rows, dim, negative, rate, seed + 1000 * epoch + step)
            losses.append(state.select(F.lit(epoch + 1).alias("epoch"), "loss", "weight"))

    def unpack(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                items = batch.column("items")[row].values
                flat = np.frombuffer(batch.column("vectors")[row].as_py(), np.float32).astype(np.float64)
                yield pa.RecordBatch.from_arrays([items, pa.ListArray.from_arrays(pa.array(np.arange(len(items) + 1, dtype=np.int32) * dim), pa.array(flat))], ["item", "vector"])

    kind = words.schema["item"].dataType.simpleString()
    vectors = state.where("kind = 0").join(blocks, "block").select("items", "vectors").mapInArrow(unpack, f"item {kind}, vector array<double>")
    if not losses:
        return checkpointed(vectors), state.select(F.lit(0).alias("epoch"), F.lit(0.0).alias("loss"), F.lit(0.0).alias("weight")).limit(0)
    told = losses[0]
    for part in losses[1:]:
        told = told.unionByName(part)
    return checkpointed(vectors), checkpointed(told.groupBy("epoch").agg((F.sum("loss") / F.sum("weight")).alias("loss"), F.sum("weight").alias("weight")))
