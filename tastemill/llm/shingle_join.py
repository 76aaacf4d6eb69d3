"""Jaccard join on word shingles with prefix filters under several global token orders.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; with fewer words, the whole sequence as one). Two
sets link when their Jaccard similarity is at least 0.8; the result names the connected component of each document.

1. One pass describes every document: set size and a 64-bit fingerprint of the set (the sum of its scrambled shingle
   hashes). Documents with equal sets form a class, and only classes go on. The same pass counts shingles in two
   tables of a million cells, whatever the size of the corpus; they tell which shingles are frequent.
2. A token order sorts shingles by frequency class (frequent last), then by a hash of its own. Under any such order two sets that
   link share a shingle among the first ``n - ceil(0.8 n) + 1`` of each. The first order's prefixes are dealt by shingle, which gives
   the buckets, with the place that the shingle has in the set; a pair must also meet in the prefixes under the second and third order before its sets are compared.
3. Only components are asked for, so a bucket need not be paired out. In each round the classes of a bucket are tried against one of them (another one each
   round) where both share enough buckets to look promising and are not in one component yet; buckets whose classes are all in one component are done. When
   few pairs are left, or after ``STAR_ROUNDS`` rounds, all pairs of different components are tried that have room for a link behind their first common shingle and whose
   prefixes have it under every order. The orders are intersected on the prefixes alone; texts are fetched for the pairs that are left. No link between components is lost.

Hashes have 64 bits. With N classes two different sets share a fingerprint with a probability below N * N / 2**65.

Defined cases: null and empty texts, and texts without words, have empty sets and link with nothing (their component is their own id); a null id stands
for no id, so the smallest of the others names the component; repeated rows are copies; an empty table gives an empty result; further columns are ignored,
and kept by ``keep_one`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tastemill.llm.common import Rolling, flat_bytes, free_names, mixed, sliced, word_spans
from tastemill.llm.links import components
from tastemill.plans.skew import spread
from tastemill.session import checkpointed

WIDTH = 5
#: Cells of each of the two frequency tables, and of a stored part of them.
CELLS, PART = 1 << 20, 1 << 14
SLICE = 2 << 20
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
STAR_ROUNDS = 8
#: All pairs are tried at once when buckets hold at most so many for each of their rows.
PAIRS_PER_ROW = 8
#: Odd factors of a shingle's words.
FACTORS = mixed(np.arange(1, WIDTH + 1)) | np.uint64(1)


def sets_of(column: pa.Array, roll: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, ordered by both, and the set size of every row."""
    data, offsets = flat_bytes(column)
    start, end, row = word_spans(data, offsets)
    word = roll.hashes(roll.prepare(data), start, end)
    m, count = len(word), np.bincount(row, minlength=len(column))
    at, which = [], []
    if m >= WIDTH:
        whole = np.flatnonzero(row[WIDTH - 1 :] == row[: m - WIDTH + 1])
        at.append(sum(word[whole + j] * FACTORS[j] for j in range(WIDTH)))
        which.append(row[whole])
    few = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(few):
        first, total = np.searchsorted(row, few), few.astype(np.uint64) * np.uint64(0)
        for j in range(WIDTH - 1):
            there = count[few] > j
            total[there] += word[first[there] + j] * FACTORS[j]
        at.append(total + count[few].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        which.append(few)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    row, token = by_row(np.concatenate(which), mixed(np.concatenate(at)))
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    row, token = row[fresh], token[fresh]
    return row, token, np.bincount(row, minlength=len(column))


def by_row(row: np.ndarray, key: np.ndarray, *more: np.ndarray):
    """Sort by row, then key."""
    order = np.argsort(key)
    order = order[np.argsort(row[order], kind="stable")]
    return row[order], key[order], *(x[order] for x in more)


def cells_of(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's cell in either table."""
    return (token & np.uint64(CELLS - 1)).astype(np.int64), ((token >> np.uint64(20)) & np.uint64(CELLS - 1)).astype(np.int64)


def prefixes(row: np.ndarray, token: np.ndarray, size: np.ndarray, ranks: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and place of the prefixes under one order."""
    low, high = cells_of(token)
    rank = np.minimum(ranks[0][low], ranks[1][high]).astype(np.uint64)
    key = (rank << np.uint64(58)) | (mixed(token ^ np.uint64(ORDERS[order])) >> np.uint64(6))
    row, _, token = by_row(row, key, token)
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    keep = place <= size[row] // 5
    return row[keep], token[keep], place[keep]


def fingerprint(row: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """Order-free fingerprint of each row's set."""
    sums = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(mixed(token ^ np.uint64(0x452821E638D01377)), out=sums[1:])
    ends = np.searchsorted(row, np.arange(n + 1))
    return mixed(sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, node) per document, and (part, seen) per task and part of the frequency tables."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "h", "n", "node", "part", "seen"]

    def run(batches):
        roll, seen, kind = Rolling(fold_case=True), np.zeros((2, CELLS), np.uint32), None
        for batch in sliced(batches, "text", SLICE):
            row, token, size = sets_of(batch.column("text"), roll)
            for table, cell in zip(seen, cells_of(token), strict=True):
                np.add.at(table, cell, np.uint32(1))
            kind, many = batch.column("doc_id").type, batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(size.astype(np.int64)), pa.array(fingerprint(row, token, many)), pa.nulls(many, pa.int32()), pa.nulls(many, pa.binary())], names)
        if kind is not None:
            parts = seen.reshape(-1, PART)
            held = np.flatnonzero(parts.any(axis=1))
            none = pa.nulls(len(held), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(held), kind), none, none, none, pa.array(held.astype(np.int32)), pa.array([parts[k].tobytes() for k in held], pa.binary())], names)

    source = spread(docs.select("doc_id", "text"), "doc_id").withColumn("h", F.xxhash64("text"))
    return checkpointed(source.mapInArrow(run, f"doc_id {id_type}, h bigint, n bigint, node bigint, part int, seen binary"))


def frequency_ranks(described: DataFrame) -> np.ndarray:
    """For each cell of the two tables a class of how far its count exceeds the mean: 0 up to twice the deviation that chance gives, then two classes for each
    doubling. The tables have a fixed size."""
    mean = max((described.agg(F.sum("n")).first()[0] or 0) / CELLS, 1)

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(x, np.uint32).astype(np.float64) for x in part["seen"])
        excess = np.maximum((counts - mean) / (2 * mean**0.5), 0.5)
        ranks = np.clip(1 + np.floor(2 * np.log2(excess)), 0, 63).astype(np.int8)
        return pd.DataFrame({"part": [part["part"].iloc[0]], "ranks": [ranks.tobytes()]})

    ranks = np.zeros((2 * CELLS // PART, PART), np.int8)
    for part, row in described.where("part IS NOT NULL").select("part", "seen").groupBy("part").applyInPandas(summed, "part int, ranks binary").toLocalIterator():
        ranks[part] = np.frombuffer(row, np.int8)
    return ranks.reshape(2, CELLS)


def first_prefixes(docs: DataFrame, ranks: Broadcast) -> DataFrame:
    """(token, node, n, place): prefixes under the first order, each set once per slice of a task's input."""

    def run(batches):
        roll = Rolling(fold_case=True)
        for batch in sliced(batches, "text", SLICE):
            row, token, size = sets_of(batch.column("text"), roll)
            node = fingerprint(row, token, batch.num_rows)
            once = np.zeros(len(node), bool)
            once[np.unique(node, return_index=True)[1]] = True
            row, token, place = prefixes(row, token, size, ranks.value, 0)
            keep = once[row]
            row, token, place = row[keep], token[keep], place[keep]
            columns = [token.view(np.int64), node[row], size[row].astype(np.int32), place.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "n", "place"])

    return spread(docs.select("doc_id", "text"), "doc_id").select("text").mapInArrow(run, "token bigint, node bigint, n int, place int")


def order_prefixes(texts: DataFrame, ranks: Broadcast) -> DataFrame:
    """(node, n, p0, p1, ...): each class's prefix under every order."""
    names = [f"p{order}" for order in range(len(ORDERS))]

    def run(batches):
        roll = Rolling(fold_case=True)
        for batch in sliced(batches, "text", SLICE):
            row, token, size = sets_of(batch.column("text"), roll)
            lists = []
            for order in range(len(ORDERS)):
                at, value, _ = prefixes(row, token, size, ranks.value, order)
                ends = np.searchsorted(at, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(size.astype(np.int32)), *lists], ["node", "n", *names])

    return texts.select("node", "text").mapInArrow(run, f"node bigint, n int, {', '.join(f'{name} array<bigint>' for name in names)}")


def texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The classes that are an end of a pair. Their numbers are stored, so that the optimizer sees whether they are few and the other texts need not travel."""
    ends = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct())
    return texts.join(ends, F.col("node") == F.col("of"), "left_semi")


def through_orders(pairs: DataFrame, texts: DataFrame, ranks: Broadcast) -> DataFrame:
    """The (a, b) pairs whose prefixes leave room for a link under every order. Only prefixes travel here, no texts."""
    held = order_prefixes(texts_of(pairs, texts), ranks)
    side = lambda s: held.select(*(F.col(c).alias(f"{c}_{s}") for c in held.columns))
    met = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
    for order in range(len(ORDERS)):
        met = met.withColumn("k", F.size(F.array_intersect(f"p{order}_a", f"p{order}_b"))).where((F.col("k") > 0) & enough("k", "n_a", "n_b"))
    return met.select("a", "b")


def similar(pairs: DataFrame, ranks: Broadcast) -> DataFrame:
    """The (a, b) pairs that pass the other orders' filters and whose sets then prove similar enough."""

    def common(x, y, n: int) -> np.ndarray:
        """Shingles that both sides of each row hold."""
        row, token = by_row(np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]))
        return np.bincount(row[1:][(row[1:] == row[:-1]) & (token[1:] == token[:-1])], minlength=n)

    def run(batches):
        roll = Rolling(fold_case=True)
        for half in sliced(batches, "text_a", SLICE // 2):
            for batch in sliced([half], "text_b", SLICE // 2):
                n = batch.num_rows
                left, right = (sets_of(batch.column(c), roll) for c in ("text_a", "text_b"))
                passed = np.ones(n, bool)
                for order in range(1, len(ORDERS)):
                    sides = []
                    for row, token, size in (left, right):
                        keep = passed[row]
                        sides.append(prefixes(row[keep], token[keep], np.where(passed, size, 0), ranks.value, order)[:2])
                    passed &= common(*sides, n) > 0
                x, y = ((row[passed[row]], token[passed[row]]) for row, token, _ in (left, right))
                both = common(x, y, n)
                linked = passed & (100 * both >= 80 * (left[2] + right[2] - both))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(linked)), batch.column("b").filter(pa.array(linked))], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def close_in_size(n: str, m: str):
    return (F.col(n) * 5 >= F.col(m) * 4) & (F.col(m) * 5 >= F.col(n) * 4)


def enough(k: str, n: str, m: str):
    """Whether ``k`` shared shingles in the prefixes leave room for a link. Of two prefixes take the one whose last shingle comes first: what the sets share
    beyond ``k`` stands behind it, in the rest of its set, so ``k`` and the longer of both rests must reach the overlap that a link needs."""
    rest = lambda x: F.expr(f"{x} - {x} div 5 - 1")
    return F.col(k) + F.greatest(rest(n), rest(m)) >= F.expr(f"(4 * ({n} + {m}) + 8) div 9")


def first_contacts(rows: DataFrame) -> DataFrame:
    """(a, b) of the classes of different components that can be linked by what stands before their first common shingle.

    A link needs ``need`` common shingles, and all of them stand at or behind the first one, in either set. The smaller set of a linked pair holds the first one among
    its first ninth, so that only those rows look for partners; copies that differ from all others by more shingles of their own than that do not meet at all.
    """
    x, y = (rows.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "place", "root"))) for s in "ab")
    x = x.where("(n_a - place_a) * 9 >= 8 * n_a")
    smaller = F.expr("n_a < n_b OR (n_a = n_b AND node_a < node_b)")
    room = F.expr("least(n_a - place_a, n_b - place_b) * 9 >= 4 * (n_a + n_b)")
    met = x.join(y, (x.token == y.token) & (F.col("root_a") != F.col("root_b")) & smaller & room)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def hooked(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after each root went over to the smallest root it has a link with. Equal roots mean one component; the reverse is settled at the end."""
    end = lambda side: labels.select(F.col("node").alias(f"of_{side}"), F.col("root").alias(f"root_{side}"))
    met = links.join(end("a"), F.col("a") == F.col("of_a")).join(end("b"), F.col("b") == F.col("of_b")).where("root_a <> root_b")
    moved = met.groupBy(F.greatest("root_a", "root_b").alias("old")).agg(F.min(F.least("root_a", "root_b")).alias("new"))
    return checkpointed(labels.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")))


def linked_sets(docs: DataFrame, described: DataFrame) -> DataFrame:
    """(node, root) of the classes that have links to others."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(frequency_ranks(described))
    dealt = first_prefixes(docs, ranks).repartition("token").dropDuplicates(["token", "node"])
    # The largest set and place are asked for so that both readers of the exchange want the same columns, and it is made once.
    shared = dealt.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.max("n").alias("largest"), F.max("place").alias("deepest")).where("many > 1 AND largest > 0 AND deepest >= 0").select(F.col("token").alias("t"))
    rows = checkpointed(dealt.join(shared, F.col("token") == F.col("t"), "left_semi"))
    # How few of a prefix's shingles stand in no other set: near copies differ from what they were made of by shingles of their own, so sets
    # without such make the best partners for the others.
    common = rows.groupBy(F.col("node").alias("of")).agg((F.count(F.lit(1)) * 1000 / (F.first("n") / 5 + 1)).cast("int").alias("common"))
    rows = checkpointed(rows.join(common, F.col("node") == F.col("of")).drop("of"))

    # One text of each class that meets another one.
    chosen = described.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("r")).join(rows.select("node").distinct(), "node").select("node", F.col("r.doc_id").alias("of_id"), F.col("r.h").alias("of_h"))
    body = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    texts = body.join(chosen, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h"))).select("node", "text")
    texts = checkpointed(texts)

    labels = before = None
    links = spark.createDataFrame([], "a bigint, b bigint")
    for step in range(STAR_ROUNDS + 1):
        current = rows.withColumn("root", F.col("node")) if labels is None else rows.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).drop("of")
        order = [(-F.col("common")).alias("c")] if step % 2 == 0 else []
        hub = F.min(F.struct(*order, F.xxhash64("node", F.lit(step)).alias("o"), "node", "n", "root")).alias("hub")
        groups = current.groupBy(F.col("token").alias("t"), "root").agg(F.count(F.lit(1)).alias("c"), hub)
        buckets = groups.groupBy("t").agg(F.count(F.lit(1)).alias("roots"), F.min("hub").alias("hub"), F.sum("c").alias("many"), F.expr("(sum(c) * sum(c) - sum(c * c)) / 2").alias("pairs")).where("roots > 1")
        current = checkpointed(current.join(buckets.select("t", "hub", F.expr("pairs / many").alias("load")), F.col("token") == F.col("t")).drop("t"))
        size, pairs = current.agg(F.count(F.lit(1)), F.sum("load")).first()
        if not size:
            break
        # Further rounds pay while there are many pairs and the round before has settled a fifth of its own.
        last = step == STAR_ROUNDS or pairs <= PAIRS_PER_ROW * size or (before is not None and pairs > 0.8 * before)
        before = pairs
        if last:
            tried = through_orders(checkpointed(first_contacts(current)), texts, ranks)
        else:
            met = current.where((F.col("root") != F.col("hub.root")) & close_in_size("n", "hub.n"))
            met = met.groupBy(F.least("node", F.col("hub.node")).alias("a"), F.greatest("node", F.col("hub.node")).alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
            tried = met.where("k * 20 >= n")  # only where it looks promising: what is passed over here is met in the last round
        tried = checkpointed(tried.select("a", "b"))
        held = texts_of(tried, texts)
        side = lambda s: held.select(F.col("node").alias(f"of_{s}"), F.col("text").alias(f"text_{s}"))
        joined = tried.join(side("a"), F.col("a") == F.col("of_a")).join(side("b"), F.col("b") == F.col("of_b"))
        links = checkpointed(links.unionByName(similar(joined, ranks)))
        if last:
            break
        labels = hooked(rows.select("node").distinct().withColumn("root", F.col("node")) if labels is None else labels, links)
        rows = current.select("token", "node", "n", "place", "common")
    return components(links)


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, component_id and, where the set is not empty, the component's root class."""
    described = describe(docs)
    found = linked_sets(docs, described)
    classes = described.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id")).join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    classes = checkpointed(classes)
    heads = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(heads, "root").select(F.col("node").alias("of"), "root", "component_id")
    rows = described.where("part IS NULL").join(named, (F.col("n") > 0) & (F.col("node") == F.col("of")), "left")
    return rows.select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with an empty set, and of every component the one with the smallest id; all columns are kept."""
    rows = checkpointed(classify(docs))
    counted = rows.where("n_shingles > 0").groupBy("root", "doc_id", "h").agg(F.count(F.lit(1)).alias("many"))
    best = checkpointed(counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h", "many")).alias("r")).select("r.doc_id", "r.h", "r.many"))
    h, of_id, of_h = free_names(docs, "h", "of_id", "of_h")
    c = lambda name: F.col(f"`{name}`")
    empty = rows.where("n_shingles = 0").select("doc_id", "h").distinct()
    wanted = best.select("doc_id", "h").unionByName(empty).select(F.col("doc_id").alias(of_id), F.col("h").alias(of_h))
    kept = docs.withColumn(h, F.xxhash64("text")).join(wanted, c("doc_id").eqNullSafe(c(of_id)) & (c(h) == c(of_h)), "left_semi")
    twice = best.where("many > 1")
    if not twice.isEmpty():
        # Rows that repeat both id and text: one of them stays.
        again = twice.select(F.col("doc_id").alias(of_id), F.col("h").alias(of_h))
        same = c("doc_id").eqNullSafe(c(of_id)) & (c(h) == c(of_h))
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", h]))
    return kept.select(*(c(name) for name in docs.columns))
