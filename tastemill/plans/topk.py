"""Top-k plans: per group, against blocks of vectors, and unseen heads of a shared ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tastemill.plans.ordered import chunk_scan, dense_index
from tastemill.plans.skew import salted_join
from tastemill.session import checkpointed

METRICS = ("inner_product", "cosine", "l2")
BROADCAST_RANKS = 100_000
PIECE = 4_000_000  # products formed at a time in a block
BLOCK_NUMBERS = 1 << 23  # numbers of the vectors of a block: 64 MB as doubles; half of that in a cell
BLOCK_PAIRS, CELL_BLOCK_PAIRS, ITEM_BLOCKS = 48, 4, 6  # pairs of blocks worth making of fewer rows, in all or in every cell of an index
LEAST_QUERIES, LEAST_ITEMS = 1024, 8192  # a block is not made smaller for that
TILE_QUERIES, TILE_ITEMS = 256, 8192  # scores formed at a time in a task
GROUP, NEAR_QUERIES, FROM_ITEMS = 1024, 512, 4096  # items of a group, queries that look at one together, items from which on they are grouped


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. For k up to 1000 the optimizer cuts each group before the shuffle as well."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered.where(F.col(rank) <= k)


# ---------------------------------------------------------------------------------------------------------------------
# vectors against vectors


def _matrix(rows: pa.Table, side: str) -> np.ndarray:
    """The vectors of one side as doubles, from ``<side>_short`` where that holds them and ``<side>_vector`` elsewhere."""
    wide = rows[f"{side}_vector"]
    short = rows[f"{side}_short"] if f"{side}_short" in rows.column_names else pa.chunked_array([pa.nulls(rows.num_rows, pa.list_(pa.float32()))])

    def flat(column: pa.ChunkedArray, n: int) -> np.ndarray:
        numbers = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
        return numbers.astype(np.float64, copy=False).reshape(n, -1)

    if not short.null_count or short.null_count == len(short):
        return flat(wide if short.null_count else short, rows.num_rows)
    there = short.is_valid().to_numpy()
    left, right = flat(short.drop_null(), int(there.sum())), flat(wide.filter(pc.invert(short.is_valid())), int((~there).sum()))
    out = np.empty((rows.num_rows, left.shape[1]))
    out[there], out[~there] = left, right
    return out


def _sent(side: str) -> list[Column]:
    """The vector of a row for its way to the blocks: as floats if these are the same numbers, which halves it, else as doubles."""
    vector = F.col(f"{side}_vector")
    same = F.coalesce(F.forall(vector, lambda x: x.cast("float").cast("double").eqNullSafe(x.cast("double"))), F.lit(False))
    return [F.when(same, vector.cast("array<float>")).alias(f"{side}_short"), F.when(~same, vector).alias(f"{side}_vector")]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return _unit(q) @ _unit(v).T
    if metric == "l2":
        gap = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2.0 * (q @ v.T)
        return -np.maximum(gap, 0.0)
    return q @ v.T


def _best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k best scores per row, equal scores in column order."""
    n = scores.shape[1]
    if k >= n:
        return np.argsort(-scores, axis=1, kind="stable")
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    floor = np.take_along_axis(scores, best, 1).min(axis=1)
    for row in np.flatnonzero((scores >= floor[:, None]).sum(axis=1) > k):
        best[row] = np.argsort(-scores[row], kind="stable")[:k]
    return best


def _masked(queries: pa.Table, seen: pa.Table, ids: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(query row, item column) of the pairs that are left out, in row order; an id may stand in several rows."""
    rows = pd.DataFrame({"query": queries["query_id"].drop_null().to_pandas(), "row": np.flatnonzero(queries["query_id"].is_valid().to_numpy())})
    pairs = pd.DataFrame({"query": seen["query_id"].to_pandas(), "item": seen["seen_item"].to_pandas()})
    pairs = pairs.merge(pd.DataFrame({"item": ids, "col": np.arange(len(ids))}), on="item").merge(rows, on="query").sort_values("row")
    return pairs["row"].to_numpy(), pairs["col"].to_numpy()


def _merged(best: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each row of both, each given as row, column and score; equal scores in column order."""
    row, col, score = (np.concatenate(x) for x in zip(best, more))
    order = np.lexsort((col, -score, row))
    row = row[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    order = order[first]
    return row[first], col[order], score[order]


def _tiled_best(left: np.ndarray, right: np.ndarray, k: int, metric: str, hidden: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, ...]:
    """Row, column and score of the k best columns of each row. Scores are formed tile by tile; of a tile only those above the k-th best score so far are looked at."""
    found = []
    for top in range(0, len(left), TILE_QUERIES):
        q = left[top : top + TILE_QUERIES]
        if hidden is not None:
            rows, cols = (x[slice(*np.searchsorted(hidden[0], (top, top + len(q))))] for x in hidden)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        floor = np.full(len(q), -np.inf)
        for start in range(0, len(right), TILE_ITEMS):
            v = right[start : start + TILE_ITEMS]
            scores = _scores(q, v, "l2" if metric == "l2" else "inner_product")
            if hidden is not None:
                here = (cols >= start) & (cols < start + len(v))
                scores[rows[here] - top, cols[here] - start] = -np.inf
            if start:
                row, col = _where(scores > floor[:, None])
            else:
                picked = _best_columns(scores, k)
                row, col = np.repeat(np.arange(len(q)), picked.shape[1]), picked.ravel()
            values = scores[row, col]
            able = values > -np.inf
            if not able.any():
                continue
            best = _merged(best, (row[able], col[able] + start, values[able]), k)
            full = np.bincount(best[0], minlength=len(q)) == k
            last = np.searchsorted(best[0], np.arange(len(q)), side="right") - 1
            floor[full] = best[2][last[full]]
        found.append((best[0] + top, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _where(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the marks of a matrix, in row order; much faster than numpy's for few of them."""
    return np.divmod(np.flatnonzero(marks.ravel()), marks.shape[1])


class _Groups:
    """Items in groups of like direction and length, each with bounds for the products of its vectors."""

    def __init__(self, items: np.ndarray, norms: np.ndarray):
        self.unit = (items / np.maximum(norms, np.finfo(float).tiny)[:, None]).astype(np.float32)
        n = max(1, min(256, len(items) // (2 * GROUP)))
        some = self.unit[:: max(1, len(items) // (64 * n))]
        self.centres = some[:: max(1, len(some) // n)][:n].copy()
        for _ in range(3):
            nearest = (some @ self.centres.T).argmax(1)
            for j in range(len(self.centres)):
                mean = some[nearest == j].sum(0)
                length = np.linalg.norm(mean)
                if length > 0:
                    self.centres[j] = mean / length
        nearest = self.nearest(self.unit)
        order = np.lexsort((np.arange(len(items)), -norms, nearest))
        cuts = np.flatnonzero(np.diff(nearest[order])) + 1
        self.members = [np.sort(part[at : at + GROUP]) for part in np.split(order, cuts) for at in range(0, len(part), GROUP)]
        self.long = np.array([norms[m].max() for m in self.members])
        self.short = np.array([norms[m].min() for m in self.members])
        middle = np.array([self.unit[m].mean(0, dtype=np.float64) for m in self.members])
        self.axis = middle / np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), np.finfo(float).tiny)
        # a vector without length has no direction: it may lie anywhere
        cos = np.array([(self.unit[m] @ a).min() if norms[m].min() > 0 else -1.0 for m, a in zip(self.members, self.axis, strict=True)])
        self.cos = np.clip(cos - 1e-5, -1.0, 1.0)
        self.sin = np.sqrt(1.0 - self.cos**2)
        self.centre = np.array([items[m].mean(0) for m in self.members])
        self.radius = np.array([np.linalg.norm(items[m] - c, axis=1).max() for m, c in zip(self.members, self.centre, strict=True)])

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        return np.concatenate([(unit[at : at + 8192] @ self.centres.T).argmax(1) for at in range(0, len(unit), 8192)])

    def most(self, unit: np.ndarray) -> np.ndarray:
        """No product of a query of length one with a vector of a group is larger: from the cone of directions and from the ball around the centre."""
        near = np.clip(unit @ self.axis.T + 1e-9, -1.0, 1.0)
        cone = np.where(near >= self.cos, 1.0, near * self.cos + np.sqrt(1.0 - near**2) * self.sin) + 1e-7
        cone = cone * np.where(cone > 0, self.long, self.short)
        return np.minimum(cone, unit @ self.centre.T + self.radius + 1e-9 * self.long)


def _grouped_best(left: np.ndarray, right: np.ndarray, k: int, hidden: tuple[np.ndarray, np.ndarray] | None, norms: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The same for inner products, of groups of items that a bound does not rule out for a query. Products are formed as floats first; those that may
    reach the k-th best score so far, by the bound of their rounding, are formed again as doubles."""
    sizes, lengths = norms
    groups = _Groups(right, lengths)
    unit = left / sizes[:, None]
    short = unit.astype(np.float32)
    slack = (left.shape[1] + 8) * 2.0**-22
    scaled = [(right[m] / (top or 1.0)).astype(np.float32) for m, top in zip(groups.members, groups.long, strict=True)]
    group_of = np.empty(len(right), np.int64)
    for j, m in enumerate(groups.members):
        group_of[m] = j
    masked = np.sort(hidden[0] * len(right) + hidden[1]) if hidden is not None else np.empty(0, np.int64)

    def exact(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", left[row], right[col])

    def shown(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        if not len(masked):
            return np.ones(len(row), bool)
        key = row * len(right) + col
        return masked[np.minimum(np.searchsorted(masked, key), len(masked) - 1)] != key

    order = np.argsort(groups.nearest(short), kind="stable")
    found = []
    for at in range(0, len(order), NEAR_QUERIES):
        rows = order[at : at + NEAR_QUERIES]
        most = groups.most(unit[rows])
        scores, cols = np.full((len(rows), k), -np.inf), np.full((len(rows), k), len(right))
        for j in np.argsort(-most.mean(0), kind="stable").tolist():
            # equal scores count: the smaller column comes first
            floor = scores[:, -1] / sizes[rows]
            open_ = np.flatnonzero(most[:, j] >= floor - slack * groups.long[j])
            if not len(open_):
                continue
            top, members = groups.long[j] or 1.0, groups.members[j]
            near = short[rows[open_]] @ scaled[j].T
            picked, col = _where(near >= (floor[open_] / top - slack).astype(np.float32)[:, None])
            if len(picked) > near.size // 8:
                # much of the group: the k best of it as doubles, without the pairs that are left out
                whole = left[rows[open_]] @ right[members].T
                mine = np.flatnonzero(np.isin(hidden[0], rows[open_]) & (group_of[hidden[1]] == j)) if hidden is not None else []
                if len(mine):
                    place = np.full(len(left), -1)
                    place[rows[open_]] = np.arange(len(open_))
                    whole[place[hidden[0][mine]], np.searchsorted(members, hidden[1][mine])] = -np.inf
                # a little more than the k best, so that the scores formed pair by pair decide
                least = np.partition(whole, max(0, whole.shape[1] - k), axis=1)[:, max(0, whole.shape[1] - k)]
                near_least = np.where(np.isfinite(least), least - slack * np.abs(sizes[rows[open_]]) * top, -np.inf)
                picked, col = _where(whole >= near_least[:, None])
            if not len(picked):
                continue
            picked, col = open_[picked], members[col]
            keep = shown(rows[picked], col)
            picked, col = picked[keep], col[keep]
            value = exact(rows[picked], col)
            better = (value > scores[picked, -1]) | ((value == scores[picked, -1]) & (col < cols[picked, -1]))
            picked, col, value = picked[better], col[better], value[better]
            if not len(picked):
                continue
            touched, again = np.unique(picked, return_inverse=True)
            who = np.concatenate([np.repeat(np.arange(len(touched)), k), again])
            all_cols, all_scores = np.concatenate([cols[touched].ravel(), col]), np.concatenate([scores[touched].ravel(), value])
            rank = np.lexsort((all_cols, -all_scores, who))
            who = who[rank]
            first = rank[np.arange(len(who)) - np.searchsorted(who, who) < k]
            cols[touched], scores[touched] = all_cols[first].reshape(-1, k), all_scores[first].reshape(-1, k)
        row, place = np.nonzero(cols < len(right))
        found.append((rows[row], cols[row, place], scores[row, place]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _best_of_block(left: np.ndarray, right: np.ndarray, k: int, metric: str, hidden: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, ...]:
    """Row, column and score of the k best columns of each row, equal scores in column order, without the ``hidden`` (row, column) pairs in row order."""
    if metric == "l2" or len(right) < FROM_ITEMS:
        return _tiled_best(left, right, k, metric, hidden)
    with np.errstate(over="ignore", invalid="ignore"):
        sizes, lengths = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    # bounds need lengths that are numbers and do not vanish by rounding; a query without length has the same score with every item
    usual = np.isfinite(sizes) & (sizes > 1e-100)
    if not usual.any() or not np.isfinite(lengths).all() or not 1e-100 < lengths.max() < 1e100 or sizes[usual].max() > 1e100:
        return _tiled_best(left, right, k, metric, hidden)
    parts = []
    for chosen, best in ((usual, lambda q, h: _grouped_best(q, right, k, h, (sizes[usual], lengths))), (~usual, lambda q, h: _tiled_best(q, right, k, metric, h))):
        names = np.flatnonzero(chosen)
        if len(names):
            held = None
            if hidden is not None:
                mine = chosen[hidden[0]]
                held = (np.searchsorted(names, hidden[0][mine]), hidden[1][mine])
            row, col, score = best(left[names], held)
            parts.append((names[row], col, score))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _block_search(k: int, metric: str, out_schema: pa.Schema):
    def search(queries: pa.Table, items: pa.Table) -> pa.Table:
        if "seen_item" in queries.column_names:
            marks = queries["seen_item"].is_valid()
            seen, queries = queries.filter(marks), queries.filter(pc.invert(marks))
        else:
            seen = None
        if queries.num_rows == 0 or items.num_rows == 0:
            return out_schema.empty_table()
        items = items.sort_by("item_id")
        left, right = _matrix(queries, "query"), _matrix(items, "item")
        if metric == "cosine":
            left, right = _unit(left), _unit(right)
        hidden = _masked(queries, seen, items["item_id"].to_pandas()) if seen is not None and seen.num_rows else None
        rows, cols, values = _best_of_block(left, right, k, metric, hidden)
        keep = np.isfinite(values)
        rows, cols, values = rows[keep], cols[keep], values[keep]
        return pa.table(
            [queries["query_id"].combine_chunks().take(pa.array(rows)), items["item_id"].combine_chunks().take(pa.array(cols)), pa.array(values)],
            schema=out_schema,
        )

    return search


def blocked_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    metric: str = "inner_product",
    seen: DataFrame | None = None,
    query_block: int | None = None,
    item_block: int | None = None,
) -> DataFrame:
    """The k best items per query vector, exact within the cells a query is matched with.

    ``queries(query_id, query_vector[, cell])``, ``items(item_id, item_vector[, cell])``, ``seen(query_id, item_id)``
    pairs never returned. Both sides of a cell are cut into sub-blocks of bounded size, so a hot cell becomes more tasks
    and not a larger one; each task multiplies one query block by one item block and returns k rows per query. No pair
    table is ever produced. ``seen`` reaches the task that scores the block, so no over-fetching is needed.
    Every vector is sent once per block of the other side, as floats where they are the same numbers; so blocks hold as many rows as ``BLOCK_NUMBERS`` allows, and
    fewer only where there would be less than ``BLOCK_PAIRS`` pairs of blocks.
    Returns ``query_id, item_id, score, rank``; for ``l2`` the score is the negative squared distance.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; one of {', '.join(METRICS)}")
    celled = "cell" in items.columns
    if not celled:
        queries, items = queries.withColumn("cell", F.lit(0)), items.withColumn("cell", F.lit(0))
    # one row per cell: bounded by the number of cells of the index
    width = F.greatest(F.lit(1), F.coalesce(F.max(F.size("item_vector")), F.lit(1)))
    item_sizes = items.groupBy("cell").agg(F.count("*").alias("_items"), F.floor(F.lit(BLOCK_NUMBERS // 2 if celled else BLOCK_NUMBERS) / width).alias("_rows"))
    sizes = item_sizes.join(queries.groupBy("cell").agg(F.count("*").alias("_queries")), "cell")

    def count(rows: str, fixed: int | None, least: int, wanted: Column) -> Column:
        few = F.greatest(F.ceil(F.col(rows) / F.col("_rows")), F.least(F.ceil(F.col(rows) / least), F.ceil(wanted)))
        return (F.ceil(F.col(rows) / fixed) if fixed else few).cast("int")

    sizes = sizes.withColumn("item_blocks", count("_items", item_block, LEAST_ITEMS, F.lit(1 if celled else ITEM_BLOCKS)))
    wanted = F.lit(CELL_BLOCK_PAIRS if celled else BLOCK_PAIRS) / F.col("item_blocks")
    sizes = F.broadcast(sizes.select("cell", "item_blocks", count("_queries", query_block, LEAST_QUERIES, wanted).alias("query_blocks")))

    def block_of(column: str, count: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(count)).cast("int")

    def all_blocks(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    keys = ["cell", "query_part", "item_part"]
    placed = items.join(sizes, "cell").withColumn("item_part", block_of("item_id", "item_blocks"))
    asked = queries.join(sizes, "cell").withColumn("query_part", block_of("query_id", "query_blocks"))
    left = asked.select("cell", "query_part", "item_blocks", "query_id", *_sent("query")).withColumn("item_part", all_blocks("item_blocks")).drop("item_blocks")
    right = placed.select("cell", "item_part", "query_blocks", "item_id", *_sent("item")).withColumn("query_part", all_blocks("query_blocks")).drop("query_blocks")
    if seen is not None:
        # a pair concerns one block of queries and one of items; it travels as a row of its own, next to the queries
        pairs = seen.select("query_id", "item_id").where(F.col("query_id").isNotNull() & F.col("item_id").isNotNull())
        if celled:
            pairs = pairs.join(placed.select("item_id", "cell", "item_part", "query_blocks"), "item_id")
        else:
            pairs = pairs.withColumn("cell", F.lit(0)).join(sizes, "cell").withColumn("item_part", block_of("item_id", "item_blocks"))
        pairs = pairs.withColumn("query_part", block_of("query_id", "query_blocks"))
        empty = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in ("query_short", "query_vector")]
        marks = pairs.select(*keys, "query_id", *empty, F.col("item_id").alias("seen_item"))
        left = left.withColumn("seen_item", F.lit(None).cast(seen.schema["item_id"].dataType)).unionByName(marks)

    out = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("item_id", items.schema["item_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_search(k, metric, to_arrow_schema(out)), out)
    return top_k(partial, ["query_id"], [F.desc("score"), F.asc("item_id")], k)


# ---------------------------------------------------------------------------------------------------------------------
# unseen head of one ranking shared by all users


def rank_items(scored: DataFrame, score: str = "score", item: str = "item_id") -> DataFrame:
    """Number the items 1..n by descending score, equal scores by id."""
    return dense_index(scored, [F.desc(score), F.asc(item)], "item_rank", start=1)


def rank_lists(scored: DataFrame, score: str = "score", item: str = "item_id") -> DataFrame:
    """Number the items of every ``list_id`` 1..n by descending score, by one range-partitioned sort over all lists."""
    numbered = dense_index(scored, [F.asc("list_id"), F.desc(score), F.asc(item)], "_n")
    firsts = numbered.groupBy("list_id").agg(F.min("_n").alias("_first"))
    return numbered.join(firsts, "list_id").withColumn("item_rank", F.col("_n") - F.col("_first") + 1).drop("_n", "_first")


def unseen_heads(users: DataFrame, seen: DataFrame, ranking: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """For every user the first k items of a ranking the user has not seen, without pairing users with items.

    Between two neighbouring seen ranks of a user lies a run of unseen ranks. The j-th seen rank r has r - j unseen ranks
    before it, so the runs that reach the first k unseen items are known from the seen ranks alone; the rows emitted are
    the answer itself. A user who has seen much is cut into blocks of ranks.

    ``users(user_id[, list_id])``, ``seen(user_id, item_id)`` with one row per pair, ``ranking([list_id,] item_id,
    item_rank, ...)``: one ranking for all, or one ranking per list with each user reading one list. Returns the
    ranking's columns with ``user_id`` and ``rank``.
    """
    listed = "list_id" in ranking.columns
    key = ["list_id"] if listed else []
    users = users.select("user_id", *key).distinct()
    # Rankings of many lists compress so well that their files look small enough to send to all tasks.
    ranking = ranking.hint("merge") if listed else ranking
    places = ranking.select(*key, "item_id", "item_rank")
    pairs = seen.select("user_id", "item_id")
    marked = pairs.join(users, "user_id").join(places, ["list_id", "item_id"]) if listed else pairs.join(places, "item_id").join(users, "user_id")
    # written once: both uses below would join all pairs, which takes two shuffles, on their own
    marked = checkpointed(marked.select("user_id", *key, "item_rank"))
    sizes = marked.groupBy("user_id").agg(F.count("*").alias("_h"))
    # rank r of a user with h seen items has at least r - h unseen ranks before it
    relevant = marked.join(sizes, "user_id").where(F.col("item_rank") <= F.col("_h") + k).drop("_h")
    # a few rows per user are left: written once instead of computed for every branch below
    points = checkpointed(relevant.unionByName(users.withColumn("item_rank", F.lit(0).cast("bigint"))))
    points = points.withColumn("_block", F.floor(F.col("item_rank") / block))
    points = chunk_scan(points, ["user_id"], "_block", ["item_rank"], position="_pos", following="_next")
    if listed:
        totals = ranking.groupBy("list_id").agg(F.max("item_rank").alias("_total"))
        points = salted_join(points, totals, ["list_id"], ["user_id"])
        deep = True
    else:
        total = ranking.count()
        points = points.withColumn("_total", F.lit(total))
        deep = total > BROADCAST_RANKS
    runs = points.withColumn("_skipped", F.col("item_rank") - (F.col("_pos") - 1)).where(F.col("_skipped") < k)  # unseen ranks before
    end = F.least(F.coalesce(F.col("_next.item_rank") - 1, F.col("_total")), F.col("item_rank") + (k - F.col("_skipped")))
    runs = runs.withColumn("_last", end).where(F.col("_last") > F.col("item_rank"))
    ranks = F.posexplode(F.sequence(F.col("item_rank") + 1, F.col("_last"))).alias("_i", "item_rank")
    picked = runs.select("user_id", *key, ranks, "_skipped")
    picked = picked.select("user_id", *key, "item_rank", (F.col("_skipped") + F.col("_i") + 1).cast("int").alias("rank"))
    if listed:
        return salted_join(picked, ranking, [*key, "item_rank"], ["user_id"])
    # nearly all answers come from the head of the ranking: a bounded broadcast; deep ranks take a shuffled join
    head = picked.where(F.col("item_rank") <= BROADCAST_RANKS).join(F.broadcast(ranking.where(F.col("item_rank") <= BROADCAST_RANKS)), "item_rank")
    if not deep:
        return head
    tail = picked.where(F.col("item_rank") > BROADCAST_RANKS).join(ranking.where(F.col("item_rank") > BROADCAST_RANKS), "item_rank")
    return head.unionByName(tail)


# ---------------------------------------------------------------------------------------------------------------------
# sparse histories against sparse item columns


def _unpacked(packed: pa.Table, key: str, items: str, values: str) -> tuple[np.ndarray, ...]:
    """Keys, and per list entry the key's number, the item and the value."""
    keys = packed[key].to_pandas().to_numpy()
    lists, numbers = packed[items].combine_chunks(), packed[values].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    return keys, np.repeat(np.arange(len(keys)), lengths), lists.flatten().to_pandas().to_numpy(), numbers.flatten().to_numpy(zero_copy_only=False)


def _sparse_search(k: int, exclude_seen: bool, out_schema: pa.Schema):
    def search(rows: pa.Table, columns: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or columns.num_rows == 0:
            return out_schema.empty_table()
        users, row, items, strength = _unpacked(rows, "user_id", "items", "strengths")
        targets, col, sources, weight = _unpacked(columns.sort_by("target_id"), "target_id", "items", "weights")
        source, at = np.unique(sources, return_inverse=True)
        order = np.argsort(at, kind="stable")
        col, weight = col[order], weight[order]
        begin = np.searchsorted(at[order], np.arange(len(source) + 1))
        known = pd.Index(source).get_indexer(items)
        used = np.flatnonzero(known >= 0)
        length = begin[known[used] + 1] - begin[known[used]]
        scores = np.zeros(len(users) * len(targets))
        touched = np.zeros(len(scores), dtype=bool)
        # products in pieces of bounded size, added into the dense block
        edges = np.searchsorted(np.cumsum(length), np.arange(0, length.sum() + PIECE, PIECE))
        for lo, hi in zip(edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)):
            piece, n = used[lo:hi], length[lo:hi]
            if not len(piece):
                continue
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[known[piece]], n)
            cell = np.repeat(row[piece], n) * len(targets) + col[offset]
            scores += np.bincount(cell, np.repeat(strength[piece], n) * weight[offset], len(scores))
            touched[cell] = True
        scores, touched = scores.reshape(len(users), -1), touched.reshape(len(users), -1)
        if exclude_seen:
            own = pd.Index(targets).get_indexer(items)
            touched[row[own >= 0], own[own >= 0]] = False
        scores[~touched] = -np.inf
        best = _best_columns(scores, k)
        where, to = np.repeat(np.arange(len(users)), best.shape[1]), best.ravel()
        values = scores[where, to]
        keep = np.isfinite(values)
        frame = {"user_id": users[where[keep]], "item_id": targets[to[keep]], "score": values[keep]}
        return pa.Table.from_pandas(pd.DataFrame(frame), schema=out_schema, preserve_index=False)

    return search


def sparse_topk(history: DataFrame, weights: DataFrame, k: int, exclude_seen: bool = True, user_block: int = 2048, target_block: int = 4096, heavy: int = 20_000) -> DataFrame:
    """Top-k of the product of sparse histories and sparse item columns.

    ``history(user_id, item_id, strength)`` with one row per pair; ``weights(item_id, target_id, weight)`` with a bounded
    number of rows per *target*. An item may speak for any number of targets, so joining histories with weights could
    emit users times targets; instead blocks of users meet blocks of targets and only k rows per user and block leave a
    task. Users with more than ``heavy`` items, of which there are few, are joined and summed by key instead.
    """
    history = history.select("user_id", "item_id", "strength")
    sizes = history.groupBy("user_id").agg(F.count("*").alias("_h"))
    n_targets = weights.select("target_id").distinct().count()
    n_users, n_heavy = sizes.agg(F.count("*"), F.count_if(F.col("_h") > heavy)).first()
    user_parts, target_parts = max(1, -(-n_users // user_block)), max(1, -(-n_targets // target_block))
    out = T.StructType([
        T.StructField("user_id", history.schema["user_id"].dataType),
        T.StructField("item_id", weights.schema["target_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])

    def part(column: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    light = history
    if n_heavy:
        big = sizes.where(F.col("_h") > heavy).select("user_id")
        light = history.join(big, "user_id", "left_anti")
    # one row per user and per target, with at most ``heavy`` and the bounded number of entries
    entries = F.collect_list(F.struct("item_id", "strength"))
    left = light.groupBy("user_id").agg(entries.alias("e")).select("user_id", F.col("e.item_id").alias("items"), F.col("e.strength").alias("strengths"))
    entries = F.collect_list(F.struct("item_id", "weight"))
    right = weights.groupBy("target_id").agg(entries.alias("e")).select("target_id", F.col("e.item_id").alias("items"), F.col("e.weight").alias("weights"))
    left = left.withColumn("up", part("user_id", user_parts)).withColumn("tp", every(target_parts))
    right = right.withColumn("tp", part("target_id", target_parts)).withColumn("up", every(user_parts))
    lists = left.groupBy("up", "tp").cogroup(right.groupBy("up", "tp")).applyInArrow(_sparse_search(k, exclude_seen, to_arrow_schema(out)), out)
    if n_heavy:
        busy = history.join(big, "user_id", "left_semi")
        summed = busy.join(weights, "item_id").groupBy("user_id", "target_id").agg(F.sum(F.col("strength") * F.col("weight")).alias("score"))
        summed = summed.select("user_id", F.col("target_id").alias("item_id"), "score")
        if exclude_seen:
            summed = summed.join(busy.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        lists = lists.unionByName(summed)
    return top_k(lists, ["user_id"], [F.desc("score"), F.asc("item_id")], k)
