"""Nearest neighbours by inner product over one hierarchical navigable small-world graph per shard.

1. Cells: centroids are fitted on a bounded sample (the ``SAMPLE`` rows of smallest id hash), about one per ``SHARD`` rows and ``MOST_CELLS`` at most. Every row goes to its nearest centroid's
   cell, and a cell of more rows than a shard is dealt into several by a hash, so no shard grows with the data.
2. Graphs: a row's top level is drawn from its id hash. On each level a row links to the nearest of that level that are nearer to it than to a link already taken, and links go both
   ways. Candidates come from block products inside the shard. Ids, vectors and links are flat arrays in one stored row per shard.
3. Search: queries are dealt in blocks of one cell. A block first meets the shards of the ``PROBES`` cells whose centroids have the largest inner products with it, which gives each
   query a k-th score. Then it meets every other shard, apart from the queries for which no row of the shard's cell can reach that score: the inner product with a row is at
   most ``query . centroid + |query| * radius`` and at most ``|query| * longest row`` of the cell. So the result is that of every shard, whatever their number, and does not depend on
   ``PROBES``. Each graph is walked down greedily and searched with a beam of ``BEAM`` on the lowest level; the scores of what it returns are worked out in double precision, and
   the shards' results are merged.

Recall against brute force is measured in the tests (at least 0.9).

Defined cases: vectors that are null, zero, hold a null or non-finite component, or have another length than the sample's first, take no part, neither as queries nor as candidates;
rows with a null id take no part; rows with a query's id are its own and no candidates; an id that stands in several rows is listed once, with its best
score; ties go to the smaller id; with fewer candidates than asked for, all are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tastemill.session import checkpointed

K = 20
SHARD = 16_384
SAMPLE = 32_768
MOST_CELLS = 4096
PROBES = 6
BEAM = 128
#: Links per row on the lowest level (half of it above), candidates looked at for them, and queries per block.
LINKS, CANDIDATES, BLOCK = 32, 48, 512
#: Rows besides the walk's end from which a beam starts.
STARTS = 16


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centroids of the sample by Lloyd's rounds from evenly spread rows."""
    centers = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = nearest_cell(sample, centers)
        sums, count = np.zeros_like(centers), np.bincount(near, minlength=cells)
        np.add.at(sums, near, sample)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance less the row's own square."""
    return (centers**2).sum(1)[None, :] - 2 * rows @ centers.T


def nearest_cell(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(rows[i : i + 2048], centers).argmin(1) for i in range(0, len(rows), 2048)]) if len(rows) else np.zeros(0, np.int64)


def build(vectors: np.ndarray, levels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level from the lowest: the rows on it, and their links as a matrix of row numbers (-1: none)."""
    out = []
    for level in range(int(levels.max()) + 1):
        rows = np.flatnonzero(levels >= level)
        most = LINKS if level == 0 else LINKS // 2
        out.append((rows, linked(vectors[rows], most, rows)))
    return out


def linked(v: np.ndarray, most: int, names: np.ndarray) -> np.ndarray:
    n, take = len(v), min(CANDIDATES, len(v) - 1)
    if take < 1:
        return np.full((n, most), -1, np.int32)
    near = np.empty((n, take), np.int32)
    step = max(64, (8 << 20) // n)
    for i in range(0, n, step):
        part = v[i : i + step] @ v.T
        part[np.arange(len(part)), np.arange(i, i + len(part))] = -np.inf
        top = np.argpartition(-part, take - 1, axis=1)[:, :take]
        near[i : i + step] = np.take_along_axis(top, np.argsort(-np.take_along_axis(part, top, 1), axis=1, kind="stable"), 1)
    # Take a candidate unless it is nearer to a link already taken than to the row itself; half of the places are for these.
    half = max(1, most // 2)
    links, count, left = np.full((n, most), -1, np.int32), np.zeros(n, np.int64), np.zeros((n, take), bool)
    for j in range(take):
        c = near[:, j]
        own = np.einsum("nd,nd->n", v, v[c])
        worst = np.full(n, -np.inf, v.dtype)
        for s in range(half):
            has = count > s
            if has.any():
                worst[has] = np.maximum(worst[has], np.einsum("nd,nd->n", v[c[has]], v[links[has, s]]))
        good = (worst <= own) & (count < half)
        links[good, count[good]] = c[good]
        count[good] += 1
        left[~good, j] = True
    # Links back, then the nearest that were passed over.
    source, target = np.nonzero(links[:, :half] >= 0)[0], links[:, :half][links[:, :half] >= 0]
    more = np.concatenate([target, np.nonzero(left)[0]]), np.concatenate([source, near[left]])
    rank = np.concatenate([np.zeros(len(target)), 1 + np.nonzero(left)[1]])
    order = np.lexsort((rank, more[0]))
    row, to = more[0][order], more[1][order]
    seat = np.arange(len(row)) - np.searchsorted(row, row) + count[row]
    ok = seat < most
    links[row[ok], seat[ok]] = to[ok]
    return np.where(links >= 0, names[links], -1).astype(np.int32)


def beam(queries: np.ndarray, vectors: np.ndarray, graph: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Rows found for each query (-1: none), in no order."""
    q, n = len(queries), len(vectors)
    if n <= width:
        return np.tile(np.arange(n, dtype=np.int32), (q, 1))
    at = np.full(q, graph[-1][0][0])
    best = np.einsum("qd,qd->q", queries, vectors[at])
    for rows, links in reversed(graph[1:]):
        seat = np.full(n, -1, np.int64)
        seat[rows] = np.arange(len(rows))
        moving = np.arange(q)
        while len(moving):
            around = links[seat[at[moving]]]
            scores = np.where(around >= 0, np.einsum("qd,qmd->qm", queries[moving], vectors[around]), -np.inf)
            pick = scores.argmax(1)
            better = scores[np.arange(len(moving)), pick] > best[moving]
            at[moving[better]] = around[np.arange(len(moving)), pick][better]
            best[moving[better]] = scores[np.arange(len(moving)), pick][better]
            moving = moving[better]
    links, width = graph[0][1], min(width, n)
    found, score, done = np.full((q, width), -1, np.int32), np.full((q, width), -np.inf, vectors.dtype), np.ones((q, width), bool)
    seen = np.zeros((q, n), bool)
    # The beam starts where the walk ended, and at rows spread over the shard in case links do not lead everywhere.
    spread_rows = np.linspace(0, n - 1, min(STARTS, width - 1)).astype(np.int64)
    found[:, 0], score[:, 0], done[:, 0] = at, best, False
    found[:, 1 : 1 + len(spread_rows)], score[:, 1 : 1 + len(spread_rows)], done[:, 1 : 1 + len(spread_rows)] = spread_rows, queries @ vectors[spread_rows].T, False
    again = spread_rows[None, :] == at[:, None]
    found[:, 1 : 1 + len(spread_rows)][again], score[:, 1 : 1 + len(spread_rows)][again], done[:, 1 : 1 + len(spread_rows)][again] = -1, -np.inf, True
    seen[np.arange(q), at] = True
    seen[:, spread_rows] = True
    active = np.arange(q)
    while len(active):
        open_scores = np.where(done[active], -np.inf, score[active])
        pick = open_scores.argmax(1)
        going = open_scores[np.arange(len(active)), pick] > -np.inf
        active, pick = active[going], pick[going]
        if not len(active):
            break
        done[active, pick] = True
        around = links[found[active, pick]]
        fresh = (around >= 0) & ~seen[active[:, None], around]
        seen[active[:, None], around] |= fresh
        # A row may stand twice among the links of one step; its second place is not fresh.
        order = np.sort(np.where(fresh, around, -1), axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        scores = np.where(order >= 0, np.einsum("qd,qmd->qm", queries[active], vectors[order]), -np.inf)
        all_rows, all_scores = np.concatenate([found[active], order], 1), np.concatenate([score[active], scores], 1)
        all_done = np.concatenate([done[active], order < 0], 1)
        top = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        found[active], score[active], done[active] = (np.take_along_axis(x, top, 1) for x in (all_rows, all_scores, all_done))
    return found


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part, components as doubles."""
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.select("vec_id", F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite & F.exists(v, lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(rows: DataFrame, is_query: Column, k: int = K, probes: int = PROBES, width: int = BEAM, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for every query row."""
    spark = rows.sparkSession
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    chosen = usable(rows).select(F.xxhash64("vec_id").alias("o"), "vec_id", "v").orderBy("o", "vec_id").limit(sample).select("v").toArrow()["v"].to_pylist()
    if not chosen:
        return spark.createDataFrame([], empty)
    size = len(chosen[0])
    marked = usable(rows).where(F.size("v") == size)
    total = marked.count()
    cells = max(1, min(MOST_CELLS, round(total / shard)))
    centers = fit_centroids(np.array([x for x in chosen if len(x) == size]), cells)

    def placed(batches):
        for batch in batches:
            v = matrix(batch.column("v"))
            cell = nearest_cell(v, centers)
            away, long = (np.linalg.norm(x, axis=1) for x in (v - centers[cell] if len(v) else v, v))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(away), pa.array(long)], ["vec_id", "v", "cell", "away", "long"])

    base = checkpointed(marked.mapInArrow(placed, "vec_id bigint, v array<double>, cell int, away double, long double"))
    counts, radius, longest = np.zeros(cells, np.int64), np.zeros(cells), np.zeros(cells)
    for cell, n, away, long in base.groupBy("cell").agg(F.count(F.lit(1)), F.max("away"), F.max("long")).collect():  # one row per cell, MOST_CELLS at most
        counts[cell], radius[cell], longest[cell] = n, away, long
    splits = np.maximum(1, -(-counts // shard))
    split_of = F.element_at(F.array(*map(F.lit, splits.tolist())), F.col("cell") + 1)

    def graphed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        # Equal vectors are one row of the graph, however many ids they have.
        v, first, name = np.unique(np.stack(part["v"].to_numpy()), axis=0, return_index=True, return_inverse=True)
        name = name.ravel()
        order = np.argsort(name, kind="stable")
        ids, of = part["vec_id"].to_numpy().astype(np.int64)[order], name[order]
        once = np.ones(len(ids), bool)
        once[1:] = (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])
        drawn = (part["o"].to_numpy()[first].astype(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
        levels = np.minimum(6, np.floor(-np.log(np.maximum(drawn, 1e-12)) / math.log(LINKS // 2))).astype(np.int64)
        graph = build(v.astype(np.float32), levels)
        return pd.DataFrame({
            "shard": [part["shard"].iloc[0]], "ids": [ids[once].tobytes()], "many": [np.bincount(of[once]).astype(np.int32).tobytes()], "vectors": [v.tobytes()],
            "sizes": [[len(r) for r, _ in graph]], "rows": [np.concatenate([r for r, _ in graph]).astype(np.int32).tobytes()], "links": [np.concatenate([x.ravel() for _, x in graph]).tobytes()]})

    dealt = base.withColumn("o", F.xxhash64("vec_id", F.lit(1))).withColumn("shard", F.struct("cell", F.pmod(F.xxhash64("vec_id"), split_of).alias("part"))).withColumn("shard", F.col("shard.cell").cast("bigint") * (1 << 32) + F.col("shard.part"))
    index = checkpointed(dealt.groupBy("shard").applyInPandas(graphed, "shard bigint, ids binary, many binary, vectors binary, sizes array<int>, rows binary, links binary"))

    filled, reach = np.flatnonzero(counts), np.linalg.norm(centers, axis=1)

    def first_cells(q: np.ndarray) -> np.ndarray:
        return filled[np.argsort(-(q @ centers[filled].T).mean(0), kind="stable")[:probes]]

    def routed(batches):
        """Without floors a block goes to its first cells, with them to the others that may hold something for a query."""
        for batch in batches:
            for block in batch.to_pylist():
                q, names = np.array([x["v"] for x in block["queries"]], np.float64), [x["query_id"] for x in block["queries"]]
                first = first_cells(q)
                if "floors" in block:
                    known = {x["query_id"]: x["floor"] for x in block["floors"] or []}
                    floor, norm = np.array([known.get(n, -np.inf) for n in names]), np.linalg.norm(q, axis=1)
                    others = np.setdiff1d(filled, first)
                    # Slack for rounding: bounds and scores are sums of products of at most these lengths.
                    slack = 1e-9 * norm[:, None] * (reach + radius + longest)[others][None, :]
                    bound = np.minimum(q @ centers[others].T + norm[:, None] * radius[others][None, :], norm[:, None] * longest[others][None, :]) + slack
                    going = {int(c): np.flatnonzero(bound[:, i] >= floor) for i, c in enumerate(others)}
                else:
                    going = {int(c): np.arange(len(q)) for c in first}
                for cell, chosen in going.items():
                    if len(chosen):
                        sent = pa.array([[block["queries"][i] for i in chosen]], pa.list_(pa.struct([("query_id", pa.int64()), ("v", pa.list_(pa.float64()))])))
                        for part in range(int(splits[cell])):
                            yield pa.RecordBatch.from_arrays([pa.array([cell * (1 << 32) + part], pa.int64()), sent], ["shard", "queries"])

    asked = base.join(rows.where(is_query).select(F.col("vec_id").alias("of")).distinct(), F.col("vec_id") == F.col("of"), "left_semi").dropDuplicates(["vec_id"])
    asked = checkpointed(asked.select(F.col("vec_id").alias("query_id"), "v", "cell"))
    many = asked.groupBy(F.col("cell").alias("c")).agg(F.count(F.lit(1)).alias("many"))
    dealt_queries = asked.join(many, F.col("cell") == F.col("c")).withColumn("block", F.struct("cell", F.pmod(F.xxhash64("query_id", F.lit(2)), F.ceil(F.col("many") / BLOCK)).alias("part"))).select("query_id", "v", "block")
    blocks = checkpointed(dealt_queries.groupBy("block").agg(F.collect_list(F.struct("query_id", "v")).alias("queries")))

    def walked(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i].as_py() for c in ("ids", "many", "vectors", "sizes", "rows", "links", "queries")}
                ids, v = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["vectors"], np.float64).reshape(-1, size)
                graph, rows_at, links_at = [], 0, 0
                flat_rows, flat_links = np.frombuffer(one["rows"], np.int32), np.frombuffer(one["links"], np.int32)
                for level, n in enumerate(one["sizes"]):
                    most = LINKS if level == 0 else LINKS // 2
                    graph.append((flat_rows[rows_at : rows_at + n], flat_links[links_at : links_at + n * most].reshape(n, most)))
                    rows_at, links_at = rows_at + n, links_at + n * most
                names = np.array([x["query_id"] for x in one["queries"]], np.int64)
                asked_v = np.array([x["v"] for x in one["queries"]], np.float64)
                found = beam(asked_v.astype(np.float32), v.astype(np.float32), graph, width)
                query, _ = np.nonzero(found >= 0)
                row = found[found >= 0]
                score = (asked_v[query] * v[row]).sum(1)
                # The smallest ids of each vector: one more than asked for, as one may be the query's own.
                many = np.frombuffer(one["many"], np.int32)
                first, take = np.cumsum(many) - many, np.minimum(many, k + 1)[row]
                seat = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                query, score, found_id = np.repeat(query, take), np.repeat(score, take), ids[np.repeat(first[row], take) + seat]
                other = found_id != names[query]
                query, score, found_id = query[other], score[other], found_id[other]
                order = np.lexsort((found_id, -score, query))
                query, score, found_id = query[order], score[order], found_id[order]
                keep = np.arange(len(query)) - np.searchsorted(query, query) < 2 * k
                yield pa.RecordBatch.from_arrays([pa.array(names[query[keep]]), pa.array(found_id[keep]), pa.array(score[keep])], ["query_id", "vec_id", "score"])

    def found_in(sent: DataFrame) -> DataFrame:
        joined = sent.join(index.withColumnRenamed("shard", "s"), F.col("shard") == F.col("s")).select("ids", "many", "vectors", "sizes", "rows", "links", "queries")
        return joined.mapInArrow(walked, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def best(hits: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    sent_type = "shard bigint, queries array<struct<query_id: bigint, v: array<double>>>"
    first = checkpointed(best(found_in(blocks.mapInArrow(routed, sent_type))))
    if len(filled) <= probes:
        return first
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("floor"))
    floors = dealt_queries.join(floors, F.col("query_id") == F.col("q")).groupBy(F.col("block").alias("b")).agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))
    rest = blocks.join(floors, F.col("block") == F.col("b"), "left").select("queries", "floors").mapInArrow(routed, sent_type)
    merged = first.select("query_id", "vec_id", "score").unionByName(found_in(rest)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best(merged)
