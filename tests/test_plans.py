"""Distributed plans against brute force, with hot keys that force the split paths."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tastemill.operators.ann import as_items, as_queries
from tastemill.operators.gram import cosine_neighbours, item_gram
from tastemill.operators import profiles, sequences
from tastemill.plans import topk
from tastemill.plans.ordered import chunk_scan, dense_index
from tastemill.plans.skew import salted_join
from tastemill.plans.topk import blocked_topk, rank_items, rank_lists, sparse_topk, unseen_heads

RNG = np.random.default_rng(7)


def skewed_interactions(n_users=40, n_items=60, hot_share=0.9):
    """User 0 holds nearly all items, the others a few."""
    rows = []
    for u in range(n_users):
        size = int(n_items * hot_share) if u == 0 else int(RNG.integers(1, 8))
        for i in RNG.choice(n_items, size, replace=False):
            rows.append((u, int(i), float(RNG.integers(1, 5))))
    return rows


@pytest.fixture(scope="module")
def rows():
    return skewed_interactions()


@pytest.fixture(scope="module")
def inter(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, strength double").cache()


def dense(rows):
    x = np.zeros((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1))
    for u, i, s in rows:
        x[u, i] = s
    return x


def test_dense_index_is_consecutive(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("v", F.col("id") % 10)
    got = dense_index(df, [F.desc("v"), F.asc("id")], "n").toPandas().sort_values("n")
    want = df.toPandas().sort_values(["v", "id"], ascending=[False, True])
    assert got["n"].tolist() == list(range(1000))
    assert got["id"].tolist() == want["id"].tolist()


def test_chunked_position_and_neighbour(spark):
    data = [("hot", t) for t in range(200)] + [("cold", 5), ("cold", 17)]
    df = spark.createDataFrame(data, "u string, t int").withColumn("c", F.floor(F.col("t") / 16))
    got = chunk_scan(df.withColumn("x", F.col("t") * 2), ["u"], "c", ["t"], "pos", "n", "p", ("x",)).toPandas()
    hot = got[got.u == "hot"].sort_values("t")
    assert hot["pos"].tolist() == list(range(1, 201))
    assert [n["t"] if n else None for n in hot["n"]] == [*range(1, 200), None]
    assert [n["x"] if n else None for n in hot["p"]] == [None, *range(0, 398, 2)]
    cold = got[got.u == "cold"].sort_values("t")
    assert [n["t"] if n else None for n in cold["p"]] == [None, 5]
    assert cold["pos"].tolist() == [1, 2]


def test_sessions_across_days(spark):
    hours = [0, 5, 23, 25, 30, 60, 61, 200]
    df = spark.createDataFrame([(i, "u", i, h) for i, h in enumerate(hours)], "event_id int, user_id string, item_id int, h int")
    events = df.withColumn("ts", F.timestamp_add("HOUR", F.col("h"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))).drop("h")
    sessions = sequences.sessionize(events, 6 * 3600)
    got = {r["event_id"]: r["session_no"] for r in sessions.collect()}
    assert [got[i] for i in range(8)] == [1, 1, 2, 2, 2, 3, 3, 4]
    places = {r["event_id"]: r["pos"] for r in sessions.collect()}
    assert [places[i] for i in range(8)] == [1, 2, 1, 2, 3, 1, 2, 1]
    pairs = {(r["prev_item"], r["next_item"]) for r in sequences.next_item_pairs(events, 6 * 3600).collect()}
    assert pairs == {(0, 1), (2, 3), (3, 4), (5, 6)}


def test_session_open_over_many_days(spark):
    """A user who never pauses, one who does, and positions that run on over days without any start."""
    rows = [("busy", h) for h in range(0, 24 * 9, 4)] + [("calm", h) for h in (0, 10, 30, 33, 47, 50, 52, 100)]
    df = spark.createDataFrame([(i, u, i, h) for i, (u, h) in enumerate(rows)], "event_id int, user_id string, item_id int, h int")
    events = df.withColumn("ts", F.timestamp_add("HOUR", F.col("h"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))).drop("h")
    got = {r["event_id"]: (r["session_no"], r["pos"]) for r in sequences.sessionize(events, 6 * 3600).collect()}
    assert [got[i] for i in range(54)] == [(1, i + 1) for i in range(54)]
    assert [got[54 + i] for i in range(8)] == [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3), (5, 1)]


def test_one_item_session_has_no_pair(spark):
    events = spark.createDataFrame([(0, "u", 1)], "event_id int, user_id string, item_id int").withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))
    assert sequences.next_item_pairs(events, 3600).count() == 0


def test_salted_join_keeps_all_rows(spark):
    left = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, 1).otherwise(F.col("id")))
    right = spark.createDataFrame([(1, "a"), (950, "b")], "k bigint, name string")
    assert salted_join(left, right, ["k"], ["id"]).count() == 901
    assert salted_join(left, right, ["k"], ["id"], how="left").count() == 1000
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], ["id"], how="right")


@pytest.mark.parametrize("block", [4, 4096])
def test_unseen_heads(spark, rows, inter, block):
    popularity = inter.groupBy("item_id").agg(F.sum("strength").alias("score"))
    users = inter.select("user_id").distinct().unionByName(spark.createDataFrame([(999,)], "user_id bigint"))
    got = unseen_heads(users, inter, rank_items(popularity), 8, block).select("user_id", "item_id", "rank").collect()
    order = [r["item_id"] for r in popularity.orderBy(F.desc("score"), "item_id").collect()]
    want = set()
    for u in [*{r[0] for r in rows}, 999]:
        seen = {r[1] for r in rows if r[0] == u}
        want |= {(u, i, n + 1) for n, i in enumerate([i for i in order if i not in seen][:8])}
    assert {tuple(r) for r in got} == want


def test_unseen_heads_of_lists(spark, rows, inter):
    lists = spark.createDataFrame([(g, i, float((i * 7) % 11)) for g in "ab" for i in range(60) if (i % 2 == 0) == (g == "a")], "list_id string, item_id bigint, score double")
    users = inter.select("user_id").distinct().withColumn("list_id", F.when(F.col("user_id") % 3 == 0, "a").otherwise("b"))
    got = {(r["user_id"], r["item_id"], r["rank"]) for r in unseen_heads(users, inter, rank_lists(lists), 5).collect()}
    ranked = {g: [r["item_id"] for r in lists.where(F.col("list_id") == g).orderBy(F.desc("score"), "item_id").collect()] for g in "ab"}
    want = set()
    for u in {r[0] for r in rows}:
        seen = {r[1] for r in rows if r[0] == u}
        want |= {(u, i, n + 1) for n, i in enumerate([i for i in ranked["a" if u % 3 == 0 else "b"] if i not in seen][:5])}
    assert got == want


def test_rankings_of_many_lists_are_not_broadcast(spark):
    ranking = spark.range(20).select(F.lit("a").alias("list_id"), F.col("id").alias("item_id"), (F.col("id") + 1).alias("item_rank"))
    users = spark.createDataFrame([(1, "a"), (2, "a")], "user_id bigint, list_id string")
    heads = unseen_heads(users, spark.createDataFrame([(1, 0)], "user_id bigint, item_id bigint"), ranking, 3)
    plan = heads._jdf.queryExecution().executedPlan().toString()
    last = next(line for line in plan.splitlines() if "Join [" in line)
    assert "SortMergeJoin" in last and "item_rank" in last
    assert {(r["user_id"], r["item_id"]) for r in heads.collect()} == {(1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2)}


@pytest.mark.parametrize("metric", ["inner_product", "cosine", "l2"])
@pytest.mark.parametrize("masked", [False, True])
def test_blocked_topk(spark, metric, masked):
    q, v = RNG.normal(size=(30, 6)), RNG.normal(size=(100, 6))
    v[50] = v[10]  # a tie is broken by id
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "item_id bigint, vector array<double>")
    vs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id bigint, vector array<double>")
    pairs = [(i, j) for i in range(30) for j in range(100) if (i * j) % 3 == 0]
    seen = spark.createDataFrame(pairs, "query_id bigint, item_id bigint") if masked else None
    hits = blocked_topk(as_queries(qs), as_items(vs), 7, metric, seen, query_block=8, item_block=16).collect()
    if metric == "cosine":
        q, v = q / np.linalg.norm(q, axis=1, keepdims=True), v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = -((q[:, None] - v[None]) ** 2).sum(2) if metric == "l2" else q @ v.T
    if masked:
        for i, j in pairs:
            scores[i, j] = -np.inf
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in hits}
    for i in range(30):
        order = sorted(range(100), key=lambda j: (-round(scores[i, j], 9), j))[:7]
        want = [j for j in order if np.isfinite(scores[i, j])]
        assert [got.get((i, n + 1)) for n in range(len(want))] == want


def test_blocked_topk_in_a_hot_cell(spark):
    q, v = RNG.normal(size=(20, 4)), RNG.normal(size=(90, 4))
    cells = [0 if j < 70 else 1 for j in range(90)]
    qs = spark.createDataFrame([(str(i), x.tolist(), c) for i, x in enumerate(q) for c in ((0, 1) if i % 2 else (0,))], "query_id string, query_vector array<double>, cell int")
    vs = spark.createDataFrame([(f"i{j:02d}", x.tolist(), cells[j]) for j, x in enumerate(v)], "item_id string, item_vector array<double>, cell int")
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in blocked_topk(qs, vs, 5, query_block=4, item_block=8).collect()}
    for i in range(20):
        allowed = [j for j in range(90) if cells[j] == 0 or i % 2]
        want = sorted(allowed, key=lambda j: -(q[i] @ v[j]))[:5]
        assert [got[(str(i), n + 1)] for n in range(5)] == [f"i{j:02d}" for j in want]


def test_blocked_topk_sends_a_vector_to_few_blocks(spark, monkeypatch):
    def counting(k, metric, out_schema):
        def rows_met(queries, items):
            return pa.table([[queries.num_rows], [items.num_rows], [1.0]], schema=out_schema)

        return rows_met

    monkeypatch.setattr(topk, "_block_search", counting)
    rows = spark.range(100_000).select(F.col("id").alias("item_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("vector"))
    met = blocked_topk(as_queries(rows), as_items(rows), 1000).agg(F.sum("query_id"), F.sum("item_id")).first()
    assert met[0] >= 100_000 and met[1] >= 100_000 and sum(met) <= 20 * 100_000


@pytest.mark.parametrize("whole", ["all", "some", "none"])
def test_blocked_topk_sends_floats_where_they_are_the_same_numbers(spark, whole, monkeypatch):
    search = topk._block_search

    def noting(k, metric, out_schema):
        inner = search(k, metric, out_schema)

        def run(queries, items):
            if any(t[f"{side}_vector"].null_count != t.num_rows for t, side in ((queries, "query"), (items, "item"))) and whole == "all":
                raise AssertionError("a vector of floats was sent as doubles")
            return inner(queries, items)

        return run

    monkeypatch.setattr(topk, "_block_search", noting)
    v = np.random.default_rng(3).normal(size=(60, 5))
    short = np.arange(60) % {"all": 1, "some": 3, "none": 61}[whole] == 0
    short[0] = whole != "none"
    v[short] = v[short].astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id bigint, vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["item_id"], r["score"]) for r in blocked_topk(as_queries(rows), as_items(rows), 4, query_block=16, item_block=16).collect()}
    scores = v @ v.T
    for i in range(60):
        want = sorted(range(60), key=lambda j: (-scores[i, j], j))[:4]
        assert [got[i, n + 1][0] for n in range(4)] == want
        assert [got[i, n + 1][1] for n in range(4)] == pytest.approx([scores[i, j] for j in want], abs=1e-12)


@pytest.mark.parametrize("width", [4, 100])
def test_blocked_topk_over_several_tiles(spark, width, monkeypatch):
    rng = np.random.default_rng(5)
    q, v = rng.integers(-3, 4, (40, width)).astype(float), rng.integers(-3, 4, (500, width)).astype(float)  # with many ties
    out = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])
    monkeypatch.setattr(topk, "TILE_QUERIES", 16)
    monkeypatch.setattr(topk, "TILE_ITEMS", 32)
    ids = [0, 0, *range(2, 40)]  # a query that stands twice
    marks = [(0, j) for j in range(0, 500, 2)] + [(7, j) for j in range(495)]
    none = pa.nulls(len(marks), pa.list_(pa.float64()))
    asked = pa.table({"query_id": ids + [m[0] for m in marks], "query_vector": pa.concat_arrays([pa.array(q.tolist()), none]), "seen_item": [None] * 40 + [m[1] for m in marks]})
    got = topk._block_search(6, "inner_product", out)(asked, pa.table({"item_id": range(500), "item_vector": v.tolist()})).to_pandas()
    want = []
    for row, query in enumerate(ids):
        scores = q[row] @ v.T
        free = [j for j in range(500) if (query, j) not in set(marks)]
        want += [(query, j, scores[j]) for j in sorted(free, key=lambda j: (-scores[j], j))[:6]]
    assert [tuple(r) for r in got.itertuples(index=False)] == want


def test_fewer_items_than_k(spark):
    vs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "item_id bigint, vector array<double>")
    assert blocked_topk(as_queries(vs), as_items(vs), 10).count() == 9


@pytest.mark.parametrize("heavy", [3, 1000])
def test_gram_of_light_and_heavy_users(spark, rows, inter, heavy):
    x = dense(rows)
    want = x.T @ x
    got = item_gram(inter, heavy=heavy, user_block=2, item_block=8).collect()
    assert len(got) == len({(r["item_i"], r["item_j"]) for r in got}) == np.count_nonzero(np.triu(want))
    for r in got:
        assert r["item_i"] <= r["item_j"]
        assert r["product"] == want[r["item_i"], r["item_j"]]
        assert r["n_users"] == ((x[:, r["item_i"]] > 0) & (x[:, r["item_j"]] > 0)).sum()


def test_gram_with_text_ids(spark, rows):
    named = spark.createDataFrame([(f"u{u}", f"i{i}", s) for u, i, s in rows], "user_id string, item_id string, strength double")
    light = {(r["item_i"], r["item_j"]): r["product"] for r in item_gram(named).collect()}
    heavy = {(r["item_i"], r["item_j"]): r["product"] for r in item_gram(named, heavy=2, user_block=3, item_block=7).collect()}
    assert light == heavy


def test_cosine_neighbours(rows, inter):
    x = dense(rows)
    unit = x / np.maximum(np.linalg.norm(x, axis=0), 1e-12)
    cos = unit.T @ unit
    np.fill_diagonal(cos, 0)
    got = {}
    for r in cosine_neighbours(inter, 4, heavy=3, user_block=2, item_block=8).collect():
        got.setdefault(r["item_id"], {})[r["rank"]] = r["score"]
    for i, ranked in got.items():
        assert np.allclose([ranked[n] for n in sorted(ranked)], np.sort(cos[i][cos[i] > 0])[::-1][:4])


@pytest.mark.parametrize("heavy", [3, 1000])
@pytest.mark.parametrize("part_entries", [1, 40, 10_000])
def test_cosine_neighbours_in_any_parts(rows, inter, heavy, part_entries):
    x = dense(rows)
    norm = np.sqrt((x * x).sum(axis=0))
    products = x.T @ x
    got = {}
    for r in cosine_neighbours(inter, 4, heavy=heavy, user_block=2, item_block=8, part_entries=part_entries).collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["other_id"], round(r["score"], 9)))
    want = {}
    for i in range(x.shape[1]):
        near = sorted((j for j in range(x.shape[1]) if j != i and products[i, j] > 0), key=lambda j: (-(products[i, j] / (norm[i] * norm[j])), j))[:4]
        if near:
            want[i] = [(n + 1, j, round(products[i, j] / (norm[i] * norm[j]), 9)) for n, j in enumerate(near)]
    assert {i: sorted(r) for i, r in got.items()} == want


def test_cosine_neighbours_shuffle_no_item_pairs(spark):
    inter = spark.createDataFrame([(u, i, 1.0) for u in range(30) for i in range(20)], "user_id bigint, item_id bigint, strength double")
    plan = cosine_neighbours(inter, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "item_j" not in plan and "Aggregate [item_id" not in plan.split("FlatMapGroups")[0]
    gaps = spark.createDataFrame([("u", 1, 2.0), ("u", 2, None), ("u", 3, 1.0), ("v", 1, 1.0), ("v", 3, 1.0), (None, 1, 2.0), ("v", None, 1.0)], "user_id string, item_id int, strength double")
    got = {(r["item_id"], r["rank"]): (r["other_id"], r["score"] and round(r["score"], 6)) for r in cosine_neighbours(gaps, 3).collect()}
    assert got == {(1, 1): (3, round(3 / 18**0.5, 6)), (1, 2): (2, None), (2, 1): (1, None), (2, 2): (3, None), (3, 1): (1, round(3 / 18**0.5, 6)), (3, 2): (2, None)}


def test_feature_sums_of_one_large_split(spark, monkeypatch):
    monkeypatch.setattr(profiles, "TASK_NUMBERS", 100)
    features = spark.range(0, 300, 1, 1).select((F.col("id") % 150).alias("item_id"), F.when(F.col("id") < 150, "a").otherwise("b").alias("feature"), F.lit(2.0).alias("weight"))
    embeddings = spark.createDataFrame([("a", [1.0, 2.0], 1.0), ("b", [3.0, 5.0], 0.5)], "feature string, vector array<double>, bias double")
    found = profiles.feature_sums(features, embeddings, 2)
    assert "RepartitionByExpression [item_id" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["item_id"], r["vector"], r["bias"]) for r in found.collect()) == [(i, [8.0, 14.0], 3.0) for i in range(150)]


@pytest.mark.parametrize("heavy", [5, 1000])
@pytest.mark.parametrize("exclude", [True, False])
def test_sparse_topk(spark, rows, inter, heavy, exclude):
    x = dense(rows)
    w = np.where(RNG.random((x.shape[1], x.shape[1])) < 0.2, RNG.random((x.shape[1], x.shape[1])), 0)
    w[3, :] = 0.5  # an item that speaks for all
    weights = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "item_id bigint, target_id bigint, weight double")
    scores = x @ w
    reached = (x > 0).astype(float) @ (w > 0) > 0
    if exclude:
        reached &= ~(x > 0)
    got = {}
    for r in sparse_topk(inter, weights, 6, exclude, user_block=7, target_block=9, heavy=heavy).collect():
        got.setdefault(r["user_id"], {})[r["rank"]] = r["score"]
    for u in range(x.shape[0]):
        want = np.sort(scores[u][reached[u]])[::-1][:6]
        assert np.allclose([got.get(u, {})[n] for n in sorted(got.get(u, {}))], want)
