"""Hand-computed cases of the serving, evaluation and text rules."""

import math

import pytest
from pyspark.sql import functions as F

from tastemill.functions.scalars import min_max
from tastemill.functions.text import weighted_item_text
from tastemill.functions.vectors import cosine, l2_normalize, mean_vectors, sum_vectors
from tastemill.models import hybrid
from tastemill.operators import evaluation as ev, interactions as ops, recommend as rec, rerank as rr


def recs_of(spark, user, items):
    return spark.createDataFrame([(user, i, n + 1) for n, i in enumerate(items)], "user_id string, item_id string, rank int")


def truth_of(spark, user, items):
    return spark.createDataFrame([(user, i) for i in items], "user_id string, item_id string")


@pytest.mark.parametrize("k, want", [(1, 0.0), (2, 1.0)])
def test_hit_rate(spark, k, want):
    assert ev.user_metrics(truth_of(spark, "u", "ab"), recs_of(spark, "u", "xa"), k).first()["hr"] == want


@pytest.mark.parametrize("truth, recs, k, want", [
    ("ab", "xab", 3, (1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3))),
    ("abc", "a", 20, 1.0),
    ("a", "x", 20, 0.0),
])
def test_ndcg(spark, truth, recs, k, want):
    assert ev.user_metrics(truth_of(spark, "u", truth), recs_of(spark, "u", recs), k).first()["ndcg"] == pytest.approx(want, abs=1e-9)


def test_user_without_recommendations_scores_zero(spark):
    row = ev.user_metrics(truth_of(spark, "u", "a"), recs_of(spark, "v", "a"), 10).first()
    assert (row["user_id"], row["n_returned"], row["hr"], row["ndcg"]) == ("u", 0, 0.0, 0.0)


@pytest.mark.parametrize("weighting, want", [("user", 0.5), ("interaction", 0.75)])
def test_mean_over_users(spark, weighting, want):
    per_user = spark.createDataFrame([("a", 3, 1.0), ("b", 1, 0.0)], "user_id string, n_true bigint, ndcg double")
    assert ev.mean_metric(per_user, "ndcg", weighting).first()["ndcg"] == want


def test_metric_names():
    assert ev.parse_metric("ndcg@20") == ("ndcg", 20)
    assert ev.parse_metric("hr") == ("hr", 10)
    with pytest.raises(ValueError):
        ev.parse_metric("map@10")


def numbered(spark, n):
    return spark.createDataFrame([("u", i, i) for i in range(1, n + 1)], "user_id string, item_id int, rank int")


def test_page_is_clamped(spark):
    got = rec.paginate(numbered(spark, 23), 5, 10).orderBy("position").collect()
    assert [r["position"] for r in got] == [21, 22, 23]
    assert {(r["page"], r["total_pages"], r["has_next"], r["has_prev"]) for r in got} == {(3, 3, False, True)}
    assert rec.paginate(numbered(spark, 0), 1, 10).count() == 0


@pytest.fixture(scope="module")
def priced(spark):
    return spark.createDataFrame([("a", 10.0, "A", "x"), ("b", 20.0, "B", "y"), ("c", None, "A", None)], "item_id string, price double, category string, brand string")


@pytest.mark.parametrize("filters, want", [
    (rec.Filters(min_price=10, max_price=15), {"a"}),
    (rec.Filters(), {"a", "b", "c"}),
    (rec.Filters(min_price=0), {"a", "b"}),
    (rec.Filters(categories=["A"]), {"a", "c"}),
    (rec.Filters(brands=["x", "y"]), {"a", "b"}),
    (rec.Filters(include_items=["a", "b"], exclude_items=["a"]), {"b"}),
])
def test_filters(priced, filters, want):
    assert {r["item_id"] for r in rec.apply_filters(priced, filters).collect()} == want


def test_filter_summary(priced):
    filters = rec.Filters(categories=["A"], min_price=5.0, exclude_items=["z", "y"])
    row = rec.filter_info(priced.withColumn("user_id", F.lit(1)), filters).first()
    assert (row["original_count"], row["filtered_count"]) == (3, 1)
    assert filters.applied() == {"categories": ["A"], "min_price": 5.0, "excluded_items": 2}


def test_buffer_rules():
    assert rec.buffered_k(10, rec.Filters()) == 10
    assert rec.buffered_k(10, rec.Filters(min_price=0)) == 10
    assert rec.buffered_k(10, rec.Filters(brands=["x"])) == 30
    assert rec.buffered_k(900, rec.Filters(brands=["x"])) == 1000


def test_page_size_limit(spark, priced):
    with pytest.raises(ValueError):
        rec.recommend_request(priced, priced, priced, priced, rec.Filters(), 10, 1, 101)


@pytest.mark.parametrize("strategy, want", [("content_boost", [0.15, 0.85]), ("content_only", [0.0, 1.0]), ("equal", [0.5, 0.5])])
def test_cold_weights(strategy, want):
    assert hybrid.cold_weights(["als", "text_embedding"], [0.5, 0.5], strategy) == pytest.approx(want)


def test_cold_weights_need_both_groups():
    assert hybrid.cold_weights(["als", "gru4rec"], [0.5, 0.5], "content_boost") == [0.5, 0.5]
    assert hybrid.cold_weights(["als", "gru4rec"], [0.5, 0.5], "content_only") == [0.5, 0.5]


def test_threshold_is_strict(spark):
    users = spark.createDataFrame([("a",), ("b",), ("c",)], "user_id string")
    sizes = spark.createDataFrame([("a", 5), ("b", 2)], "user_id string, n_items bigint")
    rows = hybrid.user_weights(users, sizes, ["als", "text_embedding"], [0.5, 0.5], 5).where("model = 'als'")
    assert {r["user_id"]: round(r["weight"], 9) for r in rows.collect()} == {"a": 0.5, "b": 0.15, "c": 0.15}


def test_base_weights():
    assert hybrid.base_weights(["a", "b"], [1.0]) == [0.5, 0.5]
    assert hybrid.base_weights(["a", "b"], [3.0, 1.0]) == [0.75, 0.25]


def test_fusion_takes_the_best(spark):
    lists = spark.createDataFrame([("u", "als", "a", 4.0), ("u", "als", "b", 2.0), ("u", "text", "b", 9.0), ("u", "text", "c", 3.0)], "user_id string, model string, item_id string, score double")
    weights = spark.createDataFrame([("als", 0.5), ("text", 0.5)], "model string, weight double")
    assert [(r["item_id"], r["score"]) for r in hybrid.fuse(lists, weights, 5).orderBy("rank").collect()] == [("a", 0.5), ("b", 0.5), ("c", 0.0)]


def test_fusion_skips_tiny_weights(spark):
    lists = spark.createDataFrame([("u", "als", "a", 4.0), ("u", "text", "b", 9.0)], "user_id string, model string, item_id string, score double")
    weights = spark.createDataFrame([("als", 1.0), ("text", 0.001)], "model string, weight double")
    assert [r["item_id"] for r in hybrid.fuse(lists, weights, 5).collect()] == ["a"]


def test_equal_scores_scale_to_one(spark):
    row = spark.range(1).select(min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0)).alias("s")).first()
    assert row["s"] == 1.0


def test_weighted_text(spark):
    df = spark.createDataFrame([("T", None, "B", "D"), (None, "", None, None), ("x" * 6000, "c", None, None)], "title string, category string, brand string, description string")
    columns = {c: F.col(c) for c in df.columns}
    got = [r[0] for r in df.select(weighted_item_text(columns)).collect()]
    assert got[:2] == ["T | T | B | D | D | D", None]
    assert len(got[2]) == 2 * 6000 + 7  # the whole text
    cut = [r[0] for r in df.select(weighted_item_text(columns, max_chars=5120)).collect()]
    assert len(cut[2]) == 5120
    half = df.limit(1).select(weighted_item_text({"brand": F.col("brand")}, {"brand": 1.5})).first()[0]
    assert half == "B"


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(l2_normalize(F.col("a")).alias("n"), l2_normalize(F.col("b")).alias("z"), cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert row["n"] == pytest.approx([0.6, 0.8])
    assert row["z"] == [0.0, 0.0]
    assert row["c"] is None


@pytest.mark.parametrize("dim", [3, 200])
def test_sums_and_means(spark, dim):
    rows = [("k", 1.0, [1.0] * dim), ("k", 3.0, [5.0] * dim)]
    df = spark.createDataFrame(rows, "k string, w double, v array<double>")
    assert sum_vectors(df, ["k"], "v", dim, "s").first()["s"] == pytest.approx([6.0] * dim)
    assert mean_vectors(df, ["k"], "v", dim, "m").first()["m"] == pytest.approx([3.0] * dim)
    assert mean_vectors(df, ["k"], "v", dim, "m", "w").first()["m"] == pytest.approx([4.0] * dim)
    gaps = [("k", None, [9.0] * dim), ("k", 2.0, None), ("k", 2.0, [None] + [9.0] * (dim - 1)), ("none", None, [1.0] * dim), ("zero", 1.0, [1.0] * dim), ("zero", -1.0, [2.0] * dim)]
    got = {r.k: r.m for r in mean_vectors(spark.createDataFrame(rows + gaps, df.schema), ["k"], "v", dim, "m", "w").collect()}
    assert got["k"] == pytest.approx([4.0] * dim) and got["zero"] is None and set(got) == {"k", "zero"}


def test_interaction_matrix(spark):
    events = spark.createDataFrame([("A", "X", 1, 1), ("A", "Y", 1, 1), ("B", "Z", 1, 1), ("B", "Z", 2, 2)], "user_id string, item_id string, qty int, ts bigint")
    inter = ops.interactions(events)
    users, items = ops.entity_index(events, "user_id", "user_idx"), ops.entity_index(events, "item_id", "item_idx")
    coded = {(r["user_idx"], r["item_idx"]): r["strength"] for r in ops.encode(inter, users, items).collect()}
    assert coded == {(0, 0): 1.0, (0, 1): 1.0, (1, 2): 3.0}
    numbers = spark.createDataFrame([(0,), (99,)], "item_idx bigint")
    assert {r["item_id"] for r in ops.decode(numbers, items, "item_idx", "item_id").collect()} == {"X", "unknown_99"}


def test_rerank_strategies(spark):
    lists = spark.createDataFrame([("u", "a", 9.0, "A"), ("u", "b", 8.0, "A"), ("u", "c", 1.0, "B")], "user_id string, item_id string, score double, category string")
    stats = spark.createDataFrame([("a", 10), ("b", 1), ("c", 5)], "item_id string, n_users bigint")
    rows = rr.components(lists, stats, 20)

    def order(**kw):
        return [r["item_id"] for r in rr.rerank(rows, **kw).orderBy("new_rank").collect()]

    assert order(strategy="diversity") == ["a", "c", "b"]
    assert order(strategy="novelty") == ["b", "c", "a"]
    assert order(strategy="popularity") == ["a", "c", "b"]
    assert order(strategy="hybrid", weights={"relevance": 1.0}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        rr.rerank(rows, "random")
    texts = {r["item_id"]: r["explanation"] for r in rr.explain_rows(rows).collect()}
    assert texts["a"] == "Recommended based on your interests"
    assert texts["c"] == "Adding variety with this B item"
