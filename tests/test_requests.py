"""Requests whose filters work before the cut, against brute force and hand-computed cases."""

import random

import pytest

from tastemill.operators import requests as ops, rerank as rr
from tastemill.operators.recommend import Filters

REQUEST = "request_id bigint, user_id bigint, page int, page_size int, categories array<string>, brands array<string>, min_price double, max_price double, exclude_items array<bigint>, include_items array<bigint>"


@pytest.fixture(scope="module")
def shop():
    r = random.Random(5)
    items = [(i, f"t{i}", r.choice(["a", "b", "c", None]), r.choice(["x", "y"]), r.choice([None, *range(1, 90)])) for i in range(200)]
    items = [(i, t, c, brand, None if p is None else float(p)) for i, t, c, brand, p in items]
    scores = [(i, float(r.randrange(40))) for i in range(190)]
    seen = sorted({(r.randrange(6), r.randrange(200)) for _ in range(250)})
    pick = lambda *options: r.choice([None, *options])
    requests = [
        (q, r.randrange(8), r.randrange(1, 4), r.randrange(1, 9), pick(["a"], ["b", "a"], ["a", "b", "a"], []), pick(["x"], ["y", "x"]), pick(10.0, 50.0), pick(40.0, 5.0), pick([1, 2, 3], []), pick(list(range(50, 120))))
        for q in range(60)
    ]
    return items, scores, seen, requests


def expected(shop, k):
    items, scores, seen, requests = shop
    meta, own = {i[0]: i for i in items}, set(seen)
    out = {}
    for q, user, page, size, cats, brands, low, high, without, only in requests:
        def passes(item):
            _, _, c, brand, p = meta[item]
            return ((not cats or c in cats) and (not brands or brand in brands) and (low is None or (p is not None and p >= low)) and (high is None or (p is not None and p <= high))
                    and (not without or item not in without) and (not only or item in only) and (user, item) not in own)

        ranked = [i for i, _ in sorted(scores, key=lambda s: (-s[1], s[0])) if passes(i)][:k]
        pages = -(-len(ranked) // size)
        page = max(1, min(page, pages))
        for n, item in enumerate(ranked[(page - 1) * size : page * size]):
            out[q, (page - 1) * size + n + 1] = (user, item, len(ranked), page, pages)
    return out


def frames(spark, shop):
    items, scores, seen, requests = shop
    return (
        spark.createDataFrame(requests, REQUEST), spark.createDataFrame(seen, "user_id bigint, item_id bigint"),
        spark.createDataFrame(items, "item_id bigint, title string, category string, brand string, price double"), spark.createDataFrame(scores, "item_id bigint, score double"),
    )


@pytest.mark.parametrize("k", [7, 500])
def test_answers_equal_brute_force(spark, shop, k):
    got = ops.answer(*frames(spark, shop), k, by="request_id").collect()
    assert {(r["request_id"], r["position"]): (r["user_id"], r["item_id"], r["total"], r["page"], r["total_pages"]) for r in got} == expected(shop, k)


def test_same_filters_share_a_list(spark):
    rows = [(1, 1, 1, 5, ["b", "a"], None, None, None, [1], None), (2, 2, 2, 5, ["a", "b", "b"], [], None, None, None, None), (3, 3, 1, 5, [], None, None, None, None, None), (4, 4, 1, 5, None, None, 0.0, None, None, None)]
    ids = [r["list_id"] for r in ops.with_list_ids(spark.createDataFrame(rows, REQUEST)).orderBy("request_id").collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 3


def test_no_prices_and_no_requests(spark, shop):
    requests, seen, items, scores = frames(spark, shop)
    bare = items.selectExpr("item_id", "title", "category", "brand", "CAST(NULL AS DOUBLE) AS price")
    priced = requests.where("min_price IS NOT NULL OR max_price IS NOT NULL")
    assert ops.answer(priced, seen, bare, scores, 5, by="request_id").count() == 0
    assert ops.answer(requests.limit(0), seen, items, scores, 5, by="request_id").count() == 0


@pytest.fixture(scope="module")
def plane(spark):
    points = [(i, [1.0, i / 10.0]) for i in range(12)]
    items = [(i, f"t{i}", "even" if i % 2 == 0 else "odd", "x", float(i)) for i in range(11)]  # item 11 has no metadata
    return spark.createDataFrame(points, "item_id bigint, vector array<double>"), spark.createDataFrame(items, "item_id bigint, title string, category string, brand string, price double")


def test_similar_fills_the_list_from_what_passes(spark, plane):
    vectors, items = plane
    rows = ops.similar(vectors, vectors, items, Filters(categories=["even"], min_price=6.0), 3).where("query_id IN (0, 8)").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["item_id"]) for r in rows] == [(0, 6), (0, 8), (0, 10), (8, 10), (8, 6)]
    assert {(r["query_id"], r["original_count"], r["filtered_count"]) for r in rows} == {(0, 11, 3), (8, 11, 2)}


def test_similar_without_filters_keeps_items_without_metadata(spark, plane):
    vectors, items = plane
    rows = ops.similar(vectors, vectors, items, Filters(), 2).where("query_id = 10").orderBy("rank").collect()
    assert [(r["item_id"], r["filtered_count"]) for r in rows] == [(11, 11), (9, 11)]


def test_similar_reranks_under_its_own_weights(spark, plane):
    vectors, items = plane
    stats = spark.createDataFrame([(4, 9), (1, 1)], "item_id bigint, n_users bigint")
    rows = ops.similar(vectors.where("item_id = 0"), vectors, items, Filters(max_price=4.0), 4, stats=stats, n_users=10, strategy="hybrid").collect()
    parts = {r["item_id"]: sum(w * r[name] for name, w in rr.SIMILAR_WEIGHTS.items()) for r in rows}
    assert {r["item_id"]: pytest.approx(r["rerank_score"]) for r in rows} == parts
    assert [r["item_id"] for r in sorted(rows, key=lambda r: r["rank"])] == sorted(parts, key=lambda i: (-round(parts[i], 9), i))
    with pytest.raises(ValueError):
        ops.similar(vectors, vectors, items, Filters(), 4, metric="l2", strategy="hybrid")


def test_echo(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "query_id bigint, category string")
    got = {r["query_id"]: r for r in ops.rerank_echo(rows, "hybrid", rr.SIMILAR_WEIGHTS, "query_id").collect()}
    assert got[1]["category_distribution"] == {"a": 1, "b": 2} and got[2]["category_distribution"] == {"other": 1}
    assert got[1]["weights"] == rr.SIMILAR_WEIGHTS and got[1]["strategy"] == "hybrid" and got[1]["applied"]
    assert ops.rerank_echo(rows, "novelty", rr.SIMILAR_WEIGHTS, "query_id").first()["weights"] == {"novelty": 1.0}


def test_page_size_of_similar_items(spark, plane):
    with pytest.raises(ValueError):
        ops.similar_page(plane[0], 1, 101)
