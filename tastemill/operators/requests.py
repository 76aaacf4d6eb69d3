"""Requests answered from whole rankings: filters work before a list is cut, so a page is full whenever enough items match.

Requests that ask for the same filters share one ranked list. Items meet filters by an equi-join on one key: an included
item, a category, a brand or, for requests with none of these, a cell of prices; the other filters are then checked row by
row. A reader's list is the unseen head of the shared ranking, taken from the gaps between the seen ranks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tastemill.operators import ann, rerank as rr
from tastemill.operators.recommend import MAX_PAGE_SIZE, Filters, apply_filters, paginate, with_metadata
from tastemill.plans.topk import rank_lists, top_k, unseen_heads
from tastemill.session import checkpointed

LIST_FILTERS = ("categories", "brands", "include_items")
FILTER_COLUMNS = (*LIST_FILTERS, "min_price", "max_price")
PRICE_CELLS = 64


def with_list_ids(requests: DataFrame) -> DataFrame:
    """Requests with a ``list_id`` that is the same for the same filters. An empty list means no filter, as null does."""
    for name in LIST_FILTERS:
        requests = requests.withColumn(name, F.when(F.size(name) > 0, F.array_sort(F.array_distinct(name))))
    return requests.withColumn("list_id", F.md5(F.to_json(F.struct(*FILTER_COLUMNS))))


def _price_cuts(items: DataFrame) -> list[float]:
    shares = [i / PRICE_CELLS for i in range(1, PRICE_CELLS)]
    return sorted(set(items.select(F.percentile_approx("price", shares)).first()[0] or []))


def _cell(price: Column, cuts: list[float]) -> Column:
    """Number of cuts up to a price; a null price is in cell 0."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= price)) if cuts else F.lit(0)


def _key(kind: str) -> Callable[[Column], Column]:
    return lambda value: F.concat(F.lit(f"{kind}:"), value.cast("string"))


def _passes() -> Column:
    def unless_null(column: str, test: Column) -> Column:
        return F.col(column).isNull() | F.coalesce(test, F.lit(False))

    return (
        unless_null("categories", F.array_contains("categories", F.col("category")))
        & unless_null("brands", F.array_contains("brands", F.col("brand")))
        & unless_null("include_items", F.array_contains("include_items", F.col("item_id")))
        & unless_null("min_price", F.col("price") >= F.col("min_price"))
        & unless_null("max_price", F.col("price") <= F.col("max_price"))
    )


def filter_lists(sets: DataFrame, items: DataFrame, scored: DataFrame) -> DataFrame:
    """The items of ``scored(item_id, score, ...)`` that pass each of ``sets(list_id, categories, brands, include_items,
    min_price, max_price)``, with their metadata. Every pair of list and item meets under one key only."""
    cuts = _price_cuts(items)
    low = _cell(F.col("min_price"), cuts)
    high = F.when(F.col("max_price").isNull(), F.lit(len(cuts))).otherwise(_cell(F.col("max_price"), cuts))
    keys = (
        F.when(F.col("include_items").isNotNull(), F.transform("include_items", _key("item")))
        .when(F.col("categories").isNotNull(), F.transform("categories", _key("category")))
        .when(F.col("brands").isNotNull(), F.transform("brands", _key("brand")))
        .otherwise(F.transform(F.sequence(low, F.greatest(low, high)), _key("price")))
    )
    offered = items.join(scored, "item_id")
    own = F.array(_key("item")(F.col("item_id")), _key("category")(F.col("category")), _key("brand")(F.col("brand")), _key("price")(_cell(F.col("price"), cuts)))
    met = offered.withColumn("_key", F.explode(own)).join(sets.withColumn("_key", F.explode(keys)), "_key")
    return met.where(_passes()).select("list_id", *offered.columns)


def answer(requests: DataFrame, inter: DataFrame, items: DataFrame, scored: DataFrame, k: int, by: str = "user_id") -> DataFrame:
    """The asked page of the k best items that pass each request's filters and that its user has not seen.

    ``requests(user_id, page, page_size, categories, brands, min_price, max_price, exclude_items, include_items)`` with one
    row per ``by``, which names the column that tells requests apart; ``scored(item_id, score, ...)`` ranks the catalog.
    Excluded items count as seen. A request without a matching item has no rows.
    """
    asked = checkpointed(with_list_ids(requests))
    ranking = checkpointed(rank_lists(filter_lists(asked.select("list_id", *FILTER_COLUMNS).dropDuplicates(["list_id"]), items, scored)))
    readers = asked.select(F.col(by).alias("_reader"), "user_id", "list_id", "exclude_items")
    own = inter.select("user_id", "item_id").join(readers.select("_reader", "user_id"), "user_id").select(F.col("_reader").alias("user_id"), "item_id")
    excluded = readers.select(F.col("_reader").alias("user_id"), F.explode("exclude_items").alias("item_id"))
    found = unseen_heads(readers.select(F.col("_reader").alias("user_id"), "list_id"), own.unionByName(excluded).distinct(), ranking, k)
    pages = asked.select(*dict.fromkeys([by, "user_id", "page", "page_size"]))
    return paginate(found.drop("list_id", "item_rank").withColumnRenamed("user_id", by).join(pages, by), F.col("page"), F.col("page_size"), by)


def reranked(rows: DataFrame, stats: DataFrame, n_users: int, strategy: str, weights: dict[str, float], by: str) -> DataFrame:
    """Lists in their new order: ``rank`` is the new place, ``rerank_score`` and the components are added."""
    return rr.rerank(rr.components(rows, stats, n_users, by), strategy, weights, by).withColumn("rank", F.col("new_rank")).drop("new_rank")


def rerank_echo(rows: DataFrame, strategy: str, weights: dict[str, float], by: str = "user_id") -> DataFrame:
    """What a reranked answer says about itself, one row per list: the strategy, the weights that it used (none but those of
    the hybrid) and how many items of the list are in each category."""
    used = weights if strategy == "hybrid" else {strategy: 1.0}
    counts = rows.groupBy(by, F.coalesce("category", F.lit("other")).alias("category")).agg(F.count("*").alias("n"))
    shares = F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_distribution")
    pairs = [F.lit(x) for name in sorted(used) for x in (name, float(used[name]))]
    return counts.groupBy(by).agg(shares).select(by, F.lit(strategy).alias("strategy"), F.lit(True).alias("applied"), F.create_map(*pairs).alias("weights"), "category_distribution")


def similar(
    queries: DataFrame, vectors: DataFrame, items: DataFrame, filters: Filters, k: int, metric: str = "cosine",
    stats: DataFrame | None = None, n_users: int = 0, strategy: str | None = None, weights: dict[str, float] | None = None,
) -> DataFrame:
    """The k nearest other items that pass the filters, with metadata and the counts of ``filter_info``.

    ``queries(item_id, vector)`` are rows of ``vectors``. ``original_count`` is the number of other items, and
    ``filtered_count`` that of those which pass. With a strategy the lists are reranked by ``stats(item_id, n_users)`` under
    the weights of similar items; that needs a score that is larger for nearer items.
    """
    if strategy and metric not in ("cosine", "inner_product"):
        raise ValueError("reranking needs cosine or inner_product")
    allowed = vectors.select("item_id", "vector")
    if filters.any():
        allowed = checkpointed(allowed.join(apply_filters(items, filters).select("item_id"), "item_id", "left_semi"))
    hits = ann.flat_search(ann.as_queries(queries), allowed, k + 1, metric)
    order = F.desc("score") if metric in ("cosine", "inner_product") else F.asc("score")
    top = top_k(hits.where(F.col("query_id") != F.col("item_id")).drop("rank"), ["query_id"], [order, F.asc("item_id")], k)
    rows = with_metadata(top, items)
    if strategy:
        rows = reranked(rows, stats, n_users, strategy, weights or rr.SIMILAR_WEIGHTS, "query_id")
    own = allowed.select(F.col("item_id").alias("query_id"), F.lit(1).alias("_own"))
    counted = rows.join(own, "query_id", "left").withColumn("original_count", F.lit(vectors.count() - 1).cast("bigint"))
    return counted.withColumn("filtered_count", F.lit(allowed.count()).cast("bigint") - F.coalesce("_own", F.lit(0))).drop("_own")


def similar_page(rows: DataFrame, page: int = 1, page_size: int = 10) -> DataFrame:
    """One page of every list of ``similar``."""
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size is 1 to {MAX_PAGE_SIZE}")
    return paginate(rows, page, page_size, "query_id")
