"""Serving semantics as set operations: candidate lists, filters, pages, enriched and nested answers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastemill.functions.scalars import page_count
from tastemill.plans.topk import rank_items, top_k, unseen_heads

# Fixed values of the request contract.
BUFFER_FACTOR = 3
BUFFER_CAP = 1000
MAX_PAGE_SIZE = 100


@dataclass
class Filters:
    """Item filters of a request; an empty list or None means no filter."""

    categories: list[str] = field(default_factory=list)
    brands: list[str] = field(default_factory=list)
    min_price: float | None = None
    max_price: float | None = None
    exclude_items: list = field(default_factory=list)
    include_items: list = field(default_factory=list)

    def any(self) -> bool:
        lists = self.categories or self.brands or self.exclude_items or self.include_items
        return bool(lists) or self.min_price is not None or self.max_price is not None

    def asks_buffer(self) -> bool:
        """A price bound of 0 does not count here."""
        return bool(self.categories or self.brands or self.min_price or self.max_price or self.exclude_items or self.include_items)

    def condition(self) -> Column:
        """True for items that pass; a null price fails any price bound, and exclusion beats inclusion."""
        keep = F.lit(True)
        if self.categories:
            keep &= F.col("category").isin(self.categories)
        if self.brands:
            keep &= F.col("brand").isin(self.brands)
        if self.min_price is not None:
            keep &= F.col("price") >= self.min_price
        if self.max_price is not None:
            keep &= F.col("price") <= self.max_price
        if self.include_items:
            keep &= F.col("item_id").isin(self.include_items)
        if self.exclude_items:
            keep &= ~F.col("item_id").isin(self.exclude_items)
        return keep

    def applied(self) -> dict:
        """Lists for categories and brands, values for prices, counts for item lists."""
        info: dict = {}
        if self.categories:
            info["categories"] = list(self.categories)
        if self.brands:
            info["brands"] = list(self.brands)
        if self.min_price is not None:
            info["min_price"] = self.min_price
        if self.max_price is not None:
            info["max_price"] = self.max_price
        if self.include_items:
            info["included_items"] = len(self.include_items)
        if self.exclude_items:
            info["excluded_items"] = len(self.exclude_items)
        return info


def apply_filters(df: DataFrame, filters: Filters, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows that pass. Long item lists come as frames with ``item_id`` and are joined, not written into the plan."""
    kept = df.where(filters.condition()) if filters.any() else df
    if include is not None:
        kept = kept.join(include.select("item_id"), "item_id", "left_semi")
    if exclude is not None:
        kept = kept.join(exclude.select("item_id"), "item_id", "left_anti")
    return kept


def filter_info(lists: DataFrame, filters: Filters, by: str = "user_id") -> DataFrame:
    return lists.groupBy(by).agg(
        F.count("*").alias("original_count"), F.count_if(F.coalesce(filters.condition(), F.lit(False))).alias("filtered_count")
    )


def with_metadata(df: DataFrame, items: DataFrame) -> DataFrame:
    """Item columns next to each row; unknown items keep null metadata."""
    return df.join(items, "item_id", "left")


def popular_unseen(users: DataFrame, inter: DataFrame, popularity: DataFrame, k: int, exclude_seen: bool = True) -> DataFrame:
    """The k most popular items per user, without the user's own; ``popularity(item_id, score, ...)`` may be filtered before."""
    ranking = rank_items(popularity)
    seen = inter if exclude_seen else inter.where(F.lit(False))
    return unseen_heads(users, seen, ranking, k).drop("item_rank")


def buffered_k(k: int, filters: Filters) -> int:
    """List length requested before filtering in the compatibility mode."""
    return max(k, min(k * BUFFER_FACTOR, BUFFER_CAP)) if filters.asks_buffer() else k


def paginate(df: DataFrame, page: int | Column, page_size: int | Column, by: str = "user_id", order: list[Column] | None = None) -> DataFrame:
    """One page per list with its page info. The page number is clamped to the pages there are.

    Lists are recommendation lists of at most ``BUFFER_CAP`` rows, so the window per list is bounded.
    """
    page = F.lit(page) if isinstance(page, int) else page
    size = F.lit(page_size) if isinstance(page_size, int) else page_size
    group = Window.partitionBy(by)
    order = order or [F.asc("rank")]
    counted = df.withColumn("position", F.row_number().over(group.orderBy(*order))).withColumn("total", F.count("*").over(group))
    counted = counted.withColumn("page_size", size.cast("bigint")).withColumn("total_pages", page_count(F.col("total"), size))
    counted = counted.withColumn("page", F.greatest(F.lit(1), F.least(page.cast("bigint"), F.col("total_pages"))))
    start = (F.col("page") - 1) * F.col("page_size")
    shown = counted.where((F.col("position") > start) & (F.col("position") <= start + F.col("page_size")))
    return shown.withColumn("has_next", F.col("page") < F.col("total_pages")).withColumn("has_prev", F.col("page") > 1)


def recommend_request(users: DataFrame, inter: DataFrame, items: DataFrame, popularity: DataFrame, filters: Filters, k: int, page: int = 1, page_size: int = 10) -> DataFrame:
    """Filter the catalog, rank it once, take each user's unseen head, enrich and cut the page."""
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size is 1 to {MAX_PAGE_SIZE}")
    candidates = popularity.join(apply_filters(items, filters), "item_id")
    return paginate(popular_unseen(users, inter, candidates, k), page, page_size)


def answer_requests(requests: DataFrame, lists: DataFrame, items: DataFrame, by: str = "user_id") -> DataFrame:
    """Requests with their own filters against ready lists (filter after the list is cut, as an online service does).

    ``requests(user_id, page, page_size, categories, brands, min_price, max_price, exclude_items, include_items)``; null
    means no filter.
    """
    rows = with_metadata(lists, items).join(requests, by)

    def unless_null(column: str, test: Column) -> Column:
        return F.col(column).isNull() | F.coalesce(test, F.lit(False))

    keep = (
        unless_null("categories", F.array_contains("categories", F.col("category")))
        & unless_null("brands", F.array_contains("brands", F.col("brand")))
        & unless_null("min_price", F.col("price") >= F.col("min_price"))
        & unless_null("max_price", F.col("price") <= F.col("max_price"))
        & unless_null("include_items", F.array_contains("include_items", F.col("item_id")))
        & unless_null("exclude_items", ~F.array_contains("exclude_items", F.col("item_id")))
    )
    return paginate(rows.where(keep), F.col("page"), F.col("page_size"), by)


def nested_response(df: DataFrame, columns: list[str], by: str = "user_id") -> DataFrame:
    """One row per list: id, recommendations as an array in order, and the same as JSON text. Lists are bounded by k."""
    rows = F.sort_array(F.collect_list(F.struct("rank", *columns)))
    nested = df.groupBy(by).agg(rows.alias("recommendations"))
    return nested.withColumn("response", F.to_json(F.struct(by, "recommendations")))


def similar_without_self(hits: DataFrame, k: int) -> DataFrame:
    """Neighbours without the query item itself and without repeats, cut to k."""
    others = hits.where(F.col("query_id") != F.col("item_id")).groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return top_k(others, ["query_id"], [F.desc("score"), F.asc("item_id")], k)


def unknown_ids(requested: DataFrame, known: DataFrame, key: str, kind: str) -> DataFrame:
    """Requested ids that do not exist, as error rows."""
    return requested.select(key).distinct().join(known.select(key), key, "left_anti").select(F.col(key).cast("string").alias("id"), F.lit(kind).alias("kind"))


def category_distribution(lists: DataFrame, by: str = "user_id") -> DataFrame:
    return lists.groupBy(by, "category").agg(F.count("*").alias("n"))
