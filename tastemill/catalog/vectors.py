"""Queries over vectors, profiles, indexes and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.catalog import bindings as b
from tastemill.catalog.registry import query
from tastemill.catalog.sequences import GAP, SQL_PAIRS
from tastemill.functions import vectors as v
from tastemill.functions.scalars import rounded
from tastemill.functions.text import weighted_item_text
from tastemill.models.item2vec import profile_recommend
from tastemill.models.text import cache_misses, content_recommend, hashed_vectors, item_texts, tfidf_terms
from tastemill.operators import ann, profiles
from tastemill.operators.sequences import next_item_pairs

K = 10


def _long(df: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """A vector column as (key, pos, value) rows."""
    return df.select(key, F.posexplode(vector).alias("pos", "x")).select(key, "pos", rounded(F.col("x")).alias("value"))


def _sql_long(source: str, key: str, vector: str = "vector") -> str:
    return f"""SELECT {key}, CAST(unnest(range(len({vector}))) AS INTEGER) AS pos, round(unnest({vector}), 6) + 0.0 AS value FROM {source}"""


SQL_COS = "list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector)))"
SQL_IP = "list_dot_product(a.vector, b.vector)"
SQL_L2 = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(a.vector, b.vector)])"


def _sql_flat(score: str, direction: str, extra: str = "") -> str:
    return f"""WITH {b.SQL_VECTORS}, scored AS (SELECT a.item_id AS query_id, b.item_id, {score} AS s FROM vectors a CROSS JOIN vectors b {extra})
SELECT query_id, item_id, round(s, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s {direction}, item_id) AS INTEGER) AS rank
FROM scored QUALIFY rank <= {K}"""


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "item_id", rounded(F.col("score")).alias("score"), "rank")


@query("l2_normalize", f"WITH {b.SQL_VECTORS}, n AS (SELECT item_id, [x / greatest(sqrt(list_dot_product(vector, vector)), 1e-12) FOR x IN vector] AS vector FROM vectors) " + _sql_long("n", "item_id"))
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _long(b.item_vectors(spark, d).withColumn("vector", v.l2_normalize(F.col("vector"))), "item_id")


@query("cosine_pairs", f"""WITH {b.SQL_VECTORS}, {SQL_PAIRS}, followed AS (SELECT DISTINCT prev_item, next_item FROM pairs)
SELECT n.prev_item, n.next_item, round({SQL_COS}, 6) + 0.0 AS cosine, round({SQL_L2}, 6) + 0.0 AS l2, round({SQL_IP}, 6) + 0.0 AS dot
FROM followed n JOIN vectors a ON a.item_id = n.prev_item JOIN vectors b ON b.item_id = n.next_item""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The three measures for every pair of items that follow each other in a session."""
    rows = b.item_vectors(spark, d)
    pairs = next_item_pairs(b.clicks(spark, d), GAP).select("prev_item", "next_item").distinct()
    scored = ann.pair_scores(pairs, rows, rows, "prev_item", "next_item")
    va, vb = F.col("va"), F.col("vb")
    return scored.select("prev_item", "next_item", rounded(v.cosine(va, vb)).alias("cosine"), rounded(v.l2_distance(va, vb)).alias("l2"), rounded(v.dot(va, vb)).alias("dot"))


@query("ann_flat_ip", _sql_flat(SQL_IP, "DESC"))
def ann_flat_ip(spark: SparkSession, d: str) -> DataFrame:
    rows = b.item_vectors(spark, d)
    return _shown(ann.flat_search(ann.as_queries(rows), rows, K, "inner_product"))


@query("ann_flat_l2", _sql_flat(SQL_L2, "ASC"))
def ann_flat_l2(spark: SparkSession, d: str) -> DataFrame:
    rows = b.item_vectors(spark, d)
    return _shown(ann.flat_search(ann.as_queries(rows), rows, K, "l2"))


@query("ann_flat_cosine", _sql_flat(SQL_COS, "DESC"))
def ann_flat_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = b.item_vectors(spark, d)
    return _shown(ann.VectorIndex.build(rows.select("item_id", "vector"), "Flat", "cosine").search(ann.as_queries(rows), K))


@query("similar_items", _sql_flat(SQL_COS, "DESC", "WHERE a.item_id <> b.item_id"))
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    return _shown(ann.similar_items(b.item_vectors(spark, d).select("item_id", "vector"), K))


SQL_CELLS = b.SQL_VECTORS + """, parts AS (SELECT label, unnest(range(len(vector))) AS pos, unnest(vector) AS x FROM vectors),
means AS (SELECT label, pos, avg(x) AS x FROM parts GROUP BY label, pos), centroids AS (SELECT label AS cell, list(x ORDER BY pos) AS vector FROM means GROUP BY label)"""


def _label_cells(spark: SparkSession, d: str, nprobe: int = 3) -> ann.VectorIndex:
    rows = b.item_vectors(spark, d)
    centroids = profiles.label_means(rows, "label", v.vector_size(rows, "vector")).withColumnRenamed("label", "cell")
    return ann.VectorIndex.from_cells(rows.withColumnRenamed("label", "cell"), centroids, "inner_product", nprobe)


@query("ivf_probe_given_cells", f"""WITH {SQL_CELLS}, probes AS (
  SELECT a.item_id AS query_id, a.vector, b.cell FROM vectors a CROSS JOIN centroids b
  QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY {SQL_L2}, b.cell) <= 3),
scored AS (SELECT a.query_id, b.item_id, {SQL_IP} AS s FROM probes a JOIN vectors b ON b.label = a.cell)
SELECT query_id, item_id, round(s, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= {K}""")
def ivf_probe_given_cells(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_label_cells(spark, d).search(ann.as_queries(b.item_vectors(spark, d)), K))


@query("label_centroids", f"WITH {SQL_CELLS} " + _sql_long("centroids", "cell"))
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _long(_label_cells(spark, d).centroids, "cell")


@query("ann_ivf")
def ann_ivf(spark: SparkSession, d: str) -> DataFrame:
    """K-means cells, 10 probes; checked by its recall against the exact search."""
    rows = b.item_vectors(spark, d).select("item_id", "vector")
    return _shown(ann.VectorIndex.build(rows, "IVF_Flat", "inner_product").search(ann.as_queries(rows), K))


@query("ann_ivf_all_cells", _sql_flat(SQL_IP, "DESC"))
def ann_ivf_all_cells(spark: SparkSession, d: str) -> DataFrame:
    """With all k-means cells probed the cell index is exact."""
    rows = b.item_vectors(spark, d).select("item_id", "vector")
    index = ann.VectorIndex.build(rows, "IVF_HNSW", "inner_product", nlist=20, nprobe=20)
    return _shown(index.search(ann.as_queries(rows), K))


@query("index_append", f"""WITH {SQL_CELLS}, fresh AS (SELECT item_id + 1000000 AS item_id, vector FROM vectors WHERE label < 5 UNION ALL SELECT item_id, [-x FOR x IN vector] FROM vectors WHERE label = 9),
assigned AS (SELECT a.item_id, b.cell FROM fresh a CROSS JOIN centroids b QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY {SQL_L2}, b.cell) = 1)
SELECT item_id, CAST(cell AS INTEGER) AS cell FROM assigned UNION ALL SELECT item_id, label FROM vectors WHERE label <> 9""")
def index_append(spark: SparkSession, d: str) -> DataFrame:
    """New ids take the nearest cell; ids that are there already take the new vector."""
    rows = b.item_vectors(spark, d)
    copies = rows.where("label < 5").select((F.col("item_id") + 1000000).alias("item_id"), "vector")
    turned = rows.where("label = 9").select("item_id", F.transform("vector", lambda x: -x).alias("vector"))
    return _label_cells(spark, d).add(copies.unionByName(turned)).vectors.select("item_id", "cell")


@query("lookup_vectors", f"WITH {b.SQL_VECTORS}, {b.SQL_CLICKS} SELECT DISTINCT c.item_id, label FROM clicks c JOIN vectors v ON v.item_id = c.item_id * 7")
def lookup_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Numbers beyond the table give no row."""
    asked = b.clicks(spark, d).select("item_id").distinct().withColumn("vec", F.col("item_id") * 7)
    rows = b.item_vectors(spark, d).withColumnRenamed("item_id", "vec")
    return profiles.lookup_vectors(asked, rows, "vec").select("item_id", "label")


@query("lookup_vectors_zero", f"""WITH {b.SQL_VECTORS}, asked AS (SELECT p_partkey AS item_id FROM part), found AS (
SELECT a.item_id, coalesce(v.vector, [0.0::DOUBLE FOR i IN range(64)]) AS vector FROM asked a LEFT JOIN vectors v USING (item_id)) """ + _sql_long("found", "item_id"))
def lookup_vectors_zero(spark: SparkSession, d: str) -> DataFrame:
    rows = b.item_vectors(spark, d).select("item_id", "vector")
    return _long(profiles.lookup_vectors_zero(b.items(spark, d).select("item_id"), rows, v.vector_size(rows, "vector")), "item_id")


@query("vector_fallback", f"""WITH {b.SQL_VECTORS} SELECT p_partkey AS item_id, CASE WHEN v.label < 5 THEN 'content' WHEN v.label IS NOT NULL THEN 'factors' ELSE 'missing' END AS vector_source,
CASE WHEN v.label < 5 THEN round(vector[1], 6) + 0.0 WHEN v.label IS NOT NULL THEN round(vector[2], 6) + 0.0 END AS first
FROM part LEFT JOIN vectors v ON v.item_id = p_partkey""")
def vector_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Content vectors exist for half of the labels; the factors are the same vectors without their first entry."""
    rows = b.item_vectors(spark, d)
    content = rows.where("label < 5").select("item_id", "vector")
    factors = rows.select("item_id", F.slice("vector", 2, 63).alias("vector"))
    found = profiles.first_available(b.items(spark, d).select("item_id"), [("content", content), ("factors", factors)])
    return found.select("item_id", "vector_source", rounded(F.col("vector")[0]).alias("first"))


SQL_OWN = b.SQL_VECTORS + ", " + b.SQL_CLICK_INTER + """, own AS (SELECT user_id, strength, v.vector FROM cinter JOIN vectors v USING (item_id)),
parts AS (SELECT user_id, strength, unnest(range(len(vector))) AS pos, unnest(vector) AS x FROM own)"""
SQL_MEAN = SQL_OWN + """, means AS (SELECT user_id, pos, avg(x) AS x FROM parts GROUP BY user_id, pos), profiles AS (SELECT user_id, list(x ORDER BY pos) AS vector FROM means GROUP BY user_id)"""
SQL_WEIGHTED = SQL_OWN + """, means AS (SELECT user_id, pos, sum(strength * x) / sum(strength) AS x FROM parts GROUP BY user_id, pos),
raw AS (SELECT user_id, list(x ORDER BY pos) AS vector FROM means GROUP BY user_id),
profiles AS (SELECT user_id, [x / greatest(sqrt(list_dot_product(vector, vector)), 1e-12) FOR x IN vector] AS vector FROM raw)"""


@query("user_profile_mean", f"WITH {SQL_MEAN} " + _sql_long("profiles", "user_id"))
def user_profile_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = b.item_vectors(spark, d).select("item_id", "vector")
    return _long(profiles.mean_profile(b.click_interactions(spark, d), rows, v.vector_size(rows, "vector")), "user_id")


@query("user_profile_weighted", f"WITH {SQL_WEIGHTED} " + _sql_long("profiles", "user_id"))
def user_profile_weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = b.item_vectors(spark, d).select("item_id", "vector")
    return _long(profiles.weighted_profile(b.click_interactions(spark, d), rows, v.vector_size(rows, "vector")), "user_id")


@query("user_profile_gaps", f"""WITH {b.SQL_VECTORS}, {b.SQL_CLICK_INTER}, own AS (SELECT user_id, strength AS w, vector FROM cinter JOIN vectors USING (item_id) WHERE item_id % 5 <> 0 AND item_id % 7 <> 0),
sums AS (SELECT user_id, sum(w * vector[1]) / sum(w) AS first, sum(w * vector[len(vector)]) / sum(w) AS last FROM own GROUP BY user_id)
SELECT user_id, unnest([64, 128])::INTEGER AS width, round(first, 6) + 0.0 AS first, round(last, 6) + 0.0 AS last FROM sums""")
def user_profile_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Weighted means at two widths where a fifth of the items lost its weight and a seventh an entry of its vector: these take no part."""
    gap = lambda x, i: F.when((i != 3) | (F.col("item_id") % 7 != 0), x)
    rows = b.item_vectors(spark, d).select("item_id", F.transform("vector", gap).alias("vector"))
    history = b.click_interactions(spark, d).select("user_id", "item_id", F.when(F.col("item_id") % 5 != 0, F.col("strength")).alias("strength"))
    wide = rows.select("item_id", F.concat("vector", "vector").alias("vector"))
    found = [v.mean_vectors(history.join(table, "item_id"), ["user_id"], "vector", width, "vector", weight="strength").withColumn("width", F.lit(width)) for table, width in ((rows, 64), (wide, 128))]
    shown = found[0].unionByName(found[1])
    return shown.select("user_id", "width", rounded(F.element_at("vector", 1)).alias("first"), rounded(F.element_at("vector", -1)).alias("last"))


def _sql_profile_topk(profiles_sql: str, score: str, shown: str = "TRUE") -> str:
    return f"""WITH {profiles_sql}, scored AS (SELECT a.user_id, b.item_id, {score} AS s FROM profiles a CROSS JOIN vectors b
WHERE NOT EXISTS (SELECT 1 FROM cinter c WHERE c.user_id = a.user_id AND c.item_id = b.item_id) AND {shown})
SELECT user_id, item_id, round(s, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= {K}"""


@query("profile_recommend", _sql_profile_topk(SQL_MEAN, SQL_COS))
def profile_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, history = b.item_vectors(spark, d).select("item_id", "vector"), b.click_interactions(spark, d)
    found = profile_recommend(history.select("user_id").distinct(), history, rows, v.vector_size(rows, "vector"), K)
    return found.select("user_id", "item_id", rounded(F.col("score")).alias("score"), "rank")


@query("content_recommend", _sql_profile_topk(SQL_WEIGHTED, SQL_IP, "b.item_id IN (SELECT p_partkey FROM part WHERE p_retailprice >= 905)"))
def content_topk(spark: SparkSession, d: str) -> DataFrame:
    """Only items of the mapping (parts from 905 up) may be shown."""
    rows, history = b.item_vectors(spark, d).select("item_id", "vector"), b.click_interactions(spark, d)
    mapping = b.items(spark, d).where("price >= 905").select("item_id")
    found = content_recommend(history.select("user_id").distinct(), history, rows, v.vector_size(rows, "vector"), K, mapping=mapping)
    return found.select("user_id", "item_id", rounded(F.col("score")).alias("score"), "rank")


@query("feature_sum_vectors", f"""WITH {b.SQL_VECTORS}, emb AS (SELECT * FROM vectors), feats AS (
  SELECT p_partkey AS item_id, 'b' || substr(p_brand, 7) AS feature, 1.0::DOUBLE AS weight, CAST(substr(p_brand, 7) AS BIGINT) AS vec FROM part
  UNION ALL SELECT p_partkey, 's' || p_size, 0.5::DOUBLE, p_size + 100 FROM part),
parts AS (SELECT f.item_id, unnest(range(len(vector))) AS pos, unnest([x * weight FOR x IN vector]) AS x, label * weight AS bias FROM feats f JOIN emb e ON e.item_id = f.vec)
SELECT item_id, CAST(pos AS INTEGER) AS pos, round(sum(x), 6) + 0.0 AS value, sum(bias) AS bias FROM parts GROUP BY item_id, pos""")
def feature_sum_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Brand and size of a part as features with weights 1 and 0.5; the label serves as bias."""
    parts = b.table(spark, d, "part")
    brand = F.substring("p_brand", 7, 10)
    features = parts.select(F.col("p_partkey").alias("item_id"), F.explode(F.array(
        F.struct(F.concat(F.lit("b"), brand).alias("feature"), F.lit(1.0).alias("weight")),
        F.struct(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("feature"), F.lit(0.5).alias("weight")),
    )).alias("f")).select("item_id", "f.*")
    number = F.col("item_id")
    names = F.array(F.concat(F.lit("b"), number.cast("string")), F.concat(F.lit("s"), (number - 100).cast("string")))
    embeddings = b.item_vectors(spark, d).select(F.explode(names).alias("feature"), "vector", F.col("label").cast("double").alias("bias"))
    rows = profiles.feature_sums(features, embeddings, v.vector_size(embeddings, "vector"))
    return rows.select("item_id", "bias", F.posexplode("vector").alias("pos", "x")).select("item_id", "pos", rounded(F.col("x")).alias("value"), "bias")


# ---------------------------------------------------------------------------------------------------------------------


@query("weighted_item_text", f"""WITH {b.SQL_ITEMS}, d AS (SELECT item_id, title, CASE WHEN category <> 'PROMO' THEN category END AS category, CASE WHEN brand <> 'Brand#1' THEN brand ELSE '' END AS brand FROM items)
SELECT item_id, concat_ws(' | ', nullif(title, ''), nullif(title, ''), nullif(category, ''), nullif(brand, '')) AS text FROM d""")
def item_text(spark: SparkSession, d: str) -> DataFrame:
    rows = b.items(spark, d).withColumn("category", F.when(F.col("category") != "PROMO", F.col("category")))
    rows = rows.withColumn("brand", F.when(F.col("brand") != "Brand#1", F.col("brand")).otherwise(F.lit("")))
    return rows.select("item_id", weighted_item_text({c: F.col(c) for c in ("title", "category", "brand")}).alias("text"))


@query("tfidf_terms", r"""WITH terms AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM terms WHERE term <> '' GROUP BY ALL), df AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term)
SELECT doc_id AS item_id, term, tf, df, round(tf * ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)), 6) + 0.0 AS tfidf FROM tf JOIN df USING (term)""")
def terms(spark: SparkSession, d: str) -> DataFrame:
    rows = tfidf_terms(b.item_documents(spark, d))
    return rows.select("item_id", "term", "tf", "df", rounded(F.col("tfidf")).alias("tfidf"))


@query("text_vectors", r"""WITH t AS (SELECT doc_id, len([w FOR w IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF w <> '']) > 0 AS has_words FROM documents)
SELECT doc_id AS item_id, CASE WHEN has_words THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length, CAST(384 AS INTEGER) AS dim, CASE WHEN has_words THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS self_score FROM t""")
def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Hashed TF-IDF vectors of all documents: unit length, or zero for a text without words."""
    rows = hashed_vectors(b.item_documents(spark, d).select("item_id", "text"), 384)
    return rows.select("item_id", rounded(v.norm(F.col("vector"))).alias("length"), F.size("vector").alias("dim"), rounded(v.dot(F.col("vector"), F.col("vector"))).alias("self_score"))


@query("embed_cache_misses", f"""WITH {b.SQL_ITEMS}, t AS (SELECT item_id, concat_ws(' | ', title, title, category, brand) AS text, concat_ws(' | ', title, title, category) AS old_text, price FROM items)
SELECT item_id, sha256(text) AS text_hash FROM t WHERE NOT (price < 950 AND text = old_text) AND NOT price >= 950""")
def embed_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """The cache holds current texts of parts from 950 up and outdated texts (no brand) of the cheaper ones."""
    rows = b.items(spark, d)
    texts = item_texts(rows)
    current = texts.join(rows.where("price >= 950").select("item_id"), "item_id", "left_semi")
    outdated = item_texts(rows.where("price < 950").drop("brand"))
    cache = current.unionByName(outdated).select("item_id", F.sha2("text", 256).alias("text_hash"))
    return cache_misses(texts, cache).select("item_id", "text_hash")
