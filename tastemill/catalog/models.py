"""Queries that fit models. Their results depend on numeric optimisation, so most have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.catalog import bindings as b
from tastemill.catalog.registry import query
from tastemill.catalog.sequences import GAP
from tastemill.functions.scalars import rounded
from tastemill.models import skipgram, training
from tastemill.models.als import ALSModel
from tastemill.models.base import load_model
from tastemill.models.ease import EASEModel, ease_weights
from tastemill.models.hybrid import HybridModel, compose
from tastemill.models.item2vec import Item2VecModel
from tastemill.models.sgd import BPRModel, FeatureFactorModel
from tastemill.models.text import TextEmbeddingModel
from tastemill.operators import privacy, sequences
from tastemill.operators.ann import VectorIndex, as_queries
from tastemill.plans.ordered import dense_index
from tastemill.session import checkpointed, work_path

K = 10


def _shown(recs: DataFrame) -> DataFrame:
    return recs.select("user_id", "item_id", rounded(F.col("score").cast("double")).alias("score"), "rank")


def _als(factors: int = 16, iterations: int = 5) -> ALSModel:
    return ALSModel(factors=factors, regularization=0.05, alpha=1.0, iterations=iterations)


def inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return b.stored_interactions(spark, d), b.users(spark, d)


@query("als_recommend")
def als_recommend(spark: SparkSession, d: str) -> DataFrame:
    inter, users = inputs(spark, d)
    return _shown(_als().fit(inter).recommend(users, inter, K))


@query("als_foldin", "SELECT o_custkey AS user_id, TRUE AS same FROM (SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")
def als_foldin(spark: SparkSession, d: str) -> DataFrame:
    """Every user's factors refitted from the item factors equal the factors of the fit."""
    inter, _ = inputs(spark, d)
    model = _als().fit(inter)
    fitted = model.user_vectors().withColumnRenamed("vector", "fitted")
    joined = model.fold_in(inter).join(fitted, "user_id")
    gap = F.aggregate(F.zip_with("vector", "fitted", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: F.greatest(acc, x))
    return joined.select("user_id", (gap < 1e-4).alias("same"))


@query("bpr_recommend")
def bpr_recommend(spark: SparkSession, d: str) -> DataFrame:
    inter, users = inputs(spark, d)
    return _shown(BPRModel(factors=16, learning_rate=0.1, iterations=3).fit(inter).recommend(users, inter, K))


@query("fm_recommend")
def fm_recommend(spark: SparkSession, d: str) -> DataFrame:
    """Factorisation over item, category and brand features."""
    inter, users = inputs(spark, d)
    model = FeatureFactorModel(no_components=16, learning_rate=0.1, loss="logistic", epochs=3).fit(inter, b.items(spark, d))
    return _shown(model.recommend(users, inter, K))


@query("warp_recommend")
def warp_recommend(spark: SparkSession, d: str) -> DataFrame:
    inter, users = inputs(spark, d)
    model = FeatureFactorModel(no_components=16, learning_rate=0.1, loss="warp", epochs=2).fit(inter, b.items(spark, d))
    return _shown(model.recommend(users, inter, K))


@query("fm_predict")
def fm_predict(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all clicked pairs."""
    inter, _ = inputs(spark, d)
    model = FeatureFactorModel(no_components=16, learning_rate=0.1, loss="logistic", epochs=2).fit(inter, b.items(spark, d))
    pairs = b.click_interactions(spark, d).select("user_id", "item_id")
    return model.predict(pairs).withColumn("score", rounded(F.col("score")))


@query("ease_weights")
def ease_query(spark: SparkSession, d: str) -> DataFrame:
    inter, _ = inputs(spark, d)
    weights = ease_weights(inter, 20, 10.0)
    return weights.withColumn("weight", rounded(F.col("weight")))


@query("ease_weights_pair", f"""WITH {b.SQL_INTERACTIONS}, diag AS (SELECT item_id, sum(strength * strength) + 10.0::DOUBLE AS v FROM inter GROUP BY item_id),
gram AS (SELECT x.item_id AS i, y.item_id AS j, sum(x.strength * y.strength) AS g FROM inter x JOIN inter y ON x.user_id = y.user_id AND x.item_id <> y.item_id GROUP BY ALL),
near AS (SELECT i, j, g, row_number() OVER (PARTITION BY i ORDER BY g DESC, j) AS r FROM gram QUALIFY r <= 2),
pairs AS (SELECT p.i, p.j AS a, q.j AS b, p.g AS ga, coalesce(q.g, 0) AS gb, da.v AS da, coalesce(db.v, 1.0) AS db, coalesce(c.g, 0) AS c
  FROM near p LEFT JOIN near q ON q.i = p.i AND q.r = 2 JOIN diag da ON da.item_id = p.j LEFT JOIN diag db ON db.item_id = q.j LEFT JOIN gram c ON c.i = p.j AND c.j = q.j WHERE p.r = 1)
SELECT a AS item_id, i AS other_id, round((ga * db - gb * c) / (da * db - c * c), 6) + 0.0 AS weight FROM pairs
UNION ALL SELECT b, i, round((gb * da - ga * c) / (da * db - c * c), 6) + 0.0 FROM pairs WHERE b IS NOT NULL""")
def ease_weights_pair(spark: SparkSession, d: str) -> DataFrame:
    """Ridge weights over the two strongest neighbours, which SQL can solve by hand."""
    inter, _ = inputs(spark, d)
    weights = ease_weights(inter, 2, 10.0)
    return weights.withColumn("weight", rounded(F.col("weight")))


@query("ease_recommend")
def ease_recommend(spark: SparkSession, d: str) -> DataFrame:
    inter, users = inputs(spark, d)
    return _shown(EASEModel(lambda_=10.0, neighbours=20).fit(inter).recommend(users, inter, K))


def _item2vec(spark: SparkSession, d: str) -> Item2VecModel:
    """With the documented settings: 128 dimensions, window 5, 5 epochs."""
    sessions = sequences.sessionize(b.clicks(spark, d), GAP)
    return Item2VecModel().fit(b.click_interactions(spark, d), sessions=sessions)


@query("item2vec_pairs", f"""WITH {b.SQL_CLICKS}, m AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL {GAP} SECOND, true) AS first FROM clicks WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(first::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM m),
p AS (SELECT user_id, session_no, item_id, row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS pos FROM s)
SELECT x.item_id AS centre, y.item_id AS context, round(sum(6 - abs(x.pos - y.pos)) / 5.0, 6) + 0.0 AS n
FROM p x JOIN p y ON x.user_id = y.user_id AND x.session_no = y.session_no AND x.pos <> y.pos AND abs(x.pos - y.pos) <= 5 WHERE x.item_id IS NOT NULL AND y.item_id IS NOT NULL GROUP BY ALL""")
def item2vec_pairs(spark: SparkSession, d: str) -> DataFrame:
    """What the skip-gram model trains on: centre and context items of all click sessions, weighted by distance."""
    sessions = sequences.sessionize(b.clicks(spark, d), GAP)
    places = sessions.select(F.struct("user_id", "session_no").alias("session"), "pos", F.col("item_id").alias("item"))
    return skipgram.window_pairs(places, 5).withColumn("n", rounded(F.col("n")))


@query("item2vec_vectors", f"""WITH {b.SQL_CLICKS}, v AS (SELECT DISTINCT item_id FROM clicks WHERE item_id IS NOT NULL) SELECT item_id, 128::BIGINT AS dimensions, true AS moved FROM v""")
def item2vec_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every clicked item has one vector of finite numbers, longer than the starting ones, whose entries are below 1/256 in size."""
    rows = _item2vec(spark, d).item_vectors()
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("item_id", F.size("vector").cast("bigint").alias("dimensions"), (finite & (square > 128 / 256.0**2)).alias("moved"))


@query("item2vec_training", """SELECT 5::BIGINT AS epochs, true AS falls, true AS same_pairs""")
def item2vec_training(spark: SparkSession, d: str) -> DataFrame:
    """The mean loss of a pair falls from epoch to epoch, and every epoch sees all pairs."""
    losses = _item2vec(spark, d).tables["losses"]
    told = losses.agg(F.sort_array(F.collect_list(F.struct("epoch", "loss", F.round("weight", 3).alias("weight")))).alias("e"))  # one row per epoch
    loss = F.col("e.loss")
    falls = F.forall(F.sequence(F.lit(1), F.size(loss) - 1), lambda k: F.element_at(loss, k + 1) < F.element_at(loss, k))
    return told.select(F.size("e").cast("bigint").alias("epochs"), falls.alias("falls"), (F.size(F.array_distinct("e.weight")) == 1).alias("same_pairs"))


@query("item2vec_recommend")
def item2vec_recommend(spark: SparkSession, d: str) -> DataFrame:
    history = checkpointed(b.click_interactions(spark, d))
    return _shown(_item2vec(spark, d).recommend(history.select("user_id"), history, K))


@query("text_recommend")
def text_recommend(spark: SparkSession, d: str) -> DataFrame:
    """Unseen parts by the words of the parts bought."""
    inter, users = inputs(spark, d)
    model = TextEmbeddingModel(embedding_dim=64).fit(inter, b.items(spark, d))
    return _shown(model.recommend(users, inter, K))


@query("hybrid_from_components")
def hybrid_from_components(spark: SparkSession, d: str) -> DataFrame:
    """Two stored models, one unreadable directory, fused with dynamic weights."""
    inter, users = inputs(spark, d)
    root = work_path(spark, "components")
    _als(8, 3).fit(inter).save(f"{root}/als")
    TextEmbeddingModel(embedding_dim=64).fit(inter, b.items(spark, d)).save(f"{root}/text")
    hybrid = compose(spark, [f"{root}/als", f"{root}/nothing", f"{root}/text"], weights=[0.6, 0.4], cold_start_threshold=40)
    return _shown(hybrid.recommend(users, inter, K))


@query("hybrid_fit")
def hybrid_fit(spark: SparkSession, d: str) -> DataFrame:
    inter, users = inputs(spark, d)
    model = HybridModel(weights=[0.7, 0.3]).with_components([_als(8, 3), EASEModel(lambda_=10.0, neighbours=10)])
    return _shown(model.fit(inter, b.items(spark, d)).recommend(users, inter, K))


@query("train_model")
def train_model(spark: SparkSession, d: str) -> DataFrame:
    """Fit, store, index, load again and search with the stored user vectors."""
    root = work_path(spark, "trained")
    training.train("als", b.purchases(spark, d), root, params={"factors": 16, "iterations": 3})
    model, index = load_model(spark, f"{root}/model"), VectorIndex.load(spark, f"{root}/index")
    hits = index.search(as_queries(model.user_vectors(), "user_id"), K)
    return _shown(hits.withColumnRenamed("query_id", "user_id"))


@query("train_without_deleted", f"""WITH {b.SQL_INTERACTIONS} SELECT DISTINCT user_id FROM inter WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def train_without_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Users of a model trained on the log after some asked to be deleted, honouring the tombstones alone."""
    root = work_path(spark, "honoured")
    events = b.purchases(spark, d)
    privacy.store_events(events.select("user_id", "item_id", "qty", "ts"), root)
    privacy.delete_users(spark, root, b.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id")), confirm=True, key="balance")
    training.train("als", events, f"{root}/als", params={"factors": 8, "iterations": 2}, deleted=privacy.deleted_users(spark, root))
    return load_model(spark, f"{root}/als/model").user_vectors().select("user_id")


@query("fit_and_evaluate")
def fit_and_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """ALS on all but the last items of each user, judged on those."""
    inter, _ = inputs(spark, d)
    train, test = (checkpointed(x) for x in training.split_interactions(inter, "last", n=3))
    score = training.score_model(_als(8, 3).fit(train), train, test, "ndcg@20")
    return test.agg(F.countDistinct("user_id").alias("n_users"), F.lit(round(score, 6)).alias("ndcg"))


@query("trials")
def trials(spark: SparkSession, d: str) -> DataFrame:
    inter, _ = inputs(spark, d)
    train, test = training.split_interactions(inter, "last", n=3)
    search = training.ParameterSearch("als", "ndcg@20", n_trials=2)
    search.run(train, test, {"factors": [4, 8]}, fixed={"iterations": 2})
    return search.trials_frame(spark).select("trial_id", "params", rounded(F.col("score")).alias("score"))


@query("search_text_model", """SELECT 3::BIGINT AS n_trials, 3::BIGINT AS n_params, true AS scored, true AS best_is_highest""")
def search_text_model(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid of field weights of the text model, each judged on the last items of all users."""
    inter, _ = inputs(spark, d)
    search = training.ParameterSearch("text_embedding", "hr@20", n_trials=3)
    search.run(*training.split_interactions(inter, "last", n=3), training.SEARCH_SPACES["text_embedding"], fixed={"embedding_dim": 64}, items=b.items(spark, d))
    told = search.trials_frame(spark).agg(F.count("*").alias("n_trials"), F.countDistinct("params").alias("n_params"), F.every(F.col("score").between(0, 1)).alias("scored"), F.max("score").alias("best"))
    return told.select("n_trials", "n_params", "scored", (F.col("best") == search.best_value).alias("best_is_highest"))


@query("best_trial", """WITH t AS (SELECT CAST(row_number() OVER (ORDER BY p_brand, p_type) AS INTEGER) AS trial_id, p_brand || '/' || p_type AS params, avg(p_size) AS score FROM part GROUP BY p_brand, p_type)
SELECT trial_id, params, round(score, 6) + 0.0 AS score FROM t ORDER BY t.score DESC, trial_id LIMIT 1""")
def best_trial(spark: SparkSession, d: str) -> DataFrame:
    """Brand and type of the parts stand for parameters, the mean size for the score."""
    sizes = b.table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.avg("p_size").alias("score"))
    table = dense_index(sizes, [F.asc("p_brand"), F.asc("p_type")], "trial_id", start=1)
    table = table.select(F.col("trial_id").cast("int"), F.concat_ws("/", "p_brand", "p_type").alias("params"), "score")
    return training.best_trial(table).withColumn("score", rounded(F.col("score")))
