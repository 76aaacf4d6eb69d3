"""Models: numeric references, invariants of the lists, storage and search."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.models import skipgram, training
from tastemill.models.als import ALSModel
from tastemill.models.base import create_model, load_model, model_class, model_names
from tastemill.models import ease
from tastemill.models.ease import EASEModel, ease_weights, identity_recommend
from tastemill.models.hybrid import HybridModel, compose, load_hybrid
from tastemill.models.item2vec import Item2VecModel
from tastemill.models.sgd import BPRModel, FactorSGD, FeatureFactorModel, item_feature_rows, pair_auc
from tastemill.models.text import TextEmbeddingModel
from tastemill.models.transitions import TransitionModel
from tastemill.operators import gram
from tastemill.operators.gram import item_gram
from tastemill.operators.interactions import entity_index, negative_triples
from tastemill.operators.profiles import first_available

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def matrix():
    """Two groups of users with a taste for two groups of items."""
    x = np.zeros((24, 16))
    for u in range(24):
        own = range(0, 8) if u % 2 == 0 else range(8, 16)
        for i in RNG.choice(list(own), 5, replace=False):
            x[u, i] = RNG.integers(1, 5)
    return x


@pytest.fixture(scope="module")
def inter(spark, matrix):
    rows = [(int(u), int(i), float(matrix[u, i])) for u, i in zip(*np.nonzero(matrix))]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, strength double")
    return df.withColumn("last_ts", F.timestamp_add("HOUR", F.col("item_id"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))).cache()


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, f"{'left' if i < 8 else 'right'} thing {i % 4}", "left" if i < 8 else "right", f"b{i % 3}", float(i)) for i in range(16)]
    return spark.createDataFrame(rows, "item_id bigint, title string, category string, brand string, price double").cache()


def check_lists(recs, inter, k, n_items=16, exclude=True):
    rows = recs.orderBy("user_id", "rank").collect()
    seen = {(r["user_id"], r["item_id"]) for r in inter.collect()}
    by_user = {}
    for r in rows:
        by_user.setdefault(r["user_id"], []).append(r)
    assert by_user
    for user, shown in by_user.items():
        assert len(shown) <= k and [r["rank"] for r in shown] == list(range(1, len(shown) + 1))
        assert all(a["score"] >= b["score"] for a, b in zip(shown, shown[1:]))
        assert len({r["item_id"] for r in shown}) == len(shown)
        assert all(0 <= r["item_id"] < n_items for r in shown)
        if exclude:
            assert not {(user, r["item_id"]) for r in shown} & seen
    return by_user


def taste(by_user):
    """Share of first places in the user's own group."""
    return np.mean([(shown[0]["item_id"] < 8) == (user % 2 == 0) for user, shown in by_user.items()])


def test_als(spark, inter, tmp_path):
    model = ALSModel(factors=4, regularization=0.05, iterations=8).fit(inter)
    by_user = check_lists(model.recommend(inter.select("user_id"), inter, 3), inter, 3)
    assert len(by_user) == 24 and all(len(r) == 3 for r in by_user.values())
    assert taste(by_user) == 1.0
    check_lists(model.recommend(inter.select("user_id"), inter, 5, exclude_seen=False), inter, 5, exclude=False)
    fitted = {r["user_id"]: np.array(r["vector"]) for r in model.user_vectors().collect()}
    folded = {r["user_id"]: np.array(r["vector"]) for r in model.fold_in(inter).collect()}
    assert max(np.abs(fitted[u] - folded[u]).max() for u in fitted) < 1e-5
    model.save(f"{tmp_path}/als")
    again = load_model(spark, f"{tmp_path}/als")
    assert {r["user_id"]: list(r["vector"]) for r in again.user_vectors().collect()} == {r["user_id"]: list(r["vector"]) for r in model.user_vectors().collect()}
    new = inter.where("user_id = 0").withColumn("user_id", F.lit(100).cast("bigint"))
    model.update_users(new)
    assert model.user_vectors().count() == 25


def test_bpr_learns(inter):
    index = entity_index(inter, "item_id", "item_idx")
    triples = negative_triples(inter, index, 16, 4, seed=999)
    auc = []
    for epochs in (0, 6):
        users, _, vectors = FactorSGD(4, 0.3, 0.01, 0.01, epochs, "bpr", 42).fit(inter)
        auc.append(pair_auc(triples, users, vectors).first()["auc"])
    assert auc[1] > 0.85 > auc[0]
    model = BPRModel(factors=4, learning_rate=0.3, iterations=2).fit(inter)
    check_lists(model.recommend(inter.select("user_id"), inter, 4), inter, 4)


@pytest.mark.parametrize("loss", ["warp", "logistic"])
def test_feature_factors(inter, items, loss):
    model = FeatureFactorModel(no_components=4, learning_rate=0.4, loss=loss, epochs=5).fit(inter, items)
    assert taste(check_lists(model.recommend(inter.select("user_id"), inter, 3), inter, 3)) > 0.8
    pairs = inter.select("user_id", "item_id")
    assert model.predict(pairs).count() == pairs.count()
    new = items.where("item_id = 0").withColumn("item_id", F.lit(77).cast("bigint"))
    assert model.item_representations(item_feature_rows(new)).count() == 1


def test_unknown_loss():
    with pytest.raises(ValueError):
        FactorSGD(4, 0.1, 0, 0, 1, "warp-kos", 1)


def test_ease_equals_closed_form(spark, inter, matrix):
    gram = matrix.T @ matrix
    inverse = np.linalg.inv(gram + 2.0 * np.eye(16))
    want = np.eye(16) - inverse / np.diag(inverse)[None, :]
    # every pair must share a user for the Gram entries to exist; missing ones are zero, so all items are neighbours
    full = spark.createDataFrame([(i, j, float(gram[i, j])) for i in range(16) for j in range(i, 16)], "item_i bigint, item_j bigint, product double")
    got = np.zeros((16, 16))
    for r in ease_weights(full, 15, 2.0).collect():
        got[r["item_id"], r["other_id"]] = r["weight"]
    np.fill_diagonal(want, 0)
    assert np.allclose(got, want, atol=1e-9)
    # with the true Gram entries an item is regressed on the items it shares users with
    for j in range(16):
        near = [i for i in range(16) if i != j and gram[i, j] > 0]
        want[:, j] = 0
        want[near, j] = np.linalg.solve(gram[np.ix_(near, near)] + 2.0 * np.eye(len(near)), gram[near, j])
    sparse = {(r["item_id"], r["other_id"]): r["weight"] for r in ease_weights(item_gram(inter).cache(), 15, 2.0).collect()}
    assert sparse and all(abs(want[i, j] - w) < 1e-9 for (i, j), w in sparse.items())

@pytest.mark.parametrize("sizes, joined_bytes, neighbours", [({}, 0, 2), ({"part_entries": 60}, 1 << 40, 6), ({"heavy": 4, "part_entries": 60}, 0, 6)])
def test_ease_weights_without_the_gram_matrix(spark, inter, monkeypatch, sizes, joined_bytes, neighbours):
    """From histories, by joins or by parts, with popular items and large users apart: the weights of the whole Gram matrix."""
    gaps = inter.select("user_id", "item_id", "strength").unionByName(spark.createDataFrame([(None, 1, 2.0), (3, None, 5.0), (2, 77, 300.25)], "user_id bigint, item_id bigint, strength double"))
    monkeypatch.setattr(gram, "JOINED_BYTES", joined_bytes)
    monkeypatch.setattr(ease, "Histories", lambda rows: gram.Histories(rows, **sizes))
    shown = lambda rows: sorted((r["item_id"], r["other_id"], round(r["weight"], 9)) for r in rows.collect())
    assert shown(ease_weights(gaps, neighbours, 2.0)) == shown(ease_weights(item_gram(gaps).cache(), neighbours, 2.0))


def test_ease_recommend(inter):
    model = EASEModel(lambda_=1.0, neighbours=7).fit(inter)
    assert taste(check_lists(model.recommend(inter.select("user_id"), inter, 3), inter, 3)) == 1.0


def test_identity_recommend(inter):
    rows = check_lists(identity_recommend(inter.select("user_id").distinct(), inter, inter, 3), inter, 3)
    assert all(r["score"] == 1.0 for shown in rows.values() for r in shown)
    assert all([r["item_id"] for r in shown] == sorted(r["item_id"] for r in shown) for shown in rows.values())


def test_item2vec(spark, inter):
    model = Item2VecModel(vector_size=8, window=3, epochs=3).fit(inter)
    assert model.item_vectors().count() == 16
    check_lists(model.recommend(inter.select("user_id"), inter, 3), inter, 3)
    asked = spark.createDataFrame([(0,), (999,)], "item_id bigint")
    got = {r["item_id"]: list(r["vector"]) for r in model.vectors_for(asked).collect()}
    assert got[999] == [0.0] * 8 and any(got[0])
    with pytest.raises(ValueError):
        Item2VecModel(sg=0)
    with pytest.raises(TypeError):
        Item2VecModel(windows=3)


def test_window_pairs_match_brute_force(spark):
    rng = random.Random(8)
    sentences = [[str(rng.randint(0, 9)) for _ in range(rng.randint(0, 14))] for _ in range(30)] + [[], ["a"], ["a", "b"], ["hot"] * 40]
    sentences[0] = ["x", None, "y"]
    want = Counter()
    for s in sentences:
        for i, x in enumerate(s):
            for j, y in enumerate(s):
                if x is not None and y is not None and 0 < abs(i - j) <= 4:
                    want[x, y] += (5 - abs(i - j)) / 4
    places = spark.createDataFrame([(k, i, w) for k, s in enumerate(sentences) for i, w in enumerate(s)], "session int, pos int, item string")
    arrays = spark.createDataFrame([(s,) for s in [*sentences, None]], "sentence array<string>")
    for pairs in (skipgram.window_pairs(places, 4), skipgram.sentence_pairs(arrays, 4)):
        got = {(r.centre, r.context): r.n for r in pairs.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_skipgram_in_tiles(spark, monkeypatch):
    """Items of two tastes that never meet part company, whatever the number of blocks; the loss falls, and every pair is in every epoch."""
    rng = random.Random(4)
    rows = [(u, 0, i + 1, rng.randint(0, 30) * 2 + u % 2) for u in range(60) for i in range(20)]
    sessions = spark.createDataFrame(rows, "user_id bigint, session_no int, pos int, item_id bigint")
    monkeypatch.setattr(skipgram, "CHUNK", 64)
    for blocks, epochs in ((2, 4), (5, 2)):
        monkeypatch.setattr(skipgram, "BLOCKS", blocks)
        places = sessions.selectExpr("struct(user_id, session_no) AS session", "pos", "item_id AS item")
        pairs = skipgram.window_pairs(places, 5)
        words = skipgram.vocabulary(places.groupBy("item").agg(F.count("*").alias("many")), 1)
        assert words[1] == blocks
        stored = skipgram.tiled(pairs, words[0], blocks).select(F.explode("n").alias("n")).agg(F.sum("n")).first()[0]
        total = pairs.agg(F.sum("n")).first()[0]
        model = Item2VecModel(vector_size=16, epochs=epochs).fit(sessions.select("user_id", "item_id"), sessions=sessions)
        losses = [(r.loss, r.weight) for r in model.tables["losses"].orderBy("epoch").collect()]
        assert abs(stored - total) < 1e-3 * total and all(abs(w - total) < 1e-3 * total for _, w in losses)
        assert [x for x, _ in losses] == sorted((x for x, _ in losses), reverse=True) and len(losses) == epochs
    vectors = {r.item_id: np.array(r.vector) / np.linalg.norm(r.vector) for r in model.item_vectors().collect()}
    nearest = {i: max((float(v @ vectors[j]), j) for j in vectors if j != i)[1] for i, v in vectors.items()}
    assert sum(i % 2 == j % 2 for i, j in nearest.items()) > 0.9 * len(nearest)
    same = Item2VecModel(vector_size=16, epochs=2).fit(sessions.select("user_id", "item_id"), sessions=sessions.repartition(7))
    again = {r.item_id: np.array(r.vector) / np.linalg.norm(r.vector) for r in same.item_vectors().collect()}
    assert again.keys() == vectors.keys() and all(np.allclose(again[i], vectors[i], atol=1e-4) for i in vectors)


def test_search_over_the_text_model(spark, inter, items, tmp_path):
    search = training.ParameterSearch("text_embedding", "hr@3", n_trials=3)
    best = search.run(*training.split_interactions(inter), training.SEARCH_SPACES["text_embedding"], fixed={"embedding_dim": 64}, items=items)
    assert [t[0] for t in search.trials] == [0, 1, 2] and best["field_weights"] in training.SEARCH_SPACES["text_embedding"]["field_weights"]
    search.refit(inter, items, f"{tmp_path}/best")
    assert load_model(spark, f"{tmp_path}/best").params["field_weights"] == best["field_weights"]


def test_text_model_and_cache(inter, items):
    model = TextEmbeddingModel(embedding_dim=256).fit(None, items)
    assert taste(check_lists(model.recommend(inter.select("user_id"), inter, 3), inter, 3)) > 0.9
    only = items.where("item_id % 2 = 0").select("item_id")
    shown = model.recommend(inter.select("user_id"), inter, 3, mapping=only)
    assert {r["item_id"] % 2 for r in shown.collect()} == {0}

    @F.pandas_udf("array<double>")
    def encoder(texts):
        return texts.map(lambda t: [float(len(t)), 1.0])

    own = TextEmbeddingModel(embedding_dim=2)
    own.fit(None, items, encoder)
    cache = own.cache_rows(items).select("item_id", "text_hash", "vector")
    changed = items.withColumn("title", F.when(F.col("item_id") == 3, "new words").otherwise(F.col("title")))
    again = TextEmbeddingModel(embedding_dim=2).fit(None, changed, encoder, cache)
    assert again.item_vectors().count() == 16


def test_transitions(spark):
    base = [("a", [1, 2, 3]), ("b", [1, 2, 4]), ("c", [5, 1])]
    rows = [(n * 10 + t, u, i, t) for n, (u, s) in enumerate(base) for t, i in enumerate(s)]
    events = spark.createDataFrame(rows, "event_id int, user_id string, item_id bigint, t int")
    events = events.withColumn("ts", F.timestamp_add("MINUTE", F.col("t"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))).drop("t")
    model = TransitionModel(smoothing=0.0).fit(events)
    last = spark.createDataFrame([("x", 2), ("y", 5)], "user_id string, last_item bigint")
    got = {(r["user_id"], r["next_item"]): r["probability"] for r in model.predict_next_items(last, 5).collect()}
    assert got == {("x", 3): 0.5, ("x", 4): 0.5, ("y", 1): 1.0}
    shown = model.recommend(events.select("user_id"), events, 5, exclude_seen=True)
    assert {(r["user_id"], r["item_id"]) for r in shown.collect()} == {("c", 2)}


def test_registry_and_storage(spark, inter, tmp_path):
    assert model_names() == ["als", "bpr", "ease", "gru4rec", "hybrid", "item2vec", "lightfm", "text_embedding"]
    assert model_class("ALS") is ALSModel
    with pytest.raises(ValueError):
        create_model("svd")
    with pytest.raises(FileNotFoundError):
        load_model(spark, f"{tmp_path}/none")
    with pytest.raises(RuntimeError):
        create_model("ease").recommend(inter, inter)
    with pytest.raises(RuntimeError):
        create_model("ease").save(f"{tmp_path}/x")


def test_hybrid(spark, inter, items, tmp_path):
    als, text = ALSModel(factors=4, iterations=3).fit(inter), TextEmbeddingModel(embedding_dim=256).fit(None, items)
    als.save(f"{tmp_path}/als")
    text.save(f"{tmp_path}/text")
    model = compose(spark, [f"{tmp_path}/als", f"{tmp_path}/broken", f"{tmp_path}/text"], weights=[0.5, 0.5, 0.1])
    assert [c.model_type for c in model.components] == ["als", "text_embedding"] and model.params["weights"] is None
    check_lists(model.recommend(inter.select("user_id"), inter, 3), inter, 3)
    source = {r["vector_source"] for r in model.vectors_for(items.select("item_id")).collect()}
    assert source == {"text_embedding"}
    model.save(f"{tmp_path}/hybrid")
    assert [c.model_type for c in load_hybrid(spark, f"{tmp_path}/hybrid").components] == ["als", "text_embedding"]
    with pytest.raises(ValueError):
        compose(spark, [f"{tmp_path}/broken"])
    with pytest.raises(RuntimeError):
        HybridModel().recommend(inter, inter)


def test_vector_sources(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "item_id int")
    a = spark.createDataFrame([(1, [1.0])], "item_id int, vector array<double>")
    b = spark.createDataFrame([(1, [9.0]), (2, [2.0])], "item_id int, vector array<double>")
    got = {r["item_id"]: (r["vector_source"], r["vector"]) for r in first_available(ids, [("a", a), ("b", b)]).collect()}
    assert got == {1: ("a", [1.0]), 2: ("b", [2.0]), 3: ("missing", None)}
    seeded = {r["item_id"]: r["vector"] for r in first_available(ids, [("a", a)], fallback_dim=1).collect()}
    assert seeded[1] == [1.0] and 0 <= seeded[2][0] < 1


def test_parameter_sampling():
    assert training.sample_params({"a": [1, 2], "b": ["x"]}, 5) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    space = {"p": {"type": "int", "low": 5, "high": 20}, "q": {"type": "float", "low": 0.01, "high": 0.5, "log": True}, "r": {"type": "int", "low": 0, "high": 10, "step": 5}, "c": {"type": "categorical", "choices": ["u", "v"]}}
    drawn = training.sample_params(space, 30, seed=1)
    assert drawn == training.sample_params(space, 30, seed=1) and len(drawn) == 30
    assert all(5 <= d["p"] <= 20 and 0.01 <= d["q"] <= 0.5 and d["r"] in (0, 5, 10) and d["c"] in "uv" for d in drawn)


def test_search(spark, inter, tmp_path):
    train, test = training.split_interactions(inter, "last", n=1)
    search = training.ParameterSearch("als", "hr@10", n_trials=2)
    with pytest.raises(RuntimeError):
        search.refit(train)
    best = search.run(train, test, {"factors": [2, 4]}, fixed={"iterations": 2})
    frame = search.trials_frame(spark)
    assert frame.count() == 2 and best["iterations"] == 2
    assert training.best_trial(frame).first()["score"] == search.best_value
    search.save(spark, f"{tmp_path}/search")
    assert search.refit(train, path=f"{tmp_path}/best").params["factors"] == best["factors"]
    for how in ("interaction", "user"):
        a, b = training.split_interactions(inter, how)
        assert a.count() + b.count() == inter.count()


def test_train_chain(spark, inter, tmp_path):
    events = inter.select("user_id", "item_id", F.col("strength").cast("int").alias("qty"), F.col("last_ts").alias("ts"))
    training.train("als", events, f"{tmp_path}/m", params={"factors": 4, "iterations": 2})
    assert load_model(spark, f"{tmp_path}/m/model").params["factors"] == 4
    with pytest.raises(ValueError):
        training.fit_model("hybrid", events)
