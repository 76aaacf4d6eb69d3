"""One answer on both sides of every size at which a plan changes."""

import os
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tastemill.functions.vectors import WIDE, mean_vectors
from tastemill.models.als import ALSModel, blocks_for
from tastemill.models.hybrid import fuse
from tastemill.models.item2vec import profile_recommend
from tastemill.operators import profiles
from tastemill.operators.ann import VectorIndex
from tastemill.operators.gram import item_gram
from tastemill.operators.recommend import Filters, buffered_k
from tastemill.operators.sequences import sessionize
from tastemill.sources.tables import VersionedTable

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("rows", [
    [("u", 1, 2.0), ("u", 2, 0.0), ("u", 3, -1.0)],
    [("u", 1, 2.0), ("u", 2, None), ("u", 3, -1.0), ("v", 1, 1.0), ("v", 3, 1.0), ("v", 2, 5.0)],
])
def test_gram_is_the_same_by_rows_and_by_blocks(spark, rows):
    inter = spark.createDataFrame(rows, "user_id string, item_id int, strength double")
    light, heavy = (sorted(map(tuple, item_gram(inter, heavy=h).collect())) for h in (100, 1))
    assert light == heavy and len(light) == 6


@pytest.mark.parametrize("dim", [2, WIDE, WIDE + 1, 384])
def test_weighted_mean_takes_returns_at_any_width(spark, dim):
    rows = spark.createDataFrame([("a", [1.0] * dim, 3.0), ("a", [2.0] * dim, -1.0), ("b", [1.0] * dim, 1.0), ("b", [5.0] * dim, -1.0)], "k string, v array<double>, w double")
    got = {r.k: r.m for r in mean_vectors(rows, ["k"], "v", dim, "m", weight="w").collect()}
    assert got == {"a": [0.5] * dim, "b": None}


def test_fusion_fills_long_lists(spark):
    lists = spark.range(300).select(F.lit("u").alias("user_id"), F.lit("als").alias("model"), F.col("id").alias("item_id"), F.col("id").cast("double").alias("score"))
    weights = spark.createDataFrame([("als", 1.0)], "model string, weight double")
    assert fuse(lists, weights, 200).count() == 200
    assert buffered_k(1500, Filters(categories=["x"])) == 1500 and buffered_k(10, Filters(categories=["x"])) == 30


def test_every_batch_is_remembered(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1,)], "x int").coalesce(1)
    assert all(table.append(rows, f"batch-{i}") for i in range(66))
    assert not table.append(rows, "batch-0") and not table.append(rows, "batch-65")
    assert table.append(rows, "batch-66") and table.append(rows, "first") and not table.append(rows, "first")


def test_events_without_a_time_are_an_error(spark):
    events = spark.createDataFrame([("u", 1, 1, None)], "user_id string, event_id int, item_id int, ts timestamp")
    with pytest.raises(PySparkException, match="no time"):
        sessionize(events, 1800).collect()


def test_als_does_not_depend_on_the_ids(spark):
    inter = spark.createDataFrame([(u, i, float(1 + (u * i) % 3)) for u in range(8) for i in range(6) if (u + i) % 3], "user_id bigint, item_id bigint, strength double")
    far = inter.withColumn("user_id", F.col("user_id") + 2**33)
    near, other = (ALSModel(factors=4, iterations=2).fit(x).tables["user_vectors"].orderBy("user_id").select("vector").collect() for x in (inter, far))
    assert near == other
    assert blocks_for(100, 8) == 10 and blocks_for(100, 400) == 400 and blocks_for(10**10, 400) == 5000


def test_submitted_master_is_kept(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(f"import sys; sys.path.insert(0, {REPO!r})\nfrom tastemill.session import build_session\nprint('MASTER', build_session('t').sparkContext.master)\n")
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS")}
    submit = [sys.executable, "-c", "import os, pyspark, sys; p = os.path.join(os.path.dirname(pyspark.__file__), 'bin', 'spark-submit'); os.execv(p, [p, *sys.argv[1:]])"]
    run = lambda args: subprocess.run(args, env=env | {"PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=120).stdout
    assert "MASTER local[3]" in run([*submit, "--master", "local[3]", str(script)])
    assert "MASTER local[*]" in run([sys.executable, str(script)])


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_lists_of_a_user_are_dealt_once_for_the_fusion(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("u", "als", 1, 4.0), ("u", "als", 2, 2.0), ("u", "text", 2, 9.0), ("u", "text", 3, 3.0), ("v", "als", 1, 1.0), (None, "als", 1, 1.0), ("w", "als", 5, 1.0), ("u", None, 4, 1.0)]
        lists = spark.createDataFrame(rows, "user_id string, model string, item_id int, score double")
        given = [("u", "als", 0.5), ("u", "als", 0.25), ("u", "text", 0.75), ("v", "als", 0.0005), ("v", None, 1.0), (None, "als", 1.0)]
        weights = spark.createDataFrame(given, "user_id string, model string, weight double")
        fused = fuse(lists, weights, 5)
        assert sorted(map(tuple, fused.select("user_id", "item_id", "score", "rank").collect())) == [("u", 1, 0.5, 2), ("u", 2, 0.75, 1), ("u", 3, 0.0, 3)]
        dealt = [line for line in plan_of(fused).splitlines() if "Exchange hashpartitioning" in line]
        assert not any("item_id" in line for line in dealt) and len(dealt) <= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


@pytest.mark.parametrize("dim", [3, WIDE + 1])
@pytest.mark.parametrize("numbers", [None, 8])
def test_profiles_by_blocks_are_the_means(spark, monkeypatch, dim, numbers):
    pairs = [(u, i) for u in range(9) for i in range(12) if (u * i) % 5 < 3] + [(None, 1), (3, None), (4, 99), (5, 2), (77, 99)]
    inter = spark.createDataFrame(pairs, "user_id bigint, item_id bigint")
    vectors = [(i, [float(i * j % 7) for j in range(dim)]) for i in range(10)] + [(2, [1.0] * dim), (10, None), (11, [None] * dim)]
    vectors = spark.createDataFrame(vectors, "item_id bigint, vector array<double>")
    if numbers:  # many blocks, and every user is too large for one
        monkeypatch.setattr("tastemill.plans.skew.BLOCK_NUMBERS", numbers * dim)
        monkeypatch.setattr("tastemill.operators.profiles.PIECE", 2 * dim)
    found = {r["user_id"]: r["vector"] for r in profiles.mean_profile_by_blocks(inter, vectors, dim).collect()}
    wanted = {r["user_id"]: r["vector"] for r in profiles.mean_profile(inter.where("user_id IS NOT NULL"), vectors, dim).collect()}
    assert set(found) == set(wanted) and 77 not in found
    assert all(found[u] == pytest.approx(wanted[u], abs=1e-12) for u in wanted)


def test_no_vector_is_shuffled_per_row_for_a_profile(spark):
    history = spark.createDataFrame([(u, i) for u in range(5) for i in range(4)], "user_id bigint, item_id bigint")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "item_id bigint, vector array<double>")
    found = profile_recommend(history.select("user_id"), history, vectors, 2, 2)
    assert "user_id" not in "".join(x for x in plan_of(found).splitlines() if "Aggregate" in x)  # profiles are read from a table
    assert {(r["user_id"], r["item_id"]) for r in found.collect()} == {(u, i) for u in range(5) for i in (4, 5)}


def test_an_index_has_few_files_per_cell(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("item_id"), (F.col("id") % 3).cast("int").alias("cell"), F.array(F.col("id").cast("double")).alias("vector")).repartition(16)
    centroids = spark.createDataFrame([(c, [float(c)]) for c in range(3)], "cell int, vector array<double>")
    VectorIndex.from_cells(rows, centroids, "l2", 1).save(str(tmp_path / "index"))
    files = [len(list((tmp_path / f"index/vectors/cell={c}").glob("*.parquet"))) for c in range(3)]
    assert max(files) <= 4  # 16 tasks wrote one for each
    assert VectorIndex.load(spark, str(tmp_path / "index")).vectors.count() == 400
