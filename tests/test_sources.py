"""Ingestion, messages, tables and privacy on small inputs."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tastemill import schemas
from tastemill.operators import privacy
from tastemill.operators.ann import VectorIndex, as_queries
from tastemill.sources import ingest, messages
from tastemill.sources.tables import VersionedTable

EVENTS = [("U_01", "I_01", 1617235200, 1), ("U_01", "I_02", 1617235300, 2), ("U_02", "I_01", 1617235400, 1), ("U_03", "I_03", 1617235500, 3)]
ITEMS = "item_id,category,brand,price,img_url\nI_01,electronics,brand1,100.0,http://example.com/1.jpg\nI_02,books,brand2,20.0,http://example.com/2.jpg\nI_03,clothing,brand3,50.0,http://example.com/3.jpg\n"


@pytest.fixture
def files(spark, tmp_path):
    # long quantities, as writers often produce
    spark.createDataFrame(EVENTS, "user_id string, item_id string, ts bigint, qty bigint").write.parquet(f"{tmp_path}/events")
    (tmp_path / "items.csv").write_text(ITEMS)
    return tmp_path


def test_batch_ingest(spark, files):
    root = f"{files}/db"
    assert ingest.ingest(spark, f"{files}/events", f"{files}/items.csv", root) == {"events": True, "items": True}
    assert ingest.ingest(spark, f"{files}/events", f"{files}/items.csv", root) == {"events": False, "items": False}
    events, items = VersionedTable(spark, f"{root}/events").read(), VersionedTable(spark, f"{root}/items").read()
    assert (events.count(), items.count()) == (4, 3)
    assert events.schema == schemas.EVENTS
    assert set(items.columns) == {"item_id", "category", "brand", "price", "img_url"}
    assert {r["user_id"]: r["n"] for r in events.groupBy("user_id").agg(F.count("*").alias("n")).collect()} == {"U_01": 2, "U_02": 1, "U_03": 1}


def test_items_by_name(spark, tmp_path):
    (tmp_path / "items.csv").write_text("price,item_id,brand,category,img_url,title\n5.5,a,b,c,,t\n")
    row = ingest.read_items_csv(spark, f"{tmp_path}/items.csv").first()
    assert (row["item_id"], row["price"], row["title"]) == ("a", 5.5, "t")


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="qty"):
        ingest.align(spark.createDataFrame([("u", "i", 1)], "user_id string, item_id string, ts bigint"), schemas.EVENTS)


def test_append_by_name(spark):
    table = spark.createDataFrame([(1, "a")], "x int, y string")
    got = ingest.append_by_name(table, spark.createDataFrame([("b", 9.9, 2)], "y string, z double, x int"))
    assert {tuple(r) for r in got.collect()} == {(1, "a"), (2, "b")}
    assert ingest.schema_template(table).count() == 0


def test_item_metadata(spark, tmp_path):
    body = {"i1": {"title": "T", "category": "A", "brand": "B", "price": 1.5, "img_url": "u"}, "i2": {"title": "S"}}
    (tmp_path / "items.json").write_text(json.dumps(body))
    (tmp_path / "bad.json").write_text("{nope")
    rows = ingest.read_item_metadata(spark, [f"{tmp_path}/none.json", f"{tmp_path}/items.json"]).orderBy("item_id").collect()
    assert [(r["item_id"], r["title"], r["price"]) for r in rows] == [("i1", "T", 1.5), ("i2", "S", None)]
    assert ingest.read_item_metadata(spark, [f"{tmp_path}/bad.json"]).count() == 0
    assert ingest.read_item_metadata(spark, [f"{tmp_path}/none.json"]).count() == 0


def test_cursor_keeps_ties(spark):
    events = spark.createDataFrame([(i, 100 + i // 3) for i in range(9)], "event_id int, ts int")
    cursor, got = None, []
    while True:
        batch = ingest.new_events_since(events, "ts", "event_id", cursor, 2)
        rows = batch.collect()
        if not rows:
            break
        got += [r["event_id"] for r in rows]
        last = ingest.cursor_after(batch, "ts", "event_id").first()
        cursor = (last["ts"], last["event_id"])
    assert got == list(range(9))


def test_messages(spark):
    raw = [
        '{"user_id":"user1","item_id":"item1","qty":1}',
        '{"user_id":"user2","item_id":"item2","timestamp":"2024-01-02T03:04:05","session_id":"s","event_type":"view"}',
        '{"user_id":"user3"}', "not json", '{"item_id":"item4"}',
    ]
    good, bad = messages.split_messages(spark.createDataFrame([(r.encode(),) for r in raw], "value binary"))
    rows = {r["user_id"]: r for r in good.collect()}
    assert {u: (r["item_id"], r["qty"]) for u, r in rows.items()} == {"user1": ("item1", 1), "user2": ("item2", 1)}
    assert rows["user2"]["ts"].strftime("%Y-%m-%d %H:%M:%S") == "2024-01-02 03:04:05"
    assert rows["user1"]["ts"] is not None
    assert {r["value"]: r["reason"] for r in bad.collect()} == {raw[2]: "missing item_id", raw[3]: "not decodable", raw[4]: "missing user_id"}
    with pytest.raises(ValueError):
        messages.queue_stream(spark, "sqs", {})


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert table.append(one, "a") and not table.append(one, "a") and table.append(two, "b")
    assert sorted(r["x"] for r in table.read().collect()) == [1, 2]
    table.replace(table.read().where("x = 2"))  # rewritten from itself
    table.append(one)
    table.compact()
    assert sorted(r["x"] for r in table.read().collect()) == [1, 2]


def test_keyed_parts_in_any_order(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    one = lambda x: spark.createDataFrame([(x,)], "x int")
    for key, x in (("day-2024-01-05", 5), ("day-2024-01-03", 3), ("feed-a/1", 1), ("feed-b/1", 2), ("feed-a/0", 0)):
        assert table.append(one(x), key) and not table.append(one(x), key)
    table.compact()
    assert not table.append(one(3), "day-2024-01-03") and table.append(one(9), "day-2024-01-09")
    table.compact()
    assert not table.append(one(9), "day-2024-01-09")
    assert sorted(r.x for r in table.read().collect()) == [0, 1, 2, 3, 5, 9]


def test_delete_users(spark, tmp_path):
    root = str(tmp_path)
    events = spark.createDataFrame(EVENTS, "user_id string, item_id string, ts bigint, qty int")
    privacy.store_events(events, root)
    requests = spark.createDataFrame([("U_01",), ("nobody",), (None,)], "user_id string")
    assert privacy.delete_users(spark, root, requests, confirm=False) == 0 and privacy.deleted_users(spark, root) is None
    assert privacy.delete_users(spark, root, requests, confirm=True) == 1
    assert {r["user_id"] for r in privacy.stored_events(spark, root).collect()} == {"U_02", "U_03"}
    stones = spark.read.parquet(f"{root}/deleted_users").collect()
    assert [r["user_id"] for r in stones] == ["U_01"] and stones[0]["deletion_timestamp"] > 1_600_000_000
    assert privacy.delete_users(spark, root, requests, confirm=True) == 0
    assert spark.read.parquet(f"{root}/deleted_users").count() == 1 and spark.read.parquet(f"{root}/audit").count() == 2


def parquet_files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_deletion_leaves_no_file_with_the_user(spark, tmp_path):
    root = str(tmp_path)
    events = spark.createDataFrame([(u, i % 5, i, 1) for u in range(40) for i in range(3 + u)], "user_id bigint, item_id int, ts bigint, qty int")
    privacy.store_events(events.where("ts < 2"), root, buckets=16)
    privacy.store_events(events.where("ts >= 2"), root, buckets=4)  # the first number counts
    lonely = [r.user_id for r in spark.read.parquet(f"{root}/events").groupBy("user_bucket").agg(F.min("user_id").alias("user_id"), F.countDistinct("user_id").alias("n")).where("n = 1").collect()]
    gone = {3, 17, 39, *lonely[:1]}
    before = parquet_files(f"{root}/events")
    requests = spark.createDataFrame([(u,) for u in [*gone, 3]], "user_id int")
    assert privacy.delete_users(spark, root, requests, confirm=True, key="r1") == len(gone)
    left = spark.read.parquet(*(str(p) for p in parquet_files(f"{root}/events")))  # every file that remains, hidden or not
    assert not gone & {r.user_id for r in left.select("user_id").distinct().collect()}
    assert sorted(map(tuple, privacy.stored_events(spark, root).collect())) == sorted(tuple(r) for r in events.collect() if r.user_id not in gone)
    held = {p for p in before if p in parquet_files(f"{root}/events")}
    assert held and all(parquet_files(f"{root}/events")[p] == before[p] for p in held)  # other buckets were not written
    assert not list(Path(root).glob("events.pending*"))
    stones = {r.user_id: r.deleted_events for r in spark.read.parquet(f"{root}/deleted_users").collect()}
    assert stones == {u: 3 + u for u in gone}
    after = parquet_files(root)
    assert privacy.delete_users(spark, root, requests, confirm=True, key="r1") == 0 and parquet_files(root) == after
    # The user comes back and asks again.
    privacy.store_events(events.where("user_id = 3"), root)
    assert privacy.delete_users(spark, root, spark.createDataFrame([(3,)], "user_id int"), confirm=True, key="r2") == 1
    assert privacy.stored_events(spark, root).where("user_id = 3").count() == 0
    assert {r.user_id for r in privacy.deleted_users(spark, root).collect()} == gone


def test_stopped_deletion_goes_on(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    events = spark.createDataFrame([(u, i, i, 1) for u in range(20) for i in range(4)], "user_id bigint, item_id int, ts bigint, qty int")
    privacy.store_events(events, root, buckets=4)
    requests = spark.createDataFrame([(u,) for u in (1, 2, 3)], "user_id bigint")
    for broken in ("erase_rows", "remove", "audit_rows"):
        with monkeypatch.context() as patch:
            patch.setattr(privacy, broken, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                privacy.delete_users(spark, root, requests, confirm=True, key="r")
    privacy.delete_users(spark, root, requests, confirm=True, key="r")
    assert sorted(map(tuple, privacy.stored_events(spark, root).collect())) == sorted(tuple(r) for r in events.where("user_id NOT IN (1, 2, 3)").collect())
    assert {(r.user_id, r.deleted_events) for r in spark.read.parquet(f"{root}/deleted_users").collect()} == {(u, 4) for u in (1, 2, 3)}
    assert spark.read.parquet(f"{root}/audit").count() == 3


def test_export_is_split_into_parts(spark, tmp_path):
    rows = [(i, "u", f"i{i % 7}", 1) for i in range(2500)]
    events = spark.createDataFrame(rows, "n int, user_id string, item_id string, qty int").withColumn("ts", F.timestamp_add("MINUTE", F.col("n"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")))
    items = spark.createDataFrame([(f"i{i}", "c", "b", 1.0) for i in range(5)], "item_id string, category string, brand string, price double")
    asked = spark.createDataFrame([("u",)], "user_id string")
    parts = privacy.export_documents(events.withColumn("d", F.to_date("ts")), items, asked, "d", ["ts", "n"]).orderBy("part").collect()
    assert [len(p["events"]) for p in parts] == [1000, 1000, 500]
    assert [e["item_id"] for p in parts for e in p["events"]] == [f"i{i % 7}" for i in range(2500)]
    assert {i["item_id"] for i in parts[0]["items"]} == {f"i{i}" for i in range(5)}
    privacy.write_export(privacy.export_documents(events.withColumn("d", F.to_date("ts")), items, asked, "d", ["ts", "n"]), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 3


@pytest.mark.parametrize("kind, metric", [("Flat", "inner_product"), ("IVF_Flat", "inner_product"), ("IVF_HNSW", "cosine"), ("IVF_Flat", "l2")])
def test_index_round_trip_append_and_recall(spark, tmp_path, kind, metric):
    import numpy as np

    rng = np.random.RandomState(42)
    data = rng.random((100, 10)).astype("float32")
    vectors = spark.createDataFrame([(f"I_{i}", x.tolist()) for i, x in enumerate(data)], "item_id string, vector array<float>")
    old, new = vectors.limit(100).where(F.substring("item_id", 3, 5).cast("int") < 80), vectors.where(F.substring("item_id", 3, 5).cast("int") >= 80)
    index = VectorIndex.build(old, kind, metric, nlist=4, nprobe=3).add(new)
    assert index.vectors.count() == 100
    queries = as_queries(vectors)
    hits = {(r["query_id"], r["item_id"]) for r in index.search(queries, 10).collect()}
    exact = {(r["query_id"], r["item_id"]) for r in VectorIndex.build(vectors, "Flat", metric).search(queries, 10).collect()}
    assert len(hits & exact) / len(exact) >= (1.0 if kind == "Flat" else 0.7)
    if metric != "inner_product":
        assert all((f"I_{i}", f"I_{i}") in hits for i in range(80, 100))
    index.save(f"{tmp_path}/index")
    again = VectorIndex.load(spark, f"{tmp_path}/index")
    assert {(r["query_id"], r["item_id"]) for r in again.search(queries, 10).collect()} == hits


def test_unknown_index_type(spark):
    with pytest.raises(ValueError):
        VectorIndex.build(spark.createDataFrame([(1, [1.0])], "item_id int, vector array<double>"), "LSH")


def test_few_vectors_make_one_cell(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "item_id int, vector array<double>")
    assert VectorIndex.build(vectors).centroids.count() == 1
