"""Streams give the batch answer, survive a restart and isolate bad files."""

import pytest
from pyspark.sql import functions as F

from tastemill import schemas
from tastemill.models.als import ALSModel, fold_in
from tastemill.operators import privacy
from tastemill.operators.interactions import interactions
from tastemill.sources.tables import VersionedTable
from tastemill.streaming import feeds, windows
from tastemill.streaming.worker import UpdateWorker

EVENTS = "user_id string, item_id string, ts bigint, qty int"


def write(spark, rows, path):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def rows_of(start, n):
    return [(f"u{i % 5}", f"i{i % 8}", start + i, 1 + i % 4) for i in range(n)]


def test_missing_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        feeds.event_files(spark, f"{tmp_path}/none")


def test_restart_reads_each_file_once(spark, tmp_path):
    root = str(tmp_path)
    write(spark, rows_of(1000, 20), f"{root}/in")

    def run():
        feeds.finish(feeds.stream_to_parquet(feeds.event_files(spark, f"{root}/in", max_files=1), f"{root}/out", f"{root}/state"))
        return spark.read.parquet(f"{root}/out").count()

    assert run() == 20
    assert run() == 20
    write(spark, rows_of(1100, 5), f"{root}/in")
    assert run() == 25


def test_bad_file_is_retried(spark, tmp_path):
    root = str(tmp_path)
    write(spark, rows_of(1000, 10), f"{root}/in")
    bad = tmp_path / "in" / "bad.parquet"
    bad.write_text("junk")
    table, quarantine = VersionedTable(spark, f"{root}/events"), VersionedTable(spark, f"{root}/quarantine")

    def run():
        feeds.finish(feeds.isolated_event_files(spark, f"{root}/in", table, quarantine, f"{root}/state", schemas.EVENTS))

    run()
    assert table.read().count() == 10
    assert [r["path"].endswith("bad.parquet") for r in quarantine.read().collect()] == [True]
    # the file is repaired in place; the next batch takes it in
    write(spark, rows_of(2000, 3), f"{root}/fixed")
    bad.write_bytes(next((tmp_path / "fixed").glob("*.parquet")).read_bytes())
    for crc in (tmp_path / "in").glob(".bad*"):
        crc.unlink()
    write(spark, rows_of(3000, 2), f"{root}/in")
    run()
    assert table.read().count() == 15
    assert quarantine.read().count() == 0


def test_feeds_into_one_table_lose_nothing(spark, tmp_path):
    """Two feeds with batches of one file, a feed that starts over with an empty checkpoint folder, and a batch that is repeated."""
    root = str(tmp_path)
    table, quarantine = VersionedTable(spark, f"{root}/events"), VersionedTable(spark, f"{root}/quarantine")

    def run(name, state):
        feeds.finish(feeds.isolated_event_files(spark, f"{root}/{name}", table, quarantine, f"{root}/{state}", schemas.EVENTS, max_files=1))
        return sorted(r["ts"] for r in table.read().collect())

    for k in range(3):
        write(spark, rows_of(1000 + k, 1), f"{root}/a")
    for k in range(2):
        write(spark, rows_of(2000 + k, 1), f"{root}/b")
    assert run("a", "state-a") == [1000, 1001, 1002]
    assert run("b", "state-b") == [1000, 1001, 1002, 2000, 2001]
    write(spark, rows_of(3000, 1), f"{root}/c")
    (tmp_path / "state-a").rename(tmp_path / "old-state")
    assert run("c", "state-a") == [1000, 1001, 1002, 2000, 2001, 3000]
    # The last batch is run again: its record of completion is lost.
    for record in (tmp_path / "state-a" / "commits").glob("*"):
        record.unlink()
    assert run("c", "state-a") == [1000, 1001, 1002, 2000, 2001, 3000]


def click_stream(spark, root, rows):
    df = spark.createDataFrame(rows, "event_id int, user_id string, item_id string, s int, value double")
    df = df.select("event_id", "user_id", "item_id", F.timestamp_seconds(F.lit(1704067200) + F.col("s")).alias("ts"), "value")
    df.coalesce(1).write.mode("append").parquet(f"{root}/clicks")
    return spark.readStream.schema(df.schema).parquet(f"{root}/clicks")


def test_duplicates_and_late_events(spark, tmp_path):
    root = str(tmp_path)

    def run(rows):
        stream = windows.distinct_events(click_stream(spark, root, rows), "1 hour")
        feeds.finish(feeds.stream_to_parquet(stream, f"{root}/out", f"{root}/state"))
        return sorted(r["event_id"] for r in spark.read.parquet(f"{root}/out").collect())

    assert run([(1, "u", "i", 0, 1.0), (1, "u", "i", 0, 1.0), (2, "u", "i", 9000, 1.0)]) == [1, 2]
    # event 3 is older than the watermark, event 2 is a repeat
    assert run([(3, "u", "i", 10, 1.0), (2, "u", "i", 9000, 1.0), (4, "u", "i", 9100, 1.0)]) == [1, 2, 4]


def test_windows_and_sessions(spark, tmp_path):
    root = str(tmp_path)
    stream = click_stream(spark, root, [(1, "u", "a", 0, 1.0), (2, "u", "a", 60, 2.0), (3, "u", "b", 4000, 1.0), (4, "v", "a", 90000, 1.0)])
    feeds.finish(feeds.stream_to_parquet(windows.windowed_popularity(stream, "1 minute", "1 hour"), f"{root}/w", f"{root}/ws"))
    got = {(r["item_id"], r["n_events"], r["value"]) for r in spark.read.parquet(f"{root}/w").collect()}
    assert got == {("a", 2, 3.0), ("b", 1, 1.0)}
    feeds.finish(feeds.stream_to_parquet(windows.session_counts(stream, "1 minute", "30 minutes"), f"{root}/s", f"{root}/ss"))
    assert sorted(r["n_events"] for r in spark.read.parquet(f"{root}/s").collect()) == [1, 2]


def test_update_worker(spark, tmp_path):
    root = str(tmp_path)
    first = rows_of(1000, 20)
    write(spark, first, f"{root}/feed")
    inter = interactions(spark.createDataFrame(first, EVENTS)).cache()
    model = ALSModel(factors=3, iterations=3, regularization=0.1).fit(inter)
    worker = UpdateWorker(spark, f"{root}/state", model.item_vectors(), 3, 0.1, 1.0)

    def run():
        feeds.finish(worker.run(feeds.event_files(spark, f"{root}/feed"), f"{root}/checkpoint"))

    run()
    assert {r["user_id"] for r in worker.users.read().collect()} == {f"u{i}" for i in range(5)}
    # newer events on two unseen items; one of them only from an unknown user without any known item
    second = [("u0", "item9", 1100, 2), ("u0", "i1", 1101, 1), ("u1", "item9", 1102, 1), ("stranger", "item10", 1103, 1)]
    write(spark, second, f"{root}/feed")
    run()
    items = {r["item_id"] for r in worker.items.read().collect()}
    assert "item9" in items and "item10" not in items
    assert [r["item_id"] for r in spark.read.parquet(f"{root}/state/pending").collect()] == ["item10"]
    full = interactions(spark.createDataFrame(first + second, EVENTS))
    want = {r["user_id"]: r["vector"] for r in fold_in(full, worker.items.read(), 3, 0.1, 1.0).collect()}
    got = {r["user_id"]: r["vector"] for r in worker.users.read().collect()}
    for user in ("u0", "u1"):
        assert got[user] == pytest.approx(want[user], abs=1e-9)
    # a repeated batch changes nothing
    worker.update(spark.createDataFrame(second, EVENTS), 1)
    again = {r["user_id"]: r["vector"] for r in worker.users.read().collect()}
    assert again["u0"] == pytest.approx(got["u0"], abs=1e-9)


def test_worker_honours_tombstones(spark, tmp_path):
    root = str(tmp_path)
    rows = rows_of(1000, 20)
    events = spark.createDataFrame(rows, EVENTS)
    model = ALSModel(factors=3, iterations=3, regularization=0.1).fit(interactions(events))
    worker = UpdateWorker(spark, f"{root}/state", model.item_vectors(), 3, 0.1, 1.0, buckets=4, privacy_root=root)
    worker.update(events, 0)
    worker.update(events.where("user_id <> 'u0'"), 1)
    privacy.store_events(events, root)
    requests = spark.createDataFrame([("u1",)], "user_id string")
    assert privacy.delete_users(spark, root, requests, confirm=True, key="r") == 1
    for _ in range(2):
        worker.erase(requests, "r")
    users = lambda path: {r.user_id for r in spark.read.parquet(path).select("user_id").distinct().collect()}
    assert users(f"{root}/state/interactions") == users(f"{root}/state/user_vectors") == {"u0", "u2", "u3", "u4"}
    worker.update(events, 2)  # a late delivery of the deleted user's events
    assert "u1" not in users(f"{root}/state/interactions") | {r.user_id for r in worker.users.read().collect()}
    kept = model.forget(privacy.deleted_users(spark, root))
    assert {r.user_id for r in kept.user_vectors().collect()} == {"u0", "u2", "u3", "u4"}
