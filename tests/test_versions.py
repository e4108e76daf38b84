"""Versioned tables: the newest record of each key, listings that move, writers that meet, batches that run twice."""

import random

import pytest
from pyspark.sql import functions as F

from adsentry.sources import versions as V

LOG = "task string, person long, value string, ts long"


def rows_of(df):
    return sorted(tuple(r) for r in df.drop("bucket").collect())


def test_newest_record_of_each_key(spark, tmp_path):
    schema = spark.createDataFrame([], LOG).schema
    state = V.newest_state(spark, f"file://{tmp_path}/state", schema)
    rng, known = random.Random(2), {}
    newest = [F.col("ts")]
    for number in range(6):
        batch = [(f"t{rng.randrange(12)}", rng.randrange(2), f"v{number}.{i}", rng.randrange(5)) for i in range(rng.choice([1, 2, 8]))]
        batch = list({(r[0], r[1], r[3]): r for r in batch}.values())
        for r in sorted(batch, key=lambda r: r[3]):
            if r[:2] not in known or r[3] >= known[r[:2]][3]:
                known[r[:2]] = r
        frame = spark.createDataFrame(batch, LOG)
        before = dict(map(lambda x: (tuple(x[0]), x[1]), state.manifest()["partitions"]))
        V.upsert_newest(state, frame, ["task", "person"], newest, 8, number)
        assert rows_of(state.read()) == sorted(known.values())
        after = dict(map(lambda x: (tuple(x[0]), x[1]), state.manifest()["partitions"]))
        touched = {(str(r.b),) for r in frame.select(F.pmod(F.xxhash64("task", "person"), F.lit(8)).alias("b")).collect()}
        assert all(after[k] == before[k] for k in before if k not in touched)
        at = state.manifest()["number"]
        assert V.upsert_newest(state, frame, ["task", "person"], newest, 8, number) == at
    assert len(state.numbers()) == 2
    assert rows_of(state.read(state.numbers()[0])) != []


def test_stream_keeps_newest(spark, tmp_path):
    schema = spark.createDataFrame([], LOG).schema
    state = V.newest_state(spark, f"file://{tmp_path}/state", schema)
    for i, rows in enumerate([[("a", 1, "x", 1), ("b", 1, "y", 5)], [("a", 1, "z", 2), ("b", 1, "old", 3)]]):
        spark.createDataFrame(rows, LOG).coalesce(1).write.json(f"{tmp_path}/in/{i}")
        query = V.keep_newest(spark.readStream.schema(schema).json(f"{tmp_path}/in/*"), state, f"{tmp_path}/check", ["task", "person"], [F.col("ts")], 8)
        query.processAllAvailable()
        query.stop()
    assert rows_of(state.read()) == [("a", 1, "z", 2), ("b", 1, "y", 5)]


STORE = "key string, label string, category string, title string"


def test_listings_move(spark, tmp_path):
    store = V.Versions(spark, f"file://{tmp_path}/store", ["label", "category"], spark.createDataFrame([], STORE).schema)
    put = lambda *rows: V.move_listings(store, spark.createDataFrame(list(rows), STORE), "key")
    put(("5", "01", None, "e"))
    assert [tuple(v) for v, _ in store.manifest()["partitions"]] == [("01", None)]
    put(("5", "1", "mode", "e"))
    assert rows_of(store.read()) == [("5", "1", "mode", "e")] and len(store.manifest()["partitions"]) == 1
    store.replace(store.read().limit(0), [("1", "mode")], store.manifest())
    put(("1", "betrug", "auto", "a"), ("2", "betrug", "möbel/küche", "b"), ("3", "serioes", "auto", "c"), ("3", "serioes", "auto", "b"))
    assert rows_of(store.read()) == [("1", "betrug", "auto", "a"), ("2", "betrug", "möbel/küche", "b"), ("3", "serioes", "auto", "c")]
    untouched = {tuple(v): f for v, f in store.manifest()["partitions"]}
    put(("2", "serioes", "auto", "b2"), ("4", "serioes", "mode", "d"))
    assert rows_of(store.read()) == [("1", "betrug", "auto", "a"), ("2", "serioes", "auto", "b2"), ("3", "serioes", "auto", "c"), ("4", "serioes", "mode", "d")]
    now = {tuple(v): f for v, f in store.manifest()["partitions"]}
    assert ("betrug", "möbel/küche") not in now and now["betrug", "auto"] == untouched["betrug", "auto"]
    assert rows_of(store.read(wanted=[("serioes", "mode")])) == [("4", "serioes", "mode", "d")]
    assert rows_of(store.read(store.numbers()[-2])) == [("1", "betrug", "auto", "a"), ("2", "betrug", "möbel/küche", "b"), ("3", "serioes", "auto", "c")]


def test_a_slower_writer_changes_nothing(spark, tmp_path):
    store = V.Versions(spark, f"file://{tmp_path}/store", ["label"], spark.createDataFrame([], "key string, label string").schema)
    before = store.manifest()
    rows = lambda *x: spark.createDataFrame(list(x), "key string, label string")
    store.replace(rows(("1", "a")), [("a",)], before)
    with pytest.raises(RuntimeError, match="another writer"):
        store.replace(rows(("2", "a")), [("a",)], before)
    assert rows_of(store.read()) == [("1", "a")]
    with pytest.raises(ValueError, match="not given"):
        store.replace(rows(("2", "b")), [("a",)], store.manifest())
    store.replace(store.read().limit(0), [("a",)], store.manifest())
    assert rows_of(store.read()) == []
