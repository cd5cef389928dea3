"""Readers, sinks and streams on small files."""

import json
import time

import numpy as np
import pytest

from fathomry.operators import manifest
from fathomry.plans import stream_queries
from fathomry.sources import readers, sinks
from fathomry.streaming import streams


def test_class_folders_and_images(spark, tmp_path):
    for p in ("b/1.png", "a/2.JPG", "a/3.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    assert {(r["class"], r.label) for r in readers.class_folders(spark, str(tmp_path)).collect()} == {("a", 0), ("b", 1)}
    assert [r.path[-5:] for r in readers.images(spark, str(tmp_path), 1).collect()] == ["2.JPG"]


@pytest.mark.parametrize("labels", [[["a.png", 3], ["b.png", 0]], None])
def test_label_file(spark, tmp_path, labels):
    (tmp_path / "dataset.json").write_text(json.dumps({"labels": labels}, indent=1))
    assert [tuple(r) for r in readers.label_file(spark, str(tmp_path / "dataset.json")).collect()] == [tuple(x) for x in labels or []]


def test_ragged_csv(spark, tmp_path):
    (tmp_path / "log.csv").write_text("epoch,itr,loss\n1,2,0.5\n1,3\n")
    rows = readers.iteration_csv(spark, str(tmp_path / "log.csv"), "epoch int, itr int, loss double").orderBy("itr").collect()
    assert [(r.itr, r.loss, r._corrupt is None) for r in rows] == [(2, 0.5, True), (3, None, False)]


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", reps=np.ones((5, 3)), other=np.zeros(2))
    np.savez(tmp_path / "b.npz", x=np.zeros((4, 3, 1, 1)))
    np.savez(tmp_path / "c.npz", np.zeros(2), np.zeros(3))
    assert readers.representations(spark, str(tmp_path / "[ab].npz")).count() == 9
    with pytest.raises(Exception, match="which array"):
        readers.representations(spark, str(tmp_path / "c.npz")).count()


def test_tick_stats(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"Loss/G/loss":{"num":4,"mean":1.5,"std":0.5},"timestamp":1700000000.0}\n')
    assert [tuple(r) for r in readers.tick_stats(spark, str(tmp_path)).collect()] == [("Loss/G/loss", 4.0, 1.5, 0.5)]


def test_metric_lines_round_trip(spark, tmp_path):
    sinks.append_metrics(spark.createDataFrame([(12.3,)], "fid double"), str(tmp_path / "m"), metric="fid50k", seconds=780)
    r = readers.metric_log(spark, str(tmp_path / "m")).first()
    assert (r.metric, r.results, r.total_time_str) == ("fid50k", {"fid": 12.3}, "13m 00s")


def test_export_resumes(spark, tmp_path):
    items = spark.range(10).selectExpr("id as idx", "'train' as split", "id % 2 as label")
    assert sinks.export(items.where("idx < 4"), str(tmp_path / "e")) == 4
    assert sinks.export(items, str(tmp_path / "e")) == 6
    assert sinks.export(items, str(tmp_path / "e")) == 0


def test_checks(spark):
    items = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, class string")
    with pytest.raises(ValueError):
        manifest.require_labels(items, spark.createDataFrame([("a", 1)], "path string, label int")).count()
    with pytest.raises(ValueError):
        manifest.class_subset(items, ["x", "z"])


def test_multiblock(spark):
    ids = spark.range(20).withColumnRenamed("id", "idx")
    rows = sorted(manifest.multiblock_masks(ids, "idx", batch=6).collect())
    assert rows == sorted(manifest.multiblock_masks(ids.repartition(7), "idx", batch=6).collect())
    for b in range(4):
        mine = [r for r in rows if r.batch == b]
        assert len(mine) == (6, 6, 6, 2)[b] and {r.idx // 6 for r in mine} == {b}
        assert len({len(t) for r in mine for t in r.targets}) == 1 and len({len(c) for r in mine for c in r.contexts}) == 1  # one size, and one length after trimming
        for r in mine:
            assert len(r.targets) == 4 and len(r.contexts) == 1 and len(r.contexts[0]) > 10
            assert not set(r.contexts[0]) & {c for t in r.targets for c in t} and all(max(c // 14 for c in t) < 13 and max(c % 14 for c in t) < 13 for t in r.targets)
    assert len({len(r.targets[0]) for r in rows}) > 1
    both = manifest.multiblock_masks(ids, "idx", contexts=2, overlap=True).first()
    assert len(both.contexts) == 2 and set(both.contexts[0]) & {c for t in both.targets for c in t}


def test_contexts_give_up_targets_when_they_must(spark):
    ids = spark.range(12).withColumnRenamed("id", "idx")
    rows = manifest.multiblock_masks(ids, "idx", targets=9, min_keep=24, context_scale=(0.2, 0.25), timeout=2).collect()
    assert all(len(r.contexts[0]) > 24 for r in rows)
    assert any(set(r.contexts[0]) & {c for t in r.targets for c in t} for r in rows)


def test_stream_equals_batch(spark, sf):
    from pyspark.sql import functions as F

    from fathomry.operators import telemetry
    from fathomry.plans import fixtures

    batch = fixtures.telemetry(spark, sf)
    slow, root = stream_queries.source(spark, sf, 3)
    averages = streams.averaged(slow, ["run", "name"], 0.9)
    assert 0 < streams.run_some(averages, f"{root}/o", f"{root}/c", 1) < 3
    got = streams.drained(averages, f"{root}/o", f"{root}/c")
    last = {(r.run, r.name): round(r.e, 9) for r in got.groupBy("run", "name").agg(F.max_by("ema", "step").alias("e")).collect()}
    assert last == {(r.run, r.name): round(r.ema, 9) for r in telemetry.ema(batch, ["run", "name"], 0.9).collect()}


def test_windowed_moments_equal_batch(spark, sf):
    from pyspark.sql import functions as F

    from fathomry.operators import telemetry
    from fathomry.plans import fixtures

    rows, root = stream_queries.source(spark, sf, 3)
    every = fixtures.telemetry(spark, sf)
    streams.close_stream(spark, f"{root}/in", every.agg(F.max("ts").cast("timestamp") + F.expr("INTERVAL 3 DAYS")).first()[0])
    got = stream_queries.run(streams.windowed_moments(rows, "1 day"), root).collect()
    batch = telemetry.moments(every.withColumn("start", F.window(F.col("ts").cast("timestamp"), "1 day").start), ["start", "name"])
    want = {(r.start, r.name): (r.num, round(r["mean"], 9)) for r in batch.collect()}
    assert {(r.start, r.name): (r.num, round(r["mean"], 9)) for r in got} == want


def folds():
    """Each fold of the streams, without a stream: f(state, steps, values)."""
    import types

    found = {}

    def keep(rows, keys, out, fold, *, state, start=(), listed=False):
        found[out] = (fold, np.zeros(0) if listed else start)

    real, streams._folded = streams._folded, keep
    try:
        rows = types.SimpleNamespace()
        streams.smoothed(rows, ["k"], 4)
        streams.records(rows, ["k"])
        streams.controlled(rows, ["k"], target=0.2, gain=0.3)
        streams.averaged(rows, ["k"], 0.8)
        streams.last_n(rows, ["k"], 3)
    finally:
        streams._folded = real
    return found


def test_folds_carry_their_state_over_any_cuts():
    r = np.random.default_rng(1)
    values = np.round(r.standard_normal(60), 1)
    for fold, start in folds().values():
        whole = fold(start, np.arange(60), values)[1]
        for cuts in ([1, 2, 3], [10, 59], [25]):
            state, parts = start, []
            for a, b in zip([0, *cuts], [*cuts, 60]):
                state, out = fold(state, np.arange(a, b), values[a:b])
                parts.append(out)
            for c in whole:
                got, want = [x for p in parts for x in list(p[c])], list(whole[c])
                assert len(got) == len(want) and all(np.allclose(g, w) for g, w in zip(got, want))
    plain = [min(values[: i + 1]) for i in range(60)]
    records = [f for k, f in folds().items() if "best" in k][0]
    assert list(records[0](records[1], np.arange(60), values)[1]["step"]) == [i for i in range(60) if i == 0 or values[i] < plain[i - 1]]


def test_state_rows_are_for_parts_of_the_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "BUCKETS", 8, raising=False)
    rows = [(k, i, f"n{k}", float(i + (k or 0)), i) for k in [None, 0, *range(1, 60)] for i in range(6)]
    for a in (0, 3):
        part = spark.createDataFrame([r for r in rows if a <= r[1] < a + 3], "run long, step long, name string, value double, i int").selectExpr("run", "timestamp_seconds(i) AS ts", "step", "name", "value", "1L AS n")
        part.coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    banks = streams.last_n(streams.tail(spark, f"{tmp_path}/in", stream_queries.SCHEMA), ["run", "name"], 4)
    query = streams._started(banks, f"{tmp_path}/out", f"{tmp_path}/state", "append", availableNow=True)
    query.awaitTermination()
    assert len(query.recentProgress) >= 2 and query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    got = {(r.run, r.name, r.step): r.bank for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(k, n, i): [float(j + (k or 0)) for j in range(max(0, i - 3), i + 1)] for k, i, n, _, _ in rows}


def test_stretches_of_several_files_come_one_to_a_trigger(spark, sf, monkeypatch):
    monkeypatch.setattr(stream_queries, "ROWS", 100, raising=False)
    rows, root = stream_queries.source(spark, sf, 3)
    banks = streams.last_n(rows, ["run", "name"], 5)
    query = streams._started(banks, f"{root}/out", f"{root}/state", "append", availableNow=True)
    query.awaitTermination()
    assert len(spark.read.json(f"{root}/in").inputFiles()) > 3 and len([p for p in query.recentProgress if p["numInputRows"]]) == 3


def test_the_state_has_no_more_parts_than_cores(spark, sf):
    rows, root = stream_queries.source(spark, sf, 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        query = streams._started(streams.records(rows, ["run", "name"]), f"{root}/out", f"{root}/state", "append", availableNow=True)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numShufflePartitions"] == spark.sparkContext.defaultParallelism == 4
        assert spark.conf.get("spark.sql.shuffle.partitions") == "16"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_stream_is_given_only_the_columns_that_it_reads(spark, sf):
    rows, root = stream_queries.source(spark, sf, 2, "ts timestamp, name string, value double")
    made, events = spark.read.parquet(f"{root}/rows"), spark.read.parquet(f"{sf}/events.parquet")
    assert sorted(made.columns) == ["name", "stretch", "ts", "value"] and rows.columns == ["ts", "name", "value"]
    assert spark.read.json(f"{root}/in").count() == events.count()
