"""Streams over several micro-batches give what the batch operators give."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from molframe.functions.tokens import hashed_fp, tokenize
from molframe.operators.runlog import early_stop, topk_checkpoints
from molframe.streaming.streams import (
    _folded,
    late_records,
    read_files,
    read_state,
    read_stops,
    stream_early_stop,
    stream_featurize,
    stream_topk,
    stream_windowed_loss,
)

SCHEMA = "run string, step bigint, loss double"


def arriving(spark, path, parts, schema):
    """One file per part, so one micro-batch per part, in order."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return read_files(spark, path, spark.read.parquet(path).schema, files_per_batch=1)


def make_log(seed):
    rng = random.Random(seed)
    parts, level = [], {}
    for batch in range(4):
        rows = []
        for run in ("hot", "b", "c"):
            for i in range(30 if run == "hot" else 5):
                step, value = level.get(run, (0, 5.0))
                value += rng.uniform(-1, 0.95)
                level[run] = (step + 1, value)
                rows.append((run, step, math.nan if rng.random() < 0.05 else round(value, 3)))
        parts.append(rows)
    return parts


def plain(df):
    return sorted((tuple(None if v is None else v for v in r) for r in df.collect()), key=repr)


def test_topk_and_early_stop(spark, tmp_path):
    for seed in (1, 2):
        parts = make_log(seed)
        base = str(tmp_path / str(seed))
        whole = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
        stream_topk(arriving(spark, f"{base}/log", parts, SCHEMA), f"{base}/top", f"{base}/ck1", k=3)
        assert plain(read_state(spark, f"{base}/top")) == plain(topk_checkpoints(whole, 3).drop("rank"))
        log = read_files(spark, f"{base}/log", whole.schema, files_per_batch=1)
        stream_early_stop(log, f"{base}/stop", f"{base}/ck2", patience=2, epoch="step")
        assert plain(read_state(spark, f"{base}/stop")) == plain(early_stop(whole, 2, epoch="step"))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    fold = _folded(target, {"state": "x int"}, lambda states, batch: {"state": states["state"].unionByName(batch)}, "x")
    a, b = (spark.createDataFrame([(i,)], "x int") for i in (1, 2))
    fold(a, 0)
    fold(b, 1)
    fold(b, 1)
    assert sorted(r["x"] for r in read_state(spark, target).collect()) == [1, 2]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    target = str(tmp_path / "t")
    keep = lambda states, batch: {"state": states["state"].unionByName(batch)}
    fold = _folded(target, {"state": "run string, x int"}, keep, "run", 1000)
    fold(spark.createDataFrame([("a", 1), ("b", 1)], "run string, x int"), 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t/state").rglob("*.parquet")}
    fold(spark.createDataFrame([("b", 2)], "run string, x int"), 1)
    fold(spark.createDataFrame([("b", 3)], "run string, x int"), 2)
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("a")), F.lit(1000)).cast("int")).first()[0]
    mine = [p for p in before if f"bucket={bucket}/" in str(p)]
    assert mine and all(p.exists() and p.stat().st_mtime_ns == before[p] for p in mine)
    assert plain(read_state(spark, target)) == [("a", 1), ("b", 1), ("b", 2), ("b", 3)]
    # A bucket that a batch empties stays empty although its slot held rows two batches ago.
    drop = _folded(target, {"state": "run string, x int"}, lambda states, batch: {"state": batch.limit(0)}, "run", 1000)
    drop(spark.createDataFrame([("b", 4)], "run string, x int"), 3)
    assert plain(read_state(spark, target)) == [("a", 1)]


def test_records_out_of_order_wait_or_are_counted(spark, tmp_path):
    rng = random.Random(4)
    log = [(run, e, round(rng.uniform(0, 5), 2)) for run in ("hot", None) for e in range(1, 25)]
    # Every record is at most three epochs behind the newest.
    shuffled = sorted(log, key=lambda r: r[1] + rng.uniform(0, 2.9))
    parts = [shuffled[i : i + 12] for i in range(0, len(shuffled), 12)]
    base = str(tmp_path)
    whole = spark.createDataFrame(log, SCHEMA)
    stream_early_stop(
        arriving(spark, f"{base}/log", parts, SCHEMA), f"{base}/stop", f"{base}/ck", patience=2, epoch="step", slack=3, buckets=4
    )
    assert plain(read_stops(spark, f"{base}/stop", 2)) == plain(early_stop(whole, 2, epoch="step"))
    assert plain(late_records(spark, f"{base}/stop")) == [("hot", 0), (None, 0)]
    # Without slack, what comes behind a folded epoch or has none changes nothing and is counted.
    parts = [[("a", 1, 3.0), ("a", 5, 2.0)], [("a", 4, 0.1), ("a", None, 0.1), ("a", 5, 0.1)], [("a", 6, 1.5)]]
    stream_early_stop(arriving(spark, f"{base}/log2", parts, SCHEMA), f"{base}/stop2", f"{base}/ck2", epoch="step")
    assert plain(read_state(spark, f"{base}/stop2")) == [("a", None, 6, 1.5)]
    assert plain(late_records(spark, f"{base}/stop2")) == [("a", 3)]


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "run string, ts timestamp, loss double"
    parts = [
        [("a", t0 + timedelta(minutes=m), 1.0) for m in (1, 2)],
        [("a", t0 + timedelta(hours=3), 2.0)],
        [("a", t0 + timedelta(hours=6), 2.0)],
        [("a", t0 + timedelta(minutes=3), 100.0), ("a", t0 + timedelta(hours=9), 2.0)],
        [("a", t0 + timedelta(hours=12), 2.0)],
    ]
    log = arriving(spark, str(tmp_path / "log"), parts, schema)
    stream_windowed_loss(log, str(tmp_path / "out"), str(tmp_path / "ck"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r["avg_loss"], r["n_steps"]) for r in rows][:2] == [(1.0, 2), (2.0, 1)]
    assert len({r["window_start"] for r in rows}) == len(rows)


def test_featurizing_stream_equals_batch(spark, tmp_path):
    parts = [[(1, "CCO"), (2, "C" * 300)], [(3, "c1ccccc1"), (4, "")]]
    docs = arriving(spark, str(tmp_path / "in"), parts, "id bigint, s string")
    stream_featurize(docs, "id", "s", str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r["id"]: r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.createDataFrame([r for p in parts for r in p], "id bigint, s string").filter("id in (1, 3)")
    want = {r["id"]: r["x"] for r in batch.select("id", hashed_fp(tokenize(F.col("s"), "smiles")).alias("x")).collect()}
    assert got == want
