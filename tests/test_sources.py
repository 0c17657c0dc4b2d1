import json
import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molframe.functions.text import PARAMETER_RULES, first_match_rewrite, uri_parts
from molframe.operators.clean import (
    clean_by_length,
    clean_report,
    drop_empty_features,
    normalize_names,
    pivot_tasks,
    unpivot_tasks,
    with_weights,
)
from molframe.operators.joins import experiment_grid
from molframe.operators.sets import id_overlap, mixture, subset_exact
from molframe.plans.lineage import CHECKPOINT_SETTING, cut, shared_root, spread
from molframe.registry import TASKS, TRANSFORMERS, DatasetSpec, resolve
from molframe.sources.readers import (
    chunk_manifest,
    read_config,
    read_labelled,
    read_npz,
    read_presplit,
    read_spec,
    rebalance,
    rows_per_file,
)
from molframe.sources.shards import merge_shards, shard_ranges, with_shard
from molframe.sources.sinks import append_metrics, write_if_absent, write_new, write_shards, write_splits, write_vocab


def test_labelled_csv_with_gaps(spark, tmp_path):
    path = str(tmp_path / "d.csv")
    with open(path, "w") as f:
        f.write('mol,smiles,t1,t2\na,"C,C",1,\nb,CC,,0.5\n')
    rows = read_spec(spark, path, DatasetSpec("smiles", ("t1", "t2"), "mol")).collect()
    assert [tuple(r) for r in rows] == [("a", "C,C", 1.0, None), ("b", "CC", None, 0.5)]


def test_manifest_names_have_three_digits(spark):
    rows = chunk_manifest(spark, "1B", "lib/").orderBy("chunk").collect()
    assert len(rows) == 100 and rows[0]["path"] == "lib/chunk_000.csv" and rows[99]["path"] == "lib/chunk_099.csv"


def test_npz_blocks(spark, tmp_path):
    for i in range(3):
        np.savez(tmp_path / f"b{i}.npz", x=np.full((4, 2), float(i)), smiles=np.array([f"C{i}{j}" for j in range(4)]))
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("smiles", T.StringType())])
    df = read_npz(spark, str(tmp_path), schema)
    assert df.count() == 12
    assert {tuple(r["x"]) for r in df.collect()} == {(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)}


def test_config(spark, tmp_path):
    path = str(tmp_path / "c.json")
    with open(path, "w") as f:
        json.dump([{"model": "m", "init": {"batch_size": 8}}, {"model": "n"}], f, indent=1)
    row = read_config(spark, path, T.StructType.fromDDL("model string, init struct<batch_size: int>")).first()
    assert row["model"] == "m" and row["init"]["batch_size"] == 8


def test_sinks_say_what_they_do_to_existing_targets(spark, tmp_path):
    path = str(tmp_path / "t")
    write_new(spark.range(3), path)
    with pytest.raises(AnalysisException):
        write_new(spark.range(5), path)
    write_if_absent(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    metrics = str(tmp_path / "m")
    one = spark.createDataFrame([("d", 0.5)], "dataset string, value double")
    append_metrics(one, metrics)
    append_metrics(one, metrics)
    assert spark.read.parquet(metrics).count() == 2
    vocab = str(tmp_path / "v")
    write_vocab(spark.createDataFrame([("C", 3, 0)], "token string, n bigint, token_id bigint"), vocab)
    assert spark.read.json(vocab).first()["token"] == "C"


def test_split_folders_prune(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.range(30).withColumn("split", F.when(F.col("id") < 20, "train").when(F.col("id") < 25, "valid").otherwise("test"))
    write_splits(df, path)
    one = spark.read.parquet(path).filter("split = 'test'")
    assert one.count() == 5
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().executedPlan().toString()
    csv = str(tmp_path / "csv")
    write_splits(df, csv, "csv")
    for split in ("train", "valid", "test"):
        os.symlink(f"{csv}/split={split}", f"{csv}/{split}.csv")
    back = read_presplit(spark, csv, T.StructType.fromDDL("id bigint"))
    assert {(r["split"], r["count"]) for r in back.groupBy("split").count().collect()} == {("train", 20), ("valid", 5), ("test", 5)}


def test_shards(spark, tmp_path):
    path = str(tmp_path / "sh")
    write_shards(spark.range(100, numPartitions=1), path, 30)
    files = spark.read.parquet(path).groupBy("_metadata.file_path").count().collect()
    assert sorted(r["count"] for r in files) == [10, 30, 30, 30]
    counted = {r["is_total"]: r["n_rows"] for r in rows_per_file(spark.read.parquet(path)).collect()}
    assert counted[1] == 100
    a, b = (with_shard(spark.range(n).withColumn("src", F.lit(n)), ["id"], 30) for n in (70, 40))
    rows, meta = merge_shards(a, b)
    assert rows.count() == 110
    listed = [(r["part"], r["shard"], r["n_rows"], r["merged_shard"]) for r in meta.orderBy("merged_shard").collect()]
    assert listed == [(0, 0, 30, 0), (0, 1, 30, 1), (0, 2, 10, 2), (1, 0, 30, 3), (1, 1, 10, 4)]


@pytest.mark.parametrize("shards,workers", [(10, 3), (3, 10), (7, 7), (1, 4)])
def test_shard_ranges(spark, shards, workers):
    got = {r["shard"]: r["worker"] for r in shard_ranges(spark.range(shards).toDF("shard"), workers).collect()}
    want = {s: p for p in range(workers) for s in range(p * shards // workers, (p + 1) * shards // workers)}
    assert got == want


def test_length_filter_edges(spark):
    rows = [("a", "x" * 199), ("b", "x" * 200), ("c", "x" * 201), ("d", ""), ("e", None)]
    df = spark.createDataFrame(rows, "id string, s string")
    assert {r["id"] for r in clean_by_length(df, "s").collect()} == {"a", "b", "d"}
    report = clean_report(df.withColumn("k", F.lit(1)), "s", 200, ["k"]).first()
    assert (report["original"], report["kept"], report["removed"]) == (5, 3, 2)
    arrays = spark.createDataFrame([(1, [1]), (2, []), (3, None)], "id int, x array<int>")
    assert [r["id"] for r in drop_empty_features(arrays).collect()] == [1]


def test_unpivot_and_back(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, None, 1.0)], "id int, a double, b double")
    back = pivot_tasks(unpivot_tasks(df, "id", ["a", "b"]), "id", ["a", "b"])
    assert sorted(map(tuple, back.collect())) == [(1, 0.5, None), (2, None, 1.0)]
    assert [tuple(r)[3:] for r in with_weights(df, ["a", "b"]).orderBy("id").collect()] == [(1.0, 0.0), (0.0, 1.0)]


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], ["measured log  solubility", "Skin \\\n   disorders"])
    assert normalize_names(df).columns == ["measured_log_solubility", "Skin_disorders"]
    assert resolve("esol") == "delaney" and resolve("hiv") == "hiv"
    assert len(TASKS["tox21"]) == 12 and len(TASKS["sider"]) == 27 and TRANSFORMERS["clearance"] == ("log",)


def test_parameter_rules(spark):
    names = {
        "module.molformer.embeddings.word_embeddings.weight": "tok_emb.weight",
        "molformer.encoder.layer.11.attention.self.query.bias": "blocks.layers.11.attention.query_projection.bias",
        "molformer.encoder.layer.0.attention.self.feature_map.weight": "blocks.layers.0.attention.inner_attention.feature_map.omega",
        "molformer.encoder.layer.3.attention.output.LayerNorm.weight": "blocks.layers.3.norm1.weight",
        "molformer.encoder.layer.3.output.LayerNorm.weight": "blocks.layers.3.norm2.weight",
        "module.molformer.LayerNorm.weight": "blocks.norm.weight",
        "lm_head.decoder.weight": "lang_model.head.weight",
        "unknown.key": None,
    }
    df = spark.createDataFrame([(k,) for k in names], "k string")
    new = first_match_rewrite(F.col("k"), PARAMETER_RULES, strip="module.")
    assert {r["k"]: r["n"] for r in df.select("k", new.alias("n")).collect()} == names


def test_uri(spark):
    df = spark.createDataFrame([("s3://bucket/a/b/chunk_001.csv",), ("local/x.npz",)], "u string")
    rows = [r["p"].asDict() for r in df.select(uri_parts(F.col("u")).alias("p")).collect()]
    assert rows[0] == {"scheme": "s3", "bucket": "bucket", "key": "a/b/chunk_001.csv", "basename": "chunk_001.csv", "stem": "chunk_001", "is_object_store": True}
    assert rows[1]["key"] == "local/x.npz" and rows[1]["bucket"] is None and not rows[1]["is_object_store"]


def test_subset_is_exact_and_stable(spark):
    df = spark.range(5000)
    a = {r["id"] for r in subset_exact(df.repartition(3), "id", 777, 1).collect()}
    b = {r["id"] for r in subset_exact(df.repartition(11), "id", 777, 1, slices=2).collect()}
    assert len(a) == 777 and a == b
    assert {r["id"] for r in subset_exact(df, "id", 500, 1).collect()} < a
    assert subset_exact(df, "id", 9999).count() == 5000 and subset_exact(df, "id", 0).count() == 0
    same = spark.createDataFrame([(7,)] * 50, "id bigint")
    assert subset_exact(same, "id", 20).count() == 20
    mixed = mixture([(df, 0.5), (spark.range(5000, 6000), 1.0)], "id")
    assert 3300 < mixed.count() < 3700 and mixed.filter("id >= 5000").count() == 1000
    assert id_overlap(df, mixed, "id").count() == mixed.filter("id < 5000").count()


def test_grid(spark):
    data = spark.createDataFrame([("hiv",), ("lipo",)], "dataset string")
    over = spark.createDataFrame([("hiv", 32)], "dataset string, batch_size int")
    rows = experiment_grid(data, ["s", "m"], {"batch_size": 64, "nb_epoch": 50}, over).collect()
    assert {(r["dataset"], r["source"], r["batch_size"], r["nb_epoch"]) for r in rows} == {
        ("hiv", "s", 32, 50), ("hiv", "m", 32, 50), ("lipo", "s", 64, 50), ("lipo", "m", 64, 50),
    }


class Session:
    """Just the settings of a session."""

    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.conf = self
        self.master = master
        self.folder = folder

    def get(self, name, default=None):
        return self.folder if name == CHECKPOINT_SETTING else default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None


def test_shared_folder_comes_from_the_session():
    assert shared_root(Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_root(Session("local[2]", "/shared")) == "/shared"
    with pytest.raises(ValueError):
        shared_root(Session("yarn"))


def test_cut_keeps_rows_and_types(spark):
    df = spark.range(10).withColumn("x", F.array("id"))
    kept = cut(df)
    assert kept.count() == 10 and kept.schema.simpleString() == df.schema.simpleString()
    assert any(n.startswith("cut-") for n in os.listdir(shared_root(spark)))


def test_partitioning_helpers(spark):
    assert spread(spark.range(10, numPartitions=1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(10, numPartitions=64)
    assert spread(wide, "id") is wide
    assert rebalance(wide, 3).rdd.getNumPartitions() == 3
    assert rebalance(wide).count() == 10


def test_malformed_rows_are_set_aside_and_counted(spark, tmp_path):
    from molframe.sources.readers import read_checked

    (tmp_path / "a.csv").write_text('id,s,y\n1,C,0.5\n2,"C,N",n/a\n3,CC\n4,O,1,9\n5,N,\n6,"a ""b""",2\n')
    good, counts = read_checked(spark, str(tmp_path / "a.csv"), "s", ["y"], str(tmp_path / "bad"), "id")
    assert sorted(map(tuple, good.collect()), key=str) == [("1", "C", 0.5), ("5", "N", None), ("6", 'a "b"', 2.0)]
    assert good.columns == ["id", "s", "y"] and counts == {"n_rows": 6, "n_bad": 3}
    aside = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert {r["record"] for r in aside} == {'2,"C,N",n/a', "3,CC", "4,O,1,9"} and all(r["file"].endswith("a.csv") for r in aside)


def test_shapes_of_merged_shards(spark):
    from molframe.sources.shards import merge_shards

    kind = "ids int, x array<float>, y array<double>, shard bigint"
    a = spark.createDataFrame([(1, [1.0, 2.0], [0.0], 0), (2, [3.0, 4.0], [1.0], 0), (3, [5.0, 6.0], None, 1)], kind)
    b = spark.createDataFrame([(4, [1.0], [0.0], 0), (5, [1.0, 2.0], [0.0], 0)], kind)
    rows, meta = merge_shards(a, b, shapes=["ids", "x", "y"])
    got = [(r["merged_shard"], r["n_rows"], r["ids_shape"], r["x_shape"], r["y_shape"]) for r in meta.orderBy("merged_shard").collect()]
    assert got == [(0, 2, [2], [2, 2], [2, 1]), (1, 1, [1], [1, 2], [1, None]), (2, 2, [2], [2, None], [2, 1])]
    assert {r["ids"]: r["merged_shard"] for r in rows.collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 2}
