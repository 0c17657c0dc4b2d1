"""The three jobs end to end on small written molecules."""

import csv
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from molframe.operators.clean import unpivot_tasks
from molframe.registry import TASKS
from molframe.jobs import (
    benchmark_datasets,
    build_vocabularies,
    featurize_datasets,
    featurize_library,
    main,
    predict_datasets,
    split_datasets,
    train_datasets,
)

RINGS = ["C1CC1", "C1CCC1", "c1ccccc1", "C1CCNCC1", "c1ccoc1", "C1CCOC1", "c1ccncc1", "C1CCCCCC1"]


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    rng = random.Random(8)
    smiles = sorted({"C" * rng.randint(1, 12) + rng.choice(["", "O", "N"]) + rng.choice(["", *RINGS]) for _ in range(400)})
    with open(root / "bbbp.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["smiles", "p_np"])
        w.writerows([s, float("O" in s)] for s in smiles)
        w.writerow(["C" * 250, 1.0])
    with open(root / "lipo.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["smiles", "exp"])
        w.writerows([s, len(s) / 2 + 10] for s in smiles)
    return str(root), smiles


def test_removed_rows_are_counted(spark, tmp_path):
    lines = ["smiles,p_np", "CCO,1", "CCN,", "C" * 250 + ",1", ",0", "C" * 300 + ",0", "c1ccccc1,0"]
    (tmp_path / "bbbp.csv").write_text("\n".join(lines) + "\n")
    split = split_datasets(spark, ["bbbp", "nope"], str(tmp_path), str(tmp_path / "s"), "none").collect()
    assert [(r["status"], r["removed"]) for r in split] == [("done", {"missing": 1, "too_long": 2}), ("unknown", None)]
    found = featurize_datasets(spark, ["bbbp"], ["ecfp"], str(tmp_path / "s"), str(tmp_path / "f"), 5).first()
    assert found["removed"] == {"too_long": 1}
    # Without a limit nothing goes for its length; a sequence without tokens has no features.
    split = split_datasets(spark, ["bbbp"], str(tmp_path), str(tmp_path / "s2"), "none", None).first()
    assert split["removed"] == {} and spark.read.parquet(str(tmp_path / "s2/bbbp")).count() == 6
    found = featurize_datasets(spark, ["bbbp"], ["ecfp"], str(tmp_path / "s2"), str(tmp_path / "f2"), None).first()
    assert found["removed"] == {"no_features": 1}
    assert spark.read.parquet(str(tmp_path / "f2/ecfp_featurized/bbbp")).count() == 5


def test_split_featurize_benchmark(spark, data, tmp_path):
    root, smiles = data
    splits, features, metrics = (str(tmp_path / n) for n in ("splits", "features", "metrics"))
    status = {r["dataset"]: r["status"] for r in split_datasets(spark, ["bbbp", "lipo", "bace", "nope"], root, splits).collect()}
    assert status == {"bbbp": "done", "lipo": "done", "bace": "failed", "nope": "unknown"}

    rows = spark.read.parquet(f"{splits}/bbbp")
    assert rows.count() == len(smiles)  # the long one is gone
    share = {r["split"]: r["count"] / len(smiles) for r in rows.groupBy("split").count().collect()}
    assert share["train"] > 0.7
    # Same ring system, same split.
    ring = F.regexp_extract("smiles", "(c1ccccc1|C1CCNCC1|c1ccoc1)$", 1)
    torn = rows.withColumn("ring", ring).filter("ring <> ''").groupBy("ring").agg(F.count_distinct("split").alias("n"))
    assert torn.filter("n > 1").count() == 0

    found = featurize_datasets(spark, ["bbbp", "lipo"], ["ecfp", "graph", "descriptors", "tokens", "dummy", "odd"], splits, features)
    assert found.filter("status = 'done'").count() == 10
    assert found.filter("status = 'unknown'").select("step").distinct().first()[0] == "featurize:odd"
    assert spark.read.parquet(f"{features}/graph_featurized/bbbp/atoms").select("mol").distinct().count() == len(smiles)

    done = benchmark_datasets(spark, ["bbbp", "lipo"], features, metrics, seeds=(0, 1), trees=10, depth=6)
    assert done.filter("status = 'done'").count() == 2
    scores = {(r["dataset"], r["split"]): r for r in spark.read.parquet(metrics).collect()}
    assert scores[("bbbp", "test")]["metric"] == "roc_auc" and scores[("lipo", "test")]["metric"] == "rmse"
    assert scores[("lipo", "valid")]["mean"] < 6


def test_train_and_predict(spark, data, tmp_path):
    """Saved models predict all rows, in label units, as the written statistics say."""
    root, smiles = data
    splits, features, models, out = (str(tmp_path / n) for n in ("s", "f", "m", "p"))
    split_datasets(spark, ["bbbp", "lipo"], root, splits, "random")
    featurize_datasets(spark, ["bbbp", "lipo"], ["ecfp"], splits, features)
    done = train_datasets(spark, ["bbbp", "lipo", "nope"], features, models, trees=10, depth=6).collect()
    assert [r["status"] for r in done] == ["done", "done", "unknown"]
    done = predict_datasets(spark, ["bbbp", "lipo", "hiv"], features, models, out).collect()
    assert [r["status"] for r in done] == ["done", "done", "failed"]
    truth = spark.read.parquet(f"{features}/ecfp_featurized/lipo").select("smiles", "exp")
    rows = spark.read.parquet(f"{out}/lipo").join(truth, "smiles").collect()
    assert len(rows) == len(smiles) and all(r["score"] is None and r["task"] == "exp" for r in rows)
    # Labels lie between 10 and 22: untransformed predictions would be near 0.
    assert sum(abs(r["y_pred"] - r["exp"]) for r in rows) / len(rows) < 2
    rows = spark.read.parquet(f"{out}/bbbp").collect()
    assert len(rows) == len(smiles) and {r["split"] for r in rows} == {"train", "valid", "test"}
    assert all((r["score"] > 0.5) == (r["y_pred"] == 1.0) for r in rows if r["score"] != 0.5)
    right = sum(r["y_pred"] == float("O" in r["smiles"]) for r in rows if r["split"] == "train")
    assert right > 0.8 * sum(r["split"] == "train" for r in rows)
    again = train_datasets(spark, ["lipo"], features, models, trees=2, depth=2).first()
    assert again["status"] == "failed"


def test_given_splits(spark, tmp_path):
    for dataset, splits in (("bbbp", ("train", "valid", "test")), ("hiv", ("train", "test"))):
        (tmp_path / dataset).mkdir()
        for i, split in enumerate(splits):
            label = TASKS[dataset][0]
            (tmp_path / dataset / f"{split}.csv").write_text(f"smiles,{label}\n" + "".join(f"{'C' * (n + 1)},1\n" for n in range(i + 2)))
    status = split_datasets(spark, ["bbbp", "hiv"], str(tmp_path), str(tmp_path / "s"), "given", 3).collect()
    assert [(r["status"], r["removed"]) for r in status] == [("done", {"too_long": 1}), ("failed", None)]
    counts = {r["split"]: r["count"] for r in spark.read.parquet(str(tmp_path / "s/bbbp")).groupBy("split").count().collect()}
    assert counts == {"train": 2, "valid": 3, "test": 3}


def test_command_line_reports_failures(spark, data, tmp_path):
    with pytest.raises(SystemExit):
        main(["split", "--data", data[0], "--out", str(tmp_path / "s"), "--datasets", "bbbp,nope", "--splitter", "random"])
    assert spark.read.parquet(str(tmp_path / "s" / "bbbp")).select("split").distinct().count() == 3


def test_many_tasks_with_awkward_names(spark, data, tmp_path):
    """All 27 tasks of the dataset whose task names hold blanks, commas and brackets."""
    rng = random.Random(2)
    root = tmp_path / "in"
    root.mkdir()
    with open(root / "sider.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["smiles", *TASKS["sider"]])
        w.writerows([s, *[rng.randint(0, 1) for _ in TASKS["sider"]]] for s in data[1])
    splits, features = str(tmp_path / "s"), str(tmp_path / "f")
    assert split_datasets(spark, ["sider"], str(root), splits, "random").first()["status"] == "done"
    assert featurize_datasets(spark, ["sider"], ["ecfp"], splits, features).first()["status"] == "done"
    rows = spark.read.parquet(f"{features}/ecfp_featurized/sider")
    assert set(TASKS["sider"]) <= set(rows.columns) and rows.count() == len(data[1])
    long = unpivot_tasks(rows.drop("x"), ["smiles", "split"], TASKS["sider"])
    assert long.filter("y is not null").count() == 27 * len(data[1])


def test_vocabularies(spark, data, tmp_path):
    splits, out = str(tmp_path / "s"), str(tmp_path / "v")
    split_datasets(spark, ["bbbp"], data[0], splits, "none")
    assert build_vocabularies(spark, ["bbbp"], splits, out).first()["status"] == "done"
    tokens = {r["token"]: r["n"] for r in spark.read.json(f"{out}/bbbp/tokens").collect()}
    assert tokens["N"] == sum(s.count("N") for s in data[1])
    assert spark.read.json(f"{out}/bbbp/atoms").count() > 10 and spark.read.json(f"{out}/bbbp/bonds").count() > 5


def test_chunked_library(spark, tmp_path):
    root = tmp_path / "lib"
    root.mkdir()
    for i in range(10):
        (root / f"chunk_{i:03d}.csv").write_text("smiles,logp\n" + "".join(f"{'C' * (j + 1)}O,{i}.5\n" for j in range(20)) + ",0.0\n")
    target = featurize_library(spark, "100M", "ecfp", f"{root}/", str(tmp_path / "out"), partitions=4)
    blocks = spark.read.parquet(target)
    assert blocks.columns == ["x", "smiles"] and blocks.count() == 200
    with pytest.raises(AnalysisException):
        featurize_library(spark, "100M", "ecfp", f"{root}/", str(tmp_path / "out"))
