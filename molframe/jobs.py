"""Whole jobs over named datasets: split and clean, featurize, build vocabularies, benchmark, train, predict.

Each job handles every dataset it can and returns a status row for each,
including unknown names and missing files, with the number of rows it left out
by reason (``removed``); nothing is skipped silently.

    python -m molframe.jobs split     --data IN --out SPLITS --datasets bbbp,tox21
    python -m molframe.jobs featurize --data SPLITS --out FEATURES --datasets bbbp,tox21 --featurizers ecfp,graph
    python -m molframe.jobs vocabulary --data SPLITS --out VOCAB --datasets bbbp
    python -m molframe.jobs benchmark --data FEATURES --out METRICS --datasets bbbp,tox21
    python -m molframe.jobs train     --data FEATURES --out MODELS --datasets bbbp,tox21
    python -m molframe.jobs predict   --data FEATURES --models MODELS --out PREDICTIONS --datasets bbbp,tox21
    python -m molframe.jobs library   --data LIB/ --out BLOCKS --datasets 1b --featurizers ecfp
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.functions.tokens import hashed_fp, tokenize
from molframe.operators.clean import (
    clean_by_length,
    drop_empty_features,
    length_losses,
    missing_labels,
    project_tasks,
    unpivot_tasks,
)
from molframe.operators.features import describe, dummy
from molframe.operators.forest import bit_features, fit_forest, load, predict, run_repeated, save
from molframe.operators.graph import atoms_bonds
from molframe.operators.scaffold import scaffold_key
from molframe.operators.split import group_split, hash_split, no_split
from molframe.operators.transform import Chain, fit_chain, load_chain, save_chain
from molframe.operators.vocab import build_vocab, node_context_vocab
from molframe.plans.lineage import cut
from molframe.plans.ordered import row_index
from molframe.registry import BALANCED, TASKS, TRANSFORMERS, DatasetSpec, resolve
from molframe.sources.readers import labelled_schema, read_library, read_presplit, read_spec
from molframe.sources.sinks import append_metrics, write_blocks, write_new, write_splits, write_vocab

STATUS = "dataset string, step string, status string, detail string, removed map<string,bigint>"
FINGERPRINT_SIZE = 1024


def spec_of(dataset: str) -> DatasetSpec:
    """A registered dataset: sequence column ``smiles``, which is also the id."""
    return DatasetSpec("smiles", TASKS[dataset], "smiles")


def _ecfp(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    return df.withColumn("x", hashed_fp(tokenize(F.col(spec.feature), "smiles"), FINGERPRINT_SIZE))


def _tokens(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    return df.withColumn("x", tokenize(F.col(spec.feature), "smiles"))


def _descriptors(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    found = describe(df, spec.feature, "smiles")
    names = [c for c in found.columns if c not in df.columns]
    return found.withColumn("x", F.array(*[F.col(n).cast("double") for n in names])).drop(*names)


FEATURIZERS: dict[str, Callable[[DataFrame, DatasetSpec], DataFrame]] = {
    "dummy": lambda df, spec: dummy(df, spec.feature),
    "ecfp": _ecfp,
    "tokens": _tokens,
    "descriptors": _descriptors,
}
GRAPH = "graph"


def molecules_of(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Distinct sequences under a short number ``mol``: graph tables repeat it on every row."""
    unique = df.select(*dict.fromkeys((spec.id, spec.feature))).dropDuplicates([spec.id])
    return cut(row_index(unique, [spec.id], "mol", derived=True))


def scaffold_split(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """80/10/10 by ring systems and linkers; equal scaffolds share a split."""
    molecules = molecules_of(df, spec)
    atoms, bonds = (cut(t) for t in atoms_bonds(molecules, "mol", spec.feature))
    keys = scaffold_key(bonds, atoms).join(molecules.select("mol", spec.id), "mol").select(spec.id, "group_key")
    return group_split(df.join(keys, spec.id, "left"), "group_key").drop("group_key")


SPLITTERS: dict[str, Callable[[DataFrame, DatasetSpec], DataFrame]] = {
    "scaffold": scaffold_split,
    "random": lambda df, spec: hash_split(df, spec.id),
    "none": lambda df, spec: no_split(df),
    # The files say it: ``data/<dataset>/train.csv`` and so on.
    "given": lambda df, spec: df,
}


def _each(
    spark: SparkSession, names: Sequence[str], step: str, work: Callable[[str], tuple[str, Mapping[str, int]]]
) -> DataFrame:
    """Run ``work`` per dataset; where it wrote and what it left out become a status row."""
    rows = []
    for name in names:
        dataset = resolve(name)
        if dataset not in TASKS:
            rows.append((name, step, "unknown", "not a registered dataset", None))
            continue
        try:
            detail, removed = work(dataset)
            rows.append((name, step, "done", detail, {k: n for k, n in removed.items() if n}))
        except (PySparkException, OSError) as error:
            rows.append((name, step, "failed", str(error).splitlines()[0], None))
    return spark.createDataFrame(rows, STATUS)


def split_datasets(
    spark: SparkSession, names: Sequence[str], data: str, out: str, splitter: str = "scaffold",
    max_len: int | None = 200, clean_first: bool = False, specs: Mapping[str, DatasetSpec] | None = None,
) -> DataFrame:
    """Split ``data/<dataset>.csv`` and write ``out/<dataset>/split=...``.

    Long sequences go after the split, as the published splits do, unless
    ``clean_first``. The splitter ``given`` reads ``data/<dataset>/train.csv``,
    ``valid.csv`` and ``test.csv``; a dataset that lacks one of them fails.
    """
    def read(dataset: str, spec: DatasetSpec) -> DataFrame:
        if splitter == "given":
            return read_presplit(spark, f"{data}/{dataset}", labelled_schema(spec.feature, spec.tasks, spec.id))
        rows = read_spec(spark, f"{data}/{dataset}.csv", spec)
        return project_tasks(rows, spec) if spec.id != spec.feature else rows

    def work(dataset: str) -> tuple[str, Mapping[str, int]]:
        spec = (specs or {}).get(dataset) or spec_of(dataset)
        rows = read(dataset, spec)
        removed = length_losses(rows, spec.feature, max_len)
        if clean_first and max_len is not None:
            rows = clean_by_length(rows, spec.feature, max_len)
        parted = SPLITTERS[splitter](rows, spec)
        if not clean_first and max_len is not None:
            parted = clean_by_length(parted, spec.feature, max_len)
        write_splits(parted, f"{out}/{dataset}")
        return f"{out}/{dataset}", removed

    return _each(spark, names, "split", work)


def featurize_datasets(
    spark: SparkSession, names: Sequence[str], featurizers: Sequence[str], data: str, out: str,
    max_len: int | None = 200, specs: Mapping[str, DatasetSpec] | None = None,
) -> DataFrame:
    """Featurize split datasets into ``out/<featurizer>_featurized/<dataset>``; without ``max_len``, of any length."""
    parts = []
    for featurizer in featurizers:
        step = f"featurize:{featurizer}"
        if featurizer != GRAPH and featurizer not in FEATURIZERS:
            rows = [(n, step, "unknown", "not a registered featurizer", None) for n in names]
            parts.append(spark.createDataFrame(rows, STATUS))
            continue

        def work(dataset: str, featurizer: str = featurizer) -> tuple[str, Mapping[str, int]]:
            spec = (specs or {}).get(dataset) or spec_of(dataset)
            target = f"{out}/{featurizer}_featurized/{dataset}"
            rows = spark.read.parquet(f"{data}/{dataset}")
            removed = length_losses(rows, spec.feature, max_len)
            if max_len is not None:
                rows = clean_by_length(rows, spec.feature, max_len)
            if featurizer == GRAPH:
                molecules = molecules_of(rows, spec)
                atoms, bonds = atoms_bonds(molecules, "mol", spec.feature)
                write_new(molecules, f"{target}/molecules")
                write_new(atoms, f"{target}/atoms")
                write_new(bonds, f"{target}/bonds")
                return target, removed
            found = FEATURIZERS[featurizer](rows, spec)
            if found.schema["x"].dataType.typeName() == "array":
                found = drop_empty_features(found)
            write_splits(found, target)
            # Both counts come from file footers unless the length limit filters.
            empty = rows.count() - spark.read.parquet(target).count()
            return target, {**removed, "no_features": empty}

        parts.append(_each(spark, names, step, work))
    return reduce(DataFrame.unionByName, parts)


def featurize_library(
    spark: SparkSession, size: str, featurizer: str, root: str, out: str, partitions: int | None = None
) -> str:
    """Featurize a chunked library (``smiles``, ``logp``) into blocks of ``x`` and ``smiles``.

    One stage from scan to sink after the rebalance; an existing target is refused.
    """
    spec = DatasetSpec("smiles", ("logp",), "smiles")
    rows = read_library(spark, size, root, labelled_schema("smiles", ["logp"]), partitions)
    found = FEATURIZERS[featurizer](rows, spec)
    if found.schema["x"].dataType.typeName() == "array":
        found = drop_empty_features(found)
    target = f"{out}/{featurizer}_{size.lower()}"
    write_blocks(found, target, ["x", "smiles"])
    return target


def build_vocabularies(
    spark: SparkSession, names: Sequence[str], data: str, out: str, train_only: bool = True,
    specs: Mapping[str, DatasetSpec] | None = None,
) -> DataFrame:
    """Token, atom-context and bond-context vocabularies of split datasets, as JSON lines."""
    def work(dataset: str) -> tuple[str, Mapping[str, int]]:
        spec = (specs or {}).get(dataset) or spec_of(dataset)
        rows = spark.read.parquet(f"{data}/{dataset}")
        if train_only:
            rows = rows.filter("split = 'train'")
        write_vocab(build_vocab(rows, tokenize(F.col(spec.feature), "smiles")), f"{out}/{dataset}/tokens")
        atoms, bonds = (cut(t) for t in atoms_bonds(molecules_of(rows, spec), "mol", spec.feature))
        of_atoms, of_bonds = node_context_vocab(atoms, bonds)
        write_vocab(of_atoms, f"{out}/{dataset}/atoms")
        write_vocab(of_bonds, f"{out}/{dataset}/bonds")
        return f"{out}/{dataset}", {}

    return _each(spark, names, "vocabulary", work)


def benchmark_datasets(
    spark: SparkSession, names: Sequence[str], data: str, out: str, seeds: Sequence[int] = (0, 1, 2),
    transform: bool = True, specs: Mapping[str, DatasetSpec] | None = None, **params,
) -> DataFrame:
    """Forests on fingerprints, one run per seed; metrics are appended to ``out``.

    Datasets with a registered label transformer are regressions scored by RMSE
    in label units; the others are classifications scored by ROC-AUC, some with
    their classes weighed alike (``registry.BALANCED``). Several
    tasks are averaged per run before runs are summarised.
    """
    def work(dataset: str) -> tuple[str, Mapping[str, int]]:
        spec = (specs or {}).get(dataset) or spec_of(dataset)
        kind = "regression" if dataset in TRANSFORMERS else "classification"
        rows = bit_features(spark.read.parquet(f"{data}/ecfp_featurized/{dataset}"), "x", FINGERPRINT_SIZE)
        rows = rows.withColumn("id", F.col(spec.id))
        per_task = []
        for task in spec.tasks:
            long = unpivot_tasks(rows.select("id", "split", "_features", F.col(f"`{task}`")), ["id", "split", "_features"], [task])
            long = long.filter("y is not null").withColumn("w", F.lit(1.0))
            chain = None
            steps = TRANSFORMERS.get(dataset) or (("balancing",) if dataset in BALANCED else ())
            if steps and transform:
                chain = fit_chain(steps, long.filter("split = 'train'"))
            scores, _ = run_repeated(long, kind, seeds, chain, **params)
            per_task.append(scores.withColumn("task", F.lit(task)))
        runs = reduce(DataFrame.unionByName, per_task).groupBy("split", "run").agg(F.avg("score").alias("score"))
        metric = "rmse" if kind == "regression" else "roc_auc"
        summary = runs.groupBy("split").agg(
            F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
            (F.max("score") - F.min("score")).alias("spread"),
        )
        append_metrics(summary.withColumns({"dataset": F.lit(dataset), "metric": F.lit(metric)}), out)
        return out, {f"unlabelled:{t}": n for t, n in missing_labels(rows, spec.tasks).items()}

    return _each(spark, names, "benchmark", work)


def _kind_and_steps(dataset: str) -> tuple[str, Sequence[str]]:
    """Kind of task and label transformers of a registered dataset."""
    if dataset in TRANSFORMERS:
        return "regression", TRANSFORMERS[dataset]
    return "classification", ("balancing",) if dataset in BALANCED else ()


def train_datasets(
    spark: SparkSession, names: Sequence[str], data: str, out: str, seed: int = 0, transform: bool = True,
    specs: Mapping[str, DatasetSpec] | None = None, **params,
) -> DataFrame:
    """One forest per task on the train split, kept in ``out/<dataset>`` with the statistics of its label transformers.

    A task is named by its place, since task names may be no file names.
    A dataset's folder that exists is refused, also one that a failed run left.
    """
    def work(dataset: str) -> tuple[str, Mapping[str, int]]:
        spec = (specs or {}).get(dataset) or spec_of(dataset)
        kind, steps = _kind_and_steps(dataset)
        rows = spark.read.parquet(f"{data}/ecfp_featurized/{dataset}").filter("split = 'train'")
        rows = cut(bit_features(rows, "x", FINGERPRINT_SIZE))
        kind_of_task = "place int, task string, kind string, steps array<string>"
        # First: an existing folder is refused before anything in it changes.
        write_new(spark.createDataFrame([], kind_of_task), f"{out}/{dataset}/begun")
        kept = []
        for i, task in enumerate(spec.tasks):
            target = f"{out}/{dataset}/task={i}"
            long = unpivot_tasks(rows.select("_features", F.col(f"`{task}`")), ["_features"], [task])
            long = long.filter("y is not null").withColumn("w", F.lit(1.0))
            chain = fit_chain(steps if transform else (), long)
            save_chain(chain, f"{target}/labels")
            model = fit_forest(chain.apply(long), kind, seed=seed, weight="w", **params)
            save(model, f"{target}/model")
            kept.append((i, task, kind, [s.name for s in chain.steps]))
        # Last: a dataset without this table has no whole set of models.
        write_new(spark.createDataFrame(kept, kind_of_task).coalesce(1), f"{out}/{dataset}/tasks")
        return f"{out}/{dataset}", {f"unlabelled:{t}": n for t, n in missing_labels(rows, spec.tasks).items()}

    return _each(spark, names, "train", work)


def predict_datasets(
    spark: SparkSession, names: Sequence[str], data: str, models: str, out: str,
    specs: Mapping[str, DatasetSpec] | None = None,
) -> DataFrame:
    """Predictions of saved models for all rows of featurized datasets, labelled or not, in ``out/<dataset>``.

    Columns: the dataset's id, ``split`` where there is one, ``task``, ``y_pred``
    in label units and, for classifications, ``score`` of class 1 (else null).
    """
    def work(dataset: str) -> tuple[str, Mapping[str, int]]:
        spec = (specs or {}).get(dataset) or spec_of(dataset)
        rows = spark.read.parquet(f"{data}/ecfp_featurized/{dataset}")
        keep = [spec.id, *(["split"] if "split" in rows.columns else [])]
        rows = bit_features(rows, "x", FINGERPRINT_SIZE).select(*keep, "_features")
        parts = []
        # One row per task.
        for place in spark.read.parquet(f"{models}/{dataset}/tasks").orderBy("place").collect():
            source = f"{models}/{dataset}/task={place['place']}"
            found = predict(load(f"{source}/model", place["kind"]), rows.withColumn("task", F.lit(place["task"])), [*keep, "task"])
            if place["kind"] == "regression":
                chain: Chain = load_chain(spark, place["steps"], f"{source}/labels")
                found = chain.invert(found.withColumnRenamed("y_pred", "y")).withColumnRenamed("y", "y_pred")
            score = F.col("score") if "score" in found.columns else F.lit(None).cast("double")
            parts.append(found.select(*keep, "task", "y_pred", score.alias("score")))
        write_new(reduce(DataFrame.unionByName, parts), f"{out}/{dataset}")
        return f"{out}/{dataset}", {}

    return _each(spark, names, "predict", work)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Split, featurize and benchmark labelled sequence datasets.")
    parser.add_argument("job", choices=("split", "featurize", "vocabulary", "benchmark", "train", "predict", "library"))
    parser.add_argument("--datasets", required=True, help="comma-separated names; for library jobs, sizes")
    parser.add_argument("--data", required=True, help="input folder")
    parser.add_argument("--out", required=True, help="output folder")
    parser.add_argument("--featurizers", default="ecfp", help="comma-separated names")
    parser.add_argument("--splitter", default="scaffold", choices=sorted(SPLITTERS))
    parser.add_argument("--max-len", type=int, default=200, help="longer sequences go; below 0, none go")
    parser.add_argument("--trees", type=int, default=100)
    parser.add_argument("--depth", type=int, default=10)
    parser.add_argument("--seed", type=int, default=0, help="of a train job")
    parser.add_argument("--criterion", help="impurity of forests; without it, Spark's for the kind of task")
    parser.add_argument("--min-samples-split", type=int, default=2)
    parser.add_argument("--no-bootstrap", action="store_true")
    parser.add_argument("--models", help="folder that a train job wrote, for predict")
    parser.add_argument("--no-transform", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"molframe-{args.job}").getOrCreate()
    names = args.datasets.split(",")
    max_len = args.max_len if args.max_len >= 0 else None
    if args.job == "split":
        status = split_datasets(spark, names, args.data, args.out, args.splitter, max_len)
    elif args.job == "featurize":
        status = featurize_datasets(spark, names, args.featurizers.split(","), args.data, args.out, max_len)
    elif args.job == "vocabulary":
        status = build_vocabularies(spark, names, args.data, args.out)
    elif args.job == "library":
        rows = [
            (size, f"library:{f}", "done", featurize_library(spark, size, f, args.data, args.out), None)
            for size in names
            for f in args.featurizers.split(",")
        ]
        status = spark.createDataFrame(rows, STATUS)
    elif args.job == "predict":
        status = predict_datasets(spark, names, args.data, args.models or parser.error("predict needs --models"), args.out)
    else:
        params = dict(
            transform=not args.no_transform, trees=args.trees, depth=args.depth, criterion=args.criterion,
            min_samples_split=args.min_samples_split, bootstrap=not args.no_bootstrap,
        )
        if args.job == "train":
            status = train_datasets(spark, names, args.data, args.out, args.seed, **params)
        else:
            status = benchmark_datasets(spark, names, args.data, args.out, **params)
    status.show(truncate=False)
    if status.filter("status <> 'done'").count():
        raise SystemExit(1)


if __name__ == "__main__":
    main()
