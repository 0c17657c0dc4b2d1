"""Random-forest baseline. Trees depend on the engine's sampling, so there is no SQL to match."""

from pyspark.sql import functions as F

from molframe.catalog.base import DOC_TASKS, PART_TASKS, part_tasks, register, table
from molframe.functions.tokens import hashed_fp, tokenize
from molframe.operators.forest import bit_features, dense_features, fit_forest, fit_tasks, join_features, predict, run_repeated
from molframe.operators.metrics import accuracy
from molframe.operators.split import hash_split
from molframe.operators.transform import fit_chain
from molframe.plans.lineage import cut, spread

SMALL = {"trees": 10, "depth": 5}


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("y"))
    return dense_features(hash_split(rows, "vec_id"), "embedding")


@register("rf_classify")
def rf_classify(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    model = fit_forest(rows.filter("split = 'train'"), "classification", **SMALL)
    return accuracy(predict(model, rows, ["split", "y"]), "y", "y_pred", ["split"])


@register("rf_predict_rows")
def rf_predict_rows(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    model = fit_forest(rows.filter("split = 'train'"), "classification", **SMALL)
    return predict(model, rows, ["vec_id"])


@register("rf_multitask")
def rf_multitask(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    docs = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", hashed_fp(tokenize(F.col("text")), 256, 1).alias("bits"), *DOC_TASKS)
    rows = bit_features(hash_split(docs, "doc_id"), "bits", 256)
    return fit_tasks(rows, DOC_TASKS, "doc_id", **SMALL)


def _part_features(spark, sf_dir):
    """One row per part: tasks joined with hashed name features."""
    bits = hashed_fp(tokenize(F.concat_ws(" ", "p_name", "p_brand", "p_type")), 256, 1)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), bits.alias("bits"))
    return bit_features(part, "bits", 256)


@register("rf_regress")
def rf_regress(spark, sf_dir):
    labels = part_tasks(spark, sf_dir).filter(F.col("task") == PART_TASKS[1])
    rows = cut(join_features(labels, _part_features(spark, sf_dir), table(spark, sf_dir, "part").count(), "id"))
    model = fit_forest(rows.filter("split = 'train'"), "regression", **SMALL)
    return predict(model, rows, ["id", "split", "y"])


@register("rf_triplicate")
def rf_triplicate(spark, sf_dir):
    labels = part_tasks(spark, sf_dir).filter(F.col("task") == PART_TASKS[1])
    chain = fit_chain(["normalization"], labels.filter("split = 'train'"))
    rows = join_features(labels, _part_features(spark, sf_dir), table(spark, sf_dir, "part").count(), "id")
    return run_repeated(rows, "regression", chain=chain, **SMALL)[1]
