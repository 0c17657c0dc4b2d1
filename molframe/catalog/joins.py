"""Joins and set operations."""

from pyspark.sql import functions as F

from molframe.catalog.base import GRAPH_SQL, UNIT_SQL, molecule_graphs, register, table
from molframe.operators.joins import align, attach_labels, experiment_grid, pairs_within_2, with_registry
from molframe.operators.sets import mixture, subset_exact, union_parts


@register(
    "label_attach",
    "SELECT doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
def label_attach(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return attach_labels(docs, table(spark, sf_dir, "labels"), "doc_id")


@register(
    "pred_truth_join",
    """
    WITH means AS (SELECT lang, avg(n_chars) AS m FROM documents GROUP BY 1),
    preds AS (SELECT doc_id, 'length' AS task, m AS y_pred FROM documents JOIN means USING (lang)),
    truth AS (SELECT doc_id, 'length' AS task, n_chars AS y FROM documents)
    SELECT doc_id, task, round(y_pred, 4) AS y_pred, y FROM preds JOIN truth USING (doc_id, task)
    """,
)
def pred_truth_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("task", F.lit("length"))
    means = docs.groupBy("lang").agg(F.avg("n_chars").alias("y_pred"))
    preds = docs.join(F.broadcast(means), "lang").select("doc_id", "task", F.round("y_pred", 4).alias("y_pred"))
    truth = docs.select("doc_id", "task", F.col("n_chars").alias("y"))
    return align(preds, truth, ["doc_id", "task"])


@register(
    "registry_join",
    "SELECT c_custkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def registry_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    found = with_registry(customers, table(spark, sf_dir, "nation"), "n_nationkey")
    return found.select("c_custkey", "n_name", "n_regionkey")


@register(
    "experiment_grid",
    """
    WITH datasets AS (SELECT source AS dataset, max(toxic) AS any_toxic
                      FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1),
    pretrain AS (SELECT unnest(['library_250k', 'library_1m']) AS source)
    SELECT dataset, source, CASE WHEN any_toxic = 1 THEN 32 ELSE 64 END AS batch_size,
           0.0001::DOUBLE AS learning_rate, 50 AS nb_epoch
    FROM datasets, pretrain
    """,
)
def grid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id").filter("toxic = 1")
    overrides = labelled.groupBy(F.col("source").alias("dataset")).agg(F.lit(32).alias("batch_size"))
    datasets = docs.select(F.col("source").alias("dataset")).distinct()
    params = {"batch_size": 64, "learning_rate": 0.0001, "nb_epoch": 50}
    return experiment_grid(datasets, ["library_250k", "library_1m"], params, overrides)


@register(
    "pairs_within_2",
    f"""
    WITH {GRAPH_SQL},
    arcs AS (SELECT mol, src AS a, dst AS b FROM bonds UNION ALL SELECT mol, dst, src FROM bonds),
    pairs AS (
      SELECT mol, a AS u, b AS v, 1 AS distance FROM arcs WHERE a < b
      UNION ALL
      SELECT x.mol, x.a, y.b, 2 FROM arcs x JOIN arcs y ON x.mol = y.mol AND x.b = y.a WHERE x.a < y.b)
    SELECT mol, u, v, min(distance) AS distance FROM pairs GROUP BY 1, 2, 3
    """,
)
def pairs(spark, sf_dir):
    return pairs_within_2(molecule_graphs(spark, sf_dir)[1])


@register(
    "union_parts",
    """
    SELECT l_returnflag, count(*) AS n_rows, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1
    """,
)
def unioned(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_linestatus")
    parts = [lines.filter("l_linestatus = 'O'"), lines.filter("l_linestatus <> 'O'").select("l_quantity", "l_linestatus", "l_returnflag")]
    return union_parts(*parts).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@register(
    "source_mixture",
    f"""
    SELECT doc_id, lang FROM documents
    WHERE lang <> 'en' OR {UNIT_SQL.format("'11|' || CAST(doc_id AS VARCHAR)")} < 0.5::DOUBLE
    """,
)
def source_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return mixture([(docs.filter("lang = 'en'"), 0.5), (docs.filter("lang <> 'en'"), 1.0)], "doc_id", seed=11)


@register(
    "subset_exact_n",
    """
    SELECT o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (ORDER BY substr(md5('5|' || CAST(o_orderkey AS VARCHAR)), 1, 8), o_orderkey) AS r
      FROM orders) WHERE r <= 1234
    """,
)
def exact_subset(spark, sf_dir):
    return subset_exact(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1234, seed=5)
