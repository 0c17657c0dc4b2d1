"""Aggregations and metrics."""

from pyspark.sql import functions as F

from molframe.catalog.base import (
    DOC_TASKS,
    GROUP_KEY,
    group_key,
    labelled_documents,
    register,
    rounded,
    split_sql,
    table,
)
from molframe.operators import metrics as M
from molframe.operators.clean import unpivot_tasks
from molframe.operators.split import hash_split


@register(
    "total_steps",
    """
    SELECT count(*) AS n_rows, CAST(trunc(count(*)::DOUBLE / 32 / 3 * 10) AS BIGINT) AS total_steps FROM lineitem
    """,
)
def steps(spark, sf_dir):
    return M.total_steps(table(spark, sf_dir, "lineitem"), 32, 3, 10)


@register(
    "dataset_summary",
    f"""
    SELECT lang, {split_sql('doc_id')} AS split, count(*) AS n_rows,
           count(quality) AS n_quality, count(*) FILTER (quality = 1) AS pos_quality,
           count(toxic) AS n_toxic, count(*) FILTER (toxic = 1) AS pos_toxic
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2
    """,
)
def summary(spark, sf_dir):
    docs = hash_split(labelled_documents(spark, sf_dir).select("doc_id", "lang", *DOC_TASKS), "doc_id")
    return M.dataset_summary(docs, DOC_TASKS, ["lang", "split"])


@register(
    "label_stats_samp",
    """
    SELECT round(avg(p_size), 6) AS mean_p_size, round(stddev_samp(p_size), 6) AS std_p_size,
           round(avg(p_retailprice), 6) AS mean_p_retailprice, round(stddev_samp(p_retailprice), 6) AS std_p_retailprice
    FROM part
    """,
)
def stats(spark, sf_dir):
    found = M.label_stats(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return found.select(*[rounded(c).alias(c) for c in found.columns])


@register("group_sizes", f"SELECT {GROUP_KEY} AS group_key, count(*) AS n_rows FROM documents GROUP BY 1")
def sizes(spark, sf_dir):
    return M.group_sizes(table(spark, sf_dir, "documents").select(group_key().alias("group_key")), "group_key")


@register(
    "group_key",
    f"SELECT doc_id, {GROUP_KEY} AS group_key FROM documents",
)
def keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", group_key().alias("group_key"))


@register(
    "triplicate_summary",
    """
    SELECT user_id, event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
           round(max(value) - min(value), 6) AS spread
    FROM events GROUP BY 1, 2
    """,
)
def triplicate(spark, sf_dir):
    found = M.run_summary(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value")
    return found.select("user_id", "event_type", *[rounded(c).alias(c) for c in ("mean", "std", "spread")])


# Regression stand-in: the price of a line against the mean price of its part.
PRICE_SQL = """
means AS (SELECT l_partkey, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1),
scored AS (SELECT l_returnflag, l_quantity AS w, l_extendedprice AS y, p FROM lineitem JOIN means USING (l_partkey))
"""


def _prices(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity", "l_extendedprice")
    means = lines.groupBy("l_partkey").agg(F.avg("l_extendedprice").alias("p"))
    return lines.join(means, "l_partkey").withColumnsRenamed({"l_extendedprice": "y", "l_quantity": "w"})


@register(
    "rmse_by_group",
    f"""
    WITH {PRICE_SQL}
    SELECT l_returnflag, round(sqrt(sum(w * (y - p) * (y - p)) / sum(w)), 4) AS rmse FROM scored GROUP BY 1
    """,
)
def rmse_by_group(spark, sf_dir):
    found = M.rmse(_prices(spark, sf_dir), "y", "p", "w", ["l_returnflag"])
    return found.withColumn("rmse", rounded("rmse", 4))


@register(
    "rmse_denormalized",
    """
    WITH stats AS (SELECT o_orderstatus, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1),
    means AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2)
    SELECT o_orderstatus, round(sqrt(avg((o_totalprice - p) * (o_totalprice - p))), 4) AS rmse
    FROM orders JOIN means USING (o_orderstatus, o_orderpriority) GROUP BY 1
    """,
)
def denormalized(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    stats = M.label_stats(orders, ["o_totalprice"], ["o_orderstatus"])
    scaled = orders.join(F.broadcast(stats), "o_orderstatus").withColumn(
        "y", (F.col("o_totalprice") - F.col("mean_o_totalprice")) / F.col("std_o_totalprice")
    )
    preds = scaled.groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("y").alias("p"))
    both = scaled.join(F.broadcast(preds), ["o_orderstatus", "o_orderpriority"])
    found = M.rmse_denormalized(both, "y", "p", "mean_o_totalprice", "std_o_totalprice", ["o_orderstatus"])
    return found.withColumn("rmse", rounded("rmse", 4))


# Classification stand-in: document length in steps of 50 scores both tasks.
AUC_SQL = """
long AS (
  SELECT doc_id, 'quality' AS task, quality AS y FROM labels
  UNION ALL SELECT doc_id, 'toxic', toxic FROM labels),
scored AS (SELECT task, y, n_chars // 50 AS p FROM long JOIN documents USING (doc_id)),
auc AS (
  SELECT a.task, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*) AS roc_auc
  FROM scored a JOIN scored b ON a.task = b.task AND a.y = 1 AND b.y = 0 GROUP BY 1)
"""


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("n_chars div 50").alias("p"))
    return unpivot_tasks(table(spark, sf_dir, "labels"), "doc_id", DOC_TASKS).join(docs, "doc_id")


@register(
    "roc_auc_by_task",
    f"""
    WITH {AUC_SQL}, counts AS (SELECT task, count(*) AS n_rows FROM scored GROUP BY 1)
    SELECT task, n_rows, round(roc_auc, 6) AS roc_auc FROM counts LEFT JOIN auc USING (task)
    """,
)
def auc_by_task(spark, sf_dir):
    found = M.roc_auc(_scored(spark, sf_dir), "y", "p", ["task"])
    return found.withColumn("roc_auc", rounded("roc_auc"))


@register(
    "roc_auc_mean",
    f"WITH {AUC_SQL} SELECT round(avg(roc_auc), 6) AS roc_auc, count(*) AS n_tasks FROM auc",
)
def auc_mean(spark, sf_dir):
    found = M.task_mean(M.roc_auc(_scored(spark, sf_dir), "y", "p", ["task"]), "roc_auc")
    return found.withColumn("roc_auc", rounded("roc_auc"))


@register(
    "accuracy",
    """
    SELECT lang, round(avg(CASE WHEN quality = CASE WHEN n_chars > 900 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy
    FROM documents JOIN labels USING (doc_id) GROUP BY 1
    """,
)
def acc(spark, sf_dir):
    docs = labelled_documents(spark, sf_dir).withColumn("pred", (F.col("n_chars") > 900).cast("int"))
    found = M.accuracy(docs, "quality", "pred", ["lang"])
    return found.withColumn("accuracy", rounded("accuracy"))


@register(
    "mse_mae",
    f"""
    WITH {PRICE_SQL}
    SELECT l_returnflag, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg((y - p) * (y - p)), 2) AS mse,
           round(avg(abs(y - p)), 4) AS mae
    FROM scored GROUP BY 1
    """,
)
def errors(spark, sf_dir):
    found = M.regression_errors(_prices(spark, sf_dir), "y", "p", ["l_returnflag"])
    return found.select("l_returnflag", rounded("rmse", 4).alias("rmse"), rounded("mse", 2).alias("mse"), rounded("mae", 4).alias("mae"))


@register(
    "pearson_r2",
    f"""
    WITH {PRICE_SQL} SELECT l_returnflag, round(pow(corr(y, p), 2), 6) AS pearson_r2 FROM scored GROUP BY 1
    """,
)
def r2(spark, sf_dir):
    found = M.pearson_r2(_prices(spark, sf_dir), "y", "p", ["l_returnflag"])
    return found.withColumn("pearson_r2", rounded("pearson_r2"))


@register(
    "validation_loss",
    """
    WITH logits AS (SELECT label, embedding::DOUBLE[] AS e FROM embeddings),
    cut AS (SELECT label, e, list_transform(e[1:10], lambda v: exp(v)) AS ex FROM logits)
    SELECT label, round(avg(ln(list_sum(ex)) - e[label + 1]), 6) AS cross_entropy,
           round(avg(pow(e[11] - e[12], 2)), 6) AS mse
    FROM cut GROUP BY 1
    """,
)
def loss(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    logits = vectors.withColumn("logits", F.slice("e", 1, 10))
    sides = vectors.select("label", F.get("e", F.lit(10)).alias("y"), F.get("e", F.lit(11)).alias("p"))
    found = M.cross_entropy(logits, "logits", "label", ["label"]).join(M.mse(sides, "y", "p", by=["label"]), "label")
    return found.select("label", rounded("cross_entropy").alias("cross_entropy"), rounded("mse").alias("mse"))


def f1(y, p):
    """A user's metric from three counts, which tasks add up before anything is shuffled."""
    hits = F.count_if((y == 1) & (p == 1))
    wrong = F.count_if(y != p)
    return F.when(hits + wrong > 0, 2.0 * hits / (2 * hits + wrong))


@register(
    "user_metric",
    """
    WITH long AS (
      SELECT lang, 'quality' AS task, quality AS y, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)
      UNION ALL
      SELECT lang, 'toxic', toxic, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END FROM documents JOIN labels USING (doc_id)),
    counts AS (SELECT lang, task, count(*) FILTER (y = 1 AND p = 1) AS hits, count(*) FILTER (y <> p) AS wrong
               FROM long WHERE y IS NOT NULL GROUP BY 1, 2),
    scores AS (SELECT lang, CASE WHEN hits + wrong > 0 THEN 2.0::DOUBLE * hits / (2 * hits + wrong) END AS f1 FROM counts)
    SELECT lang, round(avg(f1), 6) AS f1, count(f1) AS n_tasks FROM scores GROUP BY 1
    """,
)
def user_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    long = unpivot_tasks(docs.select("doc_id", "lang", "n_chars", *DOC_TASKS), ["doc_id", "lang", "n_chars"], DOC_TASKS)
    scored = long.withColumn("p", (F.col("n_chars") > 800).cast("int"))
    return M.user_metric(scored, "f1", f1, "y", "p", ["lang"], "task").withColumn("f1", rounded("f1"))
