"""Label transformers fitted on the training split."""

from pyspark.sql import functions as F

from molframe.catalog.base import DOC_TASKS, PART_LONG_SQL, part_tasks, register, rounded, split_sql, table
from molframe.operators.clean import unpivot_tasks
from molframe.operators.split import hash_split
from molframe.operators.transform import fit, fit_chain


def _both_ways(rows, transformer):
    """Transformed labels and what inversion makes of them."""
    there = transformer.apply(rows)
    back = transformer.invert(there.select("id", "split", "task", "y", "w"))
    keys = ["id", "split", "task"]
    return there.select(*keys, rounded("y").alias("y_new")).join(
        back.select(*keys, rounded("y").alias("y_back")), keys
    )


def _train(rows):
    return rows.filter("split = 'train'")


STATS_SQL = """
stats AS (SELECT task, avg(y) AS mu, stddev_pop(y) AS sigma, min(y) AS low, max(y) AS high
          FROM long WHERE split = 'train' GROUP BY 1)
"""


def _two_way_sql(forward: str) -> str:
    return f"""
    WITH {PART_LONG_SQL}, {STATS_SQL}
    SELECT id, split, task, round({forward}, 6) AS y_new, round(y, 6) AS y_back FROM long JOIN stats USING (task)
    """


@register("tr_normalize", _two_way_sql("(y - mu) / sigma"))
def tr_normalize(spark, sf_dir):
    rows = part_tasks(spark, sf_dir)
    return _both_ways(rows, fit("normalization", _train(rows)))


@register("tr_minmax", _two_way_sql("(y - low) / (high - low)"))
def tr_minmax(spark, sf_dir):
    rows = part_tasks(spark, sf_dir)
    return _both_ways(rows, fit("minmax", _train(rows)))


@register("tr_log", _two_way_sql("ln(1 + y)"))
def tr_log(spark, sf_dir):
    rows = part_tasks(spark, sf_dir)
    return _both_ways(rows, fit("log", _train(rows)))


@register(
    "tr_clip",
    f"WITH {PART_LONG_SQL} SELECT id, task, greatest(-30.0::DOUBLE, least(30.0::DOUBLE, y)) AS y FROM long",
)
def tr_clip(spark, sf_dir):
    rows = part_tasks(spark, sf_dir)
    return fit("clipping", _train(rows), limit=30.0).apply(rows).select("id", "task", "y")


@register(
    "tr_balance",
    f"""
    WITH wide AS (SELECT doc_id, {split_sql('doc_id')} AS split, quality, toxic
                  FROM documents LEFT JOIN labels USING (doc_id)),
    long AS (SELECT doc_id, split, 'quality' AS task, quality AS y FROM wide
             UNION ALL SELECT doc_id, split, 'toxic', toxic FROM wide),
    per_class AS (SELECT task, y, count(*) AS n FROM long WHERE split = 'train' AND y IS NOT NULL GROUP BY 1, 2),
    per_task AS (SELECT task, sum(n) AS total FROM per_class GROUP BY 1)
    SELECT doc_id, long.task, long.y, round(coalesce(total::DOUBLE / n, 0.0::DOUBLE), 6) AS w
    FROM long JOIN per_task USING (task) LEFT JOIN per_class ON long.task = per_class.task AND long.y = per_class.y
    """,
)
def tr_balance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    long = unpivot_tasks(hash_split(docs, "doc_id"), ["doc_id", "split"], DOC_TASKS)
    rows = long.withColumn("w", F.when(F.col("y").isNull(), 0.0).otherwise(1.0))
    balanced = fit("balancing", _train(rows)).apply(rows)
    return balanced.select("doc_id", "task", "y", rounded("w").alias("w"))


@register("tr_chain", _two_way_sql("ln(1 + (y - low) / (high - low))"))
def tr_chain(spark, sf_dir):
    rows = part_tasks(spark, sf_dir)
    return _both_ways(rows, fit_chain(["MinMax", "log"], _train(rows)))
