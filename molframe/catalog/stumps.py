"""Forests of one tree with one split: the best split is exact, so SQL finds it too."""

from pyspark.sql import functions as F

from molframe.catalog.base import DOC_TASKS, PART_TASKS, labelled_documents, part_tasks, register, split_sql, table
from molframe.functions.tokens import hashed_fp, tokenize
from molframe.operators.forest import STUMP, bit_features, fit_forest, fit_tasks, join_features, load, predict, run_repeated, save
from molframe.operators.metrics import accuracy
from molframe.operators.split import hash_split
from molframe.operators.transform import fit_chain
from molframe.plans.lineage import cut, scratch_path

SIZE, RADIUS = 1024, 2


def _bits_sql(id: str, text: str, source: str) -> str:
    word = "('0x' || substr(md5('{r}:' || array_to_string(t[greatest(i - {r}, 0) + 1:i + {r} + 1], ' ')), 1, 8))::BIGINT"
    each = " UNION ALL ".join(f"SELECT id, unnest(list_transform(range(len(t)), lambda i: {word.format(r=r)} % {SIZE})) AS bit FROM toks" for r in range(RADIUS + 1))
    return rf"toks AS (SELECT {id} AS id, regexp_extract_all({text}, '[^ \n]+') AS t FROM {source}), bits AS (SELECT DISTINCT id, bit FROM ({each}))"


def _gini(n: str, p: str) -> str:
    return f"(1 - ({p} / {n}) * ({p} / {n}) - (1 - {p} / {n}) * (1 - {p} / {n}))"


def _stump_sql(name: str, y: str, weighted: bool) -> str:
    """CTEs that end in ``{name}(bit, p1, p0)``: the best bit, and the share of class 1 with and without it.

    Spark merges leaves of one class, so both then have the share of all rows.
    """
    w = f"count(*) OVER () / count(*) OVER (PARTITION BY {y})::DOUBLE" if weighted else "1.0::DOUBLE"
    return f"""
    {name}_train AS (SELECT id, {y}::DOUBLE AS y, {w} AS w FROM labelled WHERE split = 'train' AND {y} IS NOT NULL),
    {name}_all AS (SELECT sum(w) AS n, sum(w * y) AS p, count(*) AS c FROM {name}_train),
    {name}_bit AS (SELECT bit, sum(w) AS n1, sum(w * y) AS s1 FROM {name}_train JOIN bits USING (id), {name}_all GROUP BY bit HAVING count(*) < any_value(c)),
    {name}_gain AS (
      SELECT bit, n, p, s1 / n1 AS q1, (p - s1) / (n - n1) AS q0,
             {_gini('n', 'p')} - n1 / n * {_gini('n1', 's1')} - (n - n1) / n * {_gini('(n - n1)', '(p - s1)')} AS gain
      FROM {name}_bit, {name}_all),
    {name} AS (
      SELECT bit, CASE WHEN (q1 > 0.5::DOUBLE) = (q0 > 0.5::DOUBLE) THEN p / n ELSE q1 END AS p1,
             CASE WHEN (q1 > 0.5::DOUBLE) = (q0 > 0.5::DOUBLE) THEN p / n ELSE q0 END AS p0
      FROM {name}_gain ORDER BY round(gain, 10) DESC, bit LIMIT 1)"""


DOC_SQL = f"""
{_bits_sql('doc_id', 'text', 'documents')},
labelled AS (SELECT doc_id AS id, {split_sql('doc_id')} AS split, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
"""


def _scored_sql(name: str) -> str:
    return f"CASE WHEN EXISTS (SELECT 1 FROM bits WHERE bits.id = labelled.id AND bits.bit = {name}.bit) THEN p1 ELSE p0 END"


def _documents(spark, sf_dir):
    docs = hash_split(labelled_documents(spark, sf_dir), "doc_id")
    bits = hashed_fp(tokenize(F.col("text")), SIZE, RADIUS)
    return cut(bit_features(docs.select("doc_id", "split", *DOC_TASKS, bits.alias("bits")), "bits", SIZE).drop("bits"))


@register(
    "stump_classify",
    f"""
    WITH {DOC_SQL}, {_stump_sql('best', 'quality', False)},
    scored AS (SELECT split, quality AS y, {_scored_sql('best')} AS score FROM labelled, best WHERE quality IS NOT NULL)
    SELECT split, round(avg(CASE WHEN (score > 0.5::DOUBLE) = (y = 1) THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM scored GROUP BY 1
    """,
)
def stump_classify(spark, sf_dir):
    rows = _documents(spark, sf_dir)
    model = fit_forest(rows.filter("split = 'train'"), "classification", "quality", **STUMP)
    found = accuracy(predict(model, rows.filter("quality IS NOT NULL"), ["split", "quality"]), "quality", "y_pred", ["split"])
    return found.withColumn("accuracy", F.round("accuracy", 6))


@register(
    "stump_predict_rows",
    f"""
    WITH {DOC_SQL}, {_stump_sql('best', 'toxic', False)},
    scored AS (SELECT id, {_scored_sql('best')} AS score FROM labelled, best)
    SELECT id AS doc_id, CASE WHEN score > 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_pred, round(score, 6) AS score FROM scored
    """,
)
def stump_predict_rows(spark, sf_dir):
    """A model saved, read back and run over every document."""
    rows = _documents(spark, sf_dir)
    path = scratch_path(spark, "model")
    save(fit_forest(rows.filter("split = 'train'"), "classification", "toxic", **STUMP), path)
    found = predict(load(path, "classification"), rows, ["doc_id"])
    return found.withColumn("score", F.round("score", 6))


@register(
    "stump_multitask",
    f"WITH {DOC_SQL}, {_stump_sql('q', 'quality', True)}, {_stump_sql('t', 'toxic', True)},"
    + " UNION ALL ".join(
        f"{'scored AS (' if k == 0 else ''}SELECT id, split, {task}::INTEGER AS y, '{task}' AS task, {_scored_sql(name)} AS score FROM labelled, {name}"
        for k, (name, task) in enumerate((("q", "quality"), ("t", "toxic")))
    )
    + """)
    SELECT id AS doc_id, split, y, task, CASE WHEN score > 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_pred, round(score, 6) AS score FROM scored
    """,
)
def stump_multitask(spark, sf_dir):
    """Classes weighed alike, one model a task."""
    found = fit_tasks(_documents(spark, sf_dir), DOC_TASKS, "doc_id", balanced=True, **STUMP)
    return found.withColumns({"y": F.col("y").cast("int"), "score": F.round("score", 6)})


NAME = "p_name || ' ' || p_brand || ' ' || p_type"
PART_SQL = f"""
{_bits_sql('p_partkey', NAME, 'part')},
labelled AS (SELECT p_partkey AS id, {split_sql('p_partkey')} AS split, p_retailprice AS y FROM part),
train AS (SELECT * FROM labelled WHERE split = 'train'),
whole AS (SELECT count(*)::DOUBLE AS n, sum(y) AS s FROM train),
per AS (SELECT bit, count(*)::DOUBLE AS n1, sum(y) AS s1 FROM train JOIN bits USING (id) GROUP BY 1),
best AS (SELECT bit, s1 / n1 AS p1, (s - s1) / (n - n1) AS p0 FROM per, whole WHERE n1 < n
         ORDER BY round((s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1)) / n, 3) DESC, bit LIMIT 1),
scored AS (SELECT id, split, y, {_scored_sql('best')} AS y_pred FROM labelled, best)
"""


def _parts(spark, sf_dir):
    bits = hashed_fp(tokenize(F.concat_ws(" ", "p_name", "p_brand", "p_type")), SIZE, RADIUS)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), bits.alias("bits"))
    labels = part_tasks(spark, sf_dir).filter(F.col("task") == PART_TASKS[1])
    return cut(join_features(labels, bit_features(part, "bits", SIZE).drop("bits"), table(spark, sf_dir, "part").count(), "id"))


@register("stump_regress", f"WITH {PART_SQL} SELECT id, split, y, round(y_pred + 1e-9::DOUBLE, 6) AS y_pred FROM scored")
def stump_regress(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    model = fit_forest(rows.filter("split = 'train'"), "regression", **STUMP)
    return predict(model, rows, ["id", "split", "y"]).withColumn("y_pred", F.round(F.col("y_pred") + 1e-9, 6))


@register(
    "stump_triplicate",
    f"""
    WITH {PART_SQL}
    SELECT split, round(sqrt(avg((y - y_pred) * (y - y_pred))), 4) AS mean, 0.0::DOUBLE AS std, 0.0::DOUBLE AS spread
    FROM scored WHERE split <> 'train' GROUP BY 1
    """,
)
def stump_triplicate(spark, sf_dir):
    """Three fits on normalised labels, scored in label units; equal stumps have no deviation."""
    rows = _parts(spark, sf_dir)
    chain = fit_chain(["normalization"], rows.filter("split = 'train'"))
    summary = run_repeated(rows, "regression", chain=chain, **STUMP)[1]
    return summary.select("split", *[(F.round(c, 4) + 0.0).alias(c) for c in ("mean", "std", "spread")])
