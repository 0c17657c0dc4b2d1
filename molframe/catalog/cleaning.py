"""Filters, projections and reports."""

from pyspark.sql import functions as F

from molframe.catalog.base import (
    DOC_TASKS,
    LOG_SQL,
    labelled_documents,
    register,
    split_sql,
    table,
    training_log,
)
from molframe.functions.arrays import joined, one_hot
from molframe.functions.text import every, first_match_rewrite
from molframe.functions.tokens import hashed_fp, tokenize
from molframe.operators.clean import (
    clean_by_length,
    clean_report,
    columns_to_vector,
    drop_empty_features,
    drop_missing,
    nonempty_splits,
    normalized,
    pivot_tasks,
    project_tasks,
    resolve_alias,
    split_known,
    unpivot_tasks,
    vector_to_columns,
    with_weights,
)
from molframe.operators.split import hash_split
from molframe.registry import DatasetSpec

MAX_LEN = 1000


@register("clean_by_length", f"SELECT doc_id, text, lang FROM documents WHERE length(text) <= {MAX_LEN}")
def by_length(spark, sf_dir):
    return clean_by_length(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text", MAX_LEN)


@register(
    "clean_report",
    f"""
    SELECT lang, {split_sql('doc_id')} AS split, count(*) AS original,
           count(*) FILTER (length(text) <= {MAX_LEN}) AS kept,
           count(*) - count(*) FILTER (length(text) <= {MAX_LEN}) AS removed
    FROM documents GROUP BY 1, 2
    """,
)
def report(spark, sf_dir):
    return clean_report(hash_split(table(spark, sf_dir, "documents"), "doc_id"), "text", MAX_LEN, ["lang", "split"])


@register(
    "drop_missing_labels",
    """
    SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
    WHERE quality IS NOT NULL AND toxic IS NOT NULL
    """,
)
def missing_labels(spark, sf_dir):
    return drop_missing(labelled_documents(spark, sf_dir), DOC_TASKS).select("doc_id", *DOC_TASKS)


@register(
    "drop_empty_features",
    """
    SELECT doc_id, len(x) AS n_features
    FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS x FROM documents) WHERE len(x) > 0
    """,
)
def empty_features(spark, sf_dir):
    numbers = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    found = table(spark, sf_dir, "documents").select("doc_id", numbers.alias("x"))
    return drop_empty_features(found).select("doc_id", F.size("x").cast("bigint").alias("n_features"))


@register("task_projection", "SELECT doc_id, text, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def task_projection(spark, sf_dir):
    spec = DatasetSpec(feature="text", tasks=("toxic",), id="doc_id")
    return project_tasks(labelled_documents(spark, sf_dir), spec)


@register(
    "task_unpivot",
    """
    SELECT doc_id, 'quality' AS task, quality AS y FROM labels
    UNION ALL SELECT doc_id, 'toxic' AS task, toxic AS y FROM labels
    """,
)
def task_unpivot(spark, sf_dir):
    return unpivot_tasks(table(spark, sf_dir, "labels"), "doc_id", DOC_TASKS)


@register("task_pivot", "SELECT doc_id, quality, toxic FROM labels")
def task_pivot(spark, sf_dir):
    long = unpivot_tasks(table(spark, sf_dir, "labels"), "doc_id", DOC_TASKS)
    return pivot_tasks(long, "doc_id", DOC_TASKS)


WIDTH = 64


@register(
    "vector_to_columns",
    "SELECT vec_id, label, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS X{i + 1}" for i in range(WIDTH))
    + " FROM embeddings",
)
def wide_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    wide = vector_to_columns(vectors, "embedding", WIDTH)
    return vector_to_columns(columns_to_vector(wide, WIDTH), "x", WIDTH)


@register(
    "with_weights",
    """
    SELECT doc_id, quality, toxic,
           CASE WHEN quality IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS w_quality,
           CASE WHEN toxic IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS w_toxic
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def weights(spark, sf_dir):
    return with_weights(labelled_documents(spark, sf_dir).select("doc_id", *DOC_TASKS), DOC_TASKS)


@register(
    "one_hot",
    """
    SELECT doc_id, CASE WHEN quality = 0 THEN '1,0' WHEN quality = 1 THEN '0,1' END AS quality_hot,
           CASE WHEN toxic = 0 THEN '1,0' WHEN toxic = 1 THEN '0,1' END AS toxic_hot
    FROM labels
    """,
)
def hot(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        "doc_id", *[joined(one_hot(F.col(t), 2)).alias(f"{t}_hot") for t in DOC_TASKS]
    )


@register(
    "normalize_names",
    r"SELECT p_partkey, regexp_replace(trim('  ' || p_name || '  ' || p_type || ' '), '\s+', '_', 'g') AS name FROM part",
)
def names(spark, sf_dir):
    raw = F.concat(F.lit("  "), "p_name", F.lit("  "), "p_type", F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", normalized(raw).alias("name"))


@register(
    "alias_resolve",
    """
    WITH named AS (SELECT c_custkey, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    aliases AS (SELECT n_name AS alias, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey
                WHERE n_nationkey % 2 = 0)
    SELECT c_custkey, coalesce(canonical, name) AS resolved FROM named LEFT JOIN aliases ON name = alias
    """,
)
def alias_resolve(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    aliases = (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .filter("n_nationkey % 2 = 0")
        .select(F.col("n_name").alias("alias"), F.col("r_name").alias("canonical"))
    )
    return resolve_alias(named.select("c_custkey", F.col("n_name").alias("name")), aliases).drop("name")


def _registered(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", "p_name"), part.filter("p_size >= 48").select("p_name")


KNOWN_SQL = """
SELECT p_partkey, p_name FROM part
WHERE p_name {0} IN (SELECT p_name FROM part WHERE p_size >= 48)
"""


@register("known_names", KNOWN_SQL.format(""))
def known_names(spark, sf_dir):
    return split_known(*_registered(spark, sf_dir), "p_name")[0].select("p_partkey", "p_name")


@register("unknown_names", KNOWN_SQL.format("NOT"))
def unknown_names(spark, sf_dir):
    return split_known(*_registered(spark, sf_dir), "p_name")[1].select("p_partkey", "p_name")


@register(
    "nonempty_splits",
    f"""
    SELECT source, {split_sql('doc_id')} AS split, count(*) AS n_rows
    FROM documents WHERE length(text) <= 300 GROUP BY 1, 2
    """,
)
def nonempty(spark, sf_dir):
    docs = hash_split(table(spark, sf_dir, "documents"), "doc_id")
    return nonempty_splits(docs, F.length("text") <= 300, ["source", "split"])


# Rules for page addresses, tried in order; other addresses are dropped.
URL_RULES = (
    (r"^https?://m\.([a-z]+)\.", "mobile/$1/"),
    (r"^https?://blog\.([a-z]+)\.", "blog/$1/"),
    (r"\.html$", "/page"),
    (r"/([a-z][a-z])/([0-9]+)", "/$2/$1"),
)


def _rewrite_sql() -> str:
    cases = " ".join(
        "WHEN regexp_matches(k, '{0}') THEN regexp_replace(k, '{0}', '{1}', 'g')".format(
            p, r.replace("$1", r"\1").replace("$2", r"\2")
        )
        for p, r in URL_RULES
    )
    return f"""
    SELECT * FROM (SELECT page_id, CASE {cases} END AS new_key
                   FROM (SELECT page_id, replace(url, 'example.', '') AS k FROM pages))
    WHERE new_key IS NOT NULL
    """


@register("first_match_rewrite", _rewrite_sql())
def rewrite(spark, sf_dir):
    new = first_match_rewrite(F.col("url"), URL_RULES, strip="example.")
    return table(spark, sf_dir, "pages").select("page_id", new.alias("new_key")).filter("new_key is not null")


@register(
    "cadence_filter",
    f"""
    WITH {LOG_SQL}, ends AS (SELECT run, max(step) AS last FROM log GROUP BY 1)
    SELECT run, step, step % 10 = 0 AS is_logged, step % 10 = 9 OR step = last AS is_saved
    FROM log JOIN ends USING (run) WHERE step % 10 IN (0, 9) OR step = last
    """,
)
def cadence(spark, sf_dir):
    log = training_log(spark, sf_dir)
    ends = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("last"))
    step = F.col("step")
    marked = log.join(ends, "run").select(
        "run", "step", every(step, 10).alias("is_logged"), (every(step, 10, 9) | (step == F.col("last"))).alias("is_saved")
    )
    return marked.filter("is_logged or is_saved")


@register(
    "feat_dummy",
    "SELECT doc_id, text AS x FROM documents",
)
def feat_dummy(spark, sf_dir):
    from molframe.operators.features import dummy

    return dummy(table(spark, sf_dir, "documents"), "text").select("doc_id", "x")
