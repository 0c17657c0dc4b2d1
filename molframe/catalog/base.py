"""Registration, table access and the stand-ins shared by several queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.operators.clean import unpivot_tasks
from molframe.operators.runlog import global_step
from molframe.operators.split import hash_split
from molframe.plans.lineage import cut, partitions
from molframe.plans.ordered import Running, running, slice_by_range

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(c, digits)


# documents stand in for sequences; this key makes uneven groups of them.
GROUP_KEY = "lang || ':' || CAST(n_chars // 100 AS VARCHAR)"


def group_key() -> Column:
    return F.concat("lang", F.lit(":"), F.expr("n_chars div 100").cast("string"))


# events stand in for training logs: user = run, position by time = step.
LOG_SQL = """
log AS (
  SELECT user_id AS run,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
         value AS loss, event_id, ts, event_type
  FROM events)
"""


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    log = events.select(
        F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("loss"), "event_type"
    )
    return global_step(log, "run", ["ts", "event_id"])


# orders and lineitem stand in for molecules: lines in order are a chain of
# atoms, and a closing bond from a third of the way makes a ring with a tail.
ATOM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
GRAPH_SQL = """
atoms AS (
  SELECT l_orderkey AS mol,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
         l_returnflag || l_linestatus AS symbol, l_quantity AS quantity
  FROM lineitem),
sizes AS (SELECT l_orderkey AS mol, count(*) AS n FROM lineitem GROUP BY 1),
bonds AS (
  SELECT mol, pos - 1 AS src, pos AS dst, 'chain' AS kind FROM atoms WHERE pos > 0
  UNION ALL
  SELECT mol, n // 3 AS src, n - 1 AS dst, 'ring' AS kind FROM sizes WHERE n - 1 - n // 3 >= 2)
"""


def molecule_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", *ATOM_ORDER)
    placed = running(slice_by_range(lines, ATOM_ORDER, ["l_orderkey"], partitions(lines, lines.count())), pos=Running("count"))
    # Written once: every use of atoms or bonds would number the lines again.
    atoms = cut(
        placed.select(
            F.col("l_orderkey").alias("mol"),
            (F.col("pos") - 1).alias("pos"),
            F.concat("l_returnflag", "l_linestatus").alias("symbol"),
            F.col("l_quantity").alias("quantity"),
        )
    )
    chain = atoms.filter("pos > 0").select(
        "mol", (F.col("pos") - 1).alias("src"), F.col("pos").alias("dst"), F.lit("chain").alias("kind")
    )
    sizes = atoms.groupBy("mol").agg(F.count(F.lit(1)).alias("n"))
    closing = sizes.filter("n - 1 - n div 3 >= 2").select(
        "mol", F.expr("n div 3").alias("src"), (F.col("n") - 1).alias("dst"), F.lit("ring").alias("kind")
    )
    return atoms, chain.unionByName(closing)


UNIT_SQL = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def split_sql(id: str, seed: int = 0) -> str:
    u = UNIT_SQL.format(f"'{seed}|' || CAST({id} AS VARCHAR)")
    return f"CASE WHEN {u} < 0.8::DOUBLE THEN 'train' WHEN {u} < 0.9::DOUBLE THEN 'valid' ELSE 'test' END"


# part stands in for a regression dataset with two tasks.
PART_TASKS = ["p_size", "p_retailprice"]
PART_LONG_SQL = f"""
wide AS (SELECT p_partkey AS id, {split_sql('p_partkey')} AS split, p_size, p_retailprice FROM part),
long AS (
  SELECT id, split, 'p_size' AS task, p_size::DOUBLE AS y FROM wide
  UNION ALL
  SELECT id, split, 'p_retailprice' AS task, p_retailprice AS y FROM wide)
"""


def part_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double"), "p_retailprice"
    )
    long = unpivot_tasks(hash_split(part, "id"), ["id", "split"], PART_TASKS)
    return long.withColumn("w", F.lit(1.0))


# documents with labels: two classification tasks with gaps.
DOC_TASKS = ["quality", "toxic"]


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
