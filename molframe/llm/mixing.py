"""Mixing sources to target weights by weighted fair queueing.

Every document of a source stands in a shuffled queue, twice over as far as
repeats are allowed. Its virtual finish time is the source's tokens up to and
including it, divided by the source's target. All queues merged by that time are
the mix; it is cut where the tokens of the whole reach the budget.

Nothing is gathered: running sums inside a source and over the merged queue go
through range-partitioned slices, so one source may hold any share of the rows.

Rows: a null text has size 0. A null source is a source of its own, the last.
Rows that agree in id, source and size are taken together. A source without
words has target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molframe.functions.hashing import hash60, seeded
from molframe.llm.registry import column
from molframe.plans.lineage import cut
from molframe.plans.ordered import Running, running, slice_by_range

KEYS = ["doc_id", "source", "size"]


def source_targets(
    units: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, limit: float = 2.0
) -> DataFrame:
    """One row per source: ``source, place, source_size, target, budget``.

    ``units`` has ``source`` and ``words``. Sources by code point, null last,
    weigh ``weights`` in turn and share ``share`` times all words; a target
    stops at ``limit`` times its source's words and the excess goes to the
    others by weight. With sources in order of the level at which they are
    full, the level reached is the largest that any suffix of them gives.
    """
    sizes = units.groupBy("source").agg(F.sum("words").alias("source_size"))
    # One row per source from here on, as many as there are weights to state.
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("place", F.row_number().over(in_turn))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = placed.withColumns(
        {
            "weight": F.get(listed, F.pmod(F.col("place") - 1, F.lit(len(weights)))),
            "full": F.col("source_size") * F.lit(limit),
            "budget": F.sum("source_size").over(Window.partitionBy()) * F.lit(share),
        }
    )
    order = Window.orderBy(F.col("full") / F.col("weight"), "place")
    before = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("level", (F.col("budget") - before) / weight_left)
    level = F.max("level").over(Window.partitionBy())
    return levels.select(
        "source", "place", "source_size", F.least("full", level * F.col("weight")).alias("target"), "budget"
    )


def fair_mix(
    df: DataFrame,
    id: str,
    source: str,
    size: str,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    limit: int = 2,
    seed: int = 0,
) -> DataFrame:
    """The decision on each distinct (id, source, size).

    Columns ``doc_id, source, size, source_size, target, copies``: how often the
    mix takes each row that has these values, 0 to ``limit`` times.
    """
    rows = df.select(column(id).alias("doc_id"), column(source).alias("source"), column(size).alias("size"))
    units = cut(rows.groupBy(*KEYS).agg((F.col("size") * F.count(F.lit(1))).alias("words")))
    targets = source_targets(units, weights, share, float(limit))

    shuffled = units.withColumn("turn", hash60(seeded(seed, F.col("doc_id"))))
    queues = running(
        slice_by_range(shuffled, ["turn", "doc_id", "size"], ["source"]), upto=Running("sum", F.col("words"))
    )
    # One row per source is joined: bounded by the weights stated, not by the documents.
    queued = queues.join(F.broadcast(targets.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
    queued = cut(queued.drop("_source"))

    def finish(epoch):
        upto = F.col("upto") + F.col("source_size") * F.lit(epoch)
        return F.when(F.col("target") > 0, upto / F.col("target")).otherwise(F.lit(0.0))

    order = ["finish", "place", "epoch", "turn", "doc_id", "size"]

    def stamp(epoch):
        named = [F.col(c) for c in ("turn", "doc_id", "size")]
        return F.struct(finish(epoch).alias("finish"), "place", F.lit(epoch).alias("epoch"), *named)

    stamps = queued.select(F.explode(F.array(*[stamp(e) for e in range(limit)])).alias("s"), "words", "budget")
    merged = stamps.select("s.*", "words", "budget")
    total = running(slice_by_range(merged, order), total=Running("sum", F.col("words")))
    last = total.filter(F.col("total") <= F.col("budget")).agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    if last is None:
        copies = F.lit(0)
    else:
        edge = F.struct(*[F.lit(last[c]).cast(merged.schema[c].dataType).alias(c) for c in order])
        copies = sum((stamp(e) <= edge).cast("int") for e in range(limit))
    return queued.select(*KEYS, "source_size", "target", copies.alias("copies"))


def mixed(df: DataFrame, id: str, source: str, size: str, **options) -> DataFrame:
    """Each row of ``df`` with its ``source_size, target, copies``."""
    decided = fair_mix(df, id, source, size, **options)
    decided = decided.select(*[F.col(c).alias(f"_{c}") for c in KEYS], "source_size", "target", "copies")
    same = (
        column(id).eqNullSafe(F.col("_doc_id"))
        & column(source).eqNullSafe(F.col("_source"))
        & (column(size) == F.col("_size"))
    )
    return df.join(decided, same).drop("_doc_id", "_source", "_size")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
units AS (SELECT doc_id, source, size, CAST(size * count(*) AS BIGINT) AS words FROM sized
          GROUP BY doc_id, source, size),
sources AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM units GROUP BY source),
placed AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sources),
weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS filled,
         CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget
  FROM placed),
levels AS (
  SELECT *, (budget - coalesce(sum(filled) OVER (ORDER BY filled / weight, place
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY filled / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighed),
targets AS (SELECT source, place, source_size, budget, least(filled, max(lvl) OVER () * weight) AS target FROM levels),
turned AS (
  SELECT *, ('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS turn FROM units),
queued AS (
  SELECT u.*, t.place, t.source_size, t.target, t.budget,
         CAST(sum(words) OVER (PARTITION BY u.source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM turned u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source),
stamps AS (
  SELECT q.*, e.epoch, CASE WHEN target > 0 THEN (upto + source_size * e.epoch) / target ELSE 0.0 END AS finish
  FROM queued q, (VALUES (0), (1)) AS e(epoch)),
merged AS (
  SELECT *, sum(words) OVER (ORDER BY finish, place, epoch, turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS total
  FROM stamps),
decided AS (
  SELECT doc_id, source, size, source_size, target, sum(CASE WHEN total <= budget THEN size ELSE 0 END) AS taken
  FROM merged GROUP BY doc_id, source, size, source_size, target)
SELECT s.doc_id, s.size, d.source_size, d.target, CAST(d.taken AS BIGINT) AS taken
FROM sized s JOIN decided d
  ON s.doc_id IS NOT DISTINCT FROM d.doc_id AND s.source IS NOT DISTINCT FROM d.source AND s.size = d.size
"""
