"""Exact duplicates: rows whose texts are identical once blanks are left out.

1. Every text is normalised (characters of SPACE deleted) and reduced to a
   128-bit digest and some numbers, so that no text travels yet.
2. Rows are counted by digest. Only texts whose digest repeats are read again;
   their bytes are compared by grouping on (digest, bytes), which combines
   before the shuffle: a task sends each text once, however many copies it read.
3. A digest that several byte strings share, a collision, gets one class for
   each of them; all other digests are classes as they are.
4. Each class elects the row with the most code points in the original text,
   then the smallest id (null after all others), then the first in the written
   table, so exactly one row stays. Rows meet their class in a join whose right
   side is unique, the shape in which a hot class is split.

Rows: a null text counts as empty, and all blank texts are one class. Repeated
rows are copies like any others: one stays, even if id and text repeat. A null
id is an id. Long texts are compared whole. An empty table gives an empty
result. Extra columns are ignored unless ``keep`` names them; names that clash
with those of the result are the caller's to rename, except that id and text
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.registry import column
from molframe.plans.lineage import cut

#: Characters that do not count: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
ranked AS (
  SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept
  FROM texts)
SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256 FROM ranked
"""


def normalised(text: Column) -> Column:
    """Bytes of the text without the characters of SPACE."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "").cast("binary")


def digest128(body: Column) -> Column:
    return F.unhex(F.md5(body))


def exact_duplicates(
    df: DataFrame, id: str, text: str, keep: Sequence[str] = (), digest: Callable[[Column], Column] = digest128
) -> DataFrame:
    """One row per row of ``df``: id, ``keep`` columns, ``keep_id, group_size, kept, text_sha256``.

    ``digest`` may be any hash of the bytes; a weak one costs time, not truth.
    """
    doc = F.struct(column(id).alias("id"), *[column(k).alias(f"keep{i}") for i, k in enumerate(keep)])
    whole = df.select(doc.alias("doc"), F.coalesce(column(text), F.lit("")).alias("raw"))
    bodies = whole.select("doc", F.length("raw").alias("n"), normalised(F.col("raw")).alias("body"))
    bodies = bodies.withColumns({"h": digest(F.col("body")), "sha": F.unhex(F.sha2("body", 256))})
    # The written table fixes these numbers: they tell repeated rows apart.
    numbered = F.monotonically_increasing_id().alias("row")
    rows = cut(bodies.select("doc", "n", "h", "sha", numbered))
    # Written, so that Spark knows the size before it chooses how to join the texts.
    repeated = cut(rows.groupBy("h").count().filter("count > 1").select("h"))
    distinct = bodies.join(repeated, "h", "left_semi").select("h", "body").distinct()
    collided = cut(distinct.groupBy("h").count().filter("count > 1").select("h"))
    classed = rows.withColumn("part", F.lit(None).cast("binary"))
    if not collided.isEmpty():
        torn = bodies.join(collided, "h", "left_semi").select("doc", "n", "h", "sha", numbered, F.col("body").alias("part"))
        classed = classed.join(collided, "h", "left_anti").unionByName(cut(torn))

    first = F.struct(-F.col("n"), F.col("doc.id").isNull(), F.col("doc.id").alias("id"), F.col("row").alias("row"))
    groups = classed.groupBy("h", "part").agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("first"))
    groups = groups.select(F.col("h").alias("_h"), F.col("part").alias("_part"), "group_size", "first")
    met = classed.join(groups, (F.col("h") == F.col("_h")) & F.col("part").eqNullSafe(F.col("_part")))
    return met.select(
        F.col("doc.id").alias(id),
        *[F.col(f"doc.keep{i}").alias(k) for i, k in enumerate(keep)],
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(df: DataFrame, id: str, text: str) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    whole = df.select(column(id), column(text), F.struct("*").alias("_doc"))
    return exact_duplicates(whole, id, text, keep=("_doc",)).filter("kept").select("_doc.*")
