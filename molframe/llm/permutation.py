"""Approximate nearest neighbours with a permutation index.

A bounded sample of vectors are the pivots. Every vector is represented by its
nearest pivots in order, and is posted, with its place in that order, in the
inverted file of each of them. A query walks the files of its own nearest
pivots and sums, for each vector, the differences of places (Spearman's
footrule; a pivot missing from a vector's list counts as at its end). The best
share of each block by that distance is reranked by the exact inner product.

Equal vectors are one entry of the index, with the smallest ids that can be in
a result; pivots are different vectors, and a vector asked for by many rows is
searched once. So copies, however many, neither fill the pivots nor the share
that is reranked. Entries lie in blocks by the hash of their smallest id, so a
block is a random part of the different vectors, whatever its size; vectors asked
for lie in batches. Each task has one block and one batch.

Rows: which vectors take part, and repeated ids, see ``vector_table``; zero
vectors do not. Ties go to the smaller id. An empty table gives an empty result.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.llm.vectors import matrix, sampled, vector_table
from molframe.plans.lineage import cut

#: Vectors of one block and queries of one batch.
BLOCK, BATCH = 8192, 1024
FOUND = "query bigint, vec_id bigint, score double"


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """Numbers of each row's nearest pivots by inner product, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :places]


def inverted_files(order: np.ndarray, pivots: int) -> np.ndarray:
    """One file per pivot: at which place each row lists it, and one past the end where it does not.

    Most pivots are listed by a good part of the rows, so files are dense.
    """
    rows, places = order.shape
    kind = np.int16 if places * places < 1 << 15 else np.int32
    files = np.full((pivots, rows), places, kind)
    files[order, np.arange(rows)[:, None]] = np.arange(places, dtype=kind)
    return files


def entries(rows: DataFrame, most: int) -> DataFrame:
    """``entry, v, ids``, written: each different vector with its ``most`` smallest ids, named by the smallest."""
    order = Window.partitionBy("v").orderBy("vec_id")
    # Spark keeps the first of each vector before the shuffle too, so copies do not gather in one task.
    first = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    return cut(first.groupBy("v").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids")))


def _searcher(pivots: np.ndarray, places: int, share: float, least: int, most: int):
    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"query": [], "vec_id": [], "score": []})
        block = block.sort_values("entry", kind="stable")
        x, names, ids = matrix(block["v"]), block["entry"].to_numpy(), block["ids"].to_numpy()
        files = inverted_files(nearest_pivots(x, pivots, places), len(pivots))
        wanted = min(len(x), max(least, int(np.ceil(share * len(x)))))
        q = matrix(queries["v"])
        out = []
        for query, vector, listed in zip(queries["query"], q, nearest_pivots(q, pivots, places)):
            gaps = files[listed]
            gaps -= np.arange(len(listed), dtype=files.dtype)[:, None]
            footrule = np.abs(gaps, out=gaps).sum(axis=0, dtype=files.dtype)
            # Ties go to the smaller id, in whose order the entries are.
            ranked = np.argsort(footrule, kind="stable")[:wanted]
            score = (x[ranked] * vector).sum(axis=1)
            # Each entry has an id ahead of all entries after it, so more entries cannot matter.
            best = np.lexsort((names[ranked], -score))[:most]
            copies = [ids[ranked[i]] for i in best]
            found, scores = np.concatenate(copies), np.repeat(score[best], [len(c) for c in copies])
            first = np.lexsort((found, -scores))[:most]
            out.append(pd.DataFrame({"query": query, "vec_id": found[first], "score": scores[first]}))
        return pd.concat(out)

    return search


def search(
    df: DataFrame,
    id: str,
    vector: str,
    is_query: Column,
    k: int = 20,
    pivots: int = 512,
    places: int = 128,
    share: float = 0.25,
    least: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` nearest found by inner product.

    ``is_query`` is a condition on ``vec_id``. ``pivots`` bounds the sample,
    ``places`` the length of the orders; of every block the ``share`` with the
    least footrule (at least ``least``) is reranked.
    """
    rows = vector_table(df, id, vector)
    rows = rows.filter(~_is_zero(F.col("v")))
    # One more than asked for, since a row's own id may be among them.
    kinds = entries(rows, k + 1)
    chosen = sampled(kinds, pivots, "entry")
    places = min(places, max(len(chosen), 1))
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    # The entries are unique on their side, so a vector that many rows ask for is split by adaptive execution.
    named = kinds.select(F.col("v").alias("kv"), F.col("entry").alias("query"))
    queries = cut(queries.join(named, F.col("qv") == F.col("kv")).select("query_id", "query"))
    asked = queries.select("query").distinct()
    blocks, batches = max(1, -(-kinds.count() // BLOCK)), max(1, -(-asked.count() // BATCH))

    def dealt(name, count):
        return F.pmod(F.xxhash64(name), F.lit(count)).cast("int")

    def all_of(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    wanted = kinds.select("entry", F.col("v").alias("v"))
    asked = wanted.join(asked, F.col("entry") == F.col("query")).select("query", F.col("v").alias("v"), dealt("query", batches).alias("batch"))
    asked = asked.select("*", all_of(blocks).alias("block"))
    held = kinds.select("entry", F.col("v").alias("v"), "ids", dealt("entry", blocks).alias("block")).select("*", all_of(batches).alias("batch"))
    found = (
        asked.groupBy("batch", "block")
        .cogroup(held.groupBy("batch", "block"))
        .applyInPandas(_searcher(chosen, places, share, least, k + 1), FOUND)
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    first = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    lists = first.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    answers = queries.join(lists, "query").select("query_id", F.posexplode(others).alias("rank", "b"))
    return answers.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id"), F.col("b.score"))


def _is_zero(v: Column) -> Column:
    """All doubles are zero, of either sign."""
    return F.regexp_like(F.hex(v), F.lit("^([08]000000000000000|00000000000000[08]0)*$"))
