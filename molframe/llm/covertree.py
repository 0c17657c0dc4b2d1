"""Exact top-k inner products by dual-tree cover-tree search.

Queries and vectors are indexed together: both are dealt to the nearest of a
few centres, and inside a task both are made into cover trees whose nodes know
their centre and covering radius. A pair of nodes whose inner products cannot
reach the worst k-th score of the query node, by the centres' inner product and
the radii (Curtin and Ram 2014), is pruned; equal bounds are kept for ties.

The same bound prunes across tasks: a query group first searches the cells of
its own centre, and then only the cells whose radius lets them reach the
group's worst k-th score. Cells and groups that grow are cut by the hash of the
id, so any number of copies of one vector spreads over tasks.

Which vectors take part: see ``vector_table``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.vectors import best_first, matrix, sampled, vector_table
from molframe.plans.lineage import cut

#: Vectors of one cell, queries of one group, and at most so many centres, a bounded sample.
CELL, GROUP, CENTRES = 8192, 1024, 1024
LEAF, CHILDREN = 256, 12
FOUND = "query_id bigint, vec_id bigint, score bigint"
NONE = -(1 << 62)


@dataclass
class Node:
    """Rows within ``radius`` of ``centre``."""

    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)
    worst: float = -np.inf

    @property
    def norm(self) -> float:
        return float(np.sqrt(self.centre @ self.centre))


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = x - centre
    return np.sqrt((gap * gap).sum(axis=1))


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, centre: np.ndarray | None = None) -> Node:
    """Each level is covered by farthest-first centres, until they halve the radius or are CHILDREN."""
    rows = np.arange(len(x)) if rows is None else rows
    centre = x[rows[0]] if centre is None else centre
    away = distances(x[rows], centre)
    node = Node(rows, centre, float(away.max()))
    if len(rows) <= LEAF or node.radius == 0:
        return node
    nearest, owner, made = away, np.zeros(len(rows), int), [centre]
    while len(made) < CHILDREN and nearest.max() > node.radius / 2:
        made.append(x[rows[int(nearest.argmax())]])
        again = distances(x[rows], made[-1])
        closer = again < nearest
        owner[closer], nearest = len(made) - 1, np.where(closer, again, nearest)
    parts = [(rows[owner == i], c) for i, c in enumerate(made) if (owner == i).any()]
    if len(parts) > 1:
        node.children = [cover_tree(x, part, c) for part, c in parts]
    else:
        half = len(rows) // 2
        node.children = [cover_tree(x, rows[:half], centre), cover_tree(x, rows[half:], centre)]
    return node


def bound(q_centre, q_radius, r_centre, r_radius) -> float:
    """No inner product of a point near one centre and a point near the other is larger."""
    q_norm, r_norm = np.sqrt(q_centre @ q_centre), np.sqrt(r_centre @ r_centre)
    top = float(q_centre @ r_centre) + q_norm * r_radius + r_norm * q_radius + q_radius * r_radius
    return top + 1e-9 * (abs(top) + 1)


class Search:
    """Best scores of all queries of a task so far, and the walk over pairs of nodes."""

    def __init__(self, queries, query_ids, vectors, ids, kth, k):
        self.q, self.query_ids, self.x, self.ids = queries, query_ids, vectors, ids
        self.known = kth
        self.scores = np.full((len(queries), k), NONE, np.int64)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)

    def kth(self, rows) -> np.ndarray:
        return np.maximum(self.scores[rows, -1].astype(np.float64), self.known[rows])

    def walk(self, q: Node, r: Node) -> None:
        if bound(q.centre, q.radius, r.centre, r.radius) < q.worst:
            return
        if not q.children and not r.children:
            self.compare(q, r)
        elif q.children and (not r.children or len(q.rows) > len(r.rows)):
            for child in q.children:
                child.worst = max(child.worst, q.worst)
                self.walk(child, r)
            q.worst = min(child.worst for child in q.children)
        else:
            for child in sorted(r.children, key=lambda c: -bound(q.centre, q.radius, c.centre, c.radius)):
                self.walk(q, child)

    def compare(self, q: Node, r: Node) -> None:
        # Whole numbers below 2 ** 53 are exact in doubles.
        scores = np.rint(self.q[q.rows] @ self.x[r.rows].T).astype(np.int64)
        scores[self.query_ids[q.rows][:, None] == self.ids[r.rows][None, :]] = NONE
        better = (scores >= self.kth(q.rows)[:, None]).any(axis=1)
        rows = q.rows[better]
        if len(rows):
            ids = np.broadcast_to(self.ids[r.rows], (len(rows), len(r.rows)))
            both = np.concatenate([self.scores[rows], scores[better]], axis=1)
            named = np.concatenate([self.found[rows], ids], axis=1)
            order = np.lexsort((named, -both), axis=1)[:, : self.scores.shape[1]]
            self.scores[rows] = np.take_along_axis(both, order, 1)
            self.found[rows] = np.take_along_axis(named, order, 1)
        q.worst = float(self.kth(q.rows).min())

    def rows(self) -> pd.DataFrame:
        real = self.scores > NONE
        asked = np.repeat(self.query_ids, real.sum(axis=1))
        return pd.DataFrame({"query_id": asked, "vec_id": self.found[real], "score": self.scores[real]})


def _searcher(k: int):
    def search(queries: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or cell.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, x = matrix(queries["v"]), matrix(cell["v"])
        kth = queries["kth"].fillna(-np.inf).to_numpy(np.float64)
        walk = Search(q, queries["query_id"].to_numpy(), x, cell["vec_id"].to_numpy(), kth, k)
        root = cover_tree(q)
        root.worst = float(kth.min())
        walk.walk(root, cover_tree(x))
        return walk.rows()

    return search


def _nearest(centres: np.ndarray):
    @F.pandas_udf("centre int, away double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            x = matrix(v)
            # Chunks keep the table of distances small.
            gaps = [
                (part * part).sum(axis=1)[:, None] - 2 * part @ centres.T + (centres * centres).sum(axis=1)
                for part in np.array_split(x, max(1, len(x) // 1024))
            ]
            nearest = np.concatenate([g.argmin(axis=1) for g in gaps]).astype(np.int32)
            yield pd.DataFrame({"centre": nearest, "away": np.sqrt(((x - centres[nearest]) ** 2).sum(axis=1))})

    return of


def scaled(v: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of every component."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            whole = np.floor(factor * matrix(vectors)) if len(vectors) else np.zeros((0, 1))
            yield pd.Series([x.tobytes() for x in whole], dtype=object)

    return of(v)


def _dealt(rows: DataFrame, centres: np.ndarray, size: int, name: str) -> tuple[DataFrame, list]:
    """Rows with centre, and the centre's part by the hash of the id; per centre (centre, radius, parts)."""
    near = rows.withColumn("near", _nearest(centres)(F.col("v"))).select("*", "near.centre", "near.away").drop("near")
    near = cut(near)
    # One row per centre, a bounded number, reaches the driver.
    stats = near.groupBy("centre").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    told = [(r["centre"], r["radius"], -(-r["n"] // size)) for r in stats]
    parts = [0] * len(centres)
    for centre, _, count in told:
        parts[centre] = count
    count = F.get(F.array(*[F.lit(p) for p in parts]), F.col("centre"))
    return near.withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(1)), count).cast("int")), told


def search(df: DataFrame, id: str, vector: str, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` (whole) of each query's ``k`` highest inner products of floored vectors."""
    rows = vector_table(df, id, vector)
    rows = cut(rows.select("vec_id", scaled(F.col("v")).alias("v")))
    n = rows.count()
    if n == 0:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    centres = sampled(rows, min(CENTRES, -(-n // CELL)))
    cells, cell_stats = _dealt(rows, centres, CELL, "part")
    asked = rows.filter(is_query)
    groups, _ = _dealt(asked, centres[: max(1, -(-asked.count() // GROUP))], GROUP, "group")
    groups = groups.select(
        F.col("vec_id").alias("query_id"), "v", F.col("centre").alias("near"), "group", "away"
    )
    keys = ["near", "group", "centre", "part"]

    def walk(pairs: DataFrame, with_queries: DataFrame) -> DataFrame:
        """``pairs`` names the (near, group, centre, part) to compare; its rows are few against the vectors."""
        left = with_queries.join(pairs, ["near", "group"]).select(*keys, "query_id", "v", "kth")
        right = cells.select("vec_id", "v", "centre", "part").join(pairs, ["centre", "part"]).select(*keys, "vec_id", "v")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_searcher(k), FOUND)

    spark = rows.sparkSession
    parts = {c: p for c, _, p in cell_stats}
    radius = {c: r for c, r, _ in cell_stats}

    def pairs_of(told: DataFrame, reaches) -> DataFrame:
        @F.pandas_udf("array<struct<centre:int,part:int>>")
        def cells_for(near: pd.Series, worst: pd.Series, away: pd.Series) -> pd.Series:
            made = []
            for c, w, r in zip(near, worst, away):
                some = [o for o in parts if reaches(int(c), float(w) if w == w else -np.inf, float(r), o)]
                made.append([{"centre": int(o), "part": p} for o in some for p in range(parts[o])])
            return pd.Series(made)

        each = F.explode(cells_for(F.col("near"), F.col("worst"), F.col("away")))
        return cut(told.select("near", "group", each.alias("c")).select("near", "group", "c.*"))

    told = groups.groupBy("near", "group").agg(F.max("away").alias("away")).withColumn("worst", F.lit(None).cast("double"))
    own = pairs_of(told, lambda c, w, r, o: o == c)
    first = cut(walk(own, groups.withColumn("kth", F.lit(None).cast("double"))))
    top = best_first(first, k)
    kth = top.filter(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").cast("double").alias("kth"))
    known = groups.join(kth, F.col("query_id") == F.col("_q"), "left").drop("_q")
    missing = F.min(F.coalesce("kth", F.lit(float("-inf")))).alias("worst")
    told = known.groupBy("near", "group").agg(F.max("away").alias("away"), missing)

    def reaches(c, w, r, o):
        return o != c and bound(centres[c], r, centres[o], radius[o]) >= w

    second = walk(pairs_of(told, reaches), known)
    return best_first(first.unionByName(second), k)
