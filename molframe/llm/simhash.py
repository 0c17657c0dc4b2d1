"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint has m = 8 segments of 8 bits on a ring. If two differ in at most
d = 4 bits, then from some segment on, every chain of l consecutive segments
differs in at most l * d / m bits (the pigeonring principle, Qin and Xiao 2018).
So the first segment is equal, the next two hold at most one difference and the
next four at most two: of these four, two are equal, at least one of them among
the first two. Each start and each such pair make a key of 24 bits; equal keys
are candidates. A candidate is then checked chain by chain, and by its whole
distance only if every chain fits.

Only distinct fingerprints are linked, so exact copies never meet. Keys with two
fingerprints are decided by their smallest and largest alone. Larger groups are
cut into blocks; pairs of blocks are compared in tasks of bounded size, each of
which returns a spanning forest of its links instead of all pairs.

Rows: a null text is empty; texts without words have fingerprint zero and are
linked like any other. Each input row gives one output row. Null ids never name
a component unless it has no other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.components import components
from molframe.llm.registry import column
from molframe.plans.lineage import cut

SEGMENTS, WIDTH = 8, 8
#: Places after the start that may be the two equal segments.
PAIRS = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4))
#: Fingerprints of one block; two blocks are compared in one task.
BLOCK = 4096
STEP = 65_536


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit fingerprint, unsigned: the majority of each bit over the hashes of all word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, STEP):
        some = zip(starts[at : min(at + STEP, n)].tolist(), (ends[at + shingle - 1 : at + STEP + shingle - 1] - 1).tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in some], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """``simhash`` as a bigint with the same bits."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _keys(fp: Column) -> Column:
    """The 40 keys of a fingerprint: start and pair above 24 bits of content."""
    made = []
    for start in range(SEGMENTS):
        for number, (p, q) in enumerate(PAIRS):
            tag = (start * len(PAIRS) + number) << 24
            made.append(
                F.lit(tag).cast("bigint")
                + F.shiftleft(_segment(fp, start), 16)
                + F.shiftleft(_segment(fp, start + p), 8)
                + _segment(fp, start + q)
            )
    return F.array(*made)


def _start(key: Column) -> Column:
    return F.shiftright(key, 24).cast("int") / len(PAIRS)


def _fits(a: Column, b: Column, start: Column, distance: int) -> Column:
    """Chain after chain from ``start``, then the whole distance."""
    differ = a.bitwiseXOR(b)
    chains = []
    for s in range(SEGMENTS):
        turned = F.shiftrightunsigned(differ, WIDTH * s).bitwiseOR(F.shiftleft(differ, (64 - WIDTH * s) % 64))
        budget = [
            F.bit_count(turned.bitwiseAND(F.lit((1 << (WIDTH * n)) - 1))) <= n * distance // SEGMENTS
            for n in range(1, SEGMENTS)
        ]
        fits = budget[0]
        for more in budget[1:]:
            fits = fits & more
        chains.append(F.when(start == s, fits))
    return F.coalesce(*chains) & (F.bit_count(differ) <= distance)


def _forest(distance: int):
    """Links of one pair of blocks that share a key, as a spanning forest."""

    def link(group: pd.DataFrame) -> pd.DataFrame:
        start = int(group["key"].iloc[0] >> 24) // len(PAIRS)
        fps = np.unique(group["fp"].to_numpy()).view(np.uint64)
        turned = (fps >> np.uint64(WIDTH * start)) | (fps << np.uint64((64 - WIDTH * start) % 64))
        masks = [np.uint64((1 << (WIDTH * n)) - 1) for n in range(1, SEGMENTS)]
        unseen = np.ones(len(fps), bool)
        found = []
        while unseen.any():
            # Walk one component breadth-first; only nodes not reached yet are compared.
            root = int(unseen.argmax())
            unseen[root] = False
            queue = [root]
            while queue and unseen.any():
                at = queue.pop()
                left = np.flatnonzero(unseen)
                differ = turned[left] ^ turned[at]
                for n, mask in enumerate(masks, 1):
                    fit = np.bitwise_count(differ & mask) <= n * distance // SEGMENTS
                    left, differ = left[fit], differ[fit]
                near = left[np.bitwise_count(differ) <= distance]
                unseen[near] = False
                queue.extend(near.tolist())
                found.extend((at, int(i)) for i in near)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        signed = fps.view(np.int64)
        return pd.DataFrame({"a": signed[pairs[:, 0]], "b": signed[pairs[:, 1]]})

    return link


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links ``a, b`` that connect all of ``fps(fp)`` within ``distance`` bits; none between the unconnected."""
    if distance != 4:
        raise ValueError("the keys are built for a distance of 4 bits")
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    groups = cut(
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter("n > 1")
    )
    start = F.floor(_start(F.col("key"))).cast("int")
    pairs = groups.filter("n = 2").filter(_fits(F.col("a"), F.col("b"), start, distance)).select("a", "b")

    crowded = groups.filter("n > 2").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # Keys are unique on the right, so a crowded key can be split on the left.
    members = keyed.join(crowded, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.select("key", "fp", "block", other.alias("other")).select(
        "key", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    forests = dealt.groupBy("key", "i", "j").applyInPandas(_forest(distance), "a bigint, b bigint")
    return pairs.unionByName(forests)


def near_duplicates(df: DataFrame, id: str, text: str, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id, fp, root, component_id`` of each row.

    ``root`` names the group of linked fingerprints, ``component_id`` is its least id.
    """
    rows = cut(df.select(column(id).alias("doc_id"), fingerprint(column(text), shingle).alias("fp")))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(links(nodes.select("fp"), distance))
    rooted = cut(
        nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        )
    )
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(firsts, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(df: DataFrame, id: str, text: str, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each group the one with the least id stays.

    Rows that repeat an id are told apart by their fingerprint, so of rows that
    repeat id and group one stays, and rows of other groups stay too.
    """
    found = cut(near_duplicates(df, id, text, shingle, distance))
    per_id = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_times"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_first")
    )
    chosen = per_id.filter("_first").select(F.col("doc_id").alias("_doc_id"), "_times")
    kept = df.join(chosen, column(id).eqNullSafe(F.col("_doc_id")))
    once = kept.filter("_times = 1").drop("_doc_id", "_times")
    # Few rows: those whose id occurs more than once.
    again = kept.filter("_times > 1").drop("_doc_id", "_times").withColumn("_fp", fingerprint(column(text), shingle))
    named = found.select(
        F.col("fp").alias("_named"), F.col("root").alias("_root"), F.col("component_id").alias("_component")
    ).distinct()
    again = again.join(named, F.col("_fp") == F.col("_named")).filter(column(id).eqNullSafe(F.col("_component")))
    return once.unionByName(again.dropDuplicates(["_root"]).drop("_fp", "_named", "_root", "_component"))
