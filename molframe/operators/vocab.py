"""Vocabularies: build, and encode with."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molframe.functions.tokens import SPECIALS, UNK_ID
from molframe.operators.joins import two_way
from molframe.plans.lineage import cut
from molframe.plans.ordered import row_index

# What every executor can hold of a vocabulary, in entries and in bytes of text.
HEAD = 500_000
HEAD_BYTES = 64 << 20


def build_vocab(
    df: DataFrame,
    tokens: Column,
    specials: Sequence[str] = SPECIALS,
    min_count: int = 1,
    max_size: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Rows ``(token, n, token_id)``: specials first, then by falling count, token ascending."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return number_tokens(counts, specials, min_count, max_size, slices)


def number_tokens(
    counts: DataFrame,
    specials: Sequence[str] = SPECIALS,
    min_count: int = 1,
    max_size: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Ids for counted tokens ``(token, n)``."""
    usable = counts.filter((F.col("n") >= min_count) & ~F.col("token").isin(*specials))
    ranked = row_index(usable.withColumn("_rarer", -F.col("n")), ["_rarer", "token"], "token_id", slices, derived=True)
    words = ranked.select("token", "n", (F.col("token_id") + len(specials)).alias("token_id"))
    if max_size is not None:
        words = words.filter(F.col("token_id") < max_size)
    first = df_of_specials(counts, specials)
    return first.unionByName(words)


def df_of_specials(like: DataFrame, specials: Sequence[str]) -> DataFrame:
    rows = [(s, 0, i) for i, s in enumerate(specials)]
    return like.sparkSession.createDataFrame(rows, "token string, n bigint, token_id bigint")


def node_contexts(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Atom and bond contexts ``(kind, token)``, one row per atom and per bond.

    An atom's context is its symbol with the counted symbols of its neighbours.
    Neighbours are counted per symbol before they meet, so a hub with millions
    of them contributes one entry per distinct symbol.
    """
    symbol = atoms.select("mol", "pos", "symbol")
    arcs = two_way(bonds).join(symbol.toDF("mol", "b", "near"), ["mol", "b"])
    near = arcs.groupBy("mol", F.col("a").alias("pos"), "near").agg(F.count(F.lit(1)).alias("n"))
    around = near.groupBy("mol", "pos").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("near", "n"))), "-").alias("around")
    )
    of_atoms = symbol.join(around, ["mol", "pos"], "left").select(
        F.lit("atom").alias("kind"), F.concat_ws("_", "symbol", F.coalesce("around", F.lit(""))).alias("token")
    )
    ends = bonds.join(symbol.toDF("mol", "src", "s1"), ["mol", "src"]).join(symbol.toDF("mol", "dst", "s2"), ["mol", "dst"])
    of_bonds = ends.select(
        F.lit("bond").alias("kind"), F.concat_ws("_", F.least("s1", "s2"), "kind", F.greatest("s1", "s2")).alias("token")
    )
    return of_atoms.unionByName(of_bonds)


def node_context_vocab(
    atoms: DataFrame, bonds: DataFrame, specials: Sequence[str] = SPECIALS, min_count: int = 1,
    max_size: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Vocabulary of atom contexts and of bond contexts."""
    counts = node_contexts(atoms, bonds).groupBy("kind", "token").agg(F.count(F.lit(1)).alias("n"))
    return tuple(
        number_tokens(counts.filter(F.col("kind") == kind).select("token", "n"), specials, min_count, max_size)
        for kind in ("atom", "bond")
    )


def encode(df: DataFrame, id: str, tokens: Column, vocab: DataFrame, head: int = HEAD) -> DataFrame:
    """Rows ``(id, input_ids)``; tokens outside the vocabulary become ``<unk>``, null tokens too.

    Ids follow falling frequency, so the hottest tokens are those below ``head``.
    They are at most ``head``, each of at most HEAD_BYTES / ``head`` bytes, and go
    to every task, where each distinct token of an Arrow batch is looked up once:
    rows stay where they are. Only if the vocabulary is larger do the other
    tokens of a row, each once, meet the rest of it, and only rows that have some
    are joined with what was found. ``vocab`` should be a written table.
    """
    spark = df.sparkSession
    near = (F.col("token_id") < head) & (F.octet_length("token") <= HEAD_BYTES // max(1, head))
    known = spark.sparkContext.broadcast(vocab.filter(near).select("token", "token_id").toArrow())
    rest = vocab.filter(~near).select("token", F.col("token_id").alias("code"))
    larger = not rest.isEmpty()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = dict(zip(known.value["token"].to_pylist(), known.value["token_id"].to_pylist()))
        for batch in batches:
            yield _coded(batch, ids, larger)

    rows = df.select(F.col(id).alias("id"), tokens.alias("tokens"))
    ids = T.ArrayType(T.LongType())
    schema = T.StructType([rows.schema["id"], T.StructField("input_ids", ids), T.StructField("others", T.ArrayType(T.StringType()))])
    found = rows.mapInArrow(coded, schema)
    if not larger:
        return found.select(F.col("id").alias(id), "input_ids")
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    open_rows = found.filter(F.size("others") > 0)
    asked = open_rows.select("row", F.posexplode("others").alias("k", "token")).join(rest, "token", "left")
    code = F.coalesce("code", F.lit(UNK_ID).cast("bigint")).alias("code")
    # Each group is the distinct rare tokens of one row.
    codes = asked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", code))).alias("codes"))
    told = F.transform("input_ids", lambda v: F.when(v < 0, F.get("codes.code", (-v - 1).cast("int"))).otherwise(v))
    filled = open_rows.join(codes, "row").select("id", told.alias("input_ids"))
    whole = found.filter(F.size("others") == 0).select("id", "input_ids").unionByName(filled)
    return whole.select(F.col("id").alias(id), "input_ids")


def _coded(batch: pa.RecordBatch, ids: dict[str, int], larger: bool) -> pa.RecordBatch:
    """Ids of the tokens of each row, and its distinct tokens that ``ids`` lacks; the k-th of them stands as -1 - k."""
    lists = batch.column(1)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    words = lists.flatten().dictionary_encode()
    names = words.dictionary.to_pylist()
    absent = -1 if larger else UNK_ID
    codes = np.array([*(ids.get(t, absent) for t in names), UNK_ID], np.int64)
    places = words.indices.fill_null(len(names)).to_numpy()
    found = codes[places]
    others, counts = pa.array([], pa.string()), np.zeros(len(lengths), np.int64)
    far = np.flatnonzero(found == -1)
    if len(far):
        row = np.repeat(np.arange(len(lengths)), lengths)[far]
        pairs, at = np.unique(row * len(names) + places[far], return_inverse=True)
        counts = np.bincount(pairs // len(names), minlength=len(lengths))
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        found[far] = -1 - (at - first[row])
        others = words.dictionary.take(pa.array(pairs % len(names)))

    def listed(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)

    return pa.RecordBatch.from_arrays([batch.column(0), listed(pa.array(found), lengths), listed(others, counts)], ["id", "input_ids", "others"])
