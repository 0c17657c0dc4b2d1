"""Sequence tokens and what is computed from them inside one row: no shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from molframe.functions.arrays import let
from molframe.functions.hashing import UINT32, seeded
from molframe.functions.md5 import bytes_of, md5_words

# Published token patterns.
# SMILES tokens after Schwaller et al. 2018; prose splits on blanks and line ends.
PATTERNS = {
    "smiles": (
        r"(\[[^\]]+\]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>|\*|\$"
        r"|%[0-9]{2}|[0-9])"
    ),
    "words": r"[^ \n]+",
}

# What counts as which kind of token.
# Word classes partition prose tokens; SMILES classes partition SMILES tokens.
WORD_CLASSES = {
    "n_numeric": r"^[0-9]+$",
    "n_capital": r"^[A-Z]",
    "n_lower": r"^[a-z]",
    "n_sentence_end": r"[.]$",
}
SMILES_CLASSES = {
    "n_bracket": r"^\[",
    "n_aliphatic": r"^(Br|Cl|B|C|N|O|S|P|F|I)$",
    "n_aromatic": r"^[bcnops]$",
    "n_bond": r"^[=#:~/\\-]$",
    "n_branch": r"^\($",
    "n_ring_token": r"^(%[0-9]{2}|[0-9])$",
    "n_dot": r"^[.]$",
}


def tokenize(sequence: Column, kind: str = "words") -> Column:
    """All tokens of the whole sequence, in order."""
    return F.regexp_extract_all(sequence, F.lit(PATTERNS[kind]), F.lit(0))


#: Rows whose tokens are hashed together, and the most cells of a table of their bits.
ROWS, CELLS = 256, 1 << 24


def _counts(lists: pa.Array) -> np.ndarray:
    """Entries of each list; null has none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(counts: np.ndarray, values: pa.Array, like: pa.Array) -> pa.ListArray:
    """Lists of so many values, null where ``like`` is."""
    ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, values, mask=like.is_null())


def _in_parts(rows: int, work: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``work`` on so many rows at a time."""
    starts = range(0, max(len(columns[0]), 1), rows)
    return pa.concat_arrays([work(*[c.slice(at, rows) for c in columns]) for at in starts])


def hash_each(tokens: Column, modulus: int, shift: int = 0) -> Column:
    """``hash32`` of each token modulo ``modulus``, plus ``shift``; each distinct token of some rows once."""

    def part(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        data, bounds = bytes_of(coded.dictionary)
        hashes = md5_words(data, bounds[:-1], bounds[1:])[0].astype(np.int64) % modulus + shift
        return _lists(_counts(lists), pa.array(hashes, pa.int64()).take(coded.indices), lists)

    def hashed(lists: pa.Array) -> pa.Array:
        return _in_parts(ROWS, part, lists)

    hashed.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(hashed, "array<bigint>")(tokens)


def hashed_fp(tokens: Column, size: int = 1024, radius: int = 2) -> Column:
    """Set bits of a folded neighbourhood fingerprint, ascending.

    The identifier of radius r at a position is the md5 of the radius and the
    tokens at most r places away, cut at the ends of the sequence.
    """

    def part(lists: pa.Array) -> pa.Array:
        counts = _counts(lists)
        # With a blank after each token, the tokens of a neighbourhood lie in one piece. Null tokens have no bytes.
        data, bounds = bytes_of(pc.binary_join_element_wise(lists.flatten(), "", " "))
        ends = np.repeat(np.cumsum(counts), counts)
        firsts = ends - np.repeat(counts, counts)
        row, at = np.repeat(np.arange(len(counts)), counts), np.arange(len(ends))
        seen = np.zeros(len(counts) * size, bool)
        for r in range(radius + 1):
            start = bounds[np.maximum(firsts, at - r)]
            end = np.maximum(start, bounds[np.minimum(ends, at + r + 1)] - 1)
            seen[row * size + md5_words(data, start, end, f"{r}:".encode())[0] % size] = True
        bits = np.flatnonzero(seen)
        return _lists(np.bincount(bits // size, minlength=len(counts)), pa.array(bits % size, pa.int64()), lists)

    def bits(lists: pa.Array) -> pa.Array:
        return _in_parts(max(1, min(ROWS, CELLS // size)), part, lists)

    bits.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(bits, "array<bigint>")(tokens)


def matching(tokens: Column, pattern: str) -> Column:
    """How many tokens match."""
    return F.size(F.filter(tokens, lambda t: F.regexp_like(t, F.lit(pattern)))).cast("bigint")


def descriptors(tokens: Column, kind: str = "words") -> Column:
    """Composition of one sequence as a struct: token counts per class and entropy in nats."""
    classes = WORD_CLASSES if kind == "words" else SMILES_CLASSES

    def describe(toks):
        total = F.size(toks).cast("bigint")
        counted = [matching(toks, p).alias(name) for name, p in classes.items()]
        rings = []
        if kind == "smiles":
            ring_tokens = matching(toks, SMILES_CLASSES["n_ring_token"])
            rings = [F.floor(ring_tokens / 2).cast("bigint").alias("n_ring")]
        return F.struct(
            total.alias("n_tokens"),
            F.size(F.array_distinct(toks)).cast("bigint").alias("n_distinct"),
            *counted,
            *rings,
            _entropy(toks).alias("entropy"),
        )

    return let(tokens, describe)


def _entropy(toks: Column) -> Column:
    """Shannon entropy of the token frequencies: run lengths of the sorted tokens."""

    def close(run):
        return F.when(run > 0, run * F.log(run)).otherwise(F.lit(0.0))

    start = F.struct(
        F.lit(None).cast("string").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total")
    )

    def step(state, token):
        same = state["last"].eqNullSafe(token)
        return F.struct(
            token.alias("last"),
            F.when(same, state["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
            F.when(same, state["total"]).otherwise(state["total"] + close(state["run"])).alias("total"),
        )

    def finish(state):
        n = F.size(toks)
        return F.when(n > 0, F.log(n) - (state["total"] + close(state["run"])) / n).otherwise(F.lit(0.0))

    return F.aggregate(F.array_sort(toks), start, step, finish)


# Special tokens and their ids, and the label of unmasked positions.
SPECIALS = ("<pad>", "<unk>", "<s>", "</s>", "<mask>")
PAD_ID = 0
UNK_ID = 1
MASK_ID = 4
IGNORED = -100


def mask_tokens(
    ids: Column, row_id: Column, vocab_size: Column | int, rate: float = 0.15, seed: int = 0
) -> Column:
    """Masked-token example (Devlin et al. 2019) as struct(input_ids, labels).

    A position is chosen with probability ``rate``; a chosen one becomes the
    mask token (80 %), a random ordinary token (10 %) or stays (10 %). Choices
    hash (seed, row, position), so they never depend on partitioning.
    """
    specials = len(SPECIALS)
    size = F.lit(vocab_size) if isinstance(vocab_size, int) else vocab_size

    def part(ids: pa.Array, keys: pa.Array, sizes: pa.Array) -> pa.Array:
        counts, token = _counts(ids), ids.flatten().cast(pa.int64())
        row = np.repeat(np.arange(len(counts)), counts)
        places = pa.array(np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)).cast(pa.string())
        data, bounds = bytes_of(pc.binary_join_element_wise(keys.take(pa.array(row)), places, "|"))
        chosen, fate, word, _ = md5_words(data, bounds[:-1], bounds[1:])
        ordinary = pc.fill_null(sizes, specials + 1).to_numpy(zero_copy_only=False).astype(np.int64)[row] - specials
        unknown = sizes.is_null().to_numpy(zero_copy_only=False)[row]
        other = pa.array(word.astype(np.int64) % ordinary + specials, mask=unknown)
        is_chosen = pa.array(chosen / UINT32 < rate)
        kept = pc.if_else(pa.array(fate / UINT32 < 0.9), other, token)
        replaced = pc.if_else(pa.array(fate / UINT32 < 0.8), pa.scalar(MASK_ID, pa.int64()), kept)
        inputs = pc.if_else(is_chosen, replaced, token)
        labels = pc.if_else(is_chosen, token, pa.scalar(IGNORED, pa.int64()))
        return pa.StructArray.from_arrays([_lists(counts, inputs, ids), _lists(counts, labels, ids)], ["input_ids", "labels"])

    def masked(ids: pa.Array, keys: pa.Array, sizes: pa.Array) -> pa.Array:
        return _in_parts(ROWS, part, ids, keys, sizes)

    masked.__annotations__ = {"ids": pa.Array, "keys": pa.Array, "sizes": pa.Array, "return": pa.Array}
    kind = "struct<input_ids:array<bigint>,labels:array<bigint>>"
    return F.arrow_udf(masked, kind)(ids, seeded(seed, row_id), size)
