"""SentencePiece encoding and decoding over the lattice of pieces.

A text is cut into units that no piece crosses: a run of blanks with the word
after it. Units frequent in a sample of the rows, a bounded number, are counted
and worked out once by Spark and handed to all tasks; a task works the others of its rows out, the
distinct ones of some hundred rows together. The edges of a unit's lattice are found
by reading the pieces backwards from every place, all places of all units of a
batch together, and the path of the highest total score is folded place by
place (Viterbi). A character that is no piece becomes its UTF-8 bytes. Of paths
with equal scores the one whose last piece is longest wins, at every place.

Rows are not moved. A task holds a batch of rows, the common units and a bounded
number of others. The piece table is a fixed file of bounded size.

Rows: null and empty texts have no ids. Each input row gives one output row,
repeated ids too. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.llm.registry import column
from molframe.plans.lineage import cut

BLANK = "▁"
#: The same in Java and Python. A unit is a line end, or blanks and what follows them.
UNIT = f"\\n|{BLANK}*[^{BLANK}\\n]+|{BLANK}+"
#: Pieces a table may have to be broadcast.
MOST_PIECES = 1 << 20
#: Places whose edges are made together; characters of units worked out together.
FOLD, CHARACTERS = 512, 1 << 18
UNKNOWN_PENALTY = 10.0
#: Units worked out once: from one row in ``SAMPLED``, at most so many in each of so many buckets, of so many characters.
SAMPLED, BUCKETS, IN_BUCKET, COMMON_LENGTH = 8, 512, 1024, 64
#: Rows a task spells at once, and units it remembers beside the common ones.
AT_ONCE, REMEMBERED = 256, 100_000
#: Names from here on are code points of characters that are no piece.
UNKNOWN = 1 << 22


@dataclass(frozen=True)
class Pieces:
    """A piece table: text and score by id; ids that are ordinary pieces; the id of byte 0."""

    texts: tuple[str, ...]
    scores: tuple[float, ...]
    ordinary: tuple[int, ...]
    first_byte: int

    @property
    def longest(self) -> int:
        return max((len(self.texts[i]) for i in self.ordinary), default=1)

    @property
    def unknown_score(self) -> float:
        return min((self.scores[i] for i in self.ordinary), default=0.0) - UNKNOWN_PENALTY


def read_pieces(path: str) -> Pieces:
    """The table of a SentencePiece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if len(ids) > MOST_PIECES:
        raise ValueError(f"{len(ids)} pieces are too many to broadcast")
    texts = tuple(model.id_to_piece(i) for i in ids)
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
    ordinary = tuple(i for i in ids if not special[i])
    if "<0x00>" not in texts:
        raise ValueError("the model has no byte pieces")
    crossing = [t for t in (texts[i] for i in ordinary) if re.fullmatch(UNIT, t) is None]
    if crossing:
        raise ValueError(f"pieces cross units: {crossing[:5]}")
    return Pieces(texts, tuple(model.get_score(i) for i in ids), ordinary, texts.index("<0x00>"))


def normalized(text: Column) -> Column:
    """Blanks marked and one put before; empty stays empty."""
    marked = F.concat(F.lit(BLANK), F.replace(text, F.lit(" "), F.lit(BLANK)))
    return F.when(F.length(text) > 0, marked).otherwise(F.lit(""))


def units_of(text: Column) -> Column:
    return F.regexp_extract_all(normalized(F.coalesce(text, F.lit(""))), F.lit(UNIT), F.lit(0))


@dataclass(frozen=True)
class Trie:
    """Ordinary pieces read from their last character on.

    ``steps`` holds, sorted, a node above ``CHARACTER_BITS`` bits of the character that leads on from it; the node
    reached is the place of the step and one. ``names`` and ``scores`` are those of the piece read there, or -1.
    """

    steps: np.ndarray
    names: np.ndarray
    scores: np.ndarray
    longest: int
    unknown_score: float
    first_byte: int


CHARACTER_BITS = 21


def trie_of(pieces: Pieces) -> Trie:
    # Of pieces with one text the best stays, of equal scores the last.
    ids = {pieces.texts[i][::-1]: i for i in sorted(pieces.ordinary, key=lambda i: (pieces.scores[i], i))}
    # By length, then by character: the steps of the nodes numbered so are sorted.
    read = sorted({text[:n] for text in ids for n in range(1, len(text) + 1)}, key=lambda t: (len(t), t))
    number = {"": 0} | {text: i for i, text in enumerate(read, 1)}
    return Trie(
        np.array([number[t[:-1]] << CHARACTER_BITS | ord(t[-1]) for t in read], np.int64),
        np.array([ids.get(t, -1) for t in read], np.int32),
        np.array([pieces.scores[ids[t]] if t in ids else 0.0 for t in read]),
        pieces.longest,
        pieces.unknown_score,
        pieces.first_byte,
    )


def _edges(trie: Trie, codes: np.ndarray, ends: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces that end before ``ends`` in ``codes``, and a character that is none: place in ``ends``, length, name, score.

    ``within`` characters before an end belong to its unit.
    """
    found = []
    at, node = np.arange(len(ends)), np.zeros(len(ends), np.int64)
    for n in range(1, trie.longest + 1):
        inside = within[at] >= n
        at, node = at[inside], node[inside]
        if not len(at):
            break
        code = codes[ends[at] - n]
        wanted = node << CHARACTER_BITS | code
        step = np.searchsorted(trie.steps, wanted)
        step[step == len(trie.steps)] = 0
        hit = trie.steps[step] == wanted if len(trie.steps) else np.zeros(len(at), bool)
        name = np.full(len(at), -1, np.int32)
        name[hit] = trie.names[step[hit]]
        is_piece = name >= 0
        found.append((at[is_piece], n, name[is_piece], trie.scores[step[is_piece]]))
        if n == 1:
            other = ~is_piece
            found.append((at[other], 1, (code[other] + UNKNOWN).astype(np.int32), np.full(int(other.sum()), trie.unknown_score)))
        at, node = at[hit], step[hit] + 1
    lengths = np.concatenate([np.full(len(places), n) for places, n, _, _ in found])
    return np.concatenate([f[0] for f in found]), lengths, np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])


def best_paths(units: list[str], trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each unit, and all their ids: Viterbi, one place of all units at a time.

    Of equal totals the longest edge is chosen. Edges of ``FOLD`` places are made together.
    """
    codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    # A unit has one place more than characters.
    first = np.cumsum(sizes + 1) - (sizes + 1)
    total, length, name = np.zeros(len(codes) + len(units)), np.zeros(len(codes) + len(units), np.int32), np.zeros(len(codes) + len(units), np.int32)
    for done in range(0, int(sizes.max(initial=0)), FOLD):
        going = np.flatnonzero(sizes > done)
        counts = np.minimum(sizes[going] - done, FOLD)
        unit = np.repeat(going, counts)
        within = done + 1 + np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
        at, n, called, score = _edges(trie, codes, first[unit] - unit + within, within)
        order = np.argsort(((within[at] - done) * len(units) + unit[at]) * (trie.longest + 1) + n)
        at, n, called, score = at[order], n[order], called[order], score[order]
        end = first[unit[at]] + within[at]
        start = end - n
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        runs = np.diff(heads, append=len(end))
        # Where the edges of each place begin, and their runs of one unit.
        edges_at = np.searchsorted(within[at], np.arange(done + 1, done + FOLD + 2))
        heads_at = np.searchsorted(heads, edges_at)
        chosen = np.zeros(len(end), bool)
        for a, b, c, d in zip(edges_at[:-1].tolist(), edges_at[1:].tolist(), heads_at[:-1].tolist(), heads_at[1:].tolist()):
            if a == b:
                break
            reached = total[start[a:b]] + score[a:b]
            best = np.maximum.reduceat(reached, heads[c:d] - a)
            total[end[heads[c:d]]] = best
            chosen[a:b] = reached == np.repeat(best, runs[c:d])
        # The longest edge of a place comes last and stays.
        length[end[chosen]], name[end[chosen]] = n[chosen], called[chosen]
    steps = []
    unit = np.flatnonzero(sizes)
    place = (first + sizes)[unit]
    while len(unit):
        steps.append((unit, name[place]))
        place = place - length[place]
        going = place > first[unit]
        unit, place = unit[going], place[going]
    counts = np.bincount(np.concatenate([u for u, _ in steps]), minlength=len(units)) if steps else np.zeros(len(units), np.int64)
    ends = np.cumsum(counts)
    names = np.zeros(int(counts.sum()), np.int32)
    for back, (unit, called) in enumerate(steps):
        names[ends[unit] - 1 - back] = called
    return _spelled(counts, names, trie.first_byte)


def _spelled(counts: np.ndarray, names: np.ndarray, first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and ids of names: an unknown character becomes the pieces of its UTF-8 bytes."""
    unknown = names >= UNKNOWN
    if not unknown.any():
        return counts, names
    characters, which = np.unique(names[unknown], return_inverse=True)
    spelled = [np.frombuffer(chr(c - UNKNOWN).encode(), np.uint8).astype(np.int32) + first_byte for c in characters.tolist()]
    widths = np.ones(len(names), np.int64)
    widths[unknown] = np.array([len(b) for b in spelled])[which]
    starts = np.cumsum(widths) - widths
    ids = np.repeat(names, widths)
    for k in range(4):
        byte = np.array([b[k] if k < len(b) else 0 for b in spelled], np.int32)
        has = widths[unknown] > k
        ids[starts[unknown][has] + k] = byte[which][has]
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(owner, weights=widths, minlength=len(counts)).astype(np.int64), ids


def _parts(units: list[str]) -> Iterator[list[str]]:
    """Units of about ``CHARACTERS`` characters together."""
    part, held = [], 0
    for unit in units:
        part.append(unit)
        held += len(unit)
        if held >= CHARACTERS:
            yield part
            part, held = [], 0
    if part:
        yield part


def _paths_of(units: list[str], trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    found = [best_paths(part, trie) for part in _parts(units)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate([c for c, _ in found]), np.concatenate([i for _, i in found])


def _lists(counts: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids, pa.int32()))


def encode_units(units: DataFrame, keys: list[str], pieces: Pieces) -> DataFrame:
    """``ids`` of each row of ``units``, whose last key is ``unit``; a batch's edges are held at once."""
    # Bounded by MOST_PIECES.
    trie = units.sparkSession.sparkContext.broadcast(trie_of(pieces))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _lists(*_paths_of(batch.column("unit").to_pylist(), trie.value))
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), ids], [*keys, "ids"])

    kinds = "".join(f"{c} {units.schema[c].dataType.simpleString()}, " for c in keys)
    return units.select(*keys).mapInArrow(encoded, kinds + "ids array<int>")


def common_units(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """``unit, ids``, written, of units frequent in every ``SAMPLED``-th row, to be worked out once and not in every block.

    Which units these are changes only the work done, not the ids. At most
    ``BUCKETS * IN_BUCKET`` units of at most ``COMMON_LENGTH`` characters, so they can be held anywhere.
    """
    some = rows.filter(F.pmod("at", F.lit(SAMPLED)) == 0)
    units = some.select(F.explode(units_of(F.col("text"))).alias("unit")).filter(F.length("unit") <= COMMON_LENGTH)
    bucket = F.pmod(F.xxhash64("unit"), F.lit(BUCKETS)).alias("bucket")
    counts = units.groupBy(bucket, "unit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = Window.partitionBy("bucket").orderBy(F.desc("n"), "unit")
    hot = counts.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= IN_BUCKET)
    return cut(encode_units(hot.select("bucket", "unit"), ["bucket", "unit"], pieces).select("unit", "ids"))


def _units_in(text: str | None, pattern: re.Pattern) -> list[str]:
    return pattern.findall(BLANK + text.replace(" ", BLANK)) if text else []


def _bytes_by_unit(units: list[str], counts: np.ndarray, ids: np.ndarray) -> dict[str, bytes]:
    raw, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
    return {unit: raw[a:b] for unit, a, b in zip(units, [0, *ends], ends)}


#: The common units of the call this worker process serves, with their ids.
_COMMON: dict[str, dict[str, bytes]] = {}


def _common_of(call: str, common: Broadcast) -> dict[str, bytes]:
    if call not in _COMMON:
        _COMMON.clear()
        ids = common.value["ids"]
        counts = pc.list_value_length(ids).to_numpy()
        _COMMON[call] = _bytes_by_unit(common.value["unit"].to_pylist(), counts, pc.list_flatten(ids).to_numpy())
    return _COMMON[call]


def _speller(call: str, common: Broadcast, trie: Broadcast):
    pattern = re.compile(UNIT)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rare = _common_of(call, common), {}
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                split = [_units_in(text, pattern) for text in part.column("text").to_pylist()]
                new = list(set().union(*split).difference(known, rare))
                if len(rare) + len(new) > REMEMBERED:
                    new += [unit for unit in set().union(*split).intersection(rare)]
                    rare = {}
                rare |= _bytes_by_unit(new, *_paths_of(new, trie.value))
                made = [b"".join([known.get(u) or rare[u] for u in units]) for units in split]
                counts = np.fromiter(map(len, made), np.int64, len(made)) // 4
                ids = _lists(counts, np.frombuffer(b"".join(made), "<i4"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return spell


def encode(df: DataFrame, id: str, text: str, pieces: Pieces, blocks: int | None = None) -> DataFrame:
    """``doc_id, ids`` of each row; with ``blocks``, rows are dealt to so many partitions first."""
    context = df.sparkSession.sparkContext
    rows = df.select(column(id).alias("doc_id"), column(text).alias("text"), F.monotonically_increasing_id().alias("at"))
    # Bounded by BUCKETS * IN_BUCKET; sent to the executors once, as Arrow.
    common = context.broadcast(common_units(rows, pieces).toArrow())
    if blocks:
        rows = rows.repartition(blocks, "at")
    kind = rows.schema["doc_id"].dataType.simpleString()
    spell = _speller(uuid.uuid4().hex, common, context.broadcast(trie_of(pieces)))
    return rows.select("doc_id", "text").mapInArrow(spell, f"doc_id {kind}, ids array<int>")


def decode(ids: Column, pieces: Pieces) -> Column:
    """The text of ids: pieces and bytes joined, blanks unmarked, the one put before removed."""
    spelled = []
    for i, text in enumerate(pieces.texts):
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", text) if i >= pieces.first_byte and i < pieces.first_byte + 256 else None
        ordinary = byte.group(1) if byte else text.encode().hex().upper()
        spelled.append(ordinary)
    table = F.from_json(F.lit("[" + ",".join(f'"{s}"' for s in spelled) + "]"), "array<string>")
    joined = F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
    text = F.replace(F.decode(F.unhex(joined), "UTF-8"), F.lit(BLANK), F.lit(" "))
    return F.when(F.size(ids) > 0, F.substring(text, 2, 2147483647)).otherwise(F.lit(""))
