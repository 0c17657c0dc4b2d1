"""Repair of conversation structure at least cost.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles: at most
one system message first, then user and assistant in turn, the assistant last.
Edits, by initial: Keep a row, give it the Role of user or assistant, Delete it,
Insert an empty message anywhere. Of the cheapest edit sequences the one whose
initials are least in ASCII order is taken.

1. Rows get their place in the conversation by the ordered scan, which cuts a
   conversation of any length into slices, and their fault: blank, else
   duplicate (an earlier row of the conversation has this role and text), else
   truncated. What matters of a row is then one character.
2. Blocks of BLOCK rows are solved apart, for every state the pattern may be in
   before and after. A path is one integer: its cost in the high digits, below
   them its edit letters as octal digits of fixed width, first letter highest,
   zeros at the end. Putting an edit first adds its cost and letter and moves
   the rest one digit down, so ordinary integer minima over the states, from
   the last row to the first, decide cost and ties at once.
3. A second integer minimum joins the blocks of a conversation: cost, and below
   it the rank of a block's letters among its four paths from one state. Every
   block path ends in a row's letter, so none is the beginning of another and
   ranks decide ties. What this gathers of a conversation is 17 numbers a block.
4. Each block is told its two states and gives its letters. Rows meet their
   edits by (conversation, place), a join without hot keys.

SHA-256 takes its input in order, so a conversation's repaired rows stream through
one task, sorted on disk and never held; its audit is one string by contract.

Rows: null roles and texts count as one space, and a role that begins with none
of s, u, a must go or change. Turns are sorted with nulls first; rows of one turn
by role, then by the SHA-256 of the text, so that repeated rows are neighbours. A
null conversation id is an id. Empty and very long texts are texts like others.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.registry import column
from molframe.plans.lineage import cut
from molframe.plans.ordered import Running, running, slice_by_range

#: Rows solved together.
BLOCK = 256
BLANKS = " \t\n\x0b\x0c\r"
NO_SHA = hashlib.sha256(b"").hexdigest()

#: Edits as octal digits, in ASCII order; zero ends a path.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
BITS = 3
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

#: States: nothing yet, after system, after user, after assistant. What a row of that role leads to.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that a new message has in each state, and the inserts that end a conversation there.
NEXT = "uuau"
ENDING = ("", "II", "I", "")

#: Characters of rows: role s, u, a or another; sound, truncated, to be deleted.
SOUND, CUT_SHORT, DOOMED = "suax", "SUAX", "1234"


def _options(code: str) -> list[list[tuple[int, str, int]]]:
    """By state before the row: (cost, letters, state after) of every way to treat it, inserts first."""
    doomed, short = code in DOOMED, code in CUT_SHORT
    role = SOUND[(SOUND + CUT_SHORT + DOOMED).index(code) % 4]
    found = []
    for state in range(4):
        ways = []
        for inserts in range(3):
            here = state
            for _ in range(inserts):
                here = STEPS[here][NEXT[here]]
            if inserts == 2 and here == state:
                continue  # a circle
            paid, letters = INSERT * inserts, "I" * inserts
            ways.append((paid + DELETE, letters + "D", here))
            if not doomed:
                if role in STEPS[here]:
                    ways.append((paid + short * TRUNCATED, letters + "K", STEPS[here][role]))
                ways.append((paid + short * TRUNCATED + REROLE, letters + "R", STEPS[here][NEXT[here]]))
        found.append(ways)
    return found


OPTIONS = {
    code: [[(cost, sum(DIGIT[c] << BITS * (2 - i) for i, c in enumerate(letters)), len(letters), after) for cost, letters, after in ways] for ways in _options(code)]
    for code in SOUND + CUT_SHORT + DOOMED
}


@lru_cache(maxsize=4096)
def solve(codes: str) -> tuple[tuple[int | None, ...], ...]:
    """``[before][after]``: the least path of a block as one integer, or None where there is no way."""
    width = BITS * 3 * len(codes)
    mask = (1 << width) - 1
    by_end = []
    for end in range(4):
        values = [0 if state == end else None for state in range(4)]
        for code in reversed(codes):
            new = []
            for ways in OPTIONS[code]:
                least = None
                for cost, letters, length, after in ways:
                    rest = values[after]
                    if rest is not None:
                        path = (((rest >> width) + cost) << width) | (letters << (width - 3 * BITS)) | ((rest & mask) >> BITS * length)
                        least = path if least is None or path < least else least
                new.append(least)
            values = new
        by_end.append(values)
    return tuple(zip(*by_end))


def block_table(codes: str) -> list[int]:
    """Cost and rank of the letters, ``4 * cost + rank``, by states before and after; -1 where there is no way."""
    width = BITS * 3 * len(codes)
    out = []
    for paths in solve(codes):
        ranked = sorted(p & ((1 << width) - 1) for p in paths if p is not None)
        out += [-1 if p is None else 4 * (p >> width) + ranked.index(p & ((1 << width) - 1)) for p in paths]
    return out


def block_edits(codes: str, before: int, after: int) -> list[str]:
    """For each row its edits: pairs of a letter and the role given, or ``.`` where none is."""
    width = BITS * 3 * len(codes)
    path = solve(codes)[before][after]
    state, edits, row = before, [], ""
    for at in range(width - BITS, -1, -BITS):
        digit = (path >> at) & ((1 << BITS) - 1)
        if not digit:
            break
        letter = "DIKR"[digit - 1]
        if letter in "IR":
            row += letter + NEXT[state]
            state = STEPS[state][NEXT[state]]
        else:
            row += letter + "."
            if letter == "K":
                state = STEPS[state][codes[len(edits)].lower()]
        if letter != "I":
            edits.append(row)
            row = ""
    return edits


def states_between(tables: list[list[int]]) -> tuple[int, list[int]]:
    """Least cost of the blocks one after another, and the states before each of them and at the end."""
    costs, steps = [2 * len(e) for e in ENDING], []
    for table in reversed(tables):
        new, step = [], []
        for before in range(4):
            # Cost, rank of the letters, state after: one integer of which only the cost goes on.
            ways = [(table[4 * before + after] + 4 * costs[after]) * 4 + after for after in range(4) if table[4 * before + after] >= 0]
            least = min(ways)
            new.append(least >> 4)
            step.append(least & 3)
        costs = new
        steps.append(step)
    path = [0]
    for step in reversed(steps):
        path.append(step[path[-1]])
    return costs[0], path


def _pairs_illegal(codes: str) -> int:
    roles = [SOUND[(SOUND + CUT_SHORT + DOOMED).index(c) % 4] for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def _block(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"table": [block_table(c) for c in codes], "illegal": [_pairs_illegal(c) for c in codes]})


def _joined(tables: pd.Series, ends: pd.Series) -> pd.DataFrame:
    solved = [states_between([list(map(int, t)) for t in each]) for each in tables]
    between = [sum(_pairs_illegal(a[1] + b[0]) for a, b in zip(e, e[1:])) for e in ends]
    return pd.DataFrame({"cost": [c for c, _ in solved], "path": [p for _, p in solved], "illegal": between})


def _edits(codes: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([block_edits(*x) for x in zip(codes, before, after)])


def key_of(conv: Column) -> Column:
    """A conversation id as text; null is one space, which no other id gives."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(" "))


def damaged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows broken by the crc32 of ``conv:turn`` modulo 20, nulls as one space.

    0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and
    question marks out, 3 repeats it, 4 makes it the user's.
    """
    name = F.concat(F.coalesce(column(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(column(turn).cast("string"), F.lit(" ")))
    body, who = F.coalesce(column(text), F.lit(" ")), F.coalesce(column(role), F.lit(" "))
    how = F.col("_how")
    broken = df.select(column(conv).alias("conv"), column(turn).alias("turn"), who.alias("role"), body.alias("text"), (F.crc32(name) % 20).alias("_how"))
    return broken.select(
        F.col("conv").alias(conv),
        F.col("turn").alias(turn),
        F.when(how == 4, "user").otherwise(F.col("role")).alias(role),
        F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias(text),
        F.explode(F.sequence(F.lit(1), F.when(how == 3, 2).otherwise(1))).alias("_copy"),
        how.alias("_how"),
    ).filter("_how <> 0").drop("_how", "_copy")


class Repair:
    """The repair of the conversations of one table. ``block`` is the number of rows solved together."""

    def __init__(self, df: DataFrame, conv: str, turn: str, role: str, text: str, block: int = BLOCK):
        self.conv, self.conv_type = conv, df.schema[conv].dataType
        self.rows = self._marked(df, conv, turn, role, text, block)
        self.blocks = self._solved()
        self.edits = self._edited()

    def _marked(self, df, conv, turn, role, text, block) -> DataFrame:
        """``k, turn, role, text, at, block, fault, code`` of every row, written."""
        rows = df.select(
            key_of(column(conv)).alias("k"),
            column(turn).alias("turn"),
            F.coalesce(column(role), F.lit(" ")).alias("role"),
            F.coalesce(column(text), F.lit(" ")).alias("text"),
        )
        # The written table fixes the numbers that tell repeated rows apart.
        rows = cut(rows.withColumns({"sha": F.unhex(F.sha2("text", 256)), "row": F.monotonically_increasing_id()}))
        slim = rows.select("k", "turn", "role", "sha", "row")
        placed = running(slice_by_range(slim, ["turn", "role", "sha", "row"], ["k"]), at=Running("count"))
        placed = cut(placed.select("k", "role", "sha", "row", (F.col("at") - 1).alias("at")))
        first = placed.groupBy("k", "role", "sha").agg(F.min("at").alias("first"))
        repeats = placed.join(first, ["k", "role", "sha"]).select("row", "at", (F.col("at") > F.col("first")).alias("again"))
        bare = F.rtrim("text", F.lit(BLANKS))
        fault = (
            F.when(bare == "", "blank").when(F.col("again"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
        )
        roles = F.when(F.substring("role", 1, 1).isin(*"sua"), F.substring("role", 1, 1)).otherwise("x")
        marks = F.when(F.col("fault").isNull(), SOUND).when(F.col("fault") == "truncated", CUT_SHORT).otherwise(DOOMED)
        marked = rows.join(repeats, "row").withColumn("fault", fault)
        code = F.substr(marks, F.instr(F.lit(SOUND), roles), F.lit(1))
        return cut(marked.select("k", "turn", "role", "text", "at", F.expr(f"at div {block}").alias("block"), "fault", code.alias("code")))

    def _solved(self) -> DataFrame:
        """``k, block, codes, before, after, last`` of every block, and what belongs to its conversation."""
        in_order = F.array_sort(F.collect_list(F.struct("at", "code")))
        blocks = self.rows.groupBy("k", "block").agg(F.array_join(F.transform(in_order, lambda r: r["code"]), "").alias("codes"), F.min("at").alias("first"))
        solved = F.pandas_udf(_block, "table array<bigint>, illegal bigint")
        blocks = cut(blocks.withColumn("solved", solved("codes")))
        ends = F.concat(F.left("codes", F.lit(1)), F.right("codes", F.lit(1)))
        gathered = blocks.groupBy("k").agg(
            F.array_sort(F.collect_list(F.struct("block", F.col("solved.table").alias("table"), ends.alias("ends")))).alias("all"),
            F.sum("solved.illegal").alias("inside"),
        )
        joined = F.pandas_udf(_joined, "cost bigint, path array<int>, illegal bigint")(F.col("all.table"), F.col("all.ends"))
        illegal = (F.col("inside") + F.col("joined.illegal")).alias("illegal")
        self.joined = cut(gathered.withColumn("joined", joined).select("k", "joined.cost", "joined.path", illegal))
        states = self.joined.select("k", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("block", "before"), "path")
        after = F.element_at("path", F.col("block") + 2)
        told = states.select("k", F.col("block").cast("bigint").alias("block"), "before", after.alias("after"))
        return blocks.select("k", "block", "first", "codes").join(told, ["k", "block"])

    def _edited(self) -> DataFrame:
        """``k, block, first, edits`` with the edits of each row of the block."""
        edits = F.pandas_udf(_edits, "array<string>")("codes", "before", "after")
        return cut(self.blocks.select("k", "block", "first", edits.alias("edits")))

    def _ending(self) -> Column:
        """Letters that end the conversation, from its last state."""
        return F.element_at(F.array(*[F.lit(e) for e in ENDING]), F.element_at("path", -1) + 1)

    def _lines(self) -> DataFrame:
        """``k, at, messages``: what stands in place of each row, with the closing inserts after the last."""
        each = self.edits.select("k", "first", F.posexplode("edits").alias("i", "edit"))
        each = each.select("k", (F.col("first") + F.col("i")).alias("at"), "edit")
        names = F.create_map(F.lit("u"), F.lit("user"), F.lit("a"), F.lit("assistant"))

        def message(edit):
            letter, given = F.substring(edit, 1, 1), names[F.substring(edit, 2, 1)]
            who = F.when(letter == "K", F.col("role")).otherwise(given)
            return F.struct(letter.alias("edit"), who.alias("role"), F.when(letter == "I", "").otherwise(F.col("text")).alias("text"))

        pairs = F.filter(F.regexp_extract_all("edit", F.lit(".."), F.lit(0)), lambda p: ~p.startswith("D"))
        rows = self.rows.select("k", "at", "role", "text").join(each, ["k", "at"])
        rows = rows.select("k", "at", F.transform(pairs, message).alias("messages"))
        closing = [F.struct(F.lit("I").alias("edit"), F.lit(n).alias("role"), F.lit("").alias("text")) for n in ("user", "assistant")]
        count = F.length(self._ending())
        last = self.joined.filter(count > 0).select(
            "k", F.lit((1 << 62)).cast("bigint").alias("at"), F.slice(F.array(*closing), F.lit(3) - count, count).alias("messages")
        )
        return rows.filter(F.size("messages") > 0).unionByName(last)

    def messages(self) -> DataFrame:
        """The repaired conversations: id, ``at`` and ``part`` to sort by, ``edit, role, text``."""
        rows = self._lines().select("k", "at", F.posexplode("messages").alias("part", "m"))
        conv = F.when(F.col("k") != " ", F.substr("k", F.lit(2))).cast(self.conv_type)
        return rows.select(conv.alias(self.conv), "at", "part", "m.edit", "m.role", "m.text")

    def digests(self) -> DataFrame:
        """``k, repaired_sha256`` of the messages as ``role:text``, one a line; none for a conversation without any."""
        line = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
        lines = self._lines().select("k", "at", line.alias("line"))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, digest = None, None
            for batch in batches:
                done = []
                for k, text in zip(batch.column("k").to_pylist(), batch.column("line").to_pylist()):
                    if k != now:
                        done += [] if now is None else [(now, digest.hexdigest())]
                        now, digest = k, hashlib.sha256()
                    else:
                        digest.update(b"\n")
                    digest.update(text.encode("utf-8", "surrogatepass"))
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["k", "repaired_sha256"])
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["k", "repaired_sha256"])

        return lines.repartition("k").sortWithinPartitions("k", "at").mapInArrow(hashed, "k string, repaired_sha256 string")

    def summary(self, conversations: DataFrame | None = None) -> DataFrame:
        """One row a conversation: id, ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

        ``conversations`` may name ids, in the column of that name, that have no rows left.
        """
        marks = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
        span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        counted = self.rows.groupBy("k").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"), *marks)
        letters = F.regexp_replace(F.array_join("edits", ""), "(.).", "$1")
        parts = F.array_sort(F.collect_list(F.struct("block", letters.alias("letters"))))
        audits = self.edits.groupBy("k").agg(F.array_join(F.transform(parts, lambda p: p["letters"]), "").alias("rows"))
        ids = self.rows.select("k").distinct()
        if conversations is not None:
            ids = conversations.select(key_of(column(self.conv)).alias("k")).unionByName(ids).distinct()
        found = ids.join(counted, "k", "left").join(self.joined, "k", "left").join(audits, "k", "left").join(self.digests(), "k", "left")
        conv = F.when(F.col("k") != " ", F.substr("k", F.lit(2))).cast(self.conv_type)
        zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        return found.select(
            conv.alias(self.conv),
            *zeros,
            F.coalesce(F.concat("rows", self._ending()), F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(NO_SHA)).alias("repaired_sha256"),
        )
