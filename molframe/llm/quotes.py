"""Quotation linking: who answers whom, read from quoted passages.

Each message is parsed into its own text and quoted passages with their level
(``>``, ``> >`` and so on, and the attribution line before them). Passages and
own texts are cut into units, normalised and hashed: each line, and the sentences
of each line, of each paragraph and of the whole, so neither missing full stops
nor other line breaks matter; a piece of a line that is no sentence is no unit.
In each conversation the first message whose own text has a unit is its origin;
origins are aggregated before the join, so a unit that a third of all messages
share meets one row.
A passage belongs to the origin of most of its units, the latest of these
if several tie; a message answers the origin of its least deeply quoted linked
passage, the first such if there are more. Messages without a linked quote
begin a thread.

The result holds threads in the order of their first turns and, inside one,
messages by turn, so every answer follows what it answers; own texts only.

Rows: a null text is empty. Rows without conversation or turn are never linked.
Rows that repeat conversation and turn share one parent, the earliest any has,
and stand next to each other. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.registry import column
from molframe.plans.lineage import cut
from molframe.plans.ordered import Running, running, slice_by_range

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r"(?i)^(?:on\b.*\bwrote|.*\b(?:wrote|writes|said))\s*:\s*$")
#: Full stops of other scripts need no blank after them.
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？｡．।॥؟۔።։។။])\s*")
SPACE = re.compile(r"\s+")
PARAGRAPH = re.compile(r"\n\s*\n")
WORD = re.compile(r"\w")

PARSED = "body string, own array<binary>, quoted array<struct<level:int,passage:int,unit:binary>>"


def units(text: str) -> list[bytes]:
    """Hashes of the different normalised lines and sentences; a line without a word (a rule, a bracket) is no unit of its own."""
    lines = [normal(line) for line in text.splitlines() if WORD.search(line)]
    found = SENTENCE.split(normal(text)) + lines
    for part in [normal(p) for p in PARAGRAPH.split(text)] + lines:
        found += [s for s in SENTENCE.split(part) if WORD.search(s)]
    return [xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")) for s in dict.fromkeys(found) if s]


def normal(text: str) -> str:
    """Lower-cased, with single blanks."""
    return SPACE.sub(" ", text).strip().lower()


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own text, and passages with their quote level."""
    body: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    open_level = 0
    for line in (text or "").splitlines():
        marked = MARKS.match(line)
        if not marked:
            body.append(line)
            open_level = 0
            continue
        level = marked.group(1).count(">")
        if open_level == 0:
            # What announces the quote is not the author's text.
            while body and not body[-1].strip():
                body.pop()
            if body and ATTRIBUTION.match(body[-1].strip()):
                body.pop()
        if level != open_level:
            passages.append((level, []))
            open_level = level
        passages[-1][1].append(line[marked.end() :])
    return "\n".join(body).strip(), [(level, "\n".join(lines)) for level, lines in passages]


def parsed(text: Column) -> Column:
    """``parse`` with hashed units: struct(body, own, quoted)."""

    @F.pandas_udf(PARSED)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for message in texts:
                body, passages = parse(message)
                quoted = [
                    {"level": level, "passage": n, "unit": u}
                    for n, (level, passage) in enumerate(passages)
                    for u in units(passage)
                ]
                rows.append((body, units(body), quoted))
            yield pd.DataFrame(rows, columns=["body", "own", "quoted"])

    return of(text)


def link_quotes(df: DataFrame, conversation: str, turn: str, text: str, keep: tuple = ()) -> DataFrame:
    """Each message as ``conv_id, turn, parent_turn, thread, depth, position, n_quoted, n_linked, body`` and ``keep``.

    ``thread`` is the first turn of its thread, ``depth`` the answers between, ``position`` the
    place in the reply-ordered conversation from 0; ``n_quoted`` and ``n_linked`` count passages.
    """
    rows = df.select(
        column(conversation).alias("conv_id"),
        column(turn).cast("bigint").alias("turn"),
        parsed(column(text)).alias("p"),
        *[column(c).alias(f"keep_{c}") for c in keep],
    )
    rows = rows.withColumn("row", F.monotonically_increasing_id()).select("*", "p.*").drop("p")
    # The table fixes the row numbers and parses each text once.
    rows = cut(rows)
    said = rows.select("conv_id", "turn", F.explode("own").alias("unit")).filter("turn IS NOT NULL")
    origins = said.groupBy("conv_id", "unit").agg(F.min("turn").alias("origin"))
    quoted = rows.select("row", "conv_id", "turn", F.explode("quoted").alias("q")).select("row", "conv_id", "turn", "q.*")
    found = quoted.join(origins, ["conv_id", "unit"]).filter("origin < turn")
    votes = found.groupBy("row", "conv_id", "turn", "level", "passage", "origin").agg(F.count(F.lit(1)).alias("n"))
    passages = votes.groupBy("row", "conv_id", "turn", "level", "passage").agg(
        F.max_by("origin", F.struct("n", "origin")).alias("origin")
    )
    answers = cut(
        passages.groupBy("row", "conv_id", "turn").agg(
            F.min_by("origin", F.struct("level", "passage")).alias("parent_turn"), F.count(F.lit(1)).alias("n_linked")
        )
    )
    parents = answers.groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("parent_turn"))
    threads = _threads(parents)

    linked = answers.select(F.col("row").alias("_row"), "n_linked")
    joined = rows.join(linked, F.col("row") == F.col("_row"), "left").drop("_row", "own")
    placed = joined.join(threads, ["conv_id", "turn"], "left")
    placed = placed.select(
        "row",
        "conv_id",
        "turn",
        "parent_turn",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.size(F.array_distinct(F.transform("quoted", lambda q: q["passage"]))).cast("bigint").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "body",
        *[f"keep_{c}" for c in keep],
    )
    ordered = running(
        slice_by_range(placed, ["thread", "turn", "row"], ["conv_id"], derived=True), position=Running("count")
    )
    renamed = {f"keep_{c}": c for c in keep}
    return ordered.withColumn("position", F.col("position") - 1).drop("row").withColumnsRenamed(renamed)


def _threads(parents: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_turn, thread, depth`` of the linked messages, by pointer doubling."""
    at = cut(parents.select("*", F.col("parent_turn").alias("thread"), F.lit(1).cast("bigint").alias("depth")))
    while True:
        above = at.select(
            F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("thread").alias("_up"), F.col("depth").alias("_d")
        )
        moved = at.join(above, (F.col("conv_id") == F.col("_c")) & (F.col("thread") == F.col("_t")), "left")
        moved = cut(
            moved.select(
                "conv_id",
                "turn",
                "parent_turn",
                F.coalesce("_up", "thread").alias("thread"),
                (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"),
                F.col("_up").isNotNull().alias("moved"),
            )
        )
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return at

