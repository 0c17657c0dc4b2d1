"""Secret scans by corpus-wide ownership frequency.

Candidate values are found by three patterns. Their digests are aggregated over
the corpus by distinct owners and distinct repositories: a value that a wide
share of all owners has is a copied example, any other that looks live is a
credential, in however many repositories it lies. Copies of one document count
as one owner's, so filing a document under other owners hides nothing in it. Only
built-in functions run on the texts; digests are aggregated in steps that each
combine before the shuffle, so a value copied into a third of all documents is
no hot key.

Rows: a null text is empty and has no spans. Null owners and null ids count as
one owner or repository. Each input row gives one output row, repeated ids too.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.registry import column
from molframe.llm.spans import matches
from molframe.plans.lineage import cut

# What counts as a candidate. A kind's place in the list orders spans that start together.
ASSIGN = (
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: A run is matched whole, so a least length in the pattern drops the same runs as a later check of the length.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = (("assign", ASSIGN, 1, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
LIVE = "live"
#: Placeholder words are whole runs of letters and digits; a filler begins or ends such a run.
WORD_BEGINS, WORD_ENDS = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
FILLER = "(?:xxxx|0000|1234|abcd)"
PLACEHOLDER = (
    f"(?i){WORD_BEGINS}(?:example|sample|change(?:me)?|dummy|test|your){WORD_ENDS}|{WORD_BEGINS}{FILLER}|{FILLER}{WORD_ENDS}"
)
#: Different characters of a value that looks live.
DISTINCT = 8

#: A value is a copied example if at least this share of all owners has it, and no fewer owners than this.
EXAMPLE_SHARE = 0.5
EXAMPLE_OWNERS = 3
#: Equal texts of so many characters are copies of one document; a shorter one is hardly more than the value itself.
COPY_CHARS = 200


def candidates(text: Column) -> Column:
    """array<struct(start, kind, end, from, digest, looks_live)>; places in characters, ``end`` exclusive.

    ``from`` is where the value itself begins; it ends where the match ends.
    """
    found = []
    for number, (_, pattern, group, least) in enumerate(KINDS):
        placed = F.filter(matches(text, F.lit(pattern), group, F.length), lambda m: F.length(m["value"]) >= least)
        spans = F.transform(
            placed,
            lambda m: F.struct(
                m["start"].alias("start"),
                F.lit(number).alias("kind"),
                m["end"].alias("end"),
                (m["end"] - F.length(m["value"])).alias("from"),
                F.unhex(F.sha2(m["value"], 256)).alias("digest"),
                looks_live(m["value"], least).alias("looks_live"),
            ),
        )
        # The costly passes run only on texts that match at all.
        found.append(F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.slice(spans_like(), 1, 0)))
    return F.sort_array(F.concat(*found))


def spans_like() -> Column:
    """An array literal of the type of ``candidates``."""
    kind = "array<struct<start:bigint,kind:int,end:bigint,from:bigint,digest:binary,looks_live:boolean>>"
    return F.array().cast(kind)


def looks_live(value: Column, least: int) -> Column:
    """As long as its kind asks for, mixed and no placeholder."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (
        (F.length(value) >= least)
        & F.regexp_like(value, F.lit("[0-9]"))
        & F.regexp_like(value, F.lit("[A-Za-z]"))
        & (distinct >= F.least(F.lit(DISTINCT), F.ceil(F.length(value) * 0.75)))
        & ~F.regexp_like(value, F.lit(PLACEHOLDER))
    )


def ownership(occurrences: DataFrame) -> DataFrame:
    """``digest, n_owners, n_repos, n_apart`` from rows ``digest, owner, repo, copy``; a repository belongs to an owner.

    ``n_apart`` counts owners too, but all rows of one ``copy`` as those of its first owner; a null is no copy.
    """
    repos = occurrences.groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = repos.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n_repos"))
    counts = owners.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repos").alias("n_repos"))
    own = F.when(F.col("copy").isNull(), F.struct("owner"))
    firsts = occurrences.groupBy("digest", "copy", own.alias("own")).agg(F.min("owner").alias("owner"))
    apart = firsts.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(apart.groupBy("digest").agg(F.count(F.lit(1)).alias("n_apart")), "digest")


def scan_secrets(
    df: DataFrame,
    id: str,
    text: str,
    owner: str,
    repo: str,
    example_share: float = EXAMPLE_SHARE,
    example_owners: int = EXAMPLE_OWNERS,
    keep: tuple = (),
) -> DataFrame:
    """One row per input row: ``doc_id, found, live, owned`` and the columns in ``keep``.

    ``found`` are the candidates, each with ``n_owners`` and ``n_repos``; ``live``
    are the distinct places ``(start, kind, end)`` of values that look live and
    are no example: fewer than ``example_share`` of all owners or fewer than
    ``example_owners`` have them, copies of a document counted once. ``owned`` are
    the places of all values that are no example, whatever they look like.
    """
    whole = F.coalesce(column(text), F.lit(""))
    rows = df.select(
        F.monotonically_increasing_id().alias("row"),
        column(id).alias("doc_id"),
        column(owner).alias("owner"),
        column(repo).alias("repo"),
        F.when(F.length(whole) >= COPY_CHARS, F.xxhash64(whole)).alias("copy"),
        candidates(whole).alias("found"),
        *[column(c).alias(f"keep_{c}") for c in keep],
    )
    # The table fixes the row numbers and spares a second scan of the texts.
    rows = cut(rows)
    wide = max(example_owners, example_share * rows.select("owner").distinct().count())
    each = rows.select("row", "owner", "repo", "copy", F.explode("found").alias("c")).select(
        "row", "owner", "repo", "copy", "c.*"
    )
    counts = ownership(each.select("digest", "owner", "repo", "copy"))
    told = each.join(counts, "digest", "left")
    owned = F.col("n_apart") < wide
    place = F.struct(F.col("from").alias("start"), F.lit(len(KINDS)).alias("kind"), "end")
    fields = ["start", "kind", "end", "n_owners", "n_repos"]
    # Bounded by the candidates of one document.
    per_row = told.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("counted"),
        F.sort_array(F.collect_set(F.when(F.col("looks_live") & owned, place))).alias("live"),
        F.sort_array(F.collect_set(F.when(owned, place))).alias("owned"),
    )
    joined = rows.join(per_row, "row", "left")
    none = "array<struct<start:bigint,kind:int,end:bigint>>"
    nothing = "array<struct<start:bigint,kind:int,end:bigint,n_owners:bigint,n_repos:bigint>>"
    return joined.select(
        "doc_id",
        F.coalesce("counted", F.array().cast(nothing)).alias("found"),
        F.coalesce("live", F.array().cast(none)).alias("live"),
        F.coalesce("owned", F.array().cast(none)).alias("owned"),
        *[F.col(f"keep_{c}").alias(c) for c in keep],
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    names = F.array(*[F.lit(n) for n, *_ in KINDS], F.lit(LIVE))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redact(text: Column, places: Column, mark: str = "[SECRET]") -> Column:
    """The text with each of the places replaced; places that overlap are replaced together."""

    def piece(state, span):
        last = state["last"]
        between = F.substring(text, (last + 1).cast("int"), F.greatest(span["start"] - last, F.lit(0)).cast("int"))
        new = span["start"] >= last
        return F.struct(
            F.greatest(last, span["end"]).alias("last"),
            F.concat(state["parts"], F.when(new, F.array(between, F.lit(mark))).otherwise(F.array().cast("array<string>"))).alias("parts"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast("array<string>").alias("parts"))

    def finish(state):
        return F.concat(F.array_join(state["parts"], ""), F.substring(text, (state["last"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(places) > 0, F.aggregate(places, start, piece, finish)).otherwise(text)
