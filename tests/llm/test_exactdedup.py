"""Exact duplicates against plain Python: collisions, ties, repeated rows, nulls, clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from molframe.llm import exactdedup

KIND = "doc_id bigint, text string, kept string, n bigint, row string"


def expected(rows):
    """Multiset of (id, keep_id, size, kept, sha)."""
    groups = defaultdict(list)
    for at, (id, text, *_) in enumerate(rows):
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[body].append((-len(text or ""), id is None, id if id is not None else 0, at, id))
    out = Counter()
    for body, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(body.encode()).hexdigest()
        for m in members:
            # Rows alike in all that counts are one to the caller; one of them stays.
            out[(m[4], best[4], len(members), m[3] == best[3], sha)] += 1
    return out


def weak(body):
    return F.substring(F.md5(body), 1, 1).cast("binary")


ROWS = [
    (5, "same text", "x", 1, "r"), (3, "same  text", "x", 1, "r"), (2, "same\ntext ", "x", 1, "r"), (9, "sametext", "x", 1, "r"),
    (1, None, "x", 1, "r"), (4, "", "x", 1, "r"), (6, " \t\r\n\x0b\x0c", "x", 1, "r"), (None, "\n", "x", 1, "r"),
    (7, "é𝒳 a", "x", 1, "r"), (8, "é 𝒳a", "x", 1, "r"), (8, "é 𝒳a", "x", 2, "r"), (None, "é 𝒳a", "x", 1, "r"),
    (10, "non-breaking blank", "x", 1, "r"), (11, "non-breakingblank", "x", 1, "r"),
    (12, "long word " * 40_000, "x", 1, "r"), (13, "longword" * 40_000, "x", 1, "r"),
    *[(100 + i, f"text {i}", "x", 1, "r") for i in range(60)], *[(200 + i, f"te xt{i}", "x", 1, "r") for i in range(0, 60, 2)],
    *[(500 + i % 50, "hot text", "x", 1, "r") for i in range(300)],
]


@pytest.mark.parametrize("digest", [exactdedup.digest128, weak])
def test_classes_and_elections(spark, digest):
    df = spark.createDataFrame(ROWS, KIND).repartition(5)
    got = exactdedup.exact_duplicates(df, "doc_id", "text", digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == expected(ROWS)


def test_rows_that_stay_keep_their_columns(spark):
    df = spark.createDataFrame(ROWS, KIND)
    kept = exactdedup.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    bodies = Counter(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect())
    assert set(bodies.values()) == {1} and len(bodies) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in ROWS})


def test_empty_table(spark):
    assert exactdedup.exact_duplicates(spark.createDataFrame([], KIND), "doc_id", "text").count() == 0


def test_no_python_and_no_text_beyond_the_repeated(spark):
    df = spark.createDataFrame(ROWS, KIND)
    plan = exactdedup.exact_duplicates(df, "doc_id", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "body" not in plan.split("== Optimized")[1]
