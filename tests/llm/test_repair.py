"""Conversation repair against search over all edit sequences, and against a plain reading of the damage."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest

from molframe.llm import repair
from tests.compare import TESTDATA

KIND = "conv_id bigint, turn bigint, role string, text string, at int, k string, fault string"
PATTERN = re.compile(r"(s?(ua)+)?")


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        named = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(named.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best(rows, marks):
    """(cost, audit, lines): Dijkstra over (row, initials so far in short), letters as text."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, i, shape, lines = heapq.heappop(heap)
        if i == len(rows) and PATTERN.fullmatch(shape):
            return cost, audit, lines
        # What may follow depends on the start and the last initial.
        if (i, shape[:0] if not shape else shape[0] + shape[-1] + str(len(shape) > 1)) in done:
            continue
        done.add((i, shape[:0] if not shape else shape[0] + shape[-1] + str(len(shape) > 1)))

        def go(more, letter, at, initial="", line=()):
            new = shape + initial
            if re.fullmatch(r"s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, audit + letter, at, new, lines + line))

        for name in ("user", "assistant"):
            go(2, "I", i, name[0], (f"{name}:",))
        if i < len(rows):
            _, _, role, text = rows[i]
            go(3, "D", i + 1)
            if marks[i] not in ("blank", "duplicate"):
                short = marks[i] == "truncated"
                if role[:1]:
                    go(short, "K", i + 1, role[0], (f"{role}:{text}",))
                for name in ("user", "assistant"):
                    go(2 + short, "R", i + 1, name[0], (f"{name}:{text}",))


def expected(rows, damage=True):
    by, out = {}, {}
    for r in rows:
        by.setdefault(r[0], [])
    for r in broken(rows) if damage else rows:
        by[r[0]].append((r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    for conv, left in by.items():
        left.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        marks = faults(left)
        turns = [r[1] for r in left if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in left]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = best(left, marks)
        counts = [marks.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def answers(got):
    return {r[0]: tuple(r)[1:] for r in got.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "none") for r in rows], KIND)


def whole(codes, block):
    """Audit and cost of a conversation cut into blocks."""
    parts = [codes[i : i + block] for i in range(0, len(codes), block)]
    cost, path = repair.states_between([repair.block_table(p) for p in parts])
    edits = [e for p, a, b in zip(parts, path, path[1:]) for e in repair.block_edits(p, a, b)]
    return cost, "".join("".join(edits)[::2]) + repair.ENDING[path[-1]]


def coded(codes):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    kinds = [(repair.SOUND + repair.CUT_SHORT + repair.DOOMED).index(c) for c in codes]
    rows = [(0, i, names[repair.SOUND[k % 4]], "x") for i, k in enumerate(kinds)]
    return rows, [(None, "truncated", "blank")[k // 4] for k in kinds]


def test_every_short_conversation():
    alphabet = "suaxSU1A"
    for n in range(1, 5):
        for codes in product(alphabet, repeat=n):
            codes = "".join(codes)
            cost, audit, _ = best(*coded(codes))
            assert whole(codes, n) == (cost, audit), codes


def test_blocks_change_nothing():
    rng = random.Random(4)
    for _ in range(200):
        codes = "".join(rng.choices("suaxSUAX1234", (2, 9, 9, 1, 1, 2, 2, 1, 1, 1, 1, 1), k=rng.randint(1, 40)))
        cost, audit, _ = best(*coded(codes))
        for block in (1, 2, 3, 7, 64):
            assert whole(codes, block) == (cost, audit), (codes, block)


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes!"), (1, 5, "user", "Then\n "), (1, 6, "tool", "42."),
    (2, 0, "user", " \t"), (2, 0, "user", None), (2, None, None, "No role."), (2, 1, "", "Empty role."), (2, 3, "assistant", "é𝒳。"),
    (3, None, "assistant", "a."), (3, None, "user", "b."), (3, None, "user", "b."), (3, None, "user", "b. "),
    (None, 0, "user", "Null id."), (None, 1, "assistant", "Fine."),
    *[(4, t, "user" if t % 2 else "assistant", f"long {'word ' * 3000}{t}.") for t in range(5)],
    *[(5, t, "user", "again?") for t in range(30)],
    *[(6, 0, "system", "s."), (6, 0, "system", "s."), (6, 0, "system", "t.")],
]


@pytest.mark.parametrize("block", [2, repair.BLOCK])
def test_odd_rows(spark, block):
    df = frame(spark, ODD).repartition(3)
    made = repair.Repair(df, "conv_id", "turn", "role", "text", block=block)
    assert answers(made.summary()) == expected(ODD, damage=False)
    lines = {}
    for r in sorted(made.messages().collect(), key=lambda r: (r["at"], r["part"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    shas = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in lines.items()}
    assert all(shas.get(k, repair.NO_SHA) == v[-1] for k, v in expected(ODD, damage=False).items())


def test_damage_and_conversations_without_rows(spark):
    rows = [*ODD, *[(100 + i, i % 3, "user", "Only one.") for i in range(60)]]
    df = frame(spark, rows)
    broken_rows = repair.damaged(df, "conv_id", "turn", "role", "text")
    got = answers(repair.Repair(broken_rows, "conv_id", "turn", "role", "text").summary(df))
    assert got == expected(rows)
    assert (0, 0, 0, 0, 0, 0, "", repair.NO_SHA) in got.values()


def test_given_conversations(spark):
    from molframe.llm.queries import LLM_QUERIES

    sf_dir = f"{TESTDATA}/sf0.01"
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answers(LLM_QUERIES["op13_conversation_repair"](spark, sf_dir)) == expected(given)


def test_one_hot_conversation(spark):
    rng = random.Random(2)
    rows = [(i % 3 and i, i, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Yes.", f"No {i}", f"{i}!"])) for i in range(1500)]
    got = repair.Repair(frame(spark, rows), "conv_id", "turn", "role", "text", block=32).summary()
    assert answers(got) == expected(rows, damage=False)


def test_empty_table(spark):
    df = frame(spark, [])
    assert repair.Repair(df, "conv_id", "turn", "role", "text").summary(df).count() == 0
