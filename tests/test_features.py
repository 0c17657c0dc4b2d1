import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from molframe.functions.tokens import IGNORED, MASK_ID, SPECIALS, UNK_ID, descriptors, hash_each, hashed_fp, mask_tokens, tokenize
from molframe.operators.features import describe, descriptor_labels, dummy, featurize, featurize_rows, pad_and_mask, table_function
from molframe.operators.vocab import build_vocab, encode


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, s string")


def test_smiles_tokens(spark):
    df = texts(spark, "C[C@@H](Cl)Br", "c1ccc%12cc1", "N=[N+]=[N-]")
    got = [r[0] for r in df.orderBy("id").select(tokenize(F.col("s"), "smiles")).collect()]
    assert got == [
        ["C", "[C@@H]", "(", "Cl", ")", "Br"], ["c", "1", "c", "c", "c", "%12", "c", "c", "1"], ["N", "=", "[N+]", "=", "[N-]"],
    ]


def fingerprint(tokens, size, radius):
    bits = set()
    for r in range(radius + 1):
        for i in range(len(tokens)):
            window = tokens[max(0, i - r) : i + r + 1]
            bits.add(int(hashlib.md5(f"{r}:{' '.join(window)}".encode()).hexdigest()[:8], 16) % size)
    return sorted(bits)


@pytest.mark.parametrize("size,radius", [(1024, 2), (64, 0), (2048, 1)])
def test_fingerprint(spark, size, radius):
    df = texts(spark, "CC(=O)Oc1ccccc1C(=O)O", "C", "")
    rows = df.orderBy("id").select(tokenize(F.col("s"), "smiles").alias("t")).select("t", hashed_fp(F.col("t"), size, radius).alias("x")).collect()
    for r in rows:
        assert r["x"] == fingerprint(r["t"], size, radius)


def test_descriptors(spark):
    df = texts(spark, "C1CC1.[Na+]c", "")
    a, b = df.orderBy("id").select(descriptors(tokenize(F.col("s"), "smiles"), "smiles").alias("d")).collect()
    counts = Counter(["C", "1", "C", "C", "1", ".", "[Na+]", "c"])
    entropy = -sum(c / 8 * math.log(c / 8) for c in counts.values())
    assert (a["d"]["n_tokens"], a["d"]["n_ring"], a["d"]["n_aliphatic"], a["d"]["n_aromatic"], a["d"]["n_bracket"], a["d"]["n_dot"]) == (8, 1, 3, 1, 1, 1)
    assert a["d"]["entropy"] == pytest.approx(entropy) and b["d"]["entropy"] == 0.0
    row = descriptor_labels(df, "id", "s", "smiles").orderBy("id").first()
    assert row["x"] == "C1CC1.[Na+]c" and row["y"][0] == 8.0 and row["w"] == 1.0
    assert "entropy" in describe(df, "s", "smiles").columns


def test_pad_and_mask(spark):
    df = spark.createDataFrame([(i, list(range(5, 5 + n))) for i, n in enumerate([1, 3, 2, 0, 4])], "id bigint, ids array<bigint>")
    rows = pad_and_mask(df, "ids", ["id"], 2).orderBy("id").collect()
    assert [len(r["input_ids"]) for r in rows] == [3, 3, 2, 2, 4]
    assert rows[0]["input_ids"] == [5, 0, 0] and rows[0]["attention_mask"] == [1, 0, 0]
    assert rows[3]["attention_mask"] == [0, 0]


def test_padding_keeps_rows_with_null_or_equal_keys(spark):
    rows = [(None, [1]), (None, [1, 2, 3]), (1, [4]), (1, [5]), (1, [5]), (2, None)]
    got = pad_and_mask(spark.createDataFrame(rows, "id bigint, ids array<bigint>"), "ids", ["id"], 2)
    assert got.columns[:2] == ["id", "ids"] and sorted(str(r["ids"]) for r in got.collect()) == sorted(str(r[1]) for r in rows)
    assert sorted(r["batch_id"] for r in got.collect()) == [0, 0, 1, 1, 2, 2]


def test_encoding_moves_no_rows(spark):
    df = texts(spark, "b a b c zzz", "a b d zzz zzz", "")
    vocab = build_vocab(texts(spark, "b a b c", "a b d"), tokenize(F.col("s")))
    plan = encode(df, "id", tokenize(F.col("s")), vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("head", [500_000, 6])
def test_encoding_of_odd_rows(spark, head):
    """Null rows and tokens, repeated ids, a long row whose rare tokens repeat."""
    vocab = build_vocab(texts(spark, "b a b c", "a b d e f"), tokenize(F.col("s")))
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    rows = [(1, ["a", None, "q"]), (1, ["f", "f", "a"]), (1, ["f", "f", "a"]), (None, None), (2, []), (3, ["e", "q", "f"] * 5000)]
    df = spark.createDataFrame(rows, "id bigint, t array<string>")
    got = encode(df, "id", F.col("t"), vocab, head).collect()
    assert sorted((str(r["id"]), r["input_ids"]) for r in got) == sorted((str(i), [ids.get(t, UNK_ID) for t in w or []]) for i, w in rows)


def test_masking_rates(spark):
    ids = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: (i + 5).cast("bigint"))
    df = spark.range(200).select("id", mask_tokens(ids, F.col("id"), 30_000, seed=1).alias("m"))
    chosen = masked = kept = total = 0
    for r in df.collect():
        for pos, (x, label) in enumerate(zip(r["m"]["input_ids"], r["m"]["labels"])):
            total += 1
            if label == IGNORED:
                assert x == pos + 5
                continue
            assert label == pos + 5
            chosen += 1
            masked += x == MASK_ID
            kept += x == label
    assert abs(chosen / total - 0.15) < 0.01
    assert abs(masked / chosen - 0.8) < 0.03 and abs(kept / chosen - 0.1) < 0.02


def test_vocabulary_order_and_limits(spark):
    df = texts(spark, "b a b c", "a b <unk> d")
    words = F.split("s", " ")
    full = build_vocab(df, words).orderBy("token_id").collect()
    assert [r["token"] for r in full] == [*SPECIALS, "b", "a", "c", "d"]
    assert [r["token_id"] for r in full] == list(range(9)) and full[5]["n"] == 3
    assert build_vocab(df, words, min_count=2).count() == 7
    assert build_vocab(df, words, max_size=6).count() == 6
    sliced = build_vocab(df, words, slices=1).orderBy("token_id").collect()
    assert [tuple(r) for r in sliced] == [tuple(r) for r in full]


@pytest.mark.parametrize("head,limit", [(500_000, 1 << 20), (7, 1 << 20), (1, 1 << 20), (500_000, 3)])
def test_encoding_is_the_same_however_much_is_broadcast(spark, monkeypatch, head, limit):
    monkeypatch.setattr("molframe.operators.vocab.HEAD_BYTES", limit)
    df = texts(spark, "b a b c zzz", "a b d zzz zzz", "")
    words = tokenize(F.col("s"))
    vocab = build_vocab(texts(spark, "b a b c", "a b d"), words)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    got = {r["id"]: r["input_ids"] for r in encode(df, "id", words, vocab, head).collect()}
    for i, text in enumerate(["b a b c zzz", "a b d zzz zzz", ""]):
        assert got[i] == [ids.get(t, UNK_ID) for t in text.split()]


def test_user_featurizer_drops_empty_results(spark):
    def lengths(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(len(t))] if t else [])

    out = featurize(texts(spark, "CC", "", "CCC"), lengths, "s", "array<double>")
    assert sorted(r["x"][0] for r in out.collect()) == [2.0, 3.0]
    assert dummy(texts(spark, "CC"), "s").first()["x"] == "CC"


def test_user_function_may_return_many_rows(spark):
    def letters(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(letter=frame["s"].map(list)).explode("letter").dropna()[["id", "letter"]]

    out = featurize_rows(texts(spark, "CO", "", "N"), letters, ["id", "s"], "id bigint, letter string")
    assert sorted(map(tuple, out.collect())) == [(0, "C"), (0, "O"), (2, "N")]


def test_table_functions_state_their_columns_and_refuse_other_types(spark):
    def halves(text):
        yield text[: len(text) // 2], len(text)

    table_function(spark, "halves", halves, "half string, n int")
    texts(spark, "abcd", "").union(spark.createDataFrame([(9, None)], "id bigint, s string")).createOrReplaceTempView("halved")
    got = spark.sql("SELECT id, half, n FROM halved, LATERAL halves(s)")
    assert got.schema.simpleString().endswith("half:string,n:int>") and sorted(map(tuple, got.collect())) == [(0, "ab", 4), (1, "", 0)]
    with pytest.raises(AnalysisException, match="halves takes one text"):
        spark.sql("SELECT * FROM halved, LATERAL halves(id)").collect()


def test_md5_of_parts_of_a_buffer():
    """Ends of blocks, several blocks, parts of others, empty ones."""
    from molframe.functions.md5 import md5_words

    data = np.random.default_rng(1).integers(0, 256, 500, np.uint8)
    bounds = [(a, a + n) for a in (0, 7, 300) for n in (0, 1, 53, 54, 55, 56, 57, 61, 62, 63, 64, 65, 117, 118, 119, 120, 128, 200)]
    for prefix in (b"", b"2:"):
        got = md5_words(data, *np.array(bounds).T, prefix)
        want = [hashlib.md5(prefix + data[a:b].tobytes()).hexdigest() for a, b in bounds]
        assert ["".join(f"{w:08x}" for w in words) for words in got.T.tolist()] == want


def test_hashes_take_whole_batches_in_tasks(spark):
    """Null rows and tokens, empty tokens, long neighbourhoods; no expression hashes token by token."""
    rows = [(0, ["a", None, "b", "", "c" * 90, "a"]), (1, None), (2, []), (3, [None]), (4, ["é漢" * 20, "d"])]
    df = spark.createDataFrame(rows, "id bigint, t array<string>")
    made = df.select("t", hashed_fp(F.col("t"), 512, 2).alias("x"), hash_each(F.col("t"), 1000, 5).alias("h"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5(" not in plan
    for r in made.collect():
        if r["t"] is None:
            assert r["x"] is None and r["h"] is None
            continue
        near = [(k, [w for w in r["t"][max(0, i - k) : i + k + 1] if w is not None]) for k in range(3) for i in range(len(r["t"]))]
        assert r["x"] == sorted({int(hashlib.md5(f"{k}:{' '.join(ws)}".encode()).hexdigest()[:8], 16) % 512 for k, ws in near})
        assert r["h"] == [None if t is None else int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 1000 + 5 for t in r["t"]]


def test_masking_of_odd_rows(spark):
    """Null rows, tokens, ids and sizes; a row's choices hash its id and the places."""
    rows = [(7, [9] * 300 + [None], 50), (None, [8] * 300, 60), (3, None, 50), (4, [], 50), (5, [6] * 300, None)]
    df = spark.createDataFrame(rows, "id bigint, ids array<int>, size int")
    got = df.select("*", mask_tokens(F.col("ids"), F.col("id"), F.col("size"), rate=0.5, seed=3).alias("m"))
    for r in got.collect():
        if r["ids"] is None:
            assert r["m"]["input_ids"] is None and r["m"]["labels"] is None
            continue
        for i, token in enumerate(r["ids"]):
            key = "|".join(str(p) for p in (3, r["id"], i) if p is not None)
            words = [int(hashlib.md5(key.encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(3)]
            other = None if r["size"] is None else words[2] % (r["size"] - 5) + 5
            want = token if words[0] / 2**32 >= 0.5 else MASK_ID if words[1] / 2**32 < 0.8 else other if words[1] / 2**32 < 0.9 else token
            assert r["m"]["input_ids"][i] == want and r["m"]["labels"][i] == (token if words[0] / 2**32 < 0.5 else IGNORED)
