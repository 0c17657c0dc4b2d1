"""The registered piece model against a plain Viterbi."""

import random

import public_tokenizers

from molframe.llm import lattice


def plain_viterbi(unit, pieces):
    ids = {pieces.texts[i]: i for i in pieces.ordinary}
    total, chosen = [0.0], [None]
    for end in range(1, len(unit) + 1):
        ways = []
        for n in range(1, min(end, pieces.longest) + 1):
            text = unit[end - n : end]
            if text in ids:
                ways.append((total[end - n] + pieces.scores[ids[text]], n, [ids[text]]))
            elif n == 1:
                ways.append((total[end - 1] + pieces.unknown_score, 1, [pieces.first_byte + b for b in text.encode()]))
        best = max(ways, key=lambda way: way[:2])
        total.append(best[0])
        chosen.append(best)
    out, end = [], len(unit)
    while end:
        out.append(chosen[end][2])
        end -= chosen[end][1]
    return [i for part in reversed(out) for i in part]


def test_registered_model_at_ends_of_blocks(spark):
    """Units shorter than the longest piece, around one and two blocks of the fold, and of several."""
    pieces = lattice.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    sizes = [0, 1, 15, 16, 17, *(lattice.FOLD * k + d for k in (1, 2) for d in (-2, -1, 0, 1, 18)), 3000]
    units = [lattice.BLANK + "".join(rng.choice("etaoinshrdlu=-0é漢😀") for _ in range(n)) for n in sizes]
    df = spark.createDataFrame([(1, u) for u in units], "bucket int, unit string")
    got = {r["unit"]: r["ids"] for r in lattice.encode_units(df, ["bucket", "unit"], pieces).collect()}
    assert got == {u: plain_viterbi(u, pieces) for u in units}


def test_substrings_and_texts_are_not_moved(spark):
    """Neither a row for each substring nor the documents go through a join or a group."""
    pieces = lattice.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["low lower", None, "", "l😀w low", "lower " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = lattice.encode(df, "doc_id", "text", pieces)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in ("Join", "Generate", "CoGroup", "Exchange") if word in plan]
    for row in encoded.collect():
        units = lattice._units_in(texts[row["doc_id"]], lattice.re.compile(lattice.UNIT))
        assert row["ids"] == [i for u in units for i in plain_viterbi(u, pieces)]


def test_units_worked_out_again_when_too_many_to_remember(monkeypatch):
    pieces = lattice.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(lattice, "REMEMBERED", 3)
    monkeypatch.setattr(lattice, "AT_ONCE", 2)

    class Sent:
        def __init__(self, value):
            self.value = value

    none = lattice.pa.table({"unit": lattice.pa.array([], "string"), "ids": lattice.pa.array([], lattice.pa.list_(lattice.pa.int32()))})
    texts = ["a b c", "b d", "c a", "e a b", "b"]
    batch = lattice.pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": texts})
    spell = lattice._speller("test", Sent(none), Sent(lattice.trie_of(pieces)))
    got = [ids for out in spell([batch]) for ids in out.column("ids").to_pylist()]
    assert got == [[i for u in lattice._units_in(t, lattice.re.compile(lattice.UNIT)) for i in plain_viterbi(u, pieces)] for t in texts]
