"""Toxic spans and document scores by a linear-chain conditional random field.

Labels mark documents; the tagger needs labelled tokens. A word of a labelled
document is tagged toxic if it (or its prefix) stands in far more distinct
places of toxic documents than of others; places are counted by the word before,
so a passage that is copied counts once. On these tokens a two-state chain is
fitted by maximum likelihood: emissions from hashed word, prefix and suffix
features, and transitions. Forward-backward gives each token's marginal; a
document's score is a logistic curve, fitted on the same documents, of the sum
of the marginals' fourth powers and the length; tokens whose marginal passes one half are
the offending spans.

The model is fitted by one task on a bounded sample: at most ``sample`` documents
of each label, of at most ``sample_chars`` characters each; of the windows without
a toxic token a quarter, drawn by a fixed seed, is fitted on. Every text is scored
whole, row by row.

Rows: null and empty texts have no tokens and score as the curve says for none.
Without a document of either label in the sample every score is 0. Each input
row gives one output row. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.registry import column

SAMPLE, SAMPLE_CHARS = 1500, 50_000
BITS, MASK = 18, (1 << 18) - 1
WINDOW, ROUNDS, RATE, PENALTY, LEAST_WEIGHT = 64, 60, 0.3, 1e-6, 0.02
#: A token label needs this log-likelihood ratio and this log odds.
LEAST_RATIO, LEAST_ODDS = 30.0, 3.0
EDGES = ".,;:!?()\"'|[]{}<>*_-#$%&~^+=/\\@`"
TOKEN = re.compile(r"\S+")
#: Words remembered per task, and padded places of one forward-backward pass.
REMEMBERED, PLACES = 300_000, 1_000_000


def normal(token: str) -> str:
    return token.lower().strip(EDGES)


def features(word: str) -> list[int]:
    """Hashed features: the word and its prefixes of 4 and 5 letters."""
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & MASK for p in (word, *prefixes(word))]


def prefixes(word: str) -> tuple[str, str]:
    return word[:4] + "*", word[:5] + "**"


@dataclass
class Tagger:
    """Weights of the features that matter; ``steps[i, j]`` is the factor of going from state i to j; curve of the score."""

    weights: dict[str, float]
    bias: float
    steps: np.ndarray
    curve: np.ndarray

    def emission(self, token: str) -> float:
        word = normal(token)
        weight = self.weights.get
        total = self.bias + weight(word, 0.0) + weight(word[:4] + "*", 0.0) + weight(word[:5] + "**", 0.0)
        return math.exp(max(-30.0, min(30.0, total)))


class Remembered(dict):
    """Emissions by token."""

    def __init__(self, tagger: Tagger):
        super().__init__()
        self.tagger = tagger

    def __missing__(self, token: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[token] = self.tagger.emission(token)
        return value


def marginals(odds: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over columns of emission odds, padded with zeros at the end.

    A state's forward and backward weights matter by their ratio only, so each
    place carries one number each way. Returns marginals and both ratios.
    """
    (a, b), (c, d) = steps
    ahead, back = np.empty_like(odds), np.ones_like(odds)
    ahead[0] = odds[0]
    for t in range(1, len(odds)):
        before = ahead[t - 1]
        np.multiply(odds[t], (b + d * before) / (a + c * before), out=ahead[t])
    for t in range(len(odds) - 2, -1, -1):
        after = odds[t + 1] * back[t + 1]
        np.divide(c + d * after, a + b * after, out=back[t])
        # Padding says nothing about what stands before it.
        back[t][odds[t + 1] == 0] = 1.0
    both = ahead * back
    return both / (1 + both), ahead, back


def _token_labels(docs: list[np.ndarray], toxic: np.ndarray, words: list[str]) -> np.ndarray:
    """Which words mark toxic tokens, by themselves or by a prefix; ``docs`` are numbers of words, 0 the empty one."""
    size = len(words)
    places = {}
    for label in (0, 1):
        own = [d for d, y in zip(docs, toxic) if y == label and len(d)]
        # Distinct (word before, word), the empty word before the first.
        pairs = [np.unique(np.concatenate([[0], d[:-1]]).astype(np.int64) * size + d) for d in own]
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        by_word = np.bincount(pairs % size, minlength=size)
        by_word[0] = 0
        places[label] = Counter()
        for word, n in zip(words, by_word.tolist()):
            if n:
                for key in (word, *prefixes(word)) if len(word) > 3 else (word,):
                    places[label][key] += n
    ones, zeros = (sum(places[k].values()) or 1 for k in (1, 0))
    marked = set()
    for key, n in places[1].items():
        m = places[0][key]
        share = ones / (ones + zeros)
        ratio = 2 * (n * math.log(n / ((n + m) * share)) + (m * math.log(m / ((n + m) * (1 - share))) if m else 0.0))
        if ratio > LEAST_RATIO and math.log((n + 0.1) / ones) - math.log((m + 0.1) / zeros) > LEAST_ODDS:
            marked.add(key)
    return np.array([not marked.isdisjoint((w, *prefixes(w))) for w in words], bool)


def fit(texts: list[str], toxic: list[int], seed: int = 0) -> Tagger | None:
    """The tagger of labelled documents, or None if a label is missing."""
    toxic = np.asarray(toxic, int)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    # Words are numbered as they are read, so that no text's words are held as objects.
    numbers: dict[str, int] = {"": 0}
    docs = [
        np.fromiter((numbers.setdefault(normal(t[0]), len(numbers)) for t in TOKEN.finditer(text or "")), np.int32)
        for text in texts
    ]
    marked = _token_labels(docs, toxic, list(numbers))
    windows, tags = [], []
    rng = np.random.default_rng(seed)
    for ids, label in zip(docs, toxic):
        tag = marked[ids] & bool(label)
        for at in range(0, len(ids), WINDOW):
            if tag[at : at + WINDOW].any() or rng.random() < 0.25:
                windows.append(ids[at : at + WINDOW])
                tags.append(tag[at : at + WINDOW])
    if not windows:
        return None
    filled = np.array([len(w) for w in windows])
    real = np.arange(WINDOW)[:, None] < filled[None, :]
    ids, truth = np.zeros(real.shape, np.int64), np.zeros(real.shape)
    ids.T[real.T], truth.T[real.T] = np.concatenate(windows), np.concatenate(tags)
    tokens, wanted = ids[real], truth[real]
    table = np.array([features(w) for w in numbers])
    table_size = 1 << BITS
    # Weights, bias and logarithms of the steps that reach or leave the toxic state.
    theta = np.zeros(table_size + 4)
    theta[table_size] = -4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    into = real[1:]
    for turn in range(1, ROUNDS + 1):
        weights, (bias, s01, s10, s11) = theta[:table_size], theta[table_size:]
        steps = np.exp(np.array([[0.0, s01], [s10, s11]]))
        emission = np.clip(weights[table].sum(axis=1) + bias, -30, 30)
        odds = np.where(real, np.exp(emission)[ids], 0.0)
        p, ahead, back = marginals(odds, steps)
        error = p[real] - wanted
        per_word = np.bincount(tokens, error, len(numbers))
        slope = np.zeros_like(theta)
        slope[:table_size] = np.bincount(table.ravel(), np.repeat(per_word, table.shape[1]), table_size)
        slope[table_size] = error.sum()
        after = odds[1:] * back[1:]
        joint = np.stack([steps[0, 1] * after, steps[1, 0] * ahead[:-1], steps[1, 1] * ahead[:-1] * after])
        joint /= steps[0, 0] + joint.sum(axis=0)
        was, now = truth[:-1], truth[1:]
        seen = np.stack([(1 - was) * now, was * (1 - now), was * now])
        slope[table_size + 1 :] = ((joint - seen) * into).sum(axis=(1, 2))
        slope = slope / len(tokens) * 100 + PENALTY * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta - RATE * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-6)
    bias, s01, s10, s11 = theta[table_size:]
    steps = np.exp(np.array([[0.0, s01], [s10, s11]]))
    keys = {f: i for w in numbers for f, i in zip((w, *prefixes(w)), features(w))}
    weights = {f: float(theta[i]) for f, i in keys.items() if abs(theta[i]) >= LEAST_WEIGHT}
    tagger = Tagger(weights, float(bias), steps, np.zeros(3))
    known = Remembered(tagger)
    measured = np.array([_measure(m) for m in tag_texts(texts, known)])
    tagger.curve = _curve(measured, toxic)
    return tagger


def _measure(p: np.ndarray) -> tuple[float, float]:
    return math.log1p(10 * float((p**4).sum())), math.log1p(len(p))


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge; both labels weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-1 * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(x.shape[1])
        beta = beta - np.clip(np.linalg.solve(bend, slope), -5, 5)
    return beta


def tag_texts(texts, known: Remembered) -> list[np.ndarray]:
    """Marginals of the tokens of each text."""
    # Texts of like length share a pass over their places.
    odds = [np.fromiter(map(known.__getitem__, (t or "").split()), np.float64) for t in texts]
    out: list[np.ndarray] = [np.zeros(0)] * len(odds)
    order = sorted((i for i, o in enumerate(odds) if len(o)), key=lambda i: len(odds[i]))
    while order:
        longest = len(odds[order[-1]])
        take = max(1, min(256, PLACES // longest))
        some, order = order[-take:], order[:-take]
        grid = np.zeros((longest, len(some)))
        for k, i in enumerate(some):
            grid[: len(odds[i]), k] = odds[i]
        p, _, _ = marginals(grid, known.tagger.steps)
        for k, i in enumerate(some):
            out[i] = p[: len(odds[i]), k].copy()
    return out


def score_texts(texts, known: Remembered) -> tuple[list[float], list[list[tuple[int, int]]]]:
    """Score and offending character spans of each text."""
    scores, spans = [], []
    for text, p in zip(texts, tag_texts(texts, known)):
        mass, length = _measure(p)
        b = known.tagger.curve
        scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, b[0] + b[1] * mass + b[2] * length)))))
        hits = set(np.flatnonzero(p >= 0.5).tolist())
        places = _places(text) if hits else []
        spans.append([places[i] for i in sorted(hits)])
    return scores, spans


def _places(text: str) -> list[tuple[int, int]]:
    """Character spans of what ``split`` gives."""
    at, out = 0, []
    for token in text.split():
        at = text.index(token, at)
        out.append((at, at + len(token)))
        at += len(token)
    return out


def training_sample(
    docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS
) -> DataFrame:
    """``id, label, text``: at most ``sample`` labelled texts of each label, those with the least hashes of their ids."""
    texts = docs.select(column(id).alias("id"), column(text).alias("text"))
    marks = labels.select(column(id).alias("id"), column(label).cast("int").alias("label")).filter("label IN (0, 1)")
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    sized = texts.select("id", F.length("text").alias("n")).filter(F.col("n") <= sample_chars)
    usable = marks.join(sized.select("id").distinct(), "id").withColumn("h", F.xxhash64("id"))
    picked = [usable.filter(F.col("label") == k).orderBy("h", "id").limit(sample) for k in (0, 1)]
    # At most 2 * sample rows.
    chosen = F.broadcast(picked[0].unionByName(picked[1]).select("id", "label"))
    found = texts.filter(F.length("text") <= sample_chars).join(chosen, "id")
    return found.groupBy("id", "label").agg(F.min("text").alias("text"))


def fit_sample(sample: DataFrame) -> Tagger | None:
    """The tagger of ``id, label, text``, fitted by one task; its weights alone reach the driver."""

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            rows = pd.concat(parts).sort_values("id")
            tagger = fit(rows.pop("text").tolist(), rows["label"].tolist())
            yield pd.DataFrame({"tagger": [pickle.dumps(tagger)]})

    made = sample.repartition(1).mapInPandas(fitted, "tagger binary").collect()
    return pickle.loads(made[0]["tagger"]) if made else None


RESULT = "score double, spans array<struct<start:int,end:int>>"


def score_documents(
    docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, trainable=None,
    sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """The rows of ``docs`` with ``toxicity``: struct(score, spans).

    ``trainable`` is a condition on the id column of ``labels``; rows that fail it are never fitted on. The fit
    sees at most ``sample`` documents of each label, of at most ``sample_chars`` characters each.
    """
    marks = labels if trainable is None else labels.filter(trainable)
    tagger = fit_sample(training_sample(docs, marks, id, text, label, sample, sample_chars))

    @F.pandas_udf(RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = None if tagger is None else Remembered(tagger)
        for texts in batches:
            if known is None:
                yield pd.DataFrame({"score": [0.0] * len(texts), "spans": [[] for _ in texts]})
                continue
            scores, spans = score_texts(list(texts), known)
            marked = [[{"start": a, "end": b} for a, b in s] for s in spans]
            yield pd.DataFrame({"score": scores, "spans": marked})

    return docs.withColumn("toxicity", scored(column(text)))


def fold(id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(id.cast("string")) % 3
