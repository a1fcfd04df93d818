"""Ordinal quality classifier: cumulative-link (proportional odds) regression on hashed text features.

P(grade <= j | text) = 1 / (1 + exp(s - t_j)) with one score s, a sum of weights that all grades share, and ordered
thresholds t_0 < t_1 < ... Features are the distinct words of a text (lower case, without punctuation at either end), the
first four and five letters of longer ones (for stems under any ending), and coarse levels of its style, hashed into
a fixed number of places. The expected grade and the probability of the best grades
select texts.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import table

#: Places of hashed features, most labelled rows that are trained on, and levels of a style feature.
PLACES, MOST_ROWS, LEVELS = 1 << 20, 20_000, 12
#: Training texts that a fault must occur in, its least chi-squared, and how much rarer it is in the best grade.
LEAST_TEXTS, LEAST_CHI, RARER = 10, 40.0, 0.7
#: First threshold of the best grade, gaps between thresholds, and past squared gradients at first.
BASE, GAP, START_POWER = 4.0, 20.0, 1e-2
#: Letters of the stems.
STEMS = (4, 5)


def grade() -> Column:
    """Grade of a row of ``labels``: 0 toxic, 1 poor, 2 sound. Null where neither label decides it."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).cast("int")


def _place(feature: bytes) -> int:
    return zlib.crc32(feature) % PLACES


def _word(word: str) -> tuple[int, ...]:
    """Places of the word and its two stems (-1 where there is none), letters, capitals, ends in two or more signs, holds a digit, length."""
    core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…")
    tail = len(word) - len(word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    capitals = sum(map(str.isupper, core))
    low = core.lower()
    places = [_place(x.encode("utf-8", "surrogatepass")) if x else -1 for x in (low, *(f"{low[:k]}\x00" if len(low) > k else "" for k in STEMS))]
    return *places, len(core), capitals, tail >= 2, core != core.translate(_NO_DIGITS), len(word)


_NO_DIGITS = {ord(d): None for d in "0123456789"}


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) pairs, each once, in order of text."""
    n = len(texts)
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    coded = lists.values.dictionary_encode()
    known = np.array([_word(w) for w in coded.dictionary.to_pylist()], np.int64).reshape(-1, 6 + len(STEMS))
    known, stems = np.delete(known, range(1, 1 + len(STEMS)), axis=1), known[:, : 1 + len(STEMS)]
    codes = coded.indices.to_numpy()
    owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    filled = known[codes, 5] > 0
    codes, owner = codes[filled], owner[filled]
    total = np.maximum(np.bincount(owner, minlength=n), 1)

    def share(column: np.ndarray, whole: np.ndarray = total) -> np.ndarray:
        return np.bincount(owner, column[codes], minlength=n) / np.maximum(whole, 1)

    letters = np.bincount(owner, known[codes, 1], minlength=n)
    pairs, times = np.unique(owner * len(known) + codes, return_counts=True)
    commonest = np.zeros(n)
    np.maximum.at(commonest, pairs // max(len(known), 1), times)
    again = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[1:][again], minlength=n)
    style = [share(known[:, 2], letters), share(known[:, 0] < 0), share(known[:, 3]), share(known[:, 4]), commonest / total, repeats / total]
    levels = np.stack([np.minimum((s * LEVELS).astype(int), LEVELS - 1) for s in style], axis=1)
    keys = [np.arange(n)[:, None] * PLACES + _style_places()[np.arange(len(style)), levels]]
    once, which = pairs // max(len(known), 1), pairs % max(len(known), 1)
    for column in stems.T:
        held = column[which] >= 0
        keys.append(once[held] * PLACES + column[which[held]])
    keys = np.unique(np.concatenate([k.ravel() for k in keys]))
    return keys // PLACES, keys % PLACES


@functools.cache
def _style_places() -> np.ndarray:
    return np.array([[_place(f"\x00style {i} {j}".encode()) for j in range(LEVELS)] for i in range(16)])


class Ordinal:
    """Weights and thresholds; without training every text has the best grade for sure."""

    def __init__(self, grades: int, weights: np.ndarray | None = None, thresholds: np.ndarray | None = None):
        self.grades = grades
        self.weights = np.zeros(PLACES, np.float32) if weights is None else weights
        self.thresholds = np.full(grades - 1, -np.inf) if thresholds is None else thresholds

    def score(self, owner: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(owner, self.weights[place], minlength=n)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 ... grades - 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -700, 700)))


def faults(rows: list[np.ndarray], y: np.ndarray, grades: int) -> np.ndarray:
    """First weights: log odds of the best grade given a feature, over those without it; 0 for features that are no faults.

    A fault occurs in ``LEAST_TEXTS`` texts, chance does not explain its spread over the grades (chi-squared), and it is much
    rarer (``RARER``, a logarithm) among texts of the best grade.
    """
    none = np.zeros(0, np.int64)
    by = np.stack([np.bincount(np.concatenate([none, *(r for r, g in zip(rows, y) if g == k)]), minlength=PLACES) for k in range(grades)])
    texts = np.bincount(y, minlength=grades)
    expected = by.sum(axis=0) * (texts / len(y))[:, None]
    chi = np.divide((by - expected) ** 2, expected, out=np.zeros_like(expected), where=expected > 0).sum(axis=0)
    odds = np.log((by[-1] + 0.5) / (texts[-1] + 1)) - np.log((by[:-1].sum(axis=0) + 0.5) / (texts[:-1].sum() + 1))
    return np.where((by.sum(axis=0) >= LEAST_TEXTS) & (chi >= LEAST_CHI) & (odds <= -RARER), odds, 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray, grades: int, epochs: int = 20, batch: int = 64, rate: float = 0.3, decay: float = 1e-4) -> Ordinal:
    """AdaGrad on the likelihood; rows are arrays of places. The order of rows is fixed by their place in the input.

    Weights are held at or below zero: features are faults that lower the grade, and no amount of common words makes
    up for them. A text without known faults has the same score at any length.
    """
    seen = np.bincount(y, minlength=grades)
    if np.count_nonzero(seen) < 2:
        return Ordinal(grades)
    weights = faults(rows, y, grades)
    rows = [r[weights[r] < 0] for r in rows]
    power = np.full(PLACES, START_POWER)
    # a first threshold and the logarithms of the gaps: wide at first, as a text may hold one fault of a kind or ten
    free = np.array([-BASE - GAP * (grades - 2), *[np.log(GAP)] * (grades - 2)], np.float64)
    free_power = np.full(len(free), 1e-2)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        turn = order.permutation(len(rows))
        for at in range(0, len(turn), batch):
            which = turn[at : at + batch]
            size = [len(rows[i]) for i in which]
            place = np.concatenate([rows[i] for i in which])
            owner = np.repeat(np.arange(len(which)), size)
            thresholds = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
            score = np.bincount(owner, weights[place], minlength=len(which))
            edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
            with np.errstate(over="ignore"):
                upper, lower = (1 / (1 + np.exp(np.clip(score - edges[y[which] + k], -700, 700))) for k in (1, 0))
            p = np.maximum(upper - lower, 1e-9)
            slope = upper + lower - 1  # of the log likelihood by the score
            gradient = np.bincount(place, slope[owner], minlength=0)
            used = np.unique(place)
            step = gradient[used] / len(which) - decay * weights[used]
            power[used] += step**2
            weights[used] = np.minimum(weights[used] + rate * step / np.sqrt(power[used]), 0)
            by_edge = np.zeros(grades + 1)
            np.add.at(by_edge, y[which] + 1, upper * (1 - upper) / p)
            np.add.at(by_edge, y[which], -lower * (1 - lower) / p)
            by_threshold = by_edge[1:-1] / len(which)
            by_free = np.cumsum(by_threshold[::-1])[::-1]
            by_free[1:] *= np.exp(free[1:])
            free_power += by_free**2
            free += 0.3 * rate * by_free / np.sqrt(free_power)
    return Ordinal(grades, weights.astype(np.float32), np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def train(docs: DataFrame, labels: DataFrame, label: Column, grades: int, most_rows: int = MOST_ROWS) -> Ordinal:
    """The model of at most ``most_rows`` labelled documents, those whose ids hash lowest; rows without text or grade train nothing."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("grade")).filter("doc_id is not null and grade is not null")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(sample), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                owner, place = features(part.column("text").to_pylist())
                starts = np.searchsorted(owner, np.arange(len(part) + 1))
                rows = [place[a:b].astype(np.int32).tobytes() for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), pa.array(rows, pa.binary())], names=["doc_id", "grade", "places"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "grade"], kind="stable").iloc[:most_rows]
        model = fit([np.frombuffer(p, np.int32) for p in group.places], group.grade.to_numpy(np.int64), grades)
        return pd.DataFrame({"weights": [model.weights.tobytes()], "thresholds": [list(map(float, model.thresholds))]})

    prepared = texts.select("doc_id", "grade", "text").mapInArrow(extract, "doc_id long, grade int, places binary")
    row = prepared.groupBy(F.lit("all")).applyInPandas(learn, "weights binary, thresholds array<double>").first()
    return Ordinal(grades) if row is None else Ordinal(grades, np.frombuffer(row.weights, np.float32), np.array(row.thresholds))


def _judge(model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and probability of the best grade."""
    texts = [t or "" for t in texts]
    owner, place = features(texts)
    tails = model.tails(model.score(owner, place, len(texts)))
    return tails.sum(axis=1), tails[:, -1]


def score(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the best grade) and keep (at least ``least``) for each row of ``docs``.

    Null and empty texts have style features alone. Null ids and repeated rows pass through; further columns are ignored; no rows
    give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                expected, tail = _judge(held.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(expected), pa.array(tail), pa.array(tail >= least)], names=["doc_id", "expected_grade", "tail_probability", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(judge, "doc_id long, expected_grade double, tail_probability double, keep boolean")


def select(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that reach ``least``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                _, tail = _judge(held.value, part.column("text").to_pylist())
                yield part.filter(pa.array(tail >= least))

    return docs.mapInArrow(choose, docs.schema)


def op6_quality(spark, sf_dir):
    """Every document graded by a model of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"), grade(), grades=3))


def sound(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    return select(docs, train(docs, labels, grade(), grades=3))
