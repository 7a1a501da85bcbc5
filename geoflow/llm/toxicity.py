"""Toxicity from positive and unlabelled text, with the non-negative risk.

Only confirmed toxic rows are used as examples; all other text is unlabelled. With the
class prior p (the share of toxic rows among labelled rows outside the held-out fold, or
given), the risk of a scorer is

    p * R_pos(+1)  +  max(0, R_unl(-1) - p * R_pos(-1))

The second part estimates the risk on clean text from unlabelled text, and may not fall
below zero: where it would, the step goes the other way, so that the unlabelled toxic rows
are not learned as clean. The scorer is linear over the distinct words of a text (lower
case A-Z; letters and characters beyond ASCII) and beginnings of words, fitted by Adam
in numpy.

Fitting takes at most ``positives`` confirmed rows and ``unlabelled`` rows outside the fold,
those with the smallest hash of their id, and of these only words that ``least`` confirmed
rows have, ``lift`` times as often as clean rows. The clean rate of a word is its unlabelled
rate less the part p of its toxic rate, so a word that only toxic rows use stays at any p. Weights are not negative, so that a
long text doesn't outweigh its insults. Scoring takes the words of whole texts.

Null and empty texts have no words and get the score of the bias. Without confirmed rows
all scores are 0. Repeated label rows count once. Equal texts get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.llm.common import lowered, slices
from geoflow.llm.folds import first_by_hash, held_out
from geoflow.session import cut, scope

_WORD = re.compile(r"[a-z\x80-\U0010FFFF]+")


@dataclass(frozen=True)
class Settings:
    positives: int = 3_000
    unlabelled: int = 9_000
    least: int = 3
    steps: int = 300
    rate: float = 0.05
    decay: float = 1e-3
    lift: float = 3.0
    prior: float | None = None


def words_of(text: str | None) -> set[str]:
    """Distinct words, and the beginnings of longer ones (marked by ``^``), which carry over to inflected forms."""
    if not text:
        return set()
    words = set(_WORD.findall(lowered(text)))
    return words | {"^" + w[:4] for w in words if len(w) > 4} | {"^" + w[:5] for w in words if len(w) > 5}


@dataclass
class Scorer:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        get = self.weights
        total = self.bias + math.fsum(get[w] for w in words_of(text) if w in get)
        return 1 / (1 + math.exp(-min(max(total, -60.0), 60.0)))


def clean_rate(n_positive, n_unlabelled, positive: int, unlabelled: int, prior: float):
    """The rate of a word among clean rows (before it is brought to 0 at least), as unlabelled rows hold the toxic share themselves."""
    return (n_unlabelled / unlabelled - prior * n_positive / positive) / (1 - prior)


def fit(positive: list[list[str]], unlabelled: list[list[str]], prior: float, given: Settings = Settings()) -> Scorer:
    """The scorer of rows that are lists of their words."""
    counts, common = Counter(w for words in positive for w in words), Counter(w for words in unlabelled for w in words)
    sizes = len(positive), len(unlabelled)
    names = sorted(w for w, n in counts.items()
                   if n >= given.least and n / sizes[0] >= given.lift * max(0.0, clean_rate(n, common[w], *sizes, prior)))
    place = {w: k for k, w in enumerate(names)}
    return descend([[place[w] for w in words if w in place] for words in positive + unlabelled], len(positive), names, prior, given)


def risk(z: np.ndarray, n_pos: int, prior: float) -> tuple[float, np.ndarray]:
    """What a step lowers, and its gradient by the rows' logits; the first ``n_pos`` rows are confirmed.

    Usually the risk: that of confirmed rows, and the clean risk estimated from the others. Where that
    estimate is below zero, only its size.
    """
    n_unl = len(z) - n_pos
    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    loss_neg = np.logaddexp(0, z)  # -log(1 - p)
    rest = loss_neg[n_pos:].mean() - prior * loss_neg[:n_pos].mean()
    g = np.empty(len(z))
    if rest >= 0:
        g[:n_pos] = prior * (p[:n_pos] - 1) / n_pos - prior * p[:n_pos] / n_pos
        g[n_pos:] = p[n_pos:] / n_unl
        return prior * float((loss_neg[:n_pos] - z[:n_pos]).mean()) + float(rest), g
    g[:n_pos] = prior * p[:n_pos] / n_pos
    g[n_pos:] = -p[n_pos:] / n_unl
    return -float(rest), g


def descend(rows: list[list[int]], n_pos: int, names: list[str], prior: float, given: Settings) -> Scorer:
    """Minimise the non-negative risk with the logistic loss; rows hold the places of their words in ``names``."""
    index = np.array([k for r in rows for k in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = len(names)
    w, bias = np.zeros(n), np.array([math.log(prior / (1 - prior))])
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, given.steps + 1):
        _, g = risk(np.bincount(owner, w[index], len(rows)) + bias, n_pos, prior)
        grad = np.append(np.bincount(index, g[owner], n) + given.decay * prior, g.sum())
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        move = given.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w = np.maximum(w - move[:n], 0)  # a word may speak for toxicity, never against it
        bias -= move[n:]
    return Scorer({name: float(x) for name, x in zip(names, w) if x > 0}, float(bias[0]))


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in slices(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, len(texts)), pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.string()))],
                ["positive", "words"])


def train(docs: DataFrame, labels: DataFrame, given: Settings = Settings(), label: str = "toxic", modulus: int = 5, rest: int = 0,
          id_col: str = "doc_id", text: str = "text") -> Scorer:
    """Fit on rows outside the held-out fold. Runs a few jobs."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(id_col), modulus, rest)).select(id_col, F.col(label).alias("_label")).distinct()
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    if not toxic:
        return Scorer({}, -60.0)
    # Labels without a clean row don't tell the share.
    prior = given.prior if given.prior is not None else min(max(toxic / total, 1e-4), 0.99 if toxic < total else 0.5)
    sure = first_by_hash(known.where("_label = 1"), id_col, given.positives).withColumn("_positive", F.lit(True))
    others = first_by_hash(docs.where(~held_out(F.col(id_col), modulus, rest)), id_col, given.unlabelled).withColumn("_positive", F.lit(False))
    sample = docs.select(id_col, F.col(text).alias("_text")).join(F.broadcast(sure.unionByName(others)), id_col)
    with scope():
        # Words are counted and chosen in Spark; the driver gets the chosen ones, and of each row their places.
        rows = cut(sample.select("_positive", "_text").mapInArrow(_word_sets, "positive boolean, words array<string>"))
        sizes = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
        n_pos, n_unl = sizes.get(True, 0), sizes.get(False, 0)
        if not n_pos or not n_unl:
            return Scorer({}, math.log(prior / (1 - prior)))
        each = rows.select("positive", F.explode("words").alias("word")).groupBy("word").agg(
            F.sum(F.col("positive").cast("long")).alias("n"), F.sum((~F.col("positive")).cast("long")).alias("common"))
        rare = F.greatest(F.lit(0.0), clean_rate(F.col("n"), F.col("common"), n_pos, n_unl, prior))
        chosen = each.where((F.col("n") >= given.least) & (F.col("n") / n_pos >= given.lift * rare))
        names = sorted(r["word"] for r in chosen.select("word").collect())
        places = rows.select("positive", "words").mapInArrow(_places({w: k for k, w in enumerate(names)}), "positive boolean, places array<int>").toArrow()
    found = sorted(zip([not x for x in places.column("positive").to_pylist()], places.column("places").to_pylist()))  # any order of rows gives one scorer
    return descend([r for _, r in found], n_pos, names, prior, given)


def _places(place: dict[str, int]):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[place[w] for w in words if w in place] for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["positive", "places"])

    return made


def probability(scorer: Scorer, text: Column) -> Column:
    """The score of every value of ``text``."""

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([scorer.score(t) for _, some in slices(texts) for t in some], pa.float64())

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, given: Settings = Settings(), id_col: str = "doc_id", text: str = "text",
             modulus: int = 5, rest: int = 0) -> DataFrame:
    """One row per document: ``id_col, held_out, score, predicted``."""
    scorer = train(docs, labels, given, modulus=modulus, rest=rest, id_col=id_col, text=text)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col), modulus, rest).alias("held_out"), probability(scorer, F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
