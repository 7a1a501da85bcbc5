"""Quality classifier: a convolutional network over bytes, in numpy.

A text is its UTF-8 bytes in blocks of ``BLOCK``; every byte has a learned vector. Learned
filters of two blocks' width are moved by one block inside a chunk. Chunks of two segments overlap by one
segment and cover the whole document; in a chunk each filter keeps its greatest value. A
linear unit on the rectified values gives the chunk's evidence, whose mean over all chunks
goes through a sigmoid: one probability for the document. Texts of up to two segments are one chunk, filled up.

Fitting: at most ``rows_per_class`` labelled rows of each class outside the held-out fold,
those with the smallest hash of their id, with all their chunks. The sample is dealt into ``parts``
by a hash of the id. In each round every part goes on from the common parameters by gradient steps on its own
rows, in a task, and the parameters of all parts are averaged by their numbers of rows. Only
parameters are gathered (some kilobytes a part). Scores are moved from the sample's share of classes to
that of all labelled rows outside the fold. Scoring reads every byte of every document.

Null and empty texts are one empty chunk and get a score. With no labelled rows of one of
the classes every score is the share of good labels, or 0.5 without labels. Repeated label
rows count once; an id with both labels counts in both. Equal texts get equal scores; ties of a maximum go to the
first block. An empty table gives an empty table. Further columns are not touched.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.llm.common import slices
from geoflow.llm.folds import first_by_hash, held_out
from geoflow.session import cut, scope

BLOCK, SEGMENT, PAD = 4, 256, 256
_PER = SEGMENT // BLOCK
#: Chunks whose activations are held at a time.
CHUNKS = 256


@dataclass(frozen=True)
class Shape:
    """``rows_per_class`` bounds the rows that are learned from; texts are never cut."""

    vector: int = 8
    filters: int = 24
    rows_per_class: int = 2_000
    parts: int = 6
    rounds: int = 24
    batch: int = 24
    rate: float = 0.01
    seed: int = 5


class Net:
    """Parameters, and scores of texts."""

    def __init__(self, shape: Shape):
        draw = np.random.default_rng(shape.seed)
        wide = BLOCK * shape.vector
        self.vectors = draw.normal(0, 0.5, (257, shape.vector)).astype(np.float32)
        self.vectors[PAD] = 0
        self.filters = draw.normal(0, 1 / math.sqrt(2 * wide), (2, wide, shape.filters)).astype(np.float32)
        self.bias = np.zeros(shape.filters, np.float32)
        self.weights = draw.normal(0, 0.1, shape.filters).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.prior = 0.0

    @property
    def params(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.weights, self.shift]

    def segments(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest value of each filter in each segment, if the chunk goes on after it, and if it ends there."""
        n = self.bias.size
        blocks = self.vectors[values].reshape(-1, BLOCK * self.vectors.shape[1])
        both = blocks @ np.concatenate([self.filters[0], self.filters[1]], axis=1)
        out = both[:, :n].reshape(-1, _PER, n).copy()
        last = out[:, -1].copy()
        out.reshape(-1, n)[:-1] += both[1:, n:]
        rest = out[:, :-1].max(axis=1)
        return np.maximum(rest, out[:, -1]), np.maximum(rest, last)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        data = [(t or "").encode() for t in texts]
        counts = np.array([segment_count(d) for d in data])
        values = np.full(counts.sum() * SEGMENT, PAD, np.int16)
        ends = np.cumsum(counts)
        for d, at in zip(data, ((ends - counts) * SEGMENT).tolist()):
            values[at:at + len(d)] = np.frombuffer(d, np.uint8)
        going, ending = self.segments(values)
        evidence = np.zeros(len(going), np.float32)
        evidence[:-1] = np.maximum(np.maximum(going[:-1], ending[1:]) + self.bias, 0) @ self.weights
        evidence[ends - 1] = 0  # the last segment of a text begins no chunk
        logit = np.add.reduceat(evidence, ends - counts) / (counts - 1) + self.shift + self.prior
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60).astype(np.float64)))


def segment_count(data: bytes) -> int:
    return max(2, -(-len(data) // SEGMENT))


def chunks_of(data: bytes, first: int, end: int) -> np.ndarray:
    """The chunks ``first`` to ``end`` of a text, one in a row, filled up with ``PAD``."""
    part = np.full((end - first + 1) * SEGMENT, PAD, np.int16)
    own = np.frombuffer(data[first * SEGMENT:(end + 1) * SEGMENT], np.uint8)
    part[:len(own)] = own
    halves = part.reshape(-1, SEGMENT)
    return np.concatenate([halves[:-1], halves[1:]], axis=1)


def _blocks(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """(row, first chunk, end) of all chunks, ``CHUNKS`` or a little more in each list."""
    out, size = [[]], 0
    for row, data in enumerate(texts):
        count = segment_count(data) - 1
        for first in range(0, count, CHUNKS):
            end = min(count, first + CHUNKS)
            if size and size + end - first > CHUNKS:
                out.append([])
                size = 0
            out[-1].append((row, first, end))
            size += end - first
    return out


def gradient(net: Net, texts: list[bytes], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean logistic loss of some rows, and its gradient, which goes to the place that each maximum was taken from.

    Chunks are taken ``CHUNKS`` at a time, first for the evidence of the rows and again for the gradient.
    """
    wide, blocks_ = net.filters.shape[1], _blocks(texts)
    counts = np.array([segment_count(d) - 1 for d in texts])
    evidence = np.zeros(len(texts))
    kept = []
    for block in blocks_:
        x = np.concatenate([chunks_of(texts[r], a, b) for r, a, b in block])
        owner = np.repeat([r for r, _, _ in block], [b - a for _, a, b in block])
        blocks = net.vectors[x].reshape(len(x), -1, wide)
        out = blocks @ net.filters[0]
        out[:, :-1] += blocks[:, 1:] @ net.filters[1]
        place = out.argmax(axis=1)  # chunk, filter
        top = np.take_along_axis(out, place[:, None], axis=1)[:, 0] + net.bias
        evidence += np.bincount(owner, np.maximum(top, 0) @ net.weights, len(texts))
        kept.append((owner, place, top))
    logit = np.clip(evidence / counts + net.shift, -30, 30)
    chance = 1 / (1 + np.exp(-logit))
    loss = float(np.mean(np.logaddexp(0, logit) - labels * logit))
    error = (chance - labels) / len(texts)
    grads = [np.zeros_like(p) for p in net.params]
    grads[4][0] = error.sum()
    for block, (owner, place, top) in zip(blocks_, kept):
        x = np.concatenate([chunks_of(texts[r], a, b) for r, a, b in block])
        per_chunk = (error / counts)[owner].astype(net.weights.dtype)
        back = per_chunk[:, None] * net.weights * (top > 0)
        row = np.arange(len(x))[:, None]
        byte = x.reshape(len(x), -1, BLOCK)
        inside = place + 1 < byte.shape[1]
        for side, at in ((0, place), (1, np.minimum(place + 1, byte.shape[1] - 1))):
            own = back if side == 0 else back * inside
            held = net.vectors[byte[row, at]].reshape(len(x), -1, wide)
            grads[1][side] += np.einsum("cf,cfw->wf", own, held)
            np.add.at(grads[0], byte[row, at].ravel(), (own[..., None] * net.filters[side].T[None]).reshape(-1, net.vectors.shape[1]))
        grads[2] += back.sum(axis=0)
        grads[3] += per_chunk @ np.maximum(top, 0)
    grads[0][PAD] = 0
    return loss, grads


class Steps:
    """Adam on the parameters of a network."""

    def __init__(self, net: Net, rate: float) -> None:
        self.net, self.rate, self.n = net, rate, 0
        self.first, self.second = ([np.zeros_like(p) for p in net.params] for _ in range(2))

    def step(self, texts: list[bytes], labels: list[int]) -> None:
        _, grads = gradient(self.net, texts, np.array(labels))
        self.n += 1
        for p, g, m, v in zip(self.net.params, grads, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.999**self.n)) + 1e-8)).astype(p.dtype)


def _round(start: Net, shape: Shape, rate: float):
    """Rows (part, label, text), sorted by part, to the parameters that each part comes to: (part, n, params)."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, steps, n = None, None, 0
        texts: list[bytes] = []
        labels: list[int] = []

        def step() -> None:
            if texts:
                steps.step(texts, labels)
                texts.clear(), labels.clear()

        def out() -> pa.RecordBatch:
            step()
            params = np.concatenate([p.ravel() for p in steps.net.params]).astype("<f4")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([params.tobytes()], pa.binary())],
                                              ["part", "n", "params"])

        for batch in batches:
            for begin, some in slices(batch.column(2)):
                own = zip(*(batch.column(k).slice(begin, len(some)).to_pylist() for k in (0, 1)), some)
                for now, label, text in own:
                    if now != part:
                        if part is not None:
                            yield out()
                        part, steps, n = now, Steps(copy.deepcopy(start), rate), 0
                    texts.append((text or "").encode()), labels.append(label)
                    n += 1
                    if len(texts) == shape.batch:
                        step()
        if part is not None:
            yield out()

    return made


def fit(rows: DataFrame, shape: Shape) -> Net:
    """Fit to the kept rows ``id, label, text``; one small job for each round."""
    net = Net(shape)
    part = F.pmod(F.xxhash64(F.lit(shape.seed), "id"), F.lit(shape.parts)).cast("int")
    for turn in range(shape.rounds):
        # Another order of the rows in each round; equal rows are in any order, which makes no difference.
        order = F.xxhash64(F.lit(turn), "id")
        dealt = rows.select(part.alias("part"), order.alias("_order"), "id", "label", "text").repartition("part").sortWithinPartitions("part", "_order", "id", "label", "text")
        rate = shape.rate * (1 - turn / shape.rounds)
        found = dealt.select("part", "label", "text").mapInArrow(_round(net, shape, rate), "part int, n long, params binary").toArrow().sort_by("part")
        weights = found.column("n").to_numpy()
        mean = np.average([np.frombuffer(p, "<f4").astype(np.float64) for p in found.column("params").to_pylist()], axis=0, weights=weights)
        at = 0
        for p in net.params:
            p[...] = mean[at:at + p.size].reshape(p.shape)
            at += p.size
    return net


def train(docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), label: str = "quality", modulus: int = 3, rest: int = 1,
          id_col: str = "doc_id", text: str = "text") -> Net:
    """Fit on labelled rows outside the held-out fold. Runs a few jobs."""
    given = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(id_col), modulus, rest)).select(id_col, F.col(label).cast("int").alias("_label")).distinct()
    counts = {r["_label"]: r["n"] for r in given.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if not (counts.get(0) and counts.get(1)):
        net = Net(shape)
        net.weights[:] = 0
        total = sum(counts.values())
        share = min(max((counts.get(1, 0) + 0.5) / (total + 1), 1e-6), 1 - 1e-6)
        net.prior = math.log(share / (1 - share))
        return net
    picked = None
    for value in (0, 1):
        own = first_by_hash(given.where(F.col("_label") == value), id_col, shape.rows_per_class).withColumn("_label", F.lit(value))
        picked = own if picked is None else picked.unionByName(own)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked.withColumnRenamed(id_col, "id")), "id")
    with scope():
        rows = cut(sample.select("id", F.col("_label").alias("label"), "text"))
        n, good = rows.agg(F.count("*"), F.sum("label")).first()
        net = fit(rows, shape) if n else Net(shape)
    net.prior = math.log(counts[1] / counts[0]) - math.log(good / (n - good)) if n and 0 < good < n else 0.0
    return net


def probability(net: Net, text: Column) -> Column:
    """The score of every value of ``text``."""

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        parts = [net.scores(some) for _, some in slices(texts, 1 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text: str = "text",
             modulus: int = 3, rest: int = 1) -> DataFrame:
    """One row per document: ``id_col, held_out, score, predicted``."""
    net = train(docs, labels, shape, modulus=modulus, rest=rest, id_col=id_col, text=text)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col), modulus, rest).alias("held_out"), probability(net, F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
