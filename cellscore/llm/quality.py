"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. What speaks for either is the line's own format (lengths, shares of kinds of characters,
repeated words; every measure cut into bins) and the same measures of the lines before and after it; a chain over the
lines of a document ties neighbours together. Forward-backward gives each line's probability of being good, and the
mean of these, weighted by line length, is the document's quality. A logistic curve fitted on the training documents
turns it into the score.

The model is fitted on the driver, on the measures (not the texts) of at most ``SAMPLE`` labelled documents, those with
the smallest hashes of doc_id among the training rows; a document's lines all have its label, and documents of over
``LINES`` lines are left out of the fit. Training rows are those whose crc32(doc_id as text) mod 5 is not 0. Scoring
covers every row and whole texts.

Null and empty texts are one empty line. A null doc_id counts as held out. Without labels of both classes every score
is 0.5. Repeated rows each get their row; other columns are passed through, and no column but text is an input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.llm.arrow import SPACE, Words, flat, slices
from cellscore.llm.store import read_table

SAMPLE, LINES, THRESHOLD = 6000, 2000, 0.3
BINS, STEPS, RATE, DECAY = 8, 120, 0.1, 1e-3


def _kinds() -> list[np.ndarray]:
    """Tables of bytes: capitals, digits, sentence marks, other ASCII symbols, white space, beyond ASCII."""
    b = np.arange(256)
    capital, digit, space = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), SPACE
    mark = np.isin(b, list(b".,;:?'-"))
    letter = ((b >= 97) & (b <= 122)) | capital
    beyond = b >= 128
    return [capital, digit, mark, ~(letter | digit | mark | space | beyond), space, beyond]


KINDS = [k.astype(np.int32) for k in _kinds()]
MEASURES = 6 + len(KINDS) + 2


def line_measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; MEASURES of each line; its weight (bytes, at least 1)."""
    data, off = flat(texts)
    words = Words(texts, SPACE)
    breaks = np.flatnonzero(data == 10)
    lines = 1 + np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1])
    start, end = np.sort(np.concatenate((off[:-1], breaks + 1))), np.sort(np.concatenate((breaks, off[1:])))
    size = (end - start).astype(np.float64)
    per_byte = np.maximum(size, 1)
    shares = []
    for kind in KINDS:
        total = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int64)))
        shares.append((total[end] - total[start]) / per_byte)
    a, b = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    n = b - a
    per_word = np.maximum(n, 1)
    length = words.end - words.start

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[b] - total[a]

    again = []
    for back in (1, 2):
        same = np.zeros(len(words.hash), dtype=bool)
        same[back:] = words.hash[back:] == words.hash[:-back]
        again.append(count(same) / per_word)
    last = np.where(size > 0, data[np.maximum(end - 1, 0)] if len(data) else 0, 0)
    first = np.where(size > 0, data[np.minimum(start, max(len(data) - 1, 0))] if len(data) else 0, 0)
    columns = [
        np.log1p(size), np.log1p(n), count(length) / per_word, count(length <= 3) / per_word, *again, *shares,
        np.isin(last, list(b".!?:")).astype(float), ((first >= 65) & (first <= 90)).astype(float),
    ]
    return lines, np.stack(columns, axis=1), per_byte


@dataclass
class Chain:
    """Bin edges, weights (own, previous and next line) and transitions of the field; slope and offset of the score."""

    edges: list[np.ndarray]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def binned(self, measures: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, measures[:, k], "right") for k, e in enumerate(self.edges)], axis=1)


class Layout:
    """Documents in order of falling line count, so that the ones with a line t are the first ``active[t]``."""

    def __init__(self, lines: np.ndarray):
        self.first = np.concatenate(([0], np.cumsum(lines)))[:-1]
        self.total = int(lines.sum())
        order = np.argsort(-lines, kind="stable")
        self.begin = self.first[order]
        ordered = lines[order]
        self.steps = int(ordered[0]) if len(ordered) else 0
        self.active = np.searchsorted(-ordered, -np.arange(self.steps), "left")
        place = np.ones(self.total, dtype=bool)
        place[self.first] = False
        self.has_before = place
        self.has_after = np.append(place[1:], False) if self.total else place

    def rows(self, t: int, n: int | None = None) -> np.ndarray:
        return self.begin[: self.active[t] if n is None else n] + t


def evidence(chain: Chain, bins: np.ndarray, layout: Layout) -> np.ndarray:
    """Log weight of good against bad for each line, without its neighbours' states."""
    at = np.arange(bins.shape[1])
    out = chain.own[at, bins].sum(axis=1) + chain.bias
    out[layout.has_before] += chain.before[at, bins[np.flatnonzero(layout.has_before) - 1]].sum(axis=1)
    out[layout.has_after] += chain.after[at, bins[np.flatnonzero(layout.has_after) + 1]].sum(axis=1)
    return out


def forward_backward(u: np.ndarray, moves: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """alpha and beta (log, lines x 2), and the probability that each line is good."""
    unary = np.stack((np.zeros_like(u), u), axis=1)
    alpha, beta = unary.copy(), np.zeros_like(unary)
    for t in range(1, layout.steps):
        now = layout.rows(t)
        prev = alpha[now - 1]
        for j in (0, 1):
            alpha[now, j] += np.logaddexp(prev[:, 0] + moves[0, j], prev[:, 1] + moves[1, j])
    for t in range(layout.steps - 1, 0, -1):
        now = layout.rows(t)
        into = unary[now] + beta[now]
        for i in (0, 1):
            beta[now - 1, i] = np.logaddexp(moves[i, 0] + into[:, 0], moves[i, 1] + into[:, 1])
    s = alpha + beta
    return alpha, beta, 1 / (1 + np.exp(np.clip(s[:, 0] - s[:, 1], -500, 500)))


def document_mean(p: np.ndarray, weight: np.ndarray, lines: np.ndarray) -> np.ndarray:
    if not len(lines):
        return np.zeros(0)
    first = np.concatenate(([0], np.cumsum(lines)))[:-1]
    return np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)


def logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def fit(lines: np.ndarray, measures: np.ndarray, weight: np.ndarray, labels: np.ndarray) -> Chain:
    """Maximum conditional likelihood of the lines' labels with squared weights as penalty, by Adam's steps."""
    edges = [np.unique(np.quantile(measures[:, k], np.arange(1, BINS) / BINS)) for k in range(MEASURES)]
    shape = (MEASURES, BINS)
    chain = Chain(edges, np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros((2, 2)))
    bins, layout = chain.binned(measures), Layout(lines)
    y = np.repeat(labels, lines).astype(np.float64)
    pairs = np.flatnonzero(layout.has_before)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[pairs - 1].astype(int), y[pairs].astype(int)), 1)
    at = np.arange(MEASURES) * BINS
    index = bins + at

    def spread(residual: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bincount(index[rows].ravel(), np.repeat(residual, MEASURES), MEASURES * BINS).reshape(shape)

    names = ["own", "before", "after", "moves", "bias"]
    first, second = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    every = np.arange(layout.total)
    for step in range(1, STEPS + 1):
        u = evidence(chain, bins, layout)
        alpha, beta, p = forward_backward(u, chain.moves, layout)
        residual = y - p
        joint = alpha[pairs - 1][:, :, None] + chain.moves + (np.stack((np.zeros(len(pairs)), u[pairs]), axis=1) + beta[pairs])[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True)) if len(pairs) else joint
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(pairs) else np.zeros((2, 2))
        gradient = {
            "own": spread(residual, every), "before": spread(residual[pairs], pairs - 1), "after": spread(residual[pairs - 1], pairs), "moves": seen - expected, "bias": residual.sum(),
        }
        for k in names:
            g = gradient[k] / layout.total - DECAY * getattr(chain, k) * (k != "bias")
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            move = RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            setattr(chain, k, getattr(chain, k) + move)
    p = forward_backward(evidence(chain, bins, layout), chain.moves, layout)[2]
    x = logit(document_mean(p, weight, lines))
    for _ in range(50):  # Newton's steps of a logistic regression with a small penalty
        s = 1 / (1 + np.exp(-np.clip(chain.slope * x + chain.offset, -30, 30)))
        r, w = labels - s, s * (1 - s) + 1e-9
        g = np.array([(r * x).sum() - 1e-2 * chain.slope, r.sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 1.0 / np.abs(d).max())
        chain.slope, chain.offset = chain.slope + d[0], chain.offset + d[1]
    return chain


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, ...]:
    """lines, measures, weights and labels of the sample, in order of doc_id."""
    chosen = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most SAMPLE rows are sent

    def measure(batches):
        for batch in slices(batches):
            lines, measures, _ = line_measures(batch.column("text"))
            size = np.exp(measures[:, 0]) - 1
            ends = np.cumsum(lines)
            packed = [None if n > LINES else np.column_stack((measures[e - n : e], size[e - n : e])).astype("<f4").tobytes() for n, e in zip(lines.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "label", "packed"])

    got = rows.select("doc_id", "label", "text").mapInArrow(measure, "doc_id bigint, label int, packed binary").where("packed is not null").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["packed"]))
    parts = [np.frombuffer(r["packed"], "<f4").reshape(-1, MEASURES + 1).astype(np.float64) for r in got]
    every = np.concatenate(parts) if parts else np.zeros((0, MEASURES + 1))
    return np.array([len(p) for p in parts], dtype=np.int64), every[:, :-1], np.maximum(every[:, -1], 1), np.array([r["label"] for r in got], dtype=np.float64)


def train(docs: DataFrame, labels: DataFrame) -> Chain | None:
    lines, measures, weight, y = training_rows(docs, labels)
    return fit(lines, measures, weight, y) if len(set(y.tolist())) == 2 else None


def scores(chain: Chain | None, texts: pa.Array) -> np.ndarray:
    if chain is None:
        return np.full(len(texts), 0.5)
    lines, measures, weight = line_measures(texts)
    layout = Layout(lines)
    bins = chain.binned(measures.astype(np.float32).astype(np.float64))
    p = forward_backward(evidence(chain, bins, layout), chain.moves, layout)[2]
    x = chain.slope * logit(document_mean(p, weight, lines)) + chain.offset
    return np.round(1 / (1 + np.exp(-np.clip(x, -500, 500))), 6)


def score_quality(docs: DataFrame, chain: Chain | None, column: str = "score") -> DataFrame:
    """``docs`` with the column ``column``: the score of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(shared.value, batch.column("text")), pa.float64())], [*batch.schema.names, column])

    docs = docs.drop(column)
    return docs.mapInArrow(run, docs.withColumn(column, F.lit(0.0).cast("double")).schema)


def accepted():
    return F.col("score") >= THRESHOLD


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", accepted().cast("int").alias("predicted"))
