"""Quality: a factorisation machine over hashed words, structure statistics and what is known of the text's size.

    score = b + sum w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

All pairs of features interact through k factors each; the identity makes a score linear in the features.
Features: hashed words (square roots of counts, scaled to unit length), structure statistics as bins of the training
quantiles, and the same statistics as bounded deviations.  Trained by AdaGrad on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .labelled import held_out, training_sample

#: Labelled texts of either label that training may see.
SAMPLE = 4_000
BUCKETS = 1 << 14
FACTORS = 8
BINS = 8
#: Gradient steps, whatever the size of the sample.
STEPS = 600

#: Byte classes: upper, lower, digit, beyond ASCII, space, newline, and some punctuation of its own.
_CLASS = np.full(256, 15, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 4, 5
for _i, _c in enumerate(b"!|*#$%&.,"):
    _CLASS[_c] = 6 + _i
CLASSES = 16
#: Shares of the classes, then: size, words, word length, distinct words, repeated words, distinct lines, line length.
STATISTICS = CLASSES + 7
_LINES = K.byte_table([10])
_SALT = np.uint64(0x9E3779B97F4A7C15)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive documents: statistics (a row each), and hashed words as (document, bucket, value)."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    shares = np.bincount(doc * CLASSES + _CLASS[buf], minlength=n * CLASSES).reshape(n, CLASSES) / np.maximum(size, 1)[:, None]
    words = K.Words(buf, off, K.SPACES, lower=True)
    count = np.diff(words.doc)
    owner = np.repeat(np.arange(n), count)
    distinct = np.unique(K.mix(words.hash + owner.astype(np.uint64) * _SALT), return_index=True)[1]
    same = np.zeros(len(owner), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    lines = K.Words(buf, off, _LINES, lower=True)
    line_count = np.diff(lines.doc)
    line_owner = np.repeat(np.arange(n), line_count)
    distinct_lines = np.unique(K.mix(lines.hash + line_owner.astype(np.uint64) * _SALT), return_index=True)[1]
    some = np.maximum(count, 1)
    rest = [
        np.log1p(size), np.log1p(count), np.bincount(owner, words.end - words.start, n) / some, np.bincount(owner[distinct], minlength=n) / some,
        np.bincount(owner[same], minlength=n) / some, np.bincount(line_owner[distinct_lines], minlength=n) / np.maximum(line_count, 1), np.log1p(size / np.maximum(line_count, 1)),
    ]
    key, times = np.unique(owner * BUCKETS + (words.hash >> np.uint64(50)).astype(np.int64), return_counts=True)
    at, bucket, value = key // BUCKETS, key % BUCKETS, np.sqrt(times)
    norm = np.sqrt(np.bincount(at, times, n))
    return np.column_stack([shares, *rest]), at, bucket, value / norm[at]


@dataclass
class Machine:
    """Bias, weights and factors; the statistics' quantiles, means and deviations."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    edges: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def entries(self, statistics: np.ndarray, at: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features as (document, feature, value), sorted by document."""
        n = len(statistics)
        z = np.clip((statistics - self.mean) / self.deviation, -4, 4) / 4
        bins = sum((statistics > e).astype(np.int64) for e in self.edges)
        wide = statistics.shape[1]
        who = np.repeat(np.arange(n), wide)
        which = np.tile(np.arange(wide), n)
        scale = 1 / np.sqrt(wide)
        doc = np.concatenate([at, who, who])
        feature = np.concatenate([bucket, BUCKETS + which * BINS + bins.ravel(), BUCKETS + wide * BINS + which])
        x = np.concatenate([value, np.full(len(who), scale), z.ravel() * scale * 2])
        order = np.argsort(doc, kind="stable")
        return doc[order], feature[order], x[order]

    def decide(self, doc: np.ndarray, feature: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decisions and factor sums; every document has features."""
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        linear = np.add.reduceat(self.weights[feature] * x, first)
        vx = self.factors[feature] * x[:, None].astype(self.factors.dtype)
        total = np.add.reduceat(vx, first)
        squares = np.add.reduceat((vx * vx).sum(1), first)
        return self.bias + linear + ((total * total).sum(1) - squares) / 2, total


def fit(statistics: np.ndarray, at: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: np.ndarray, *, steps: int = STEPS, rate: float = 0.1, shrink: float = 1e-5, batch: int = 128, seed: int = 11) -> Machine:
    """Train on documents 0..n-1.  Without either label every score is the smoothed share of label 1."""
    n, wide = len(y), statistics.shape[1]
    size = BUCKETS + wide * (BINS + 1)
    rng = np.random.default_rng(seed)
    share = (y.sum() + 1) / (n + 2)
    edges = np.quantile(statistics, np.arange(1, BINS) / BINS, axis=0) if n else np.zeros((BINS - 1, wide))
    mean, deviation = (statistics.mean(0), np.maximum(statistics.std(0), 1e-9)) if n else (np.zeros(wide), np.ones(wide))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, FACTORS)), edges, mean, deviation)
    if not n or y.min() == y.max():
        return m
    m.factors = rng.normal(0, 0.05, (size, FACTORS))
    doc, feature, x = m.entries(statistics, at, bucket, value)
    starts = np.searchsorted(doc, np.arange(n + 1))
    gw, gv, gb = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(-(-steps * batch // n)):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            some = order[lo : lo + batch]
            length = starts[some + 1] - starts[some]
            place = np.repeat(starts[some] - np.cumsum(length) + length, length) + np.arange(length.sum())
            row = np.repeat(np.arange(len(some)), length)
            f, v = feature[place], x[place]
            decision, total = m.decide(row, f, v)
            slope = (1 / (1 + np.exp(-np.clip(decision, -30, 30))) - y[some]) / len(some)
            used, where = np.unique(f, return_inverse=True)
            dw = np.bincount(where, slope[row] * v, len(used)) + shrink * m.weights[used]
            each = slope[row, None] * v[:, None] * (total[row] - m.factors[f] * v[:, None])
            dv = np.column_stack([np.bincount(where, each[:, k], len(used)) for k in range(FACTORS)]) + shrink * m.factors[used]
            db = slope.sum()
            gw[used] += dw**2
            gv[used] += dv**2
            gb += db**2
            m.weights[used] -= rate * dw / np.sqrt(gw[used])
            m.factors[used] -= rate * dv / np.sqrt(gv[used])
            m.bias -= rate * db / np.sqrt(gb)
    m.weights, m.factors = m.weights.astype(np.float32), m.factors.astype(np.float32)
    return m


def _known(batch: pa.RecordBatch, metadata: int) -> np.ndarray:
    """The batch's last columns as two statistics each: the logarithm of its size with the sign, and whether it's missing."""
    columns = [np.asarray(batch.column(batch.num_columns - metadata + i).to_numpy(zero_copy_only=False), float) for i in range(metadata)]
    gone = [~np.isfinite(c) for c in columns]
    return np.column_stack([f(c, g) for c, g in zip(columns, gone, strict=True) for f in (lambda c, g: np.sign(np.where(g, 0, c)) * np.log1p(np.abs(np.where(g, 0, c))), lambda c, g: g.astype(float))]) if metadata else np.zeros((batch.num_rows, 0))


def _features_of(batches: Iterator[pa.RecordBatch], metadata: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = K.binary_column(batch, "text")
        known = _known(batch, metadata)
        for lo, hi in K.slices(off):
            statistics, at, bucket, value = features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            statistics = np.hstack([statistics, known[lo:hi]])
            cuts = np.searchsorted(at, np.arange(hi - lo + 1)).tolist()
            cells = [(bucket[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float32).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s.tobytes() for s in statistics]), pa.array([b for b, _ in cells]), pa.array([v for _, v in cells])], names=["doc_id", "label", "statistics", "buckets", "vals"])


def _metadata(docs: DataFrame, metadata: list[str]) -> list[Column]:
    """Numeric columns under names of their own, so that none clashes."""
    return [F.col(f"`{c}`").cast("double").alias(f"_meta{i}") for i, c in enumerate(metadata)]


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE, metadata: list[str] | None = None) -> Machine:
    """Fit on at most ``sample`` labelled documents of either label that are not held out."""
    metadata = metadata or []
    wide, more = STATISTICS + 2 * len(metadata), [f"_meta{i}" for i in range(len(metadata))]
    rows = training_sample(docs.select("doc_id", "text", *_metadata(docs, metadata)), labels, label, each=sample, columns=more).select("doc_id", "label", "text", *more).mapInArrow(lambda it: _features_of(it, len(metadata)), "doc_id long, label int, statistics binary, buckets binary, vals binary").toArrow()
    order = sorted(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), rows["statistics"].to_pylist(), rows["buckets"].to_pylist(), rows["vals"].to_pylist(), strict=True))
    statistics = np.frombuffer(b"".join(r[2] for r in order)).reshape(-1, wide)
    bucket = np.frombuffer(b"".join(r[3] for r in order), np.int32).astype(np.int64)
    value = np.frombuffer(b"".join(r[4] for r in order), np.float32).astype(np.float64)
    at = np.repeat(np.arange(len(order)), [len(r[3]) // 4 for r in order]) if order else np.zeros(0, np.int64)
    return fit(statistics, at, bucket, value, np.array([r[1] for r in order], float))


def _scored(batches: Iterator[pa.RecordBatch], machine: Machine, threshold: float, metadata: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = K.binary_column(batch, "text")
        known = _known(batch, metadata)
        for lo, hi in K.slices(off):
            statistics, at, bucket, value = features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            decision, _ = machine.decide(*machine.entries(np.hstack([statistics, known[lo:hi]]), at, bucket, value))
            score = 1 / (1 + np.exp(-np.clip(decision.astype(np.float64), -40, 40)))
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", threshold: float = 0.3, sample: int = SAMPLE, metadata: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``threshold``), a row for each row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and ``label`` (0 or 1); only rows that are not held out are learnt from.  Of a document nothing but
    its text and the numeric columns ``metadata`` is looked at; a null text is an empty one, which has a score by its
    statistics, and a null or non-finite number is a feature of its own.  Equal rows have equal scores.  Without labels of
    both kinds the score is the smoothed share of label 1 for all.
    """
    metadata = metadata or []
    machine = train(docs, labels, label=label, sample=sample, metadata=metadata)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", *_metadata(docs, metadata))
    return rows.mapInArrow(lambda it: _scored(it, machine, threshold, len(metadata)), "doc_id long, held_out boolean, score double, predicted int")
