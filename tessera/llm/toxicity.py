"""Toxicity: a support vector machine over a gapped subsequence kernel, with Nystroem landmarks.

The kernel of two words counts the subsequences they share, over their norms: of three letters, a gap costing a factor for
each letter it spans, and of five letters, one of which may follow a gap.  A word begins with a mark of its own, so that
a stem at its start counts for more.
Characters that are no letters are dropped from a word, and single letters in a row are read as one word: dots,
digits and spaces inside an insult change nothing, inserted letters little.

A text is judged by the decisions of its three worst words, through a logistic curve.  Training sees labelled texts
only: a word is an example of either side, by the shares of toxic and clean texts that have it, and in turn the
worst words of clean texts are added, for a linear machine in the landmarks' space (K_nm K_mm^-1/2).  As the kernel is a sum over
subsequences, the machine folds into one weight for each subsequence (hashed for five letters): scoring takes eleven look-ups a letter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .labelled import held_out, training_sample

#: Labelled texts of either label that training may see.
SAMPLE = 3_000
LANDMARKS = 320
#: How much more a clean text's word counts than a toxic one's.
CAUTION = 2.0
#: Words whose decisions a text is judged by.
WORST = 3
DECAY = 0.7
#: Places of a subsequence's letters and its weight: three letters over a span of five, where each letter that the span is
#: longer costs DECAY; and five letters, one of which may follow a gap.  The latter tell stems apart, the former short words.
SPAN = 5
_THREE = [((0, a, b), DECAY**b) for b in range(2, 5) for a in range(1, b)]
_FIVE = [((0, 1, 2, 3, 4), 1.0), *((tuple(p for p in range(6) if p != gap), DECAY) for gap in (1, 2, 3, 4))]
PATTERNS = [*_THREE, *_FIVE]

#: Symbols: 0 begins a word, 1-26 letters of either case, 27-58 bytes beyond ASCII; 255 is dropped.
SYMBOLS = 59
_SYMBOL = np.full(256, 255, np.uint8)
_SYMBOL[[*range(65, 91)]] = np.arange(1, 27)
_SYMBOL[[*range(97, 123)]] = np.arange(1, 27)
_SYMBOL[128:] = 27 + (np.arange(128, 256) & 31)
_SYMBOL[K.SPACES] = 0
#: Weights that a machine holds: one for each three symbols, and hashed ones for five.
HASHED = 1 << 21
WEIGHTS = SYMBOLS**3 + HASHED


class Stream:
    """The words of consecutive documents as symbols: each word its mark and then its letters."""

    __slots__ = ("symbols", "start", "length", "doc")

    def __init__(self, buf: np.ndarray, off: np.ndarray) -> None:
        n = len(off) - 1
        symbols = _SYMBOL[np.insert(buf, off[:-1], 32)]
        place = np.flatnonzero(symbols != 255)
        symbols = symbols[place]
        mark = symbols == 0
        last = np.ones(len(symbols), bool)
        last[:-1] = mark[1:]
        stays = ~(mark & last)
        symbols, place = symbols[stays], place[stays]
        self.start = np.flatnonzero(symbols == 0)
        self.doc = np.searchsorted(off[:-1] + np.arange(n), place[self.start], "right") - 1
        self.length = np.diff(self.start, append=len(symbols))
        self.symbols = symbols
        self._join_single_letters()

    def _join_single_letters(self) -> None:
        """Three or more single letters in a row become one word."""
        one = self.length == 2
        goes = np.zeros(len(one), bool)
        goes[1:] = one[1:] & one[:-1] & (self.doc[1:] == self.doc[:-1])
        beside = np.zeros(len(one), bool)
        beside[1:] |= goes[:-1]
        beside[:-1] |= goes[1:]
        goes &= beside
        if goes.any():
            self.symbols = np.delete(self.symbols, self.start[goes])
            self.start = np.flatnonzero(self.symbols == 0)
            self.doc = self.doc[~goes]
            self.length = np.diff(self.start, append=len(self.symbols))

    def word(self, i: int) -> bytes:
        return self.symbols[self.start[i] : self.start[i] + self.length[i]].tobytes()


def _norms(length: np.ndarray) -> np.ndarray:
    """Of a word by its length: the root of its subsequences' squared weights."""
    total = sum(weight**2 * np.maximum(length - places[-1], 0) for places, weight in PATTERNS)
    return np.sqrt(np.maximum(total, 1e-12))


def subsequences(symbols: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each pattern: its weight, and code and validity of the subsequence that begins at each symbol."""
    s = symbols.astype(np.int64)
    inner = np.ones(len(s), bool)
    inside: dict[int, np.ndarray] = {}
    for d in range(1, SPAN + 1):
        inner = inner[: len(s) - d] & (s[d:] != 0) if len(s) > d else np.zeros(0, bool)
        inside[d] = inner
    for places, weight in PATTERNS:
        n = max(0, len(s) - places[-1])
        code = s[:n]
        for p in places[1:]:
            code = code * SYMBOLS + s[p : p + n]
        if len(places) > 3:
            # the top bits of a multiplication spread the codes evenly
            code = ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 21)).astype(np.int64) + SYMBOLS**3
        yield weight, code, inside[places[-1]]


@dataclass
class Model:
    """A weight for each subsequence, the machine's bias, and the logistic curve over its decisions."""

    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def words(self, stream: Stream) -> np.ndarray:
        """The machine's decision for each word."""
        total = np.zeros(len(stream.symbols), np.float32)
        for weight, code, inside in subsequences(stream.symbols):
            total[: len(code)] += self.weights[code] * inside * np.float32(weight)
        if not len(stream.start):
            return np.zeros(0)
        return np.add.reduceat(total, stream.start) / _norms(stream.length) + self.bias

    def documents(self, stream: Stream, n: int) -> np.ndarray:
        """The decisions of the worst words of each document, the worst first: a row of WORST; the bias where words are missing."""
        worst = np.full((n, WORST), self.bias)
        decision = self.words(stream)
        if len(decision):
            first = np.flatnonzero(np.diff(stream.doc, prepend=-1))
            doc, size = stream.doc[first], np.diff(first, append=len(decision))
            for turn in range(WORST):
                best = np.maximum.reduceat(decision, first)
                some = np.isfinite(best)
                worst[doc[some], turn] = best[some]
                # every occurrence of each document's worst word goes: words count once
                decision[decision == np.repeat(best, size)] = -np.inf
        return worst

    def probability(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(decisions @ self.curve[:-1] + self.curve[-1], -40, 40)))


def _stream_of(words: list[bytes]) -> Stream:
    """Distinct words as a stream, a document each."""
    stream = Stream.__new__(Stream)
    stream.symbols = np.frombuffer(b"".join(words), np.uint8)
    stream.length = np.array([len(w) for w in words], np.int64)
    stream.start = np.cumsum(stream.length) - stream.length
    stream.doc = np.arange(len(words))
    return stream


def _features(words: list[bytes], codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised weights of the words' subsequences: a row for each word, a column for each of ``codes``."""
    stream = _stream_of(words)
    owner = np.repeat(np.arange(len(words)), stream.length)
    rows, cols, vals = [], [], []
    for weight, code, inside in subsequences(stream.symbols):
        at = np.flatnonzero(inside)
        rows.append(owner[at]), cols.append(code[at]), vals.append(np.full(len(at), weight))
    row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    if codes is None:
        codes = np.unique(col)
    place = np.minimum(np.searchsorted(codes, col), max(0, len(codes) - 1))
    known = codes[place] == col if len(codes) else np.zeros(len(col), bool)
    out = np.zeros((len(words), len(codes)))
    np.add.at(out, (row[known], place[known]), val[known])
    return out / _norms(stream.length)[:, None], codes


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps."""
    z1 = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    weight = weight / weight.sum()

    def loss(v: np.ndarray) -> float:
        return float((weight * np.maximum(1 - y * (z1 @ v), 0) ** 2).sum() + (penalty * v * v).sum())

    now = loss(w)
    for _ in range(60):
        bad = 1 - y * (z1 @ w) > 0
        a = z1[bad]
        step = np.linalg.solve((a * weight[bad, None]).T @ a + np.diag(penalty), a.T @ (weight[bad] * y[bad])) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now - 1e-12:
            size /= 2
        if size <= 1e-4:
            break
        w = w + size * step
        now = loss(w)
    return w[:-1], float(w[-1])


def fit(texts: Iterable[tuple[int, list[bytes]]], *, landmarks: int = LANDMARKS, rounds: int = 5) -> Model:
    """Train on (label, distinct words) of labelled texts.  Without either label every score is the share of label 1."""
    number: dict[bytes, int] = {}
    every = [(y, np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32)) for y, words in texts]
    docs = [(y, d) for y, d in every if len(d)]
    toxic, clean = [d for y, d in docs if y], [d for y, d in docs if not y]
    share = sum(y for y, _ in every) / max(1, len(every))
    blank = Model(np.zeros(WEIGHTS, np.float32), 0.0, np.append(np.zeros(WORST), np.log((share + 1e-3) / (1 - share + 1e-3))))
    if not toxic or not clean:
        return blank
    words, n = list(number), len(number)
    p = np.bincount(np.concatenate(toxic), minlength=n)
    q = np.bincount(np.concatenate(clean), minlength=n)
    odds = np.log((p + 0.5) / (len(toxic) + 1)) - np.log((q + 0.5) / (len(clean) + 1))
    ranked = np.lexsort((np.arange(n), -odds))
    telling = [i for i in ranked[: 3 * landmarks] if p[i] > 1 and odds[i] > 0 and len(words[i]) > 3][: landmarks * 3 // 4]
    usual = [i for i in np.lexsort((np.arange(n), -q)) if len(words[i]) > 3][: landmarks - len(telling)]
    marks = sorted(set(telling) | set(usual))
    if not marks:
        return blank
    phi, codes = _features([words[i] for i in marks], None)
    value, vector = np.linalg.eigh(phi @ phi.T)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    # a word stands on both sides, weighed by the shares of toxic and of clean texts that have it
    often = [i for i in ranked if p[i] > 1 and odds[i] > 1][:1500] + np.lexsort((np.arange(n), -q))[:1500].tolist()
    plus = np.zeros(n)
    minus = np.zeros(n)
    plus[often] = p[often] / len(toxic)
    minus[often] = CAUTION * (q[often] + 0.5) / len(clean)
    model, decision = blank, np.zeros(n)
    for turn in range(rounds):
        if turn:
            # the worst word of each clean text, if it's on the wrong side
            worst = np.array([d[np.argmax(decision[d])] for d in clean])
            new = np.bincount(worst[decision[worst] > -0.5], minlength=n)
            fresh = (new > 0) & (plus + minus == 0)
            plus[fresh] = p[fresh] / len(toxic)
            minus = np.maximum(minus, CAUTION * np.where(new > 0, np.maximum(new, q), 0) / len(clean))
        rows = np.flatnonzero(plus + minus)
        z = np.vstack([_features([words[i] for i in rows[at : at + 128]], codes)[0] @ phi.T for at in range(0, len(rows), 128)]) @ root
        both = np.concatenate([plus[rows], minus[rows]])
        y = np.repeat([1.0, -1.0], len(rows))
        some = both > 0
        w, bias = _machine(np.vstack([z, z])[some], y[some], both[some])
        table = np.zeros(WEIGHTS, np.float32)
        table[codes] = phi.T @ (root @ w)
        model = Model(table, bias, blank.curve)
        # some words at a time: the driver holds little beside them
        decision = np.concatenate([model.words(_stream_of(words[at : at + 20_000])) for at in range(0, n, 20_000)])
    top = [np.sort(decision[d])[::-1][:WORST] for _, d in docs]
    model.curve = _logistic(np.array([np.append(t, np.full(WORST - len(t), model.bias)) for t in top]), np.array([y for y, _ in docs], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients and offset of a logistic curve, with a little shrinkage."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    shrink = np.diag([1e-1] * (len(w) - 1) + [1e-6])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (s * (1 - s) + 1e-9)[:, None]).T @ x + shrink, x.T @ (s - y) + shrink @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each sampled text its distinct words, joined by a byte that no symbol has."""
    for batch in batches:
        buf, off = K.binary_column(batch, "text")
        for lo, hi in K.slices(off):
            stream = Stream(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            bounds = np.searchsorted(stream.doc, np.arange(hi - lo + 1))
            words = [b"\xff".join(sorted({stream.word(i) for i in range(a, b)})) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words, pa.binary())], names=["label", "words"])


def _scored(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = K.binary_column(batch, "text")
        for lo, hi in K.slices(off):
            stream = Stream(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            score = model.probability(model.documents(stream, hi - lo))
            own = batch.slice(lo, hi - lo)
            rest = [own.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*(n for n in batch.schema.names if n != "text"), "score", "predicted"])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of either label that are not held out."""
    rows = training_sample(docs, labels, label, each=sample).select("label", "text").mapInArrow(_words_of, "label int, words binary").toArrow()
    # in a fixed order, whatever the tasks' was
    pairs = sorted(zip(rows["label"].to_pylist(), rows["words"].to_pylist(), strict=True))
    del rows
    return fit((y, w.split(b"\xff") if w else []) for y, w in pairs)


def without_toxic(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any other columns) whose score is below ``threshold``, with all their columns.

    Each row is judged by its own text, whatever its id: null and repeated ids included.  A null text is an empty one.
    """
    model = train(docs, labels, label=label, sample=sample)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(lambda it: _below(it, model, threshold), rows.schema).select("row.*")


def _below(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = K.binary_column(K.texts_of(batch), "text")
        for lo, hi in K.slices(off):
            stream = Stream(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            clean = model.probability(model.documents(stream, hi - lo)) < threshold
            yield batch.slice(lo, hi - lo).filter(pa.array(clean))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``threshold``), a row for each row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and ``label`` (0 or 1); only rows that are not held out are learnt from.  A null or empty text
    has the score of a document without words; equal texts have equal scores.  Without labels of both
    kinds the score is the smoothed share of label 1 for all.
    """
    model = train(docs, labels, label=label, sample=sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _scored(it, model, threshold), "doc_id long, held_out boolean, score double, predicted int")
