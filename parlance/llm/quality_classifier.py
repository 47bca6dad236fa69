"""Quality classifier: naive Bayes support vectors.

A text becomes the set of its n-grams: words, word shapes in ones to threes,
repetitions of the word before, and repeated lines, each hashed to one of 2 ** BITS
indicators. Every indicator is scaled by the log ratio of its smoothed class
counts, and a linear hinge-loss model over the scaled indicators is fitted by dual
coordinate descent. Margins become scores by a logistic fit to out-of-fold margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import Texts, mix, pieces, span_hashes, texts_of, word_spans

BITS = 20
#: Learned from at most so many labelled rows; documented bound of the sample.
SAMPLE_ROWS = 12_000
#: Indicators of these rows that are taken at most, four bytes each.
SAMPLE_INDICATORS = 40_000_000
THRESHOLD = 0.3

_KIND = np.arange(256, dtype=np.uint8)
_KIND[0x80:] = _KIND[0x61:0x7B] = ord("a")
_KIND[0x41:0x5B] = ord("A")
_KIND[0x30:0x3A] = ord("0")
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: kinds of characters, each run of a kind written once."""
    kind = _KIND[data]
    turn = np.ones(len(kind), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[starts] = True
    kept = np.flatnonzero(turn)
    a, b = np.searchsorted(kept, starts), np.searchsorted(kept, ends)
    return span_hashes(kind[kept], a, b, seed=3)


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, indicator) pairs, sorted: the texts and the indicators."""
    starts, ends, first = word_spans(t)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(t), dtype=np.uint64), np.diff(first))
    word, shape = span_hashes(t.data, starts, ends, seed=2), _shapes(t.data, starts, ends)
    same1 = np.zeros(n, bool)
    same1[1:] = of[1:] == of[:-1]
    same2 = np.zeros(n, bool)
    same2[2:] = of[2:] == of[:-2]
    again = np.zeros(n, bool)
    again[1:] = same1[1:] & (word[1:] == word[:-1])
    twice = again.copy()
    twice[1:] &= again[:-1]
    two = shape[1:] + shape[:-1] * np.uint64(3)
    three = two[1:] + shape[:-2] * np.uint64(17)
    made = [(of, word), (of, shape + np.uint64(1)), (of[1:][same1[1:]], two[same1[1:]] + np.uint64(2)), (of[2:][same2[2:]], three[same2[2:]] + np.uint64(3))]
    made += [(of[again], np.full(again.sum(), 5, np.uint64)), (of[twice], np.full(twice.sum(), 6, np.uint64))]
    # lines equal to an earlier line of the text, by how many: 1, 2 to 3, 4 to 7, ...
    ls, le, lfirst = word_spans(t, _NEWLINE)
    lof = np.repeat(np.arange(len(t), dtype=np.uint64), np.diff(lfirst))
    lines = np.sort(mix(lof) ^ span_hashes(t.data, ls, le, seed=4)) if len(ls) else np.zeros(0, np.uint64)
    if len(lines):
        key = mix(lof) ^ span_hashes(t.data, ls, le, seed=4)
        _, at = np.unique(key, return_index=True)
        more = np.bincount(lof.astype(np.int64), minlength=len(t)) - np.bincount(lof[at].astype(np.int64), minlength=len(t))
        some = np.flatnonzero(more)
        made.append((some.astype(np.uint64), np.log2(more[some]).astype(np.uint64) + np.uint64(1000)))
    key = np.concatenate([(o << np.uint64(BITS)) | (mix(f) >> np.uint64(64 - BITS)) for o, f in made])
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # float32, 2 ** BITS: hinge-loss weight times log-count ratio
    bias: float
    slope: float
    shift: float

    def margins(self, t: Texts) -> np.ndarray:
        of, f = features(t)
        return np.bincount(of, self.weights[f], minlength=len(t)) + self.bias

    def scores(self, t: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(t) + self.shift, -50, 50)))


def ratios(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of the classes' smoothed, normalised counts of each indicator."""
    p, q = (np.bincount(np.concatenate([s for s, v in zip(sets, y) if v == k] or [np.zeros(0, np.int64)]), minlength=1 << BITS) + 1.0 for k in (1, 0))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_svm(sets: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; each text's scaled indicators have length one."""
    rng, n = np.random.default_rng(seed), len(sets)
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(n)
    sign = np.where(y == 1, 1.0, -1.0)
    top = cost * np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
    rows = [scale[s] / max(np.sqrt((scale[s] ** 2).sum()), 1e-9) for s in sets]
    q = np.array([(r * r).sum() for r in rows]) + 1.0
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            g = sign[i] * (w[sets[i]] @ rows[i] + bias) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), top[i])
            if step := (new - alpha[i]) * sign[i]:
                w[sets[i]] += step * rows[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _margin(sets: list[np.ndarray], scale: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([(w[s] * scale[s]).sum() / max(np.sqrt((scale[s] ** 2).sum()), 1e-9) + bias for s in sets])


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic fit to margins, by Newton's method with smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, v = p - target, p * (1 - p) + 1e-9
        h = np.array([[(v * m * m).sum() + 1e-6, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * m).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class NormalModel(Model):
    """A model whose texts have length one: the margin is divided by the length of the scaled indicators."""

    squares: np.ndarray = None

    def margins(self, t: Texts) -> np.ndarray:
        of, f = features(t)
        size = np.sqrt(np.bincount(of, self.squares[f], minlength=len(t)))
        return np.bincount(of, self.weights[f], minlength=len(t)) / np.maximum(size, 1e-9) + self.bias


def fit(sets: list[np.ndarray], y: np.ndarray) -> Model:
    """One class alone, or no rows at all, gives its own constant score."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0 if not len(y) else 6.0 if y[0] == 1 else -6.0)
    folds, out = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        own = np.flatnonzero(folds != k)
        if y[own].min() < y[own].max():
            some = [sets[i] for i in own]
            scale = ratios(some, y[own])
            out[folds == k] = _margin([sets[i] for i in np.flatnonzero(folds == k)], scale, *fit_svm(some, y[own], scale))
    scale = ratios(sets, y)
    w, bias = fit_svm(sets, y, scale)
    slope, shift = logistic(out, y)
    return NormalModel((w * scale).astype(np.float32), bias, max(slope, 1e-6), shift, (scale**2).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, indicators: int = SAMPLE_INDICATORS) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. Rows without a text, an id or a label of 0 or 1 teach nothing.

    At most `rows` labelled ids are used, those of the lowest hash; of an id's several labels the lowest counts.
    In that order texts are taken while their indicators together stay within `indicators`. One task
    fits the model, within bounded memory; the driver gets the weights alone.
    """
    wanted = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(wanted), "doc_id")  # `rows` rows at most

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            of, f = features(texts_of(b.column(1)))
            cut = np.searchsorted(of, np.arange(b.num_rows + 1)).astype(np.int64)
            raw = f.astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3).cast(pa.int32()), pa.array([raw[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], names=["turn", "quality", "f"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, y, left = [], [], indicators
        for b in batches:
            for quality, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                left -= len(raw) // 4
                if left >= 0:
                    sets.append(np.frombuffer(raw, np.int32))
                    y.append(quality)
        m = fit(sets, np.array(y, np.int64))
        squares = getattr(m, "squares", None)
        numbers = [pa.array([float(x)]) for x in (m.bias, m.slope, m.shift)]
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([None if squares is None else squares.tobytes()], pa.binary()), *numbers], names=["weights", "squares", "bias", "slope", "shift"])

    turned = some.select("doc_id", "text", F.xxhash64("doc_id").alias("turn"), "quality")
    sets = turned.mapInArrow(listed, "turn long, quality int, f binary")
    one = sets.repartition(1).sortWithinPartitions("turn", "f")  # `rows` rows at most
    r = one.mapInArrow(fitted, "weights binary, squares binary, bias double, slope double, shift double").first()
    if r is None:  # no labelled rows
        return fit([], np.zeros(0, np.int64))
    weights = np.frombuffer(r["weights"], np.float32)
    if r["squares"] is None:
        return Model(weights, r["bias"], r["slope"], r["shift"])
    return NormalModel(weights, r["bias"], r["slope"], r["shift"], np.frombuffer(r["squares"], np.float32))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, score (0 to 1, higher: better) and predicted.

    Null and empty texts have no indicators and get the model's bias; repeated rows give repeated rows.
    """
    keep = keep or ["doc_id"]
    at = keep.index("text") if "text" in keep else len(keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text" if at < len(keep) else "__text"):
            s = sent.value.scores(texts_of(b.column(at)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    extra = [] if at < len(keep) else [F.col("text").alias("__text")]
    return docs.select(*keep, *extra).mapInArrow(run, f"{types}, score double, predicted int")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model doesn't reject, all columns as they were."""
    plain = docs.select(*(F.col(c).alias(f"k{i}") if c != "text" else F.col(c) for i, c in enumerate(docs.columns)))
    kept = score(plain, model, threshold, plain.columns).where("predicted = 1")
    return kept.select(*(F.col(k).alias(c) for k, c in zip(plain.columns, docs.columns)))
