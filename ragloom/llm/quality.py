"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

A text's indicators say which n-grams it has: words and word pairs (A-Z lower-cased), and the
single, paired and tripled shapes of its words, where a shape is the kinds of characters in the
word and its last character if that is ASCII punctuation; further, which share of its three-word
windows repeats, and which share of its words equals the word before, in eight steps each. Each indicator is scaled by its log-count ratio between the
classes, a linear hinge-loss model is fitted by dual coordinate descent, and the margin becomes a
probability by a logistic curve fitted on rows that the descent did not see.

The model is fitted on at most ``sample`` labelled rows, half of each class as far as there are so
many, those with the least hash of the id; the curve weighs them back to the classes' shares among
all labelled rows. Fitting is one task over that bounded sample; scoring reads every text whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm import textkit as K
from ragloom.llm.scratch import least_hashes

BUCKETS = 1 << 17
SAMPLE = 8000
THRESHOLD = 0.3

_KIND = np.full(256, 32, np.uint8)  # other ASCII
_KIND[[0x20, *range(9, 14)]] = 0
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
_U = np.uint64


def _shapes(w: K.Words) -> np.ndarray:
    kinds = np.bitwise_or.reduceat(_KIND[w.data], w.start) if len(w.start) else np.zeros(0, np.uint8)
    last = w.data[w.end - 1]
    return K.mix(kinds.astype(np.uint64) + (np.where(_KIND[last] == 32, last, 0).astype(np.uint64) << _U(8)))


def _repeats(w: K.Words) -> np.ndarray:
    """Eighths of each row's three-word windows that repeat an earlier one, rounded up."""
    sh, bound = K.shingles(w, 3)
    row = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    order = np.lexsort((sh, row))
    again = np.zeros(len(sh), bool)
    again[1:] = (sh[order][1:] == sh[order][:-1]) & (row[order][1:] == row[order][:-1])
    count = np.bincount(row[order][again], minlength=len(bound) - 1)
    return -(-8 * count // np.maximum(np.diff(bound), 1))


def indicators(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of each row, and where each row's begin."""
    rows, shape, word = w.rows, _shapes(w), w.hash
    out = []
    for kind, h in ((1, word), (2, shape)):
        for n in range(1, 4 if kind == 2 else 3):
            size = max(len(h) - n + 1, 0)
            g, ok = np.full(size, 10 * kind + n, np.uint64), np.ones(size, bool)
            for k in range(n):
                g = K.mix(g * _U(0x9FB21C651E98DF25) + h[k : k + size])
            if n > 1:
                ok = rows[:size] == rows[n - 1 :]
            out.append((rows[:size][ok].astype(np.int64) << 17) | (g[ok] & _U(BUCKETS - 1)).astype(np.int64))
    same = np.flatnonzero((word[1:] == word[:-1]) & (rows[1:] == rows[:-1])) if len(word) else np.zeros(0, np.int64)
    doubled = -(-8 * np.bincount(rows[same], minlength=w.hi - w.lo) // np.maximum(np.diff(w.first), 1))
    for kind, share in ((777, _repeats(w)), (888, doubled)):
        steps = np.repeat(np.arange(w.hi - w.lo), share)
        nth = np.arange(len(steps)) - np.searchsorted(steps, steps)
        out.append((steps.astype(np.int64) << 17) | (K.mix(nth.astype(np.uint64) + _U(kind)) & _U(BUCKETS - 1)).astype(np.int64))
    keys = np.unique(np.concatenate(out))
    return keys & (BUCKETS - 1), np.searchsorted(keys >> 17, np.arange(w.hi - w.lo + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 0.1, epochs: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss support vector machine with rows scale[indices] and labels -1 or 1."""
    x = [scale[r] for r in rows]
    norm = np.array([float(v @ v) + 1.0 for v in x])
    w, bias, alpha, order = np.zeros(len(scale)), 0.0, np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ x[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                worst = max(worst, abs(gradient))
                alpha[i] = new
                w[rows[i]] += step * x[i]
                bias += step
        if worst < tolerance:
            break
    return w, bias


def logistic_curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) fits y in {0, 1}; targets are smoothed by one row of each class."""
    pos, neg = max((weight * y).sum(), 1e-9), max((weight * (1 - y)).sum(), 1e-9)
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log(pos / neg))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margin).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-6)), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, good_share: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the log-odds from indicator rows and labels 0 or 1; both classes must occur."""
    held = np.arange(len(rows)) % 5 == 0
    if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
        held = np.zeros(len(rows), bool)
    counts = np.ones((2, BUCKETS))
    for i in np.flatnonzero(~held):
        counts[y[i], rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    train = np.flatnonzero(~held)
    own = [rows[i] for i in train]
    length = np.sqrt(np.mean([float(ratio[r] @ ratio[r]) for r in own])) or 1.0
    scale = ratio / length
    w, bias = dual_descent(own, np.where(y[train] > 0, 1.0, -1.0), scale, cost=1.0)
    w = w * scale
    check = np.flatnonzero(held) if held.any() else train
    margin = np.array([w[rows[i]].sum() + bias for i in check])
    weight = np.where(y[check] > 0, good_share / max((y[check] > 0).mean(), 1e-9), (1 - good_share) / max((y[check] == 0).mean(), 1e-9))
    a, b = logistic_curve(margin, y[check].astype(float), weight)
    return a * w, a * bias + b


def _features(batches):
    for b in batches:
        for w in K.words(b.column(1)):
            at, first = indicators(w)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(w.lo, w.hi - w.lo), b.column(2).slice(w.lo, w.hi - w.lo), lists], ["id", "y", "at"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn_from=None, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model: log-odds weight of each bucket, and the bias. Rows with a null id or label are left out; an id with several labels counts as its least, one with several texts as the text of the least hash.

    ``learn_from``: a condition on the id column. Without rows of both classes the weights are 0 and the score is the
    share of label 1, or 1 without any labelled row.
    """
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    marked = (marked.filter(learn_from) if learn_from is not None else marked).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    by_class = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    total = sum(by_class.values())
    if len(by_class) < 2:
        share = by_class.get(1, 0) / total if total else 1.0
        return np.zeros(BUCKETS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    chosen = least_hashes(marked, "y", by_class, sample // 2)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    # one row of a repeated id, so that the fitting task holds no more than the sample
    texts = texts.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "y")
    rows = texts.mapInArrow(_features, f"id {dict(texts.dtypes)['id']}, y int, at array<int>")
    share = by_class[1] / total

    def one(batches):
        got = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        order = np.lexsort((got.column("y").to_numpy(), np.unique(np.array(got.column("id").to_pylist()), return_inverse=True)[1]))
        at, y = got.column("at").combine_chunks(), got.column("y").to_numpy()
        bound, flat = at.offsets.to_numpy(), at.values.to_numpy()
        y = y[order]
        if len({*y.tolist()}) < 2:
            return
        w, bias = fit([flat[bound[i] : bound[i + 1]] for i in order], y, share)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([bias])], ["w", "bias"])

    model = rows.repartition(1).mapInArrow(one, "w binary, bias double").collect()
    if not model:
        return np.zeros(BUCKETS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return np.frombuffer(model[0]["w"], np.float32).astype(np.float64), model[0]["bias"]


def scores(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column ``out`` put first: the probability of label 1, of every row. A null text counts as empty. An own column of that name is replaced."""
    table = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    kept = [c for c in docs.columns if c != out]
    schema = f"`{out}` double, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    at = kept.index(text_col)

    def run(batches):
        w8, bias = table.value
        for b in batches:
            score = np.zeros(b.num_rows)
            for w in K.words(b.column(at)):
                buckets, first = indicators(w)
                score[w.lo : w.hi] = 1 / (1 + np.exp(-np.clip(_sums(w8[buckets], first) + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([pa.array(score), *b.columns], [out, *kept])

    return docs.select(*kept).mapInArrow(run, schema)
