"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's features are the hashed n-grams of 1 to 3 characters of its lower-cased letters, every run
of other characters being one space: (1 + log tf) * idf, scaled to length 1. Document frequencies
cover every text to learn from. The weights are learned by the follow-the-regularised-leader
proximal rule with elastic-net penalties on a bounded sample of labelled rows (``sample`` in all,
equally many of each language, those with the least hash of the id), in one task, and a temperature
is then fitted on the fifth of the sample that was held back.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm import textkit as K
from ragloom.llm.scratch import least_hashes

BUCKETS = 1 << 16
SAMPLE = 6000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: pa.Array):
    """For each slice: (lo, hi, bucket, count, first), the distinct buckets of each row with their counts; a row without letters has none."""
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    raw, bounds, _ = K.buffers(low)
    for lo, hi in K.slices(bounds):
        if hi - lo > 1 << 15:
            parts = [(a, min(a + (1 << 15), hi)) for a in range(lo, hi, 1 << 15)]
        else:
            parts = [(lo, hi)]
        for a, z in parts:
            own = raw[bounds[a] : bounds[z]]
            lead = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            points = np.frombuffer(own.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            edge = lead[bounds[a : z + 1] - bounds[a]]
            row = np.repeat(np.arange(z - a, dtype=np.uint32), np.diff(edge))
            letter = _letters()[points]
            points = np.where(letter, points, 32)
            keep = letter.copy()
            keep[1:] |= letter[:-1] & (row[1:] == row[:-1])
            points, row = points[keep], row[keep]
            keys, h = [], np.zeros(len(points), np.uint32)
            for n in range(1, 4):
                size = max(len(points) - n + 1, 0)
                h = (h[:size] + points[n - 1 :][:size]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                bucket = (h * np.uint32(0x85EBCA77)) >> np.uint32(16)
                ok = row[:size] == row[n - 1 :][:size]
                keys.append(((row[:size] << np.uint32(16)) | bucket)[ok])
            keys = np.sort(np.concatenate(keys))
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            at = np.flatnonzero(new)
            keys, count = keys[at], np.diff(np.append(at, len(keys)))
            yield a, z, (keys & np.uint32(BUCKETS - 1)).astype(np.int64), count, np.searchsorted(keys >> np.uint32(16), np.arange(z - a + 1))


def _weights(bucket: np.ndarray, count: np.ndarray, first: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[bucket]
    total = np.concatenate([[0.0], np.cumsum(x * x)])
    norm = np.sqrt(np.maximum(total[first[1:]] - total[first[:-1]], 1e-30))
    return (x / np.repeat(norm, np.diff(first))).astype(np.float32)


def ftrl(rows, y: np.ndarray, n_class: int, alpha=2.0, beta=1.0, l1=1e-4, l2=1e-4, epochs=4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket, class) and biases from rows of (buckets, values) and class numbers."""
    z, n = np.zeros((BUCKETS + 1, n_class)), np.zeros((BUCKETS + 1, n_class))
    order = np.random.default_rng(11)

    def w_of(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    rows = [(np.append(at, BUCKETS), np.append(v, 1.0)[:, None]) for at, v in rows]
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            w = w_of(at)
            s = (w * v).sum(0)
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = v * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = w_of(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden section on its logarithm between 1/50 and 50."""

    def loss(t):
        s = scores / np.exp(t)
        top = s.max(1)
        return float((np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(y)), y]).mean())

    a, b, g = -np.log(50), np.log(50), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class LanguageModel:
    """Languages, idf, weights and temperature; ``predict`` is for Arrow columns."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf.astype(np.float32), weights.astype(np.float32), bias, temperature

    def predict(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        for lo, hi, bucket, count, first in ngrams(texts):
            some = np.diff(first) > 0
            if not self.langs or not some.any():
                continue
            x = _weights(bucket, count, first, self.idf)
            sums = np.empty((hi - lo, len(self.langs)))
            for k in range(len(self.langs)):
                total = np.concatenate([[0.0], np.cumsum(self.weights[bucket, k] * x, dtype=np.float64)])
                sums[:, k] = total[first[1:]] - total[first[:-1]] + self.bias[k]
            sums /= self.temperature
            p = np.exp(sums - sums.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best[lo:hi] = np.where(some, p.argmax(1), -1)
            score[lo:hi] = np.where(some, p.max(1), 0.0)
        names = np.array([*self.langs, UNKNOWN], object)
        return pa.array(names[best], pa.string()), score


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_from: Column | None = None, sample: int = SAMPLE, most_languages: int = 256) -> LanguageModel:
    """A model from the rows of ``docs`` that ``learn_from`` admits and whose language is not null. Without any, every prediction is ``und``.

    The ``most_languages`` languages with most rows are learned. Of rows that repeat an id and a language one is in the sample.
    """
    known = docs.filter(learn_from) if learn_from is not None else docs
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")

    def frequencies(batches):
        df, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            for lo, hi, bucket, _, _ in ngrams(b.column(0)):
                df[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                df[BUCKETS] += hi - lo
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "df"])

    counted = known.select("text").mapInArrow(frequencies, "bucket bigint, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[counted["bucket"].to_numpy(np.int64)] = counted["df"].to_numpy(np.float64)
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1

    named = known.filter("id is not null")
    counts = {r["lang"]: r["count"] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    chosen = least_hashes(named, "lang", counts, max(1, sample // len(langs)))
    texts = known.join(F.broadcast(chosen), ["id", "lang"])
    # one row of a repeated id, so that the fitting task holds no more than the sample
    texts = texts.groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "lang")
    number = {name: k for k, name in enumerate(langs)}

    def features(batches):
        for b in batches:
            for lo, hi, bucket, count, first in ngrams(b.column(1)):
                x = _weights(bucket, count, first, idf)
                first = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(first, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(first, pa.array(x))], ["id", "lang", "at", "x"])

    def one(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        got = pa.Table.from_batches(got)
        lang = got.column("lang").to_pylist()
        order = np.lexsort((np.array([number[v] for v in lang]), np.unique(np.array(got.column("id").to_pylist()), return_inverse=True)[1]))
        at, x = got.column("at").combine_chunks(), got.column("x").combine_chunks()
        bound, flat, values = at.offsets.to_numpy(), at.values.to_numpy(), x.values.to_numpy()
        rows = [(flat[bound[i] : bound[i + 1]].astype(np.int64), values[bound[i] : bound[i + 1]]) for i in order if bound[i + 1] > bound[i]]
        y = np.array([number[lang[i]] for i in order if bound[i + 1] > bound[i]], np.int64)
        if not len(y):
            return
        held = np.arange(len(y)) % 5 == 0 if len(y) >= 10 else np.zeros(len(y), bool)
        w, bias = ftrl([r for r, h in zip(rows, held, strict=True) if not h], y[~held], len(langs))
        check = np.flatnonzero(held) if held.any() else np.arange(len(y))
        t = temperature(np.array([(w[rows[i][0]] * rows[i][1][:, None]).sum(0) + bias for i in check]), y[check])
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([bias.tobytes()]), pa.array([t])], ["w", "bias", "t"])

    fitted = texts.mapInArrow(features, f"id {dict(texts.dtypes)['id']}, lang string, at array<int>, x array<float>").repartition(1).mapInArrow(one, "w binary, bias binary, t double").collect()
    if not fitted:
        return LanguageModel([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    return LanguageModel(langs, idf, np.frombuffer(fitted[0]["w"], np.float32).reshape(BUCKETS, -1), np.frombuffer(fitted[0]["bias"]), fitted[0]["t"])


def languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its probability put first, of every row and whole text; own columns of those names are replaced.

    A null text, and one without a letter, is ``und`` with score 0.
    """
    table = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in out]
    schema = f"`{out[0]}` string, `{out[1]}` double, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    at = kept.index(text_col)

    def run(batches):
        for b in batches:
            lang, score = table.value.predict(b.column(at))
            yield pa.RecordBatch.from_arrays([lang, pa.array(score), *b.columns], [*out, *kept])

    return docs.select(*kept).mapInArrow(run, schema)
