"""Measures by query, judges, and experiments over several systems."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.plans.pipeline import shared_runs
from ragloom.tables import Tables
from ragloom.functions import text as X
from ragloom.functions.stem import stemmed
from ragloom.operators.generation import Backend, generated
from ragloom.operators.retrieval import ranges

GOLD = "gold_answer"


def _rouge(kind: str, part: str, stem: bool = True):
    tokens = (lambda x: stemmed(X.rouge_tokens(x))) if stem else X.rouge_tokens
    return lambda a, golds: X.rouge(a, F.get(golds, 0), kind, tokens)[part]


#: Measures of an answer column and a column with an array of gold answers.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "EM": lambda a, g: X.best_of(X.exact_match, a, g),
    "F1": lambda a, g: X.best_of(X.token_f1, a, g),
    "AnswerLen": lambda a, g: X.answer_length(a).cast("double"),
    "AnswerZeroLen": lambda a, g: X.is_empty_answer(a).cast("double"),
    **{f"ROUGE{n}{p}": _rouge(f"rouge{n}", p) for n in ("1", "2", "L") for p in ("P", "R", "F")},
}


def collected_gold(rows: DataFrame, answer: str = GOLD) -> DataFrame:
    """One row a query with all its gold answers, sorted, from one row an answer."""
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(answer)).alias(GOLD))


def exploded_gold(rows: DataFrame, answers: str = GOLD) -> DataFrame:
    """One row an answer from arrays of answers (also of structs), other columns kept; no answers give one null."""
    return rows.select(*(c for c in rows.columns if c != answers), F.explode_outer(answers).alias(answers))


def by_query(run: DataFrame, gold: DataFrame, measures: Sequence[str] | Mapping[str, Callable] = ("EM", "F1")) -> DataFrame:
    """(qid, one column a measure) of every run row; a query without gold has null EM, F1 and ROUGE."""
    chosen = {m: MEASURES[m] for m in measures} if not isinstance(measures, Mapping) else measures
    rows = run.join(gold.select("qid", GOLD), "qid", "left")
    return rows.select("qid", *(f(F.col("qanswer"), F.col(GOLD)).alias(name) for name, f in chosen.items()))


#: Codes of a letter pair of tokens of a-z and 0-9: two characters, or one and none.
_LETTERS = 37
#: Token pairs with a letter pair in common that are held at once.
_HELD = 1 << 20


def _letter_pairs(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letter pairs of each token, one after the other, and where each token's begin; a token of one letter has itself."""
    tokens = tokens.cast(pa.large_string())
    ends = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    data = np.frombuffer(tokens.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.int64)
    letter = np.append(np.where(data >= 97, data - 97, data - 48 + 26), _LETTERS - 1)
    n = np.diff(ends)
    own = np.repeat(np.arange(len(n)), np.maximum(n - 1, 1))
    at = np.arange(len(own)) + np.repeat(ends[:-1] - ends[0] - np.append(0, np.cumsum(np.maximum(n - 1, 1)))[:-1], np.maximum(n - 1, 1))
    second = np.where(n[own] > 1, letter[at + 1], _LETTERS - 1)
    pairs = np.unique((own * _LETTERS + letter[at]) * _LETTERS + second)
    return pairs % _LETTERS**2, np.searchsorted(pairs // _LETTERS**2, np.arange(len(n) + 1))


def _matched(a: pa.Array, b: pa.Array) -> pa.Array:
    """For lists of tokens, none null, the mean over a's tokens of the best similarity to one of b's (p), and the other way (r).

    Only different tokens of a row that share a letter pair are compared: pairs of tokens are made from equal letter pairs, a number of a's tokens at a time.
    """
    n, sides = len(a), []
    words = pa.concat_arrays([x.flatten().cast(pa.string()) for x in (a, b)]).dictionary_encode()
    codes, first = _letter_pairs(words.dictionary)
    at = 0
    for x in (a, b):
        row = np.repeat(np.arange(n), np.diff(x.offsets.to_numpy()))
        token = words.indices.to_numpy()[at : at + len(row)].astype(np.int64)
        at += len(row)
        own, place = np.unique(row * max(len(words.dictionary), 1) + token, return_inverse=True)
        sides.append((row, place, own // max(len(words.dictionary), 1), own % max(len(words.dictionary), 1)))
    (_, _, row_a, token_a), (_, _, row_b, token_b) = sides
    size = np.diff(first)
    pairs, own_b = ranges(first[token_b], size[token_b])
    key_b = row_b[own_b] * _LETTERS**2 + codes[pairs]
    order = np.argsort(key_b, kind="stable")
    key_b, own_b = key_b[order], own_b[order]
    pairs, own_a = ranges(first[token_a], size[token_a])
    key_a = row_a[own_a] * _LETTERS**2 + codes[pairs]
    lo = np.searchsorted(key_b, key_a)
    met = np.searchsorted(key_b, key_a, side="right") - lo
    best = [np.zeros(len(token_a)), np.zeros(len(token_b))]
    starts, total = np.append(0, np.cumsum(size[token_a])), np.append(0, np.cumsum(met))
    begin = 0
    while begin < len(token_a):
        stop = max(begin + 1, int(np.searchsorted(total[starts], total[starts[begin]] + _HELD, side="right")) - 1)
        part = slice(starts[begin], starts[stop])
        at, which = ranges(lo[part], met[part])
        both, alike = np.unique(own_a[part][which] * len(token_b) + own_b[at], return_counts=True)
        x, y = both // max(len(token_b), 1), both % max(len(token_b), 1)
        value = alike / np.sqrt(size[token_a[x]].astype(np.float64) * size[token_b[y]])
        np.maximum.at(best[0], x, value)
        np.maximum.at(best[1], y, value)
        begin = stop
    means = [np.bincount(row, top[place], n) / np.maximum(np.bincount(row, minlength=n), 1) for (row, place, _, _), top in zip(sides, best, strict=True)]
    return pa.StructArray.from_arrays([pa.array(m) for m in means], ["p", "r"])


def bertscore(run: DataFrame, qrels: DataFrame, rel: int = 3, part: str = "f1", agg: str = "max", scorer: Callable | None = None) -> DataFrame:
    """(qid, value): greedy matching of token vectors between the answer and each reference of relevance ``rel`` or more, max or avg over them.

    The vectors are unit vectors by hash of the token's letter pairs, so the measure is deterministic; ``part`` is p, r or f1.
    ``scorer``, a function from two pandas Series (answers, references) to a Series of numbers, is a model in their place; it runs in Arrow batches.
    """
    refs = qrels.filter(F.col("relevance") >= rel).select("qid", F.col("text").alias("_ref"))
    if scorer is not None:
        scored = run.select("qid", "qanswer").join(refs, "qid").select("qid", F.pandas_udf(scorer, "double")("qanswer", "_ref").alias("_v"))
        return scored.groupBy("qid").agg({"max": F.max, "avg": F.avg}[agg]("_v").alias("value"))
    matched = F.arrow_udf(_matched, "struct<p double, r double>")
    tokens = lambda c: F.coalesce(X.rouge_tokens(c), F.array().cast("array<string>"))
    rows = run.select("qid", "qanswer").join(refs, "qid").select("qid", matched(tokens("qanswer"), tokens("_ref")).alias("_m")).select("qid", "_m.p", "_m.r")
    value = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)) if part == "f1" else F.col(part)
    return rows.groupBy("qid").agg({"max": F.max, "avg": F.avg}[agg](value).alias("value"))


JUDGE_PROMPT = "Rate from 1 to 10 how well the answer agrees with the reference. Begin with the number.\nReference: {{ reference }}\nAnswer: {{ prediction }}"
PAIR_PROMPT = "Which answer is better? End with [[A]], [[B]] or, if neither is, [[C]].\nQuestion: {{ query }}\nA: {{ answer_a }}\nB: {{ answer_b }}"
AGGREGATES: dict[str, Callable[[str], Column]] = {"max": F.max, "min": F.min, "sum": F.sum, "avg": F.avg, "none": lambda c: F.array_sort(F.collect_list(c))}


def result_stats(results: DataFrame) -> DataFrame:
    """One row: n_queries, mean_docs a query, mean_chars of the texts that are not null, and docs_counts, a map from rows a query to queries."""
    per_query = results.groupBy("qid").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"), F.count("text").alias("texts"))
    by_n = per_query.groupBy("n").agg(F.count("*").alias("queries"), F.sum("chars").alias("chars"), F.sum("texts").alias("texts"))
    return by_n.agg(
        F.sum("queries").alias("n_queries"), (F.sum(F.col("n") * F.col("queries")) / F.sum("queries")).alias("mean_docs"), F.try_divide(F.sum("chars"), F.sum("texts")).alias("mean_chars"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "queries")))).alias("docs_counts"),
    )


def judged_pointwise(run: DataFrame, qrels: DataFrame, backend: Backend, rel: int = 3, agg: str = "max", prompt: str = JUDGE_PROMPT) -> DataFrame:
    """(qid, value): a backend's ratings of the answer against each reference of relevance ``rel`` or more, aggregated."""
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    refs = qrels.filter(F.col("relevance") >= rel).select("qid", F.col("text").alias("reference"))
    rows = run.select("qid", F.col("qanswer").alias("prediction")).join(refs, "qid").withColumn("prompt", X.template(prompt))
    return generated(rows, backend, output_field="_said").withColumn("_r", X.rating("_said")).groupBy("qid").agg(AGGREGATES[agg]("_r").alias("value"))


def judged_pairwise(a: DataFrame, b: DataFrame, queries: DataFrame, backend: Backend, prompt: str = PAIR_PROMPT) -> DataFrame:
    """(qid, verdict): A, B, C or null, of two systems' answers."""
    rows = queries.join(a.select("qid", F.col("qanswer").alias("answer_a")), "qid").join(b.select("qid", F.col("qanswer").alias("answer_b")), "qid").withColumn("prompt", X.template(prompt))
    return generated(rows, backend, output_field="_said").select("qid", X.verdict("_said").alias("verdict"))


def long_form(runs: Mapping[str, DataFrame], gold: DataFrame, measures: Sequence[str] = ("EM", "F1")) -> DataFrame:
    """(system, qid, measure, value) of all runs in one plan."""
    out = None
    for name, run in runs.items():
        rows = by_query(run, gold, measures).select(F.lit(name).alias("system"), "qid", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))).alias("_m"))
        rows = rows.select("system", "qid", "_m.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def experiment(values: DataFrame, measures: Sequence[str]) -> DataFrame:
    """(system, one mean a measure) over the queries of each run."""
    return values.groupBy("system").pivot("measure", list(measures)).agg(F.avg("value"))


def against_baseline(values: DataFrame, baseline: str) -> DataFrame:
    """(system, measure, n, better, worse, t, p): paired t statistics and two-sided p-values against one system."""
    base = values.filter(F.col("system") == baseline).select("qid", "measure", F.col("value").alias("base"))
    d = values.filter(F.col("system") != baseline).join(base, ["qid", "measure"]).withColumn("d", F.col("value") - F.col("base"))
    stats = d.groupBy("system", "measure").agg(
        F.count("d").alias("n"), F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"),
        F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("t"),
    )
    return stats.withColumn("p", F.udf(lambda t, n: two_sided_p(t, n), "double", useArrow=True)("t", "n"))  # one row a system and measure


def compared(systems: Sequence[Callable[[DataFrame], DataFrame]], topics: DataFrame, gold: DataFrame, measures: Sequence[str] = ("EM", "F1"), names: Sequence[str] | None = None, baseline: int | None = None, timed: bool = False, share: bool = False) -> DataFrame:
    """(name, one mean a measure) of systems that answer topics, in one table.

    names default to the systems' places. With a baseline (a system's place) each measure gets m_better, m_worse and m_p, null for the baseline
    itself. With timed, mrt is the milliseconds a query took: each system's answers are then made once, kept on the executors' disks
    (and made again where an executor is lost), and what a run shares with another is timed in both. With share, steps that systems begin
    with in common run once, see ``shared_runs``: measures are then made at once and written, and the shared tables deleted.
    """
    if share and timed:
        raise ValueError("shared steps have no time of their own")
    names = [str(k) for k in range(len(systems))] if names is None else list(names)
    if len(names) != len(systems) or len(set(names)) != len(names):
        raise ValueError("each system needs a name of its own")
    n, runs, spent = topics.count() if timed else 0, {}, []
    tables = Tables(topics.sparkSession)
    made = shared_runs(systems, topics, tables) if share else [system(topics) for system in systems]
    for name, run in zip(names, made, strict=True):
        if timed:
            began = time.perf_counter()
            run = run.persist(StorageLevel.DISK_ONLY)
            run.count()
            spent.append((name, 1000 * (time.perf_counter() - began) / n if n else None))
        runs[name] = run
    values = long_form(runs, gold, measures)
    if share:
        values = Tables(topics.sparkSession).save(values)
        tables.drop()
    out = experiment(values, measures)
    if timed:
        out = out.join(F.broadcast(topics.sparkSession.createDataFrame(spent, "system string, mrt double")), "system")
    if baseline is not None:
        pairs = against_baseline(values, names[baseline]).groupBy("system").agg(
            *(F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in measures for c in ("better", "worse", "p"))
        )
        out = out.join(pairs, "system", "left")
    return out.withColumnRenamed("system", "name")


def two_sided_p(t: float | None, n: int) -> float | None:
    """P(|T| > |t|) for n - 1 degrees of freedom, by the incomplete beta function's continued fraction."""
    if t is None or n < 2:
        return None
    df = n - 1
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(x, a, b):
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + k * d or 1e-300)
                c = 1 + k / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-12:
                break
        return h

    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b
