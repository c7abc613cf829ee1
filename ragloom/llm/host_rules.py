"""Quality rules on documents and on their hosts.

Each document is measured and tried against the rules of ``rules()``. Failures of each rule are summed by host
(a column that names where a document is from), and each host's rate is shrunk towards the rate of all hosts by
a beta prior whose two parameters come from the hosts' own rates by the method of moments. A host fails if its
shrunk rate in one rule is above the rule's limit, which is relative to the prior's mean m: ``TIMES`` m, or half way
from m to 1 if that is less, and ``LEAST`` at least. Verdicts are joined back to the documents. Sums by host are taken
before the shuffle, so a host with a third of all rows is a few rows there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm import textkit as K
from ragloom.llm.scratch import Scratch

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
TIMES, LEAST = 3.0, 0.2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _repeat_words(w: K.Words) -> np.ndarray:
    """Words of each row that stand in a three-word window found twice or more in the row."""
    rows, n = w.rows, len(w.hash)
    if n < 3:
        return np.zeros(w.hi - w.lo, np.int64)
    own = rows[2:] == rows[:-2]
    h = K.mix(K.mix(w.hash[:-2] * np.uint64(3) + w.hash[1:-1]) * np.uint64(5) + w.hash[2:])
    at = np.flatnonzero(own)
    order = at[np.lexsort((h[at], rows[at]))]
    same = (h[order][1:] == h[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit, words = order[twice], np.zeros(n, bool)
    for k in range(3):
        words[hit + k] = True
    return np.bincount(rows[words], minlength=w.hi - w.lo)


def _measure(batches):
    for b in batches:
        out = np.zeros((len(MEASURES), b.num_rows), np.int64)
        for w in K.words(b.column(2), lower=False):
            lead = np.concatenate([[0], np.cumsum(~K._SPACE[w.data] & ((w.data & 0xC0) != 0x80))])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
            own = w.data.tobytes()
            lines, dups = np.array([_lines(own[a:z]) for a, z in zip(w.bounds[:-1], w.bounds[1:], strict=True)], np.int64).reshape(-1, 2).T
            out[:, w.lo : w.hi] = np.diff(w.first), np.diff(lead[w.bounds]), np.diff(symbols[w.bounds]), dups, _repeat_words(w), lines
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, out)], ["id", "host", *MEASURES])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of every row and whole text; a null text has 0 of each.

    Words are runs outside x20 and x09-x0D; word_chars are code points; a line that has a word and equals an earlier
    line is a duplicate; n_lines counts lines with a word; symbols are ``#*$%&|<>``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_measure, f"id {kind}, host string, " + ", ".join(f"{m} bigint" for m in MEASURES))


def base_failed() -> Column:
    """Under 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Whether a measured row fails each rule. Only ``base`` fails a document by itself; all of them count for its host.

    symbols: over one in ten of the words' characters; lines: over three lines in ten equal to an earlier one. Neither depends on a language.
    """
    return {
        "base": base_failed(),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def host_rates(measured: DataFrame, failed: dict[str, Column]) -> DataFrame:
    """(host, rule, n_docs, n_failed, host_rate, rate_limit) of each host and rule; host_rate is n_failed + a over n_docs + a + b, where a and b fit the hosts' rates in the rule.

    The prior has the hosts' mean rate m (weighed by documents) and the strength s = m(1 - m) / v - 1, v being the
    variance of the rates beyond what sampling explains; s stays between 1 and 1e6, and is 1e6 if v is not positive.
    A null host is one host.
    """
    by_host = measured.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.count_if(c).alias(name) for name, c in failed.items()))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n_failed")) for name in failed)))
    sums = by_host.select("host", "n_docs", each.alias("x")).select("host", "n_docs", "x.*")
    rate, m = F.col("n_failed") / F.col("n_docs"), F.col("m")
    whole = sums.groupBy("rule").agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("h"), F.sum(F.col("n_docs") * rate * rate).alias("q")).select(
        "rule", (F.col("f") / F.col("n")).alias("m"), (F.col("q") / F.col("n")).alias("q"), (F.col("h") / F.col("n")).alias("per_doc"),
    )
    spread = F.col("q") - m * m - m * (1 - m) * F.col("per_doc")
    strength = F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), m * (1 - m) / spread - 1))).otherwise(1e6)
    limit = F.greatest(F.lit(LEAST), F.least(TIMES * m, (1 + m) / 2))
    prior = whole.select("rule", "m", strength.alias("s"), limit.alias("rate_limit"))
    # the prior has one row a rule
    rated = sums.join(F.broadcast(prior), "rule").withColumn("host_rate", (F.col("n_failed") + m * F.col("s")) / (F.col("n_docs") + F.col("s")))
    return rated.select("host", "rule", "n_docs", "n_failed", "host_rate", "rate_limit")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures of every row with base_failed, ``kept`` (neither it nor its host fails), host_failed and the host's shrunk rate in each rule (rate_base and so on)."""
    tried = rules()
    m = Scratch(docs.sparkSession).save(measures(docs, id_col, text_col, host_col))
    rates = host_rates(m, tried).groupBy(F.col("host").alias("rated")).agg(
        F.bool_or(F.col("host_rate") > F.col("rate_limit")).alias("host_failed"), *(F.max(F.when(F.col("rule") == name, F.col("host_rate"))).alias(f"rate_{name}") for name in tried),
    )
    out = m.join(rates, F.col("host").eqNullSafe(F.col("rated")), "left")
    return out.select(
        F.col("id").alias(id_col), *MEASURES, base_failed().alias("base_failed"), (~base_failed() & ~F.col("host_failed")).alias("kept"), "host_failed", *(f"rate_{name}" for name in tried),
    )
