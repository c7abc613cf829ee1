"""What each order of a set of filters keeps and removes, from one histogram of failures a part.

Every document gets a mask of the filters that it fails. A part's histogram over the masks is a
row of integers; the outcomes of all orders and steps are that row times integer matrices with a
row for each mask and a column for each (order, step).
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
FILTERS = "ABCDE"
HISTOGRAMS = ("n", "good", "toxic")
RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of A to D on a text's words, letters and signs; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return {
        "A": F.size("_w") < 100,
        "B": 100 * F.size(F.array_distinct("_w")) < 80 * F.size("_w"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, same, mask): the bits of A to D (A is 1), and a digest that only equal texts share."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text", F.array_remove(F.split(text, SPACES), "").alias("_w"))
    mask = sum((F.when(bad, 1 << k).otherwise(0) for k, bad in enumerate(text_failures(F.col("text")).values())), F.lit(0))
    return cut.select("doc_id", "part", F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"), mask.alias("mask"))


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, those labelled quality 1 and those labelled toxic 1, by failures of A to E.

    E fails for a row if any row with the same text has a smaller id; rows with a null id neither fail
    nor make others fail. Rows of one id and text are counted together first, then all rows of a text,
    a part and a label, so that a text with very many copies is summed before it is shuffled.
    """
    named = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    rows = masked(docs)
    known = rows.filter("doc_id is not null").join(named.filter("good = 1 or toxic = 1"), "doc_id", "left").fillna(0, ["good", "toxic"])
    keys = ["same", "part", "mask", "good", "toxic"]
    by_id = known.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    first = F.col("least") == F.min("least").over(Window.partitionBy("same"))
    split = by_text.withColumn("first", F.when(first, F.col("n_least")).otherwise(0))
    each = F.inline(F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n"))))
    counted = split.select("part", "good", "toxic", each).select("part", "mask", "n", "good", "toxic")
    unknown = rows.filter("doc_id is null").select("part", "mask", F.lit(1).cast("bigint").alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    sums = F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    return counted.unionByName(unknown).groupBy("part", "mask").agg(*sums)


def incidence(filters: str = FILTERS) -> tuple[list[str], dict[str, np.ndarray]]:
    """All orders of the filters, and for each outcome the matrix of 0 and 1 by mask and by (order, step)."""
    orders = ["".join(p) for p in permutations(sorted(filters))]
    bit = np.array([[filters.index(c) for c in order] for order in orders])
    masks = np.arange(1 << len(filters))
    fails = (masks[:, None, None] >> bit[None]) & 1
    before = np.zeros_like(fails)
    before[:, :, 1:] = np.maximum.accumulate(fails, axis=2)[:, :, :-1]
    outcomes = {
        "kept": (1 - before) * (1 - fails),
        "removed": (1 - before) * fails,
        "redundant": before * fails,
        "unique_fails": (masks[:, None, None] == 1 << bit[None]).astype(int),
    }
    # a filter's removals at any step of any order, at each place that the filter stands at
    removals = np.zeros((len(masks), len(filters)), np.int64)
    for k in range(len(filters)):
        removals[:, k] = (outcomes["removed"] * (bit[None] == k)).sum(axis=(1, 2))
    outcomes["shapley"] = removals[:, bit]
    return orders, {name: m.reshape(len(masks), -1).astype(np.int64) for name, m in outcomes.items()}


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: what the step's filter keeps, removes, finds removed already, fails alone, and its sum over all orders.

    Documents have (doc_id, text, lang), labels (doc_id, quality, toxic); other columns are ignored. A null text is empty, a null
    language the part of the empty string; of several label rows of an id any 1 counts; label rows without a document count for
    nothing. No documents give no rows. Every row of a repeated id is a document.
    """
    def row(h: str) -> Column:
        return F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(h))), F.lit(0)).cast("bigint") for m in range(1 << len(FILTERS)))).alias(h)

    rows = histograms(docs, labels).groupBy("part").agg(*(row(h) for h in HISTOGRAMS))

    def products(batches):
        orders, outcomes = incidence()
        places = len(orders) * len(FILTERS)
        for b in batches:
            if not b.num_rows:
                continue
            n, good, toxic = (b.column(1 + k).flatten().to_numpy().reshape(-1, 32) for k in range(3))
            found = {name: n @ m for name, m in outcomes.items()}
            found |= {"good_lost": good @ outcomes["removed"], "toxic_lost": toxic @ outcomes["removed"]}
            columns = {
                "part": b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), places))),
                "filter_order": pa.array(np.tile(np.repeat(orders, len(FILTERS)), b.num_rows)),
                "step": pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), b.num_rows * len(orders))),
            } | {name: pa.array(found[name].reshape(-1)) for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(products, RESULT)
