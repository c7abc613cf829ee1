"""Retrieval: BM25, dense top-k, reranking, texts by document number, query rewriting."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.text import once
from ragloom.plans.pipeline import ranked
from ragloom.tables import Tables

#: Between words: anything but letters and digits.
SEPARATOR = r"[^\p{L}\p{N}]+"
#: Pairs of a query and a term that may be broadcast with the terms' frequencies, counted first.
SMALL = 1 << 20


def terms(text: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text) if isinstance(text, str) else text), SEPARATOR), "")


def term_counts(text: Column | str) -> Column:
    """array<struct<term, tf>> of the distinct terms of a text, and first the term '' with the number of all; from the runs of the sorted terms."""

    def counted(t: Column, starts: Column) -> Column:
        runs = F.transform(starts, lambda at, i: F.struct(F.get(t, at).alias("term"), (F.coalesce(F.get(starts, i + 1), F.size(t)) - at).alias("tf")))
        return F.concat(F.array(F.struct(F.lit("").alias("term"), F.size(t).alias("tf"))), runs)

    def starts(t: Column) -> Column:
        places = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))

    return once(lambda t: once(counted, t, starts(t)), F.array_sort(F.coalesce(terms(text), F.array().cast("array<string>"))))


def bm25(queries: DataFrame, documents: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, small: int = SMALL) -> DataFrame:
    """(qid, query, docno, score, rank): the k best documents (docno, text) of each query (qid, query).

    Documents are read twice: for the document frequencies of the queries' terms with the number and length of documents, and for the scores. With up
    to ``small`` pairs of a query and a term these are broadcast: a task counts a document's terms and sums its scores in place, and only the k best of each query and task
    are shuffled. With more, postings and queries are joined by term. Scores are rounded to six places, so that ties do not depend on the order of addition, and go to the
    smaller docno. A null text has no terms. A qid names one query; of several texts the least is shown, and all terms count.
    """
    asked = queries.filter("qid is not null").select("qid", F.explode(F.array_distinct(terms("query"))).alias("term"))
    few = asked.limit(small + 1).count() <= small
    scored = (_scored_in_place if few else _scored_by_join)(asked.distinct(), documents, k, k1, b)
    named = queries.groupBy("qid").agg(F.min("query").alias("query"))
    return ranked(scored, k=k).join(named, "qid").select("qid", "query", "docno", "score", "rank")


def idf(n: int | Column, df: np.ndarray | Column):
    return (np.log if isinstance(df, np.ndarray) else F.log)(1 + (n - df + 0.5) / (df + 0.5))


def saturated(tf, length, mean, k1: float, b: float):
    """The weight of a term that occurs tf times in a document of a length, of arrays or columns."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _scored_by_join(asked: DataFrame, documents: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(qid, docno, score) of all documents with a term of a query."""
    spark = asked.sparkSession
    wanted = asked.select("term").union(spark.createDataFrame([("",)], "term string")).distinct()
    # an inner explode would be filtered by its size below the projection, which makes the terms once more
    postings = documents.select("docno", term_counts("text").alias("t")).select("docno", F.get("t", 0)["tf"].alias("dl"), F.inline_outer("t"))
    stats = Tables(spark).save(postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n_terms")))
    whole = stats.filter("term = ''").first()
    n, mean = (whole["df"], whole["n_terms"] / whole["df"]) if whole else (0, 1.0)
    by_query = asked.join(stats, "term").select("qid", "term", idf(n, F.col("df")).alias("idf"))
    score = F.round(F.sum(F.col("idf") * saturated(F.col("tf"), F.col("dl"), mean, k1, b)), 6)
    return postings.join(by_query, "term").groupBy("qid", "docno").agg(score.alias("score"))


def ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of some ranges one after the other, and the range of each."""
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) + np.repeat(begin - (np.cumsum(size) - size), size), which


class _Asked:
    """The queries' different terms, and the queries of each term; held by every task."""

    def __init__(self, asked: pa.Table):
        self.terms = pc.unique(asked.column("term"))
        self.terms = self.terms.combine_chunks() if isinstance(self.terms, pa.ChunkedArray) else self.terms
        self.qids = pc.unique(asked.column("qid"))
        self.qids = self.qids.combine_chunks() if isinstance(self.qids, pa.ChunkedArray) else self.qids
        term = pc.index_in(asked.column("term"), value_set=self.terms).to_numpy()
        order = np.argsort(term, kind="stable")
        self.query = pc.index_in(asked.column("qid"), value_set=self.qids).to_numpy()[order].astype(np.int64)
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def counted(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and count of the asked terms of lists of terms, and the length of each list."""
        size = np.diff(lists.offsets.to_numpy())
        at = pc.index_in(lists.flatten(), value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(size)), size)[at >= 0]
        pair, tf = np.unique(doc * len(self.terms) + at[at >= 0], return_counts=True)
        return pair // len(self.terms), pair % len(self.terms), tf, size


def _scored_in_place(asked: DataFrame, documents: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(qid, docno, score) of the k best documents of each query and task."""
    types = dict(asked.dtypes) | dict(documents.dtypes)
    schema = f"qid {types['qid']}, docno {types['docno']}, score double"
    sc = asked.sparkSession.sparkContext
    table = _Asked(asked.toArrow())
    shared = sc.broadcast(table)
    lists = documents.select("docno", F.coalesce(terms("text"), F.array().cast("array<string>")).alias("t"))
    if not len(table.terms):
        return asked.sparkSession.createDataFrame([], schema)

    def frequencies(batches):
        n, length, df = 0, 0, np.zeros(len(shared.value.terms), np.int64)
        for batch in batches:
            _, term, _, size = shared.value.counted(batch.column(0))
            n, length = n + len(size), length + int(size.sum())
            df += np.bincount(term, minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([n, length, *df[at].tolist()], pa.int64())], ["at", "n"])

    sums = {r["at"]: r["n"] for r in lists.select("t").mapInArrow(frequencies, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    n, length = sums.pop(-2, 0), sums.pop(-1, 0)
    df = np.zeros(len(table.terms), np.int64)
    df[list(sums)] = list(sums.values())
    weights = sc.broadcast((idf(n, df), length / n if length else 1.0))

    def best(batches):
        own, kind = shared.value, None
        value, mean = weights.value
        found = _Best(k)
        for batch in batches:
            kind = batch.column(0).type
            doc, term, tf, size = own.counted(batch.column(1))
            score = value[term] * saturated(tf, size[doc], mean, k1, b)
            n_queries = np.diff(own.first)[term]
            row = np.repeat(np.arange(len(term)), n_queries)
            query = own.query[own.first[term[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n_queries) - n_queries, n_queries)]
            pair, which = np.unique(query * len(size) + doc[row], return_inverse=True)
            total = np.round(np.bincount(which, score[row], len(pair)), 6)
            found.add(pair // max(len(size), 1), batch.column(0).to_numpy(zero_copy_only=False).astype(object), pair % max(len(size), 1), total)
        if kind is not None and len(found.query):
            yield found.batch(own.qids, kind)

    return lists.mapInArrow(best, schema)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _stacked(column: pa.Array) -> np.ndarray:
    """Vectors of one size as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


class _Best:
    """The k best documents of each query among those seen; equal scores go to the smaller docno."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.docno, self.score = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)

    def see(self, asked: np.ndarray, docno: np.ndarray, vectors: np.ndarray) -> None:
        """Score all vectors for all queries, some at a time."""
        step = max(1, (1 << 22) // max(len(docno), 1))
        for lo in range(0, len(asked), step):
            s = np.round(asked[lo : lo + step] @ vectors.T, 6)
            least = np.partition(s, -self.k, axis=1)[:, -self.k, None] if s.shape[1] > self.k else -np.inf
            q, d = np.nonzero(s >= least)
            self.add(q + lo, docno, d, s[q, d])

    def add(self, query: np.ndarray, docno: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        """Scores of documents docno[at]; names are compared only among those that the k-th score leaves."""
        q, s = np.append(self.query, query), np.append(self.score, score)
        source = np.append(np.arange(len(self.query)), len(self.query) + at)
        names = np.append(self.docno, docno)
        order = np.lexsort((-s, q))
        first = np.searchsorted(q[order], q[order])
        last = np.minimum(first + self.k - 1, np.searchsorted(q[order], q[order], side="right") - 1)
        order = order[s[order] >= s[order][last]]
        names, q, s = names[source[order]], q[order], s[order]
        place = np.unique(names, return_inverse=True)[1] if len(names) else q
        order = np.lexsort((place, -s, q))
        order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < self.k]
        self.query, self.docno, self.score = q[order], names[order], s[order]

    def batch(self, qids: pa.Array, kind: pa.DataType) -> pa.RecordBatch:
        taken = qids.take(pa.array(self.query))
        taken = taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken
        return pa.RecordBatch.from_arrays([taken, pa.array(self.docno.tolist(), kind), pa.array(self.score)], ["qid", "docno", "score"])


def dense(queries: DataFrame, documents: DataFrame, k: int = 10, most: int = 1 << 22, block: int = 1 << 15) -> DataFrame:
    """(qid, docno, score, rank): the k documents (docno, doc_vec) with the highest inner product, rounded to six places, for each query (qid, query_vec).

    Keys may be strings or numbers; ties go to the smaller docno. Vectors that are null or hold a null, and rows without a key, take no part, and a query meets the
    vectors of its own size only; without any it has no rows. If the queries have at most ``most`` components they are broadcast, each task reads its
    documents in batches and k of each task go on. Beyond that, queries are dealt to blocks and meet blocks of ``block`` documents.
    """
    sized = lambda df, key, vec: df.select(key, F.col(vec).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", F.isnull)).withColumn("dim", F.size("v"))
    docs, asked = sized(documents.filter("docno is not null"), "docno", "doc_vec"), sized(queries.filter("qid is not null"), "qid", "query_vec")
    schema = f"qid {dict(queries.dtypes)['qid']}, docno {dict(documents.dtypes)['docno']}, score double"
    components = asked.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0]
    if components <= most:
        table = asked.toArrow()
        by_size = {dim: (rows.column("qid"), _stacked(rows.column("v"))) for dim in table.column("dim").unique().to_pylist() for rows in [table.filter(pc.equal(table.column("dim"), dim))]}
        shared = queries.sparkSession.sparkContext.broadcast(by_size)

        def run(batches):
            best, kind = {dim: _Best(k) for dim in shared.value}, None
            for b in batches:
                kind, dims = b.column(0).type, b.column(2).to_numpy(zero_copy_only=False)
                for dim in set(dims.tolist()) & best.keys():
                    rows = b.filter(pa.array(dims == dim))
                    best[dim].see(shared.value[dim][1], rows.column(0).to_numpy(zero_copy_only=False).astype(object), _stacked(rows.column(1)))
            for dim, found in best.items():
                if len(found.query):
                    yield found.batch(shared.value[dim][0], kind)

        return ranked(docs.mapInArrow(run, schema), k=k)

    blocks, parts = max(1, math.ceil(documents.count() / block)), math.ceil(components / most)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("docno"), F.lit(blocks))).withColumn("part", each(parts))
    copies = asked.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts))).withColumn("block", each(blocks))

    def meet(q: pa.Table, d: pa.Table) -> pa.Table:
        found = _Best(k)
        if q.num_rows and d.num_rows:
            found.see(_stacked(q.column("v")), d.column("docno").to_numpy(zero_copy_only=False).astype(object), _stacked(d.column("v")))
        return pa.Table.from_batches([found.batch(q.column("qid"), d.column("docno").type)])

    keys = ("dim", "block", "part")
    return ranked(copies.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(meet, schema), k=k)


def rescored(results: DataFrame, score: Column | Callable[[pd.Series, pd.Series], pd.Series], query: str = "query", text: str = "text") -> DataFrame:
    """Results with a new score and rank; ``score`` is a column, or a model over Arrow batches of (query, text)."""
    column = score if isinstance(score, Column) else F.pandas_udf(score, "double")(query, text)
    return ranked(results.drop("rank").withColumn("score", column))


def with_texts(results: DataFrame, documents: DataFrame, *fields: str) -> DataFrame:
    """Left join of document fields by docno; Spark broadcasts the smaller side if its size allows."""
    return results.join(documents.select("docno", *(fields or ("text",))), "docno", "left")


def only_for(rows: DataFrame, keys: DataFrame, on: str = "qid") -> DataFrame:
    """Rows whose key is among another table's; neither repeated by it nor joined with its columns. A null key is among none."""
    return rows.join(keys.select(on), on, "left_semi")


def distinct_documents(documents: DataFrame, by: str = "text", docno: str = "docno") -> DataFrame:
    """(by, docno): one document of each text, the one with the least number; texts are counted together before the shuffle, and a null text is one of its own."""
    return documents.groupBy(by).agg(F.min(docno).alias(docno))


def hashed_vectors(df: DataFrame, text: str, out: str, size: int = 64) -> DataFrame:
    """A deterministic encoder: counts of terms by hash, scaled to length 1; zeros for a text without terms."""
    at = F.transform(terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    count = lambda at: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("double"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda v, n: F.transform(v, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))
    return df.withColumn(out, once(lambda v: once(unit, v, norm(v)), once(count, at)))


def bare_queries(df: DataFrame) -> DataFrame:
    """The query without punctuation for retrieval; the original is in query_0 (``pop_columns`` restores it)."""
    from ragloom.operators.columns import push_columns

    return push_columns(df, keep_original=True).withColumn("query", F.array_join(terms("query"), " "))
