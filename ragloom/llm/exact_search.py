"""Exact top-k inner-product search, term at a time.

Query rows are sparse lists of (term, weight). Candidates are dealt to blocks of about ``BLOCK`` rows
and queries to blocks of ``QUERIES``; each pair of blocks is one group. A group turns its candidates
into postings, one list per term, and for each query adds the weighted postings of the query's
terms to a dense array of scores; the best k by partition selection go on, and a final pass merges
the blocks' winners. A block's arrays are bounded whatever the table's size, and a query block goes
to each candidate block once: the set of queries is stated, and no pair of rows leaves a group
unless it is among its block's best k.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES = 1 << 14, 1 << 11
_SAFE = 1 << 62


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(id, v array<double>) with scale * x for each component x, which the search floors; rows with a null id or vector, or a null or non-finite component, are left out."""
    x = F.col(vector_col).cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: c * scale)
    return rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & good).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))


def _matrix(vectors) -> np.ndarray:
    """Floors of the components, rows padded with 0 to the longest."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out)


def best_of_block(q_ids, q: np.ndarray, c_ids, c: np.ndarray, k: int) -> tuple[list, list, list]:
    """Query ids, candidate ids and scores of each query's k best candidates here, itself left out; ties go to the smaller id."""
    width = min(q.shape[1], c.shape[1]) if len(q) and len(c) else 0
    big = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(width, 1) >= 2.0**53
    if big:  # exact integers of any size
        q, c = q.astype(object), c.astype(object)
        for a in (q, c):
            a[...] = np.vectorize(int, otypes=[object])(a) if a.size else a
    else:
        q, c = q.astype(np.int64), c.astype(np.int64)
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = np.asarray(c_ids)[order], c[order]
    postings = []
    for t in range(width):
        at = np.flatnonzero(c[:, t])
        postings.append((slice(None) if len(at) == len(c) else at, np.ascontiguousarray(c[at, t])))
    out: tuple[list, list, list] = ([], [], [])
    for i, own in enumerate(q_ids):
        score = np.zeros(len(c_ids), q.dtype)
        for t in np.flatnonzero(q[i, :width]):
            at, weights = postings[t]
            score[at] += q[i, t] * weights
        other = np.flatnonzero(c_ids != own)
        s = score[other]
        if len(s) > k:
            floor = np.partition(s, len(s) - k)[len(s) - k] if s.dtype != object else sorted(s)[len(s) - k]
            keep = np.flatnonzero(s >= floor)
            other, s = other[keep], s[keep]
        top = sorted(range(len(s)), key=lambda j: (-s[j], c_ids[other[j]]))[:k]
        out[0].extend([own] * len(top))
        out[1].extend(int(c_ids[other[j]]) for j in top)
        out[2].extend(max(-_SAFE * 2, min(_SAFE * 2 - 1, int(s[j]))) for j in top)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k candidates with the highest inner product for each row of ``queries``; all, if fewer.

    Both have (id, v) as from ``integer_vectors``; missing components of a shorter vector are 0. A query's own id is no
    candidate for it. Ties go to the smaller id; rows that repeat an id are candidates each, and one query. A score outside
    64 bits is cut to that range. Empty tables give no rows.
    """
    n, m = vectors.count(), queries.count()
    n_blocks, m_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(m / query_block))
    deal = lambda df, blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    c = vectors.select("id", "v", deal(vectors, n_blocks).alias("cb")).withColumn("qb", every(m_blocks))
    q = queries.dropDuplicates(["id"]).select("id", "v", deal(queries, m_blocks).alias("qb")).withColumn("cb", every(n_blocks))

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, others, scores = best_of_block(left["id"].to_numpy(), _matrix(left["v"].tolist()), right["id"].to_numpy(), _matrix(right["v"].tolist()), k) if len(left) and len(right) else ([], [], [])
        return pd.DataFrame({"query_id": pd.array(ids, "int64"), "vec_id": pd.array(others, "int64"), "score": pd.array(scores, "int64")})

    found = q.groupBy("cb", "qb").cogroup(c.groupBy("cb", "qb")).applyInPandas(one, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
