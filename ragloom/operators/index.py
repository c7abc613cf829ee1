"""A written inverted index: BM25 that reads only the postings of the queries' terms.

Postings are stored in blocks of one term and some documents, with the largest count and the shortest document of a block, in folders
by a hash of the term. A block is made from the documents of one task's segment, so a frequent term has many blocks and no group
has to hold all of it. A posting is a number within the segment, a count and a length, packed so that zero bytes compress; the numbers of
documents are in one row a segment, in a folder of their own. Batches of documents are added as folders of their own.
A search sends blocks to the task of their segment, which has all postings of its documents and sends the k best of each query.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.operators.retrieval import SMALL, idf, ranges, saturated, terms
from ragloom.plans.pipeline import ranked

#: Terms of the documents of a segment, and documents of a block.
SEGMENT, BLOCK = 1 << 20, 128
#: The bucket of the rows with the documents' numbers; their term is empty.
NUMBERS = -1
_BLOCKS = "term string, segment bigint, df int, max_tf int, min_length int, packed binary, docnos array<string>"
_WIDTH = 12


def _planes(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks of some postings: where the first byte of each posting lies in the packed blocks, and how far its other bytes are apart."""
    apart = np.repeat(size, size)
    begin = np.cumsum(size) - size
    return np.arange(len(apart)) + np.repeat((_WIDTH - 1) * begin, size), apart


def _packed(doc: np.ndarray, tf: np.ndarray, length: np.ndarray, size: np.ndarray) -> pa.Array:
    """Postings by block: steps between documents, counts and lengths, of each block by bytes of the same place."""
    step = np.diff(doc, prepend=0)
    edge = (np.cumsum(size) - size)[size > 0]
    step[edge] = doc[edge]
    raw = np.ascontiguousarray(np.stack([step, tf, length], axis=1).astype("<u4")).view(np.uint8).reshape(len(doc), _WIDTH)
    at, apart = _planes(size)
    out = np.empty(raw.size, np.uint8)
    for k in range(_WIDTH):
        out[at + k * apart] = raw[:, k]
    ends = np.concatenate([[0], np.cumsum(size) * _WIDTH])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, count and length of each posting, and the postings of each block."""
    packed = packed.cast(pa.large_binary())
    ends = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1] if len(packed) else np.zeros(1, np.int64)
    size = np.diff(ends) // _WIDTH
    data = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    at, apart = _planes(size)
    raw = np.empty((len(at), _WIDTH), np.uint8)
    for k in range(_WIDTH):
        raw[:, k] = data[at + k * apart]
    step, tf, length = raw.view("<u4").astype(np.int64).T if len(raw) else np.zeros((3, 0), np.int64)
    sums = np.cumsum(step)
    begin = np.cumsum(size) - size
    doc = sums - np.repeat(np.append(0, sums)[begin], size)
    return doc, tf, length, size


def _segments(batches):
    """Blocks of postings of lists of terms, and the numbers of their documents."""
    held, size = [], 0

    def blocks(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        segment = int.from_bytes(hashlib.blake2b(rows.column(0)[0].as_py().encode(), digest_size=8).digest(), signed=True)
        rows = rows.take(pc.sort_indices(rows.column(0))).combine_chunks()  # so that ties go by the number within the segment
        lists, docnos = (rows.column(k).combine_chunks() if isinstance(rows.column(k), pa.ChunkedArray) else rows.column(k) for k in (1, 0))
        flat = lists.flatten().dictionary_encode()
        length = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        pair, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * len(length) + np.repeat(np.arange(len(length)), length), return_counts=True)
        term, doc = pair // max(len(length), 1), pair % max(len(length), 1)
        place = np.arange(len(term)) - np.searchsorted(term, term)
        edge = np.flatnonzero(place % BLOCK == 0)
        df = np.diff(np.append(edge, len(term)))
        most, least = (f.reduceat(x, edge) if len(edge) else np.zeros(0, np.int64) for f, x in ((np.maximum, tf), (np.minimum, length[doc])))
        one = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(1, kind)])
        columns = [
            pa.concat_arrays([flat.dictionary.take(pa.array(term[edge])).cast(pa.string()), pa.array([""], pa.string())]), pa.array(np.full(len(edge) + 1, segment)), pa.array(np.append(df, int(length.sum())), pa.int32()),
            one(most, pa.int32()), one(least, pa.int32()), pa.concat_arrays([_packed(doc, tf, length[doc], df), pa.nulls(1, pa.binary())]),
            pa.ListArray.from_arrays(pa.array([0] * (len(edge) + 1) + [len(docnos)], pa.int32()), docnos.cast(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["term", "segment", "df", "max_tf", "min_length", "packed", "docnos"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += len(b.column(1).flatten()) + b.num_rows
        if size > SEGMENT:
            yield blocks(held)
            held, size = [], 0
    if held:
        yield blocks(held)


def _weights(mean: float, k: int, k1: float, b: float):
    """The k largest weights in each block of (term, packed)."""

    def run(batches):
        for batch in batches:
            _, tf, length, size = _unpacked(batch.column(1))
            weight, block = saturated(tf, length, mean, k1, b), np.repeat(np.arange(len(size)), size)
            order = np.lexsort((-weight, block))
            order = order[np.arange(len(order)) - np.searchsorted(block, block) < k]
            ends = np.append(0, np.cumsum(np.minimum(size, k)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(weight[order]))], ["term", "w"])

    return run


def _reaches(value, bound, others, least):
    """Whether a block may have one of a query's best documents, with room for what sums and rounding may differ by; of arrays or columns."""
    return value * bound + others + 1e-5 >= least


def _scored(k: int, mean: float, k1: float, b: float):
    """(qid, docno, score) of the k best documents of each query in a segment, from (at, qid, word, idf, others, least) and its blocks."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        blocks, numbers = rows.filter(pc.is_valid(rows.column("packed"))), rows.filter(pc.is_null(rows.column("packed"))).column("docnos").combine_chunks()
        docnos = numbers.chunk(0).flatten() if isinstance(numbers, pa.ChunkedArray) and numbers.num_chunks else numbers.flatten()
        doc, tf, length, size = _unpacked(_flat(blocks.column("packed"), pa.binary()))
        begin, weight = np.cumsum(size) - size, saturated(tf, length, mean, k1, b)
        bound = saturated(blocks.column("max_tf").to_numpy(), blocks.column("min_length").to_numpy(), mean, k1, b)
        names = _flat(blocks.column("term"), pa.string()).dictionary_encode()
        by_term = np.argsort(names.indices.to_numpy(), kind="stable")
        first = np.searchsorted(names.indices.to_numpy()[by_term], np.arange(len(names.dictionary) + 1))
        term = pc.index_in(_flat(asked.column("word"), pa.string()), value_set=names.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        qids = _flat(asked.column("qid"), asked.column("qid").type).dictionary_encode()
        query, (value, others, least) = qids.indices.to_numpy(), (asked.column(c).to_numpy() for c in ("idf", "others", "least"))
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        order = np.argsort(query, kind="stable")
        order = order[term[order] >= 0]
        cuts = np.append(np.flatnonzero(np.diff(query[order], prepend=-1)), len(order))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[lo:hi]
            block, pair = ranges(first[term[own]], first[term[own] + 1] - first[term[own]])
            block, pair = by_term[block], own[pair]
            keep = _reaches(value[pair], bound[block], others[pair], least[pair])
            block, pair = block[keep], pair[keep]
            at, which = ranges(begin[block], size[block])
            sums = np.bincount(doc[at], value[pair[which]] * weight[at], len(docnos))
            hit = np.flatnonzero(sums)
            score = np.round(sums[hit], 6)
            if len(hit) > k:
                few = np.flatnonzero(score >= np.partition(score, -k)[-k])
                hit, score = hit[few], score[few]
            best = np.argsort(-score, kind="stable")[:k]
            for rows_of, x in zip(out, (np.full(len(best), query[own[0]]), hit[best], score[best]), strict=True):
                rows_of.append(x)
        which, at, score = (np.concatenate(x) for x in out)
        return pa.table([qids.dictionary.take(pa.array(which)), docnos.take(pa.array(at)), pa.array(score)], names=["qid", "docno", "score"])

    return run


def _flat(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([c.cast(kind) for c in column.chunks]) if column.num_chunks else pa.array([], kind)


class TermIndex:
    """An index in a folder of any store that Spark writes; ``add`` makes or extends it.

    Document numbers are strings, each in one batch only. A batch that fails half-way is not part of the index: its sizes are written last, and batches without are not read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _sizes(self) -> DataFrame | None:
        sc = self.spark.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sizes")
        if not folder.getFileSystem(sc._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.parquet(f"{self.path}/sizes")

    def add(self, documents: DataFrame) -> int:
        """Add documents (docno, text) as a batch, and give its number. A null text has no terms, a null docno is left out."""
        sizes = self._sizes()
        known = [] if sizes is None else [r["batch"] for r in sizes.select("batch", "buckets").collect() if r["buckets"] == self.buckets or self._refuse(r["buckets"])]
        number = max(known, default=-1) + 1
        lists = documents.filter("docno is not null").select(F.col("docno").cast("string").alias("docno"), F.coalesce(terms("text"), F.array().cast("array<string>")).alias("t"))
        bucket = F.when(F.col("term") == "", NUMBERS).otherwise(F.pmod(F.xxhash64("term"), F.lit(self.buckets))).cast("int")
        blocks = lists.mapInArrow(_segments, _BLOCKS).withColumn("bucket", bucket)
        # a frequent term's blocks go to several tasks
        dealt = blocks.repartition("bucket", F.pmod("segment", F.lit(8))).sortWithinPartitions("bucket", "term")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={number}")
        n = self._read([number]).filter(F.col("bucket") == NUMBERS).agg(F.coalesce(F.sum(F.size("docnos")), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_terms"))
        n.select(F.lit(number).alias("batch"), F.lit(self.buckets).alias("buckets"), "n", "n_terms").write.mode("append").parquet(f"{self.path}/sizes")
        return number

    def _refuse(self, buckets: int) -> bool:
        raise ValueError(f"the index has {buckets} buckets")

    def _read(self, batches: list[int] | None = None) -> DataFrame:
        """The rows of all written batches, or of some."""
        known = sorted(r["batch"] for r in self._sizes().select("batch").collect()) if batches is None else batches
        return self.spark.read.option("basePath", f"{self.path}/postings").schema(f"{_BLOCKS}, batch int, bucket int").parquet(*(f"{self.path}/postings/batch={b}" for b in known))

    def blocks(self, asked: DataFrame) -> DataFrame:
        """The blocks of the terms of (term): of the folders of their hashes only, and of row groups that may have them."""
        read = self._read()
        wanted = asked.select("term").distinct()
        names = [r["term"] for r in wanted.limit(SMALL + 1).toLocalIterator()]
        if len(names) > SMALL:
            return read.join(wanted, "term", "left_semi")
        at = {r["b"] for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()}
        own = read.filter(F.col("bucket").isin(sorted(at)))
        return own.filter(F.col("term").isin(names)) if len(names) <= 1000 else own.join(F.broadcast(wanted), "term", "left_semi")

    def bm25(self, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(qid, query, docno, score, rank), the rows of ``retrieval.bm25`` on all documents of the index.

        Blocks that can't have one of a query's k best documents are skipped: their largest weight, with the largest ones of the query's other terms in the same segment, is less than
        the k-th best weight in some term's best blocks.
        """
        asked = queries.filter("qid is not null").select("qid", F.explode(F.array_distinct(terms("query"))).alias("term")).distinct()
        bounded, known, mean = self._bounds(asked, k, k1, b)
        cols = ("segment", "term", "max_tf", "min_length", "packed", "docnos")
        rows = bounded.select(*cols).unionByName(self._read().filter(F.col("bucket") == NUMBERS).select(*cols))
        own = known.select(F.col("segment").alias("at"), "qid", F.col("term").alias("word"), "idf", "others", "least")
        found = own.groupBy("at").cogroup(rows.groupBy("segment"))
        best = found.applyInArrow(_scored(k, mean, k1, b), f"qid {dict(asked.dtypes)['qid']}, docno string, score double")
        named = queries.groupBy("qid").agg(F.min("query").alias("query"))
        return ranked(best, k=k).join(named, "qid").select("qid", "query", "docno", "score", "rank")

    def _kept(self, asked: DataFrame, k: int, k1: float, b: float) -> DataFrame:
        """(qid, idf, blocks) of the blocks that a query has to read."""
        bounded, known, _ = self._bounds(asked, k, k1, b)
        return bounded.join(known, ["segment", "term"]).filter(_reaches(F.col("idf"), F.col("bound"), F.col("others"), F.col("least")))

    def _bounds(self, asked: DataFrame, k: int, k1: float, b: float) -> tuple[DataFrame, DataFrame, float]:
        """The blocks of the terms with their bounds; (segment, qid, term, idf, others, least) of the terms that segments have; and the documents' mean length."""
        whole = self._sizes().agg(F.sum("n").alias("n"), F.sum("n_terms").alias("n_terms")).first()
        n, mean = whole["n"], (whole["n_terms"] / whole["n"] if whole["n_terms"] else 1.0)
        blocks = self.blocks(asked)
        weigh = lambda tf, length: saturated(tf, length, F.lit(mean), k1, b)
        bounded = blocks.withColumn("bound", weigh(F.col("max_tf"), F.col("min_length")))
        # a term's best blocks until they have k documents: the k-th best weight in them
        by = [F.desc("bound"), "segment", "df", F.xxhash64("packed")]
        before = F.sum("df").over(Window.partitionBy("term").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
        stats = bounded.groupBy("term").agg(F.sum("df").alias("df"))
        top = bounded.withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy(*by))).filter(F.col("nth") <= k)
        top = top.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < k)
        weights = top.select("term", "packed").mapInArrow(_weights(mean, k, k1, b), "term string, w array<double>")
        reached = weights.groupBy("term").agg(F.sort_array(F.flatten(F.collect_list("w")), asc=False).alias("w")).select("term", F.coalesce(F.get("w", k - 1), F.lit(0.0)).alias("reached"))
        value: Column = idf(F.lit(n), F.col("df"))
        by_term = stats.join(reached, "term").select("term", value.alias("idf"), (value * F.col("reached")).alias("reached"))
        known = asked.join(by_term, "term").withColumn("least", F.max("reached").over(Window.partitionBy("qid")))
        most = bounded.groupBy("segment", "term").agg(F.max("bound").alias("most")).join(known, "term").withColumn("most", F.col("idf") * F.col("most"))
        known = most.withColumn("others", F.sum("most").over(Window.partitionBy("qid", "segment")) - F.col("most"))
        return bounded, known.select("segment", "qid", "term", "idf", "others", "least"), mean
