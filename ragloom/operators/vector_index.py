"""A written index of vectors: lists by nearest centre, read by bounds on inner products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators.retrieval import _Best, _stacked
from ragloom.plans.pipeline import ranked


def _sized(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: F.isnull(x) | F.isnan(x)))


class VectorIndex:
    """Vectors of one size in lists by their nearest centre, each with its distance from it (``residual``), in a folder that Spark writes.

    Centres come from k-means on at most about ``sample`` of the vectors of the first batch; every vector of each batch is indexed. For a query q and a vector x at distance r from
    centre c, q x is at most q c + |q| r, so with ``exact`` a search reads, after the ``probe`` best lists, those that this bound leaves, and equals ``retrieval.dense``;
    without, the probed lists are all. A list is met by its queries in parts of about ``part`` vectors, so that a large list is many groups.
    """

    def __init__(self, spark: SparkSession, path: str, part: int = 1 << 15):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part

    def build(self, documents: DataFrame, lists: int = 64, sample: int = 1 << 18, seed: int = 1) -> None:
        """Centres and the first batch from (docno, doc_vec); rows with a null key, vector or component are left out."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = _sized(documents, "docno", "doc_vec")
        sizes = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
        if not sizes["n"] or sizes["a"] != sizes["b"]:
            raise ValueError("vectors of one size are needed")
        share = max(1, math.ceil(sizes["n"] / sample))
        some = rows.filter(F.pmod(F.xxhash64("docno"), F.lit(share)) == 0).select(array_to_vector("v").alias("features"))
        model = KMeans(k=max(1, min(lists, sizes["n"])), seed=seed, maxIter=20).fit(some)
        centres = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
        self.spark.createDataFrame(centres, "list int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres")
        self.add(documents)

    def _centres(self) -> np.ndarray:
        table = self.spark.read.parquet(f"{self.path}/centres").toArrow().sort_by("list")
        return _stacked(table.column("centre"))

    def _known(self) -> DataFrame | None:
        sc = self.spark.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists")
        there = folder.getFileSystem(sc._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.parquet(f"{self.path}/lists") if there else None

    def add(self, documents: DataFrame) -> int:
        """Add a batch of (docno, doc_vec), and give its number. What is known of its lists is written last, and a batch without is not read."""
        known = self._known()
        number = 0 if known is None else 1 + (known.agg(F.max("batch")).first()[0] or 0)
        shared = self.spark.sparkContext.broadcast(self._centres())
        docno = dict(documents.dtypes)["docno"]

        def nearest(batches):
            for b in batches:
                c, v = shared.value, _stacked(b.column(1))
                apart = (v * v).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * v @ c.T if len(v) else np.zeros((0, len(c)))
                at = apart.argmin(1)
                residual = np.linalg.norm(v - c[at], axis=1) if len(v) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(residual), pa.array(at, pa.int32())], ["docno", "v", "residual", "list"])

        rows = _sized(documents, "docno", "doc_vec").mapInArrow(nearest, f"docno {docno}, v array<double>, residual double, list int")
        path = f"{self.path}/vectors/batch={number}"
        # a large list is written by several tasks
        rows.repartition("list", F.pmod(F.xxhash64("docno"), F.lit(8))).sortWithinPartitions("list").write.mode("overwrite").partitionBy("list").parquet(path)
        written = self.spark.read.schema(f"docno {docno}, v array<double>, residual double, list int").option("basePath", path).parquet(path)
        stats = written.groupBy("list").agg(F.count("*").alias("n"), F.max("residual").alias("radius"))
        stats.select(F.lit(number).alias("batch"), "list", "n", "radius").coalesce(1).write.mode("append").parquet(f"{self.path}/lists")
        return number

    def search(self, queries: DataFrame, k: int = 10, probe: int = 4, exact: bool = False) -> DataFrame:
        """(qid, docno, score, rank): the k vectors found with the highest inner product, rounded to six places, for each (qid, query_vec); ties go to the smaller docno."""
        asked = _sized(queries, "qid", "query_vec")
        kind = dict(asked.dtypes)["qid"]
        known = self._known().groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).toArrow().sort_by("list")
        table = known.column("list").to_numpy(), known.column("radius").to_numpy(), self._centres()[known.column("list").to_numpy()]
        shared = self.spark.sparkContext.broadcast(table)

        def pairs(rest: bool):
            """Query and list: the probed ones, or with ``rest`` the others whose bound reaches the k-th score so far."""

            def run(batches):
                lists, radius, centres = shared.value
                for b in batches:
                    q = _stacked(b.column(1))
                    if not len(q):
                        continue
                    near = q @ centres.T
                    rank = (-near).argsort(axis=1, kind="stable").argsort(axis=1)
                    want = rank < probe
                    if rest:
                        want = ~want & (near + np.linalg.norm(q, axis=1)[:, None] * radius[None] + 1e-5 >= b.column(2).to_numpy(zero_copy_only=False)[:, None])
                    row, at = np.nonzero(want)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(lists[at].astype(np.int32))], ["qid", "v", "list"])

            return run

        schema = f"qid {kind}, v array<double>, list int"
        first = ranked(self._met(asked.mapInArrow(pairs(False), schema), known, k), k=k)
        if not exact:
            return first
        least = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        more = asked.join(least, "qid", "left").select("qid", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        found = self._met(more.mapInArrow(pairs(True), schema), known, k)
        return ranked(first.drop("rank").unionByName(found), k=k)

    def _met(self, pairs: DataFrame, known: pa.Table, k: int) -> DataFrame:
        """(qid, docno, score) of the k best of each query, list and part."""
        batches = sorted({r["batch"] for r in self._known().select("batch").distinct().collect()})
        read = self.spark.read.option("basePath", f"{self.path}/vectors").parquet(*(f"{self.path}/vectors/batch={b}" for b in batches)).select("docno", "v", "list")
        n_parts = {lst: max(1, math.ceil(n / self.part)) for lst, n in zip(known.column("list").to_pylist(), known.column("n").to_pylist())}
        sizes = F.broadcast(self.spark.createDataFrame(list(n_parts.items()), "list int, parts int"))
        wanted = sorted(r["list"] for r in pairs.select("list").distinct().collect())
        rows = read.filter(F.col("list").isin(wanted)).join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("docno"), F.col("parts")))
        copies = pairs.join(sizes, "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("parts") - 1).cast("bigint"))))

        def meet(q: pa.Table, d: pa.Table) -> pa.Table:
            found = _Best(k)
            if q.num_rows and d.num_rows:
                found.see(_stacked(q.column("v")), d.column("docno").to_numpy(zero_copy_only=False).astype(object), _stacked(d.column("v")))
            return pa.Table.from_batches([found.batch(q.column("qid"), d.column("docno").type)])

        schema = f"qid {dict(pairs.dtypes)['qid']}, docno {dict(read.dtypes)['docno']}, score double"
        return copies.select("qid", "v", "list", "part").groupBy("list", "part").cogroup(rows.select("docno", "v", "list", "part").groupBy("list", "part")).applyInArrow(meet, schema)
