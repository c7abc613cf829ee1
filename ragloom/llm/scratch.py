"""Written tables that cut lineage, connected components and sets of keys."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of a local session where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = sc._jsc.sc().getCheckpointDir()
    if set_before.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ragloom-"))
        set_before = sc._jsc.sc().getCheckpointDir()
    return set_before.get().rstrip("/")


class Scratch:
    """Tables of one operator call in the shared folder; a lost executor's part is read again from there."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/ragloom-{uuid.uuid4().hex}"
        self.saved = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.saved += 1
        path = f"{self.root}/{self.saved}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            files = t.inputFiles()
            if files:
                path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
                path.getFileSystem(conf).delete(path, True)

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all saved tables but these, which the result still reads."""
        kept = {f.rsplit("/", 2)[-2] for t in tables for f in t.inputFiles()[:1]}
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for k in range(1, self.saved + 1):
            if str(k) not in kept:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{k}"), True)
        self.free_shuffles()

    def free_shuffles(self) -> None:
        """Let Spark's cleaner delete shuffle files of plans that are no longer referenced."""
        self.spark.sparkContext._jvm.System.gc()


def least_hashes(rows: DataFrame, by: str, counts: dict, k: int) -> DataFrame:
    """Distinct rows (id, by) with, for each value of ``by``, the k least hashes of the id; ``counts`` has the rows of each value that is wanted.

    A cut of the hash by the counts leaves about 4 k ids a value, so that no task sees all rows of a value. Where ids repeat more than
    four times on average there may be fewer than k.
    """
    least = -(1 << 63)
    cuts = [(v, least + min((1 << 64) - 1, (4 * k << 64) // n)) for v, n in counts.items()]
    h = F.xxhash64("id")
    wanted = functools.reduce(lambda a, b: a | b, ((F.col(by) == v) & (h <= cut) for v, cut in cuts))
    order = Window.partitionBy(by).orderBy(h, "id")
    return rows.select("id", by).filter(wanted).distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select("id", by)


#: Rows and values of a table that may be broadcast; 0.13 million rows with lists took 19 MB in memory, so some 150 MB at most.
SMALL = 1 << 20


def if_small(table: DataFrame, size: Column | None = None) -> DataFrame:
    """A written table with a hint to broadcast it if it has at most ``SMALL`` rows and values by ``size``, counted here; else as it is."""
    values = F.lit(0) if size is None else F.coalesce(F.sum(size), F.lit(0))
    n, more = table.agg(F.count("*"), values).first()
    return F.broadcast(table) if max(n, more) <= SMALL else table


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, comp) for the ends of edges (u, v): comp is the smallest node that links reach.

    Labels go to the least label of the neighbours and then jump to their label's label, until
    nothing changes; each round is a written table. Null ends and loops are no links.
    """
    e = edges.filter("u is not null and v is not null and u != v").select("u", "v").distinct()
    both = scratch.save(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = scratch.save(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("comp")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("c").alias("near"))
        )
        hooked = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        step = scratch.save(hooked.join(up, "comp").select("node", "old", F.least("comp", "up").alias("comp")))
        moved = step.filter("old != comp").limit(1).count()
        scratch.drop(labels)
        labels = step.select("node", "comp")
        if not moved:
            scratch.drop(both)
            return labels


#: Bits of the largest broadcast bitmap; beyond ``MOST_KEYS`` keys it would let too much pass, and tables are narrowed by a join.
BITMAP_BITS = 1 << 26
MOST_KEYS = BITMAP_BITS // 16


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    from ragloom.llm.textkit import mix

    a = mix(h.view(np.uint64))
    return [(a % np.uint64(bits)).astype(np.int64), ((a >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)]


class KeySet:
    """The values of one bigint column as a broadcast bitmap of at most ``BITMAP_BITS`` bits, 16 or more for each; ``has`` may be true of a few others.

    Over ``MOST_KEYS`` keys there is no bitmap: ``has`` is true of all, and ``narrowed`` is a semi join.
    """

    def __init__(self, keys: DataFrame):
        name = keys.columns[0]
        keys = keys.filter(F.col(name).isNotNull())
        n = keys.count()
        self.keys, self.table = keys, None
        if n > MOST_KEYS:
            return
        bits = self.bits = 1 << max(20, (16 * n - 1).bit_length())

        def places(batches):
            for b in batches:
                at = np.unique(np.concatenate(_places(b.column(0).to_numpy(zero_copy_only=False), bits)))
                word, bit = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
                edge = np.flatnonzero(np.diff(word, prepend=-1)) if len(word) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word[edge]), pa.array(np.bitwise_or.reduceat(bit, edge).view(np.int64) if len(edge) else np.zeros(0, np.int64))], ["word", "bits"])

        rows = keys.mapInArrow(places, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        table = np.zeros(bits // 64, np.uint64)
        table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def __getstate__(self):
        return {"table": self.table, "bits": getattr(self, "bits", 0)}

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        if self.table is not None:
            table = self.table.value
            for at in _places(keys, self.bits):
                found &= (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
        return found

    def narrowed(self, df: DataFrame, column: str) -> DataFrame:
        """df itself if there is a bitmap, else its rows whose value of the column is a key."""
        return df if self.table is not None else df.join(self.keys.withColumnRenamed(self.keys.columns[0], column), column, "left_semi")
