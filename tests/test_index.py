import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import retrieval
from ragloom.operators.index import TermIndex, _packed, _unpacked
from ragloom.operators.vector_index import VectorIndex


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    common, rare = [f"c{i}" for i in range(5)], [f"r{i}" for i in range(3000)]
    rows = [(f"d{i:04}", " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(rng.choice([3, 20, 60])))) for i in range(1500)]
    rows += [("null", None), ("empty", ""), ("long", "c1 " * 500 + "r7"), ("tie1", "r1 r2"), ("tie2", "r1 r2")]
    return spark.createDataFrame(rows, "docno string, text string").repartition(6)


def found(df):
    return sorted(map(tuple, df.select("qid", "query", "docno", "score", "rank").collect()))


def test_index_equals_a_scan_also_by_batches(spark, corpus, tmp_path):
    rng = random.Random(3)
    asked = spark.createDataFrame([(str(i), " ".join(rng.choice([f"c{rng.randrange(5)}", f"r{rng.randrange(3000)}"]) for _ in range(3))) for i in range(25)] + [("none", "zz"), ("tie", "r1 R2"), ("null", None)], "qid string, query string")
    whole, parts = TermIndex(spark, str(tmp_path / "whole")), TermIndex(spark, str(tmp_path / "parts"), buckets=7)
    whole.add(corpus)
    for k in range(3):
        assert parts.add(corpus.filter(F.pmod(F.xxhash64("docno"), F.lit(3)) == k)) == k
    for k in (1, 4, 3000):
        want = found(retrieval.bm25(asked, corpus, k=k))
        assert found(whole.bm25(asked, k=k)) == want == found(parts.bm25(asked, k=k)) and len(want) > 25
    with pytest.raises(ValueError, match="7 buckets"):
        TermIndex(spark, str(tmp_path / "parts"), buckets=8).add(corpus)
    spark.createDataFrame([("x", 1, [], [], [], 1, 1, 0)], "term string, segment bigint, docs array<string>, tfs array<int>, lengths array<int>, max_tf int, min_length int, bucket int").write.partitionBy("bucket").parquet(str(tmp_path / "parts/postings/batch=9"))
    assert found(parts.bm25(asked, k=4)) == found(retrieval.bm25(asked, corpus, k=4))


def test_only_files_of_the_asked_terms_are_read(spark, corpus, tmp_path):
    index = TermIndex(spark, str(tmp_path / "i"))
    index.add(corpus)
    files = lambda *words: {
        r["f"] for r in index.blocks(spark.createDataFrame([(w,) for w in words], "term string")).select(F.input_file_name().alias("f")).distinct().collect()}
    one, many = files("r5"), files(*(f"r{i}" for i in range(40)))
    assert 1 <= len(one) <= 8 and len({f.split("bucket=")[1].split("/")[0] for f in one}) == 1
    assert len(one) < len(many) and len({f.split("bucket=")[1].split("/")[0] for f in many}) <= 40
    plan = index.blocks(spark.createDataFrame([("r5",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "term" in plan.split("PushedFilters:")[1].split("]")[0]


def test_blocks_are_skipped_by_their_bounds(spark, tmp_path):
    """One rare term decides; blocks of a term that all documents have can't reach it in the segments without the rare one."""
    rows = [(f"d{i:05}", "all " + "filler " * (i % 50) + ("needle needle" if i in (7, 3000) else "")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "docno string, text string").repartition(4)
    index = TermIndex(spark, str(tmp_path / "i"))
    index.add(docs)
    asked = spark.createDataFrame([("q", "needle all")], "qid string, query string")
    every = index.blocks(asked.select(F.explode(F.array(F.lit("needle"), F.lit("all"))).alias("term"))).count()
    kept = index._kept(asked.select("qid", F.explode(F.array(F.lit("needle"), F.lit("all"))).alias("term")), 2, 1.2, 0.75).count()
    assert kept < every
    assert found(index.bm25(asked, k=2)) == found(retrieval.bm25(asked, docs, k=2))


def test_a_segment_sends_its_best_documents_only(spark, corpus, tmp_path):
    """Scores are summed within a segment: k rows of each query and segment go on, whatever number of documents has its terms."""
    index = TermIndex(spark, str(tmp_path / "i"))
    index.add(corpus)
    asked = spark.createDataFrame([("q", "c1 c2 c3 r7"), ("p", "c4")], "qid string, query string")
    out = index.bm25(asked, k=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "arrays_zip" not in plan
    assert found(out) == found(retrieval.bm25(asked, corpus, k=3))


def test_postings_are_packed_and_unpacked():
    doc, tf, length = np.array([0, 3, 70000, 2, 5]), np.array([1, 300, 2, 1, 1]), np.array([9, 70000, 4, 1, 255])
    packed = _packed(doc, tf, length, np.array([3, 0, 2]))
    for a, got in ((0, _unpacked(packed)), (3, _unpacked(packed.slice(1)))):
        assert [x.tolist() for x in got[:3]] == [x[a:].tolist() for x in (doc, tf, length)] and got[3].tolist() == ([3, 0, 2] if not a else [0, 2])
    assert [len(x) for x in _unpacked(packed[:0])] == [0, 0, 0, 0]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16)) * 3
    x = np.round(centres[rng.integers(0, 12, 1200)] + rng.normal(size=(1200, 16)), 3)
    x[5] = x[6]
    rows = [(f"d{i:04}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("hole", [None] * 16), (None, [0.0] * 16)]
    asked = [(f"q{i}", (x[i * 31] + rng.normal(size=16) * 0.3).tolist()) for i in range(30)] + [("q_null", None)]
    return spark.createDataFrame(rows, "docno string, doc_vec array<double>"), spark.createDataFrame(asked, "qid string, query_vec array<double>")


def test_vector_index_recall_and_exact_mode(spark, vectors, tmp_path):
    docs, asked = vectors
    want = {(r["qid"], r["docno"], r["score"], r["rank"]) for r in retrieval.dense(asked, docs.filter("docno is not null"), k=10).collect()}
    index = VectorIndex(spark, str(tmp_path / "v"), part=50)
    index.build(docs.filter("docno < 'd0800' or docno is null"), lists=24, sample=400)
    assert index.add(docs.filter("docno >= 'd0800'")) == 1
    get = lambda **more: {(r["qid"], r["docno"], r["score"], r["rank"]) for r in index.search(asked, k=10, **more).collect()}
    assert get(probe=2, exact=True) == want and len(want) == 300
    recall = len({x[:2] for x in get(probe=4)} & {x[:2] for x in want}) / len(want)
    assert recall >= 0.9
    with pytest.raises(ValueError, match="one size"):
        VectorIndex(spark, str(tmp_path / "w")).build(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "docno string, doc_vec array<double>"))
