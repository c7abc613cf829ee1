import random

import pytest
from pyspark.sql import functions as F
from test_operators import lines_left, words

import corpus_pipeline
from ragloom.llm import language_id, quality
from ragloom.session import ship

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def near():
    """Groups of near copies, a pair of texts that share an id, and edge cases."""
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(4, 90))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(50)}"
            rows.append((len(rows) * 7 % 101, " ".join(copy)))
    same = "one two three four five six seven"
    rows += [(500, "entirely different text under one id here"), (500, same), (501, same), (500, same), (600, ""), (600, None), (601, ""), (None, same), (None, None), (7000, "a b"), (7001, "A B")]
    return rows


def sets(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates_against_brute_force(spark, near):
    nodes = sorted({(i, t) for i, t in near if i is not None and sets(t)}, key=lambda r: r[0])
    group = list(range(len(nodes)))
    for a, x in enumerate(nodes):
        for b in range(a):
            s, o = sets(x[1]), sets(nodes[b][1])
            if 10 * len(s & o) >= 8 * len(s | o):
                new, old = sorted((group[a], group[b]))
                group = [new if g == old else g for g in group]
    got = STAGES["near_duplicates"](spark, rows_of(spark, near), "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    linked = [r for r in kept if r[0] is not None and sets(r[1])]
    assert sorted(group[nodes.index(r)] for r in linked) == sorted(set(group))
    least = {g: min(n[0] for n, h in zip(nodes, group, strict=True) if h == g) for g in group}
    assert all(r[0] == least[group[nodes.index(r)]] for r in linked)
    rest = sorted((r for r in kept if r[0] is None or not sets(r[1])), key=str)
    assert rest == sorted({r for r in near if r[0] is not None and not sets(r[1])} | {(None, None), (None, "one two three four five six seven")}, key=str)


def test_line_stage_against_brute_force(spark):
    rows = [(1, "a b c d e\nq"), (2, "a b c d e f\nz z1 z2"), (3, "q\nQ"), (4, None), (5, ""), (None, "q")]
    got = STAGES["line_dedup"](spark, rows_of(spark, rows), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(lines_left(rows), key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_model_stages_keep_what_the_model_says(spark, tmp_path):
    """Each stage's rows are those that its model scores at the threshold, row by row."""
    sf = "/root/testdata/sf0.001"
    docs = ship(spark).read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), learn_from=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    want = {r["doc_id"] for r in quality.scores(docs, model).collect() if r["score"] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in STAGES["quality"](spark, docs, sf).collect()} == want
    model = language_id.train(docs, learn_from=F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    told = language_id.languages(docs, model).collect()
    want = {r["doc_id"] for r in told if r["lang_pred"] != language_id.UNKNOWN and r["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert {r["doc_id"] for r in STAGES["language"](spark, docs, sf).collect()} == want


def test_packing_stage_covers_every_text(spark, near):
    rows = [(i, t) for i, t in near if i is not None]
    out = STAGES["packing"](spark, rows_of(spark, rows), "").collect()
    assert {r["doc_id"] for r in out} >= {i for i, t in rows if t}
