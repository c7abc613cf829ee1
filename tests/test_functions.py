import random
import pytest
from pyspark.sql import functions as F

from ragloom.functions import text as X
from ragloom.functions.stem import stem
from ragloom.operators import columns as C
from ragloom.operators.context import concat


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("p", "g", "em", "f1"),
    [("The cat.", "cat", 1.0, 1.0), ("x y x", "x x z", 0.0, 2 / 3), ("", "", 1.0, 0.0), ("yes", "yes it is", 0.0, 0.0), ("yes", "yes", 1.0, 1.0), ("Été, là", "été là", 1.0, 1.0), ("a b", "c d", 0.0, 0.0)],
)
def test_answer_measures(spark, p, g, em, f1):
    assert value(spark, X.exact_match(F.lit(p), F.lit(g))) == em
    assert value(spark, X.token_f1(F.lit(p), F.lit(g))) == pytest.approx(f1)


def test_best_of_no_gold_is_null(spark):
    assert value(spark, X.best_of(X.exact_match, F.lit("a"), F.array().cast("array<string>"))) is None
    assert value(spark, X.best_of(X.token_f1, F.lit("b c"), F.array(F.lit("z"), F.lit("b c")))) == 1.0


def test_rouge(spark):
    r = X.rouge(F.lit("the cat sat"), F.lit("the cat was here"), "rouge1")
    assert value(spark, r["P"]) == pytest.approx(2 / 3)
    assert value(spark, r["R"]) == pytest.approx(0.5)
    assert value(spark, X.rouge(F.lit("a c b d"), F.lit("a b x d"), "rougeL")["P"]) == pytest.approx(0.75)
    assert value(spark, X.rouge(F.lit("a b c"), F.lit("b c d"), "rouge2")["F"]) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        X.rouge(F.lit("a"), F.lit("b"), "rouge9")


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("agreed", "agre"), ("happy", "happi"), ("electriciti", "electr"), ("adjustable", "adjust"), ("sky", "sky"), ("controlling", "control"), ("rate", "rate")])
def test_stem(word, root):
    assert stem(word) == root


def test_reasoning(spark):
    answer, thought = X.split_reasoning(F.lit("a <think>one</think> b\n<think>two"))
    assert value(spark, answer) == "a  b"
    assert value(spark, thought) == "onetwo"


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: X.after_first(F.lit("x <answer> y </answer>"), "<answer>"), "y </answer>"), (lambda: X.after_first(F.lit("none"), "<answer>"), None),
        (lambda: X.last_between(F.lit("<s>a</s><s> b </s><s>c"), "<s>", "</s>"), "b"), (lambda: X.last_between(F.lit("no"), "<s>", "</s>"), None),
        (lambda: X.first_query(F.lit('<s>"who"\t is ... it</s>'), "<s>", "</s>"), "who is it"), (lambda: X.first_query(F.lit("<s> </s>"), "<s>", "</s>"), None),
        (lambda: X.last_query(F.lit("<s>a</s> <s>b"), "<s>", "</s>"), "b"),
        (lambda: X.boxed(F.lit("so \\boxed{\\text{Paris}}")), "Paris"), (lambda: X.boxed(F.lit("nothing")), ""),
        (lambda: X.extracted_answer(F.lit("```python\nx=1\n```"), "codegen"), "x=1"), (lambda: X.extracted_answer(F.lit("z"), "infogen"), "No helpful information found."),
        (lambda: X.answer_cascade(F.lit("hm</think> yes")), "yes"), (lambda: X.answer_cascade(F.lit(" all ")), "all"),
        (lambda: X.replaced_steps(F.lit("Step 1: a\nStep 2: b"), F.lit("Step 2: DELETE THIS STEP\nStep 4: d")), "Step 1: a\n\nStep 4: d"),
        (lambda: X.first_words(F.lit("a b c"), 2), "a b"), (lambda: X.first_words(F.lit(" a  b "), 2), " a  b "), (lambda: X.as_question(F.lit(" who ")), "who?"), (lambda: X.as_question(F.lit("who?")), "who?"),
        (lambda: X.rating(F.lit("7 good")), 7), (lambda: X.rating(F.lit("it is [[4]]")), 4), (lambda: X.rating(F.lit("bad")), None), (lambda: X.verdict(F.lit("x [[A]] [[B]]")), "B"),
        (lambda: X.cut_at_stops(F.lit("a STOP b STOP c"), ["STOP"]), "a STOP b "), (lambda: X.choice_label(F.lit(1)), "C"), (lambda: X.choice_index(F.lit("A")), -1), (lambda: X.choice_index(F.lit("ab")), None),
        (lambda: X.says_answer(F.lit("So the Answer IS 3")), True),
        (lambda: X.shortened_steps(F.array(*[F.lit(f"s{i}") for i in range(1, 9)]), ["zz"]), "Step 1: s1\n\n...\n\nStep 5: s5\n\nStep 6: s6\n\nStep 7: s7\n\nStep 8: s8"),
        (lambda: X.template("{{ a }}-{{b}}", {"a": F.lit("x"), "b": F.lit(None)}), "x-"),
    ],
)
def test_parsers(spark, column, want):
    assert value(spark, column()) == want


def test_triples(spark):
    got = value(spark, X.triples(F.lit("<a; b; c> <x; y> <p; q; r; s>")))
    assert [tuple(t) for t in got] == [("a", "b", "c"), ("p; q", "r", "s")]
    fixed = value(spark, X.repaired_heads(X.triples(F.lit("<It; is; here> <Cat; is; here>")), F.lit("Dog"), F.lit("The cat")))
    assert [t["head"] for t in fixed] == ["Dog", "Cat"]
    parts = X.sentences(F.lit("One cat. Two dogs. "))
    assert value(spark, parts) == ["One cat.", "Two dogs."]
    assert value(spark, X.aligned_sentence(parts, F.struct(F.lit("dogs").alias("head"), F.lit("two").alias("relation"), F.lit("x").alias("tail")))) == 1


def test_concat_budget(spark):
    pieces = F.array(*map(F.lit, ("river", "oak", "stones", "fog")))
    assert value(spark, concat(pieces, tokenizer="chars", max_length=11, max_per_context=4, truncation_rate=1)) == "ri\noa\nst\nfo"
    assert value(spark, concat(pieces, max_elements=3)) == "river\noak\nstones"
    assert value(spark, concat(pieces, tokenizer="chars", max_length=2, max_per_context=4, truncation_rate=2)) == "\n\n\n"


def test_column_versions(spark):
    df = spark.createDataFrame([("q", 1)], "query string, other int")
    once = C.push_columns(df, keep_original=True)
    assert once.columns == ["query_0", "other", "query"]
    twice = C.push_columns(once)
    assert sorted(twice.columns) == ["other", "query_0", "query_1"]
    assert sorted(C.pop_columns(twice).columns) == ["other", "query", "query_0"]
    with pytest.raises(KeyError):
        C.push_columns(df.drop("query"))
    assert C.push_record({"query": "a", "foo": 1}) == {"query_0": "a", "foo": 1}
    assert C.find_maximum_push(["query_0", "query_2", "query_1"]) == ("query_2", 2)
    assert C.find_maximum_push(["x"]) == (None, -1)
    with pytest.raises(ValueError):
        C.require_columns(df, "qid")


@pytest.mark.parametrize(
    ("text", "want"),
    [("The\u2013cat", "\u2013cat"), ("a\u2019s cat", "\u2019s cat"), ("\u201cThe end\u201d", "\u201c end\u201d"), ("the-an a.theory", "thean atheory"), ("l\u00e0 the \u00e9a", "l\u00e0 \u00e9a"), ("An\u00a0apple,\ta pear", "apple pear")],
)
def test_articles_go_at_word_boundaries(spark, text, want):
    assert value(spark, X.normalize_answer(F.lit(text))) == want


def test_overlap_counts_repeats(spark):
    rows = [(list("abca"), list("aacd"), 3), ([], ["a"], 0), (["a"], [], 0), (["b"] * 5, ["b"] * 3, 3)]
    df = spark.createDataFrame(rows, "p array<string>, g array<string>, want int")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", X.overlap(F.col("p"), F.col("g"))).collect())


def test_subsequence_of_long_texts(spark):
    rng = random.Random(4)
    a, b = ([rng.choice("abcdefgh") for _ in range(n)] for n in (150, 170))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    long = [f"w{rng.randrange(500)}" for _ in range(3000)]
    df = spark.createDataFrame([(a, b), (long, long[::2]), ([], b), (None, b)], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.common_subsequence(F.col("a"), F.col("b"))).collect()] == [table[-1][-1], 1500, 0, 0]
