import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragloom.operators import agents, aicl, context, evaluation, generation, kg, retrieval
from ragloom.plans.pipeline import Transformer, queries
from ragloom.sources import datasets


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"q{i}", f"query {i}", f"d{j}", float(3 - j), f"text {j} of {i}") for i in range(3) for j in range(3)]
    return spark.createDataFrame(rows, "qid string, query string, docno string, score double, text string")


def test_bm25_and_compose(spark):
    docs = spark.createDataFrame([("1", "red fox jumps"), ("2", "blue whale swims deep"), ("3", "red whale")], "docno string, text string")
    pipe = Transformer(lambda q: retrieval.bm25(q, docs)) % 1 >> Transformer(lambda r: retrieval.with_texts(r, docs)) >> Transformer(context.concatenator)
    assert pipe.search(spark, "red whale").first()["qcontext"] == "red whale"
    assert retrieval.bm25(queries(spark, ["zzz"]), docs).count() == 0


def test_reader_and_experiment(spark, found):
    out = generation.reader(context.concatenator(found), generation.EchoBackend())
    assert out.columns == ["prompt", "qid", "query_0", "qanswer"] and out.count() == 3
    gold = out.select("qid", F.array("qanswer").alias("gold_answer"))
    values = evaluation.long_form({"a": out, "b": out.withColumn("qanswer", F.lit("x"))}, gold)
    table = {r["system"]: r for r in evaluation.experiment(values, ("EM", "F1")).collect()}
    assert table["a"]["EM"] == 1.0 and table["b"]["F1"] == 0.0
    assert {r["worse"] for r in evaluation.against_baseline(values, "a").collect()} == {3}
    assert generation.prompts(context.concatenator(found.limit(0))).count() == 0


def test_compared_systems(spark):
    topics = spark.createDataFrame([(f"q{i}", f"what {i}") for i in range(6)], "qid string, query string")
    gold = topics.select("qid", F.array("query").alias("gold_answer"))
    right = lambda t: t.select("qid", F.col("query").alias("qanswer"))
    half = lambda t: t.select("qid", F.when(F.col("qid") < "q3", F.col("query")).otherwise("no").alias("qanswer"))
    out = evaluation.compared([right, half], topics, gold, ("EM", "F1"), names=["right", "half"], baseline=0, timed=True)
    rows = {r["name"]: r for r in out.collect()}
    assert (rows["right"]["EM"], rows["half"]["EM"], rows["right"]["EM_p"]) == (1.0, 0.5, None)
    assert (rows["half"]["EM_better"], rows["half"]["EM_worse"]) == (0, 3) and 0 < rows["half"]["EM_p"] < 1
    assert all(r["mrt"] > 0 for r in rows.values())
    assert evaluation.compared([right], topics, gold, ("EM",)).columns == ["name", "EM"]
    with pytest.raises(ValueError):
        evaluation.compared([right, half], topics, gold, names=["a", "a"])


def test_archive_specs(spark, tmp_path):
    (tmp_path / "names.txt").write_text("AA/one.jsonl\n\n AB/two.jsonl \n")
    specs = datasets.members_listed(spark, str(tmp_path / "names.txt"), "https://x.example/files/abstracts.tar.bz2?dl=1")
    assert specs == {n: f"https://x.example/files/abstracts.tar.bz2?dl=1#{n}" for n in ("AA/one.jsonl", "AB/two.jsonl")}
    assert [datasets.unpacked(s) for s in (*specs.values(), "a.jsonl", "b.tgz#c")] == ["abstracts/AA/one.jsonl", "abstracts/AB/two.jsonl", "a.jsonl", "b/c"]
    for k, spec in enumerate(specs.values()):
        file = tmp_path / datasets.unpacked(spec)
        file.parent.mkdir(parents=True)
        file.write_text(json.dumps({"id": str(k), "contents": f"T{k}\nbody"}) + "\n")
    d = datasets.FileDataset(spark, str(tmp_path), {"corpus": specs})
    assert {(r["docno"], r["title"], r["text"]) for r in d.corpus().collect()} == {("0", "T0", "body"), ("1", "T1", "body")}


def test_p_value():
    assert evaluation.two_sided_p(2.262, 10) == pytest.approx(0.05, abs=1e-3)


@pytest.mark.parametrize("n", [1, 2])
def test_backend_contract(spark, n):
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "qid string, prompt string")
    out = generation.generated(rows, generation.EchoBackend(), num_responses=n, logprobs_field="lp").collect()
    assert len(out) == 2 * n and {r["qanswer"] for r in out} == {"resp:a", "resp:b"}
    upper = generation.FunctionBackend(function=lambda ps: [p.upper() for p in ps])
    assert {r["qanswer"] for r in generation.generated(rows, upper).collect()} == {"A", "B"}
    with pytest.raises(ValueError):
        generation.generated(rows, upper, num_responses=2)
    with pytest.raises(ValueError):
        upper.logprobs_generator()


def test_backend_registry(monkeypatch):
    b = generation.Backend.from_dsn("echo:m/x-1.5 max_new_tokens=7 supports_logprobs=False")
    assert (b.model_id, b.max_new_tokens, b.supports_logprobs) == ("m/x-1.5", 7, False)
    with pytest.raises(ValueError):
        generation.Backend.from_dsn("nothing")
    monkeypatch.delenv("LLM_API_KEY", raising=False)
    with pytest.raises(ValueError):
        generation.HTTPBackend("m")
    http = generation.HTTPBackend("m", api_key="k", max_retries=1)
    monkeypatch.setattr(http, "_post", lambda body: {"choices": [{"message": {"content": "hi"}}]})
    assert http.generate(["x"], max_new_tokens=1, num_responses=2) == [[("hi", None), ("", None)]]


def test_judge(spark):
    run = spark.createDataFrame([("1", "a")], "qid string, qanswer string")
    qrels = spark.createDataFrame([("1", 3, "r"), ("1", 3, "s"), ("1", 1, "t")], "qid string, relevance int, text string")
    backend = generation.ColumnBackend(function=lambda p: F.lit("3 good"))
    got = {a: evaluation.judged_pointwise(run, qrels, backend, agg=a).first()["value"] for a in evaluation.AGGREGATES}
    assert got == {"max": 3, "min": 3, "sum": 6, "avg": 3.0, "none": [3, 3]}
    with pytest.raises(ValueError):
        evaluation.judged_pointwise(run, qrels, backend, agg="median")


def test_bertscore_prefers_the_closer(spark):
    qrels = spark.createDataFrame([("1", 3, "the red fox")], "qid string, relevance int, text string")
    score = lambda a: evaluation.bertscore(spark.createDataFrame([("1", a)], "qid string, qanswer string"), qrels).first()["value"]
    assert score("the red fox") == pytest.approx(1.0) and score("a red box") > score("blue sky")


def test_fusion_order(spark):
    rows = spark.createDataFrame([("1", "q", "d1", 0.1, "low", "T"), ("1", "q", "d2", 0.9, "high", "U")], "qid string, query string, docno string, score double, text string, title string")
    assert generation.fusion_inputs(rows).first()["inputs"] == ["question: q title: U context: high", "question: q title: T context: low"]
    assert generation.fusion_reader(rows, lambda s: s.map(lambda x: x[0][-4:]), 1).first()["qanswer"] == "high"


def _agent_case(spark, script, **options):
    asked = queries(spark, ["a", "b", "c", "d"], ["1", "2", "3", "4"])
    docs = spark.createDataFrame([("d1", "T", "words", 1.0)], "docno string, title string, text string, score double")
    rows = spark.createDataFrame(script, "qid string, turn int, text string")
    retriever = lambda q: q.filter("query != 'nothing'").withColumn("_j", F.lit(1)).join(docs.withColumn("_j", F.lit(1)), "_j").drop("_j")
    out = agents.search_r1(retriever, generation.ScriptedBackend(script=rows), max_turn=2, **options).transform(asked)
    return {r["qid"]: r for r in out.collect()}


def test_agent_transitions(spark):
    out = _agent_case(spark, [("1", 0, "<answer>x"), ("2", 0, "<search>s"), ("2", 1, "<answer>y</answer>"), ("3", 0, "hm"), ("4", 0, "<search>nothing</search>")])
    assert [out[k]["stop_reason"] for k in "1234"] == ["Got answer", "Got answer", "No answer, no search", "No retrieval results"]
    assert out["1"]["qanswer"] == "x" and out["1"]["output"].endswith("</answer>")
    assert out["2"]["search_history"] == ["s"] and "Doc 1(Title: T) words" in out["2"]["context"]
    assert _agent_case(spark, [("1", 0, "<search>a"), ("1", 1, "<search>b")])["1"]["stop_reason"] == "No answer after max turns"


def test_ircot(spark):
    docs = spark.createDataFrame([("d1", "T", "words", 1.0)], "docno string, title string, text string, score double").withColumn("_j", F.lit(1))
    retriever = lambda q: q.withColumn("_j", F.lit(1)).join(docs, "_j").drop("_j")
    script = spark.createDataFrame([("1", 0, "a thought"), ("1", 1, "So the answer is 4")], "qid string, turn int, text string")
    loop = agents.IRCOT(retriever, generation.ScriptedBackend(script=script))
    assert loop.transform(queries(spark, ["q"])).first()["qanswer"] == "So the answer is 4"
    loop.max_iterations = 1
    assert loop.transform(queries(spark, ["q"])).first()["qanswer"] == "a thought"
    loop.max_iterations = 2
    assert [loop.exceeded(i) for i in (1, 2, 3)] == [False, True, True]


def test_aicl(spark, found):
    labels = aicl.labels(found, spark.createDataFrame([("q0", "TEXT 1"), ("q1", "none")], "qid string, gold_answer string"), 3)
    got = {r["qid"]: r["labels"] for r in labels.collect()}
    assert got == {"q0": [0, 1, 1], "q1": [0, 0, 0], "q2": [0, 0, 0]}
    selector = aicl.AICLContextSelector(3)
    with pytest.raises(RuntimeError):
        selector.predict_k(found)
    out = selector.fit(found, labels).transform(found)
    assert out.columns == found.columns and 0 < out.count() <= found.count()


def test_chains(spark):
    graph = F.array(*(F.struct(F.lit(h).alias("head"), F.lit("r").alias("relation"), F.lit(t).alias("tail")) for h, t in (("a", "b"), ("b", "c"))))
    docs = spark.createDataFrame([("1", "a c", "d1", 0, "text")], "qid string, query string, docno string, rank int, text string").withColumn("knowledge_graph", graph)
    encoder = lambda df, text, out: retrieval.hashed_vectors(df, text, out, 8)
    script = spark.createDataFrame([("1", 0, "B", [{"B": -0.1, "A": -3.0}]), ("1", 1, "A", [{"A": -0.1, "Z": -0.2}])], "qid string, turn int, text string, logprobs array<map<string,double>>")
    chains = kg.reasoning_chains(docs, generation.ScriptedBackend(script=script), encoder)
    best = chains.first()["chains"]
    assert best[0]["score"] > best[-1]["score"] and len(best[0]["triples"]) == 1
    assert kg.chain_documents(chains, docs).first()["qcontext_doc_count"] == 1
    assert kg.chain_texts(chains).first()["qcontext"].startswith("<")
    none = kg.reasoning_chains(docs.withColumn("knowledge_graph", F.array().cast(kg.TRIPLES)), generation.ScriptedBackend(script=script), encoder)
    assert none.first()["chains"] == []


def test_graph_extraction_cache(spark, tmp_path):
    docs = spark.createDataFrame([("1", "Dog", "A dog runs.")], "docno string, title string, text string")
    backend = generation.ColumnBackend(function=lambda p: F.lit("<It; does; run>"))
    path = str(tmp_path / "kg")
    for _ in range(2):
        assert kg.extract_graph(docs, backend, cache=path).first()["knowledge_graph"][0]["head"] == "Dog"
    assert spark.read.parquet(path).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "dev.jsonl").write_text("".join(json.dumps(r) + "\n" for r in ({"id": "1", "question": "who", "golden_answers": ["a", "b"]}, {"id": "2", "question": "what", "golden_answers": []})))
    (tmp_path / "wiki.jsonl").write_text("\n".join([json.dumps({"id": "7", "contents": "Title\nBody\nmore"})] * 20 + ["{broken"]) + "\n")
    (tmp_path / "dev.json").write_text(json.dumps([{"_id": "x", "type": "t", "question": "q", "answer": "a", "context": [["T", ["one", "two"]], ["U", ["three"]]]}]))
    d = datasets.question_files(spark, str(tmp_path))
    assert d.topics("dev").count() == 2 and {r["gold_answer"] for r in d.answers("dev").collect()} == {"a", "b", None}
    with pytest.raises(ValueError):
        d.topics(None)
    with pytest.raises(NotImplementedError):
        d.corpus()
    wiki = datasets.read_wiki_passages(spark, str(tmp_path / "wiki.jsonl"))
    assert wiki.count() == 20 and wiki.first()["text"] == "Body\nmore"
    rows = datasets.reading_files(spark, str(tmp_path)).topics("dev").orderBy("docno").collect()
    assert [(r["docno"], r["title"], r["text"]) for r in rows] == [("x_00", "T", "one two"), ("x_01", "U", "three")]
    datasets.register_dataset("mine", lambda: datasets.TableDataset({"corpus": wiki}))
    assert datasets.get_dataset("mine").corpus().count() == 20 and "mine" in datasets.list_datasets()
    spark.dataSource.register(datasets.QuestionSource)
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "dev.jsonl").write_text((tmp_path / "dev.jsonl").read_text())
    assert spark.read.format("rag_questions").load(str(tmp_path / "q")).count() == 2


def test_streams(spark, tmp_path):
    from ragloom.streaming import streams

    spark.createDataFrame([("1", "who"), ("1", "who"), ("2", "what")], "qid string, query string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid string, query string").parquet(str(tmp_path / "in"))
    out = streams.answered(stream, generation.EchoBackend(), F.col("query"))
    q = out.writeStream.format("memory").queryName("answers").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.table("answers").filter("qanswer = 'resp:who'").count() == 2


def test_catalogue_imports():
    import __spark_entry__

    assert {"flagship", "bm25_topk"} <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dense_takes_any_key_and_vector(spark):
    docs = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 2.0]), ("n", None), ("m", [None, 1.0]), ("w", [1.0, 1.0, 1.0])], "docno string, doc_vec array<double>")
    asked = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 1.0]), ("q3", None), ("q4", [1.0])], "qid string, query_vec array<double>")
    want = [("q1", "a", 1.0, 0), ("q1", "b", 1.0, 1), ("q2", "c", 2.0, 0), ("q2", "a", 0.0, 1)]
    for most in (1 << 20, 1):
        got = retrieval.dense(asked, docs, k=2, most=most, block=2)
        assert sorted(map(tuple, got.select("qid", "docno", "score", "rank").collect())) == sorted(want)
        assert retrieval.dense(asked, docs.limit(0), most=most).count() == retrieval.dense(asked.limit(0), docs, most=most).count() == 0


def test_cutoff_limits_each_partition(spark, found):
    cut = (Transformer(lambda df: df) % 2)(found)
    assert "WindowGroupLimit" in cut._jdf.queryExecution().executedPlan().toString()
    assert {r["rank"] for r in cut.collect()} == {0, 1}


def test_bm25_null_and_empty_texts(spark):
    docs = spark.createDataFrame([("1", "red fox"), ("2", None), ("3", ""), ("4", "fox fox")], "docno string, text string")
    got = retrieval.bm25(queries(spark, ["the fox"]), docs).collect()
    assert [r["docno"] for r in sorted(got, key=lambda r: r["rank"])] == ["4", "1"]


def test_search_loop_limits_and_repeats(spark):
    """q1 repeats a query, q2 meets the limit, q3 answers at once."""
    begin, end = "<|begin_search_query|>", "<|end_search_query|>"
    turns = {
        "q1": [f"look {begin}sky{end}", f"again {begin}sky{end} \n", "so \\boxed{blue}"],
        "q2": [f"{begin}one{end}", f"{begin}two{end}", f"{begin}three{end}", "\\boxed{none}"],
        "q3": ["\\boxed{now}"],
    }
    rows = [(q, t, text) for q, texts in turns.items() for t, text in enumerate(texts)]

    class Reads(generation.ScriptedBackend):
        def apply(self, df, prompt, *rest):
            if "reasoning" in df.columns:
                none = F.lit(None).cast(generation.LOGPROBS).alias("logprobs")
                return df.withColumn("_out", F.array(F.struct(F.concat(F.lit("Final Information: of "), "query").alias("text"), none)))
            return super().apply(df, prompt, *rest)

    backend = Reads(script=spark.createDataFrame(rows, "qid string, turn int, text string"))
    docs = spark.createDataFrame([("d", "t", "text", 1.0)], "docno string, title string, text string, score double")
    loop = agents.SearchO1Loop(lambda q: q.join(docs), backend, max_searches=2)
    asked = spark.createDataFrame([(q, "why") for q in turns], "qid string, query string")
    got = {r["qid"]: r for r in loop.transform(asked).collect()}
    assert {q: r["qanswer"] for q, r in got.items()} == {"q1": "blue", "q2": "none", "q3": "now"}
    assert [x["query"] for x in got["q1"]["all_queries"]] == ["sky"] and [x["query"] for x in got["q2"]["all_queries"]] == ["one", "two"]
    assert agents.SEARCHED_BEFORE_TEXT in got["q1"]["history"][3] and agents.SEARCH_LIMIT_TEXT in got["q2"]["output"] and "of sky" in got["q1"]["output"]
    assert {q: (r["iteration"], r["stop_reason"]) for q, r in got.items()} == {"q1": (3, "finished"), "q2": (4, "finished"), "q3": (1, "finished")}
    assert got["q1"]["history"][1] == "\n\n<|begin_search_result|>of sky<|end_search_result|>\n\n" and got["q1"]["history"][3] == f"\n<|begin_search_result|>\n{agents.SEARCHED_BEFORE_TEXT}\n<|end_search_result|>\n"


def test_forced_first_search(spark):
    """q1 asks in its second step, q2 never asks and is made to, q3 opens a thought, q4 answers, q5 closes its thought at once."""
    begin, end = "<|begin_search_query|>", "<|end_search_query|>"
    turns = {
        "q1": {-3: "step\n\nignored", -2: f"look {begin}sky{end} and on", -1: "unused"},
        "q2": {-3: "well\n\n", -2: "so\n\n", -1: "hm", 0: f"sea{end} tail"},
        "q3": {-3: "<think>\n\n", -2: "deep\n\n", -1: "x", 0: f"air{end}"},
        "q4": {-3: "it is \\boxed{now}", 0: ""},
        "q5": {-3: "</think>\n\n", -2: "fine", -1: "", 0: f"fire{end}"},
    }
    rows = [(q, t, text) for q, texts in turns.items() for t, text in texts.items()]

    class Reads(generation.ScriptedBackend):
        def apply(self, df, prompt, *rest):
            if "reasoning" in df.columns:
                none = F.lit(None).cast(generation.LOGPROBS).alias("logprobs")
                return df.withColumn("_out", F.array(F.struct(F.concat(F.lit("Final Information: of "), "query").alias("text"), none)))
            return super().apply(df, prompt, *rest)

    docs = spark.createDataFrame([("d", "t", "text", 1.0)], "docno string, title string, text string, score double")
    loop = agents.SearchO1Loop(lambda q: q.join(docs), Reads(script=spark.createDataFrame(rows, "qid string, turn int, text string")), forced_first=True, max_turn=1)
    got = {r["qid"]: r for r in loop.transform(spark.createDataFrame([(q, "why") for q in turns], "qid string, query string")).collect()}
    assert {q: [x["query"] for x in r["all_queries"]] for q, r in got.items()} == {"q1": ["sky"], "q2": ["sea"], "q3": ["air"], "q4": [], "q5": ["fire"]}
    assert got["q1"]["history"][0] == f"step\n\nlook {begin}sky{end}" and got["q2"]["history"][0] == f"well\n\n{begin}sea{end}" and got["q3"]["history"][0] == f"<think>\n\ndeep\n\n{begin}air{end}"
    assert got["q4"]["qanswer"] == "now" and got["q4"]["stop_reason"] == "finished" and got["q5"]["history"][0] == f"fine{begin}fire{end}"


def test_local_models_take_a_loader(spark):
    def loader(backend):
        return lambda prompts, new, logprobs, stops: [(f"{p} says {new} STOP more", [{"x": -1.0}] if logprobs else None) for p in prompts]

    rows = spark.createDataFrame([("q", "hi")], "qid string, prompt string")
    backend = generation.LocalModelBackend(kind="causal", loader=loader, max_new_tokens=7)
    assert generation.generated(rows, backend, stop_sequences=["STOP"]).first()["qanswer"] == "hi says 7 "
    with pytest.raises(ImportError, match="loader"):
        generation.get_backend("seq2seq", "m")


def test_public_names_import():
    import ragloom

    assert all(getattr(ragloom, name) is not None for name in ragloom.__all__)
    with pytest.raises(AttributeError):
        ragloom.nothing  # noqa: B018


def test_known_datasets(spark, tmp_path):
    names = datasets.known_datasets(spark, str(tmp_path))
    assert set(names) <= set(datasets.list_datasets())
    (tmp_path / "nq").mkdir()
    (tmp_path / "nq_wiki").mkdir()
    (tmp_path / "nq" / "dev.jsonl").write_text(json.dumps({"id": "1", "question": "why", "golden_answers": ["so", "thus"]}))
    (tmp_path / "nq_wiki" / "corpus.jsonl").write_text(json.dumps({"id": "d", "contents": "Title\nBody"}))
    nq = datasets.get_dataset("nq")
    assert nq.topics("dev").first()["query"] == "why" and nq.answers("dev").count() == 2 and nq.corpus().first()["text"] == "Body"
    qrels = spark.createDataFrame([("1", "d", 1), ("1", "e", 0)], "qid string, docno string, label int")
    assert datasets.answers_of_qrels(qrels, nq.corpus()).collect()[0]["gold_answer"] == "Body"


def test_bertscore_equals_all_pairs(spark, monkeypatch):
    """Against every pair of tokens in plain Python, with few pairs held at once; the lists of letter pairs are not shuffled."""
    rng = random.Random(5)
    letters = lambda t: {t[i : i + 2] for i in range(max(len(t) - 1, 1))}
    tokens = lambda s: [t for t in re.split("[^a-z0-9]+", (s or "").lower()) if t]
    text = lambda: " ".join("".join(rng.choice("abcd9") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 30)))
    rows = [(str(i), text(), text()) for i in range(60)] + [("null", None, "a b"), ("none", "A, b", None), ("both", "", "..."), ("é", "é a ab", "AB z"), ("zz", "zzzz9", "z 9")]

    def mean(x, y):
        return sum(max((len(letters(s) & letters(t)) / (len(letters(s)) * len(letters(t))) ** 0.5 for t in y), default=0.0) for s in x) / len(x) if x else 0.0

    df = spark.createDataFrame(rows, "qid string, qanswer string, text string").withColumn("relevance", F.lit(3))
    for part in ("p", "r", "f1"):
        got = evaluation.bertscore(df, df, part=part)
        assert "array_intersect" not in got._jdf.queryExecution().toString()
        got = {r["qid"]: r["value"] for r in got.collect()}
        for q, a, b in rows:
            p, r = mean(tokens(a), tokens(b)), mean(tokens(b), tokens(a))
            assert abs(got[q] - {"p": p, "r": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}[part]) < 1e-12
    lists = [pa.array([tokens(x[k]) for x in rows], pa.list_(pa.string())) for k in (1, 2)]
    whole = evaluation._matched(*lists)
    monkeypatch.setattr(evaluation, "_HELD", 7)
    assert evaluation._matched(*lists).equals(whole) and len(evaluation._matched(lists[0][:0], lists[1][:0])) == 0


def test_bertscore_takes_a_scorer(spark):
    run = spark.createDataFrame([("1", "abc")], "qid string, qanswer string")
    refs = spark.createDataFrame([("1", 3, "ab"), ("1", 3, "abcd"), ("1", 1, "abc")], "qid string, relevance int, text string")
    scorer = lambda a, r: (a.str.len() - r.str.len()).abs().rsub(2.0)
    assert evaluation.bertscore(run, refs, scorer=scorer).first()["value"] == 1.0
