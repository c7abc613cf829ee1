import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from ragloom.operators import aicl, context, evaluation, generation, kg, retrieval
from ragloom.plans.pipeline import Transformer, queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_joined_equals_in_place(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Éa", "x-y"]
    docs = [(f"d{i:03}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [("null", None), ("d000b", "w1 w1"), ("d000a", "w1 w1")]
    asked = [(f"q{i}", " ".join(rng.choice(words) for _ in range(3))) for i in range(12)] + [("q_none", "zzz"), ("q_null", None)]
    d, q = spark.createDataFrame(docs, "docno string, text string").repartition(5), spark.createDataFrame(asked, "qid string, query string")
    near, far = (sorted(map(tuple, retrieval.bm25(q, d, k=4, small=small).collect())) for small in (1 << 20, 0))
    assert near == far and len(near) > 40
    assert [retrieval.bm25(q, d.limit(0), small=s).count() for s in (1 << 20, 0)] == [0, 0]
    numbers = retrieval.bm25(queries(spark, ["w1"]).withColumn("qid", F.lit(7)), d.withColumn("docno", F.monotonically_increasing_id()), k=2).collect()
    assert {r["qid"] for r in numbers} == {7} and len(numbers) == 2
    text = plan(retrieval.bm25(q, d, k=4, small=0))
    assert text.count("array_sort") == 1 and "WindowGroupLimit" in text


def test_dense_without_keys(spark):
    docs = spark.createDataFrame([(None, [1.0]), ("a", [1.0])], "docno string, doc_vec array<double>")
    asked = spark.createDataFrame([(None, [1.0]), ("q", [1.0])], "qid string, query_vec array<double>")
    for most in (1 << 20, 1):
        assert [tuple(r) for r in retrieval.dense(asked, docs, most=most).collect()] == [("q", "a", 1.0, 0)]


def test_limits_cut_before_groups(spark):
    rows = spark.createDataFrame([(f"q{i % 3}", "why", f"d{i}", float(i % 7), f"text {i} Needle {i}") for i in range(90)], "qid string, query string, docno string, score double, text string")
    gold = spark.createDataFrame([("q0", "needle 6")], "qid string, gold_answer string")
    for df in (context.concatenator(rows, max_elements=2), generation.fusion_inputs(rows, 2), aicl.labels(rows, gold, k_max=4)):
        assert "WindowGroupLimit" in plan(df) and df.count() == 3
    assert context.concatenator(rows, max_elements=2).filter("qid = 'q0'").first()["qcontext"] == "text 27 Needle 27\ntext 48 Needle 48"


def labels_by_joining(texts, golds, k_max):
    texts = texts[:k_max]
    return [int(any(g.lower() in " ".join(t.lower() for t in texts[:k]) for g in golds)) for k in range(1, max(len(texts), 1) + 1)]


def test_labels_by_first_hit(spark):
    rng = random.Random(5)
    rows, gold, want = [], [], {}
    for q in range(40):
        texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 9))]
        golds = ["".join(rng.choice("AB ") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 3))]
        rows += [(str(q), f"d{k:02}", float(-k), t or None) for k, t in enumerate(texts)]
        gold.append((str(q), golds))
        want[str(q)] = labels_by_joining(texts, golds, 6)
    got = aicl.labels(spark.createDataFrame(rows, "qid string, docno string, score double, text string"), spark.createDataFrame(gold, "qid string, gold_answer array<string>"), k_max=6)
    assert {r["qid"]: r["labels"] for r in got.collect()} == want


def whole_text(texts, size, cut, max_length, cap, step, separator):
    caps = [c for c in range(cap, 0, -step) if sum(min(size(t), c) for t in texts) + (len(texts) - 1) * separator <= max_length]
    return "\n".join(cut(t, caps[0]) if caps else "" for t in texts)


@pytest.mark.parametrize("max_length", [3, 60, 400, 5000])
def test_frame_under_a_limit(spark, max_length):
    rng = random.Random(max_length)
    texts = [" ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 12))) for _ in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(4)
    for tokenizer, size, cut, sep in (("chars", len, lambda t, c: t[:c], 1), ("words", lambda t: len(t.split()), lambda t, c: " ".join(t.split()[:c]), 0)):
        got = context.frame_concat(df, order=[F.col("i")], tokenizer=tokenizer, max_length=max_length, max_per_context=40, truncation_rate=7)
        assert got.first()["qcontext"] == whole_text(texts, size, cut, max_length, 40, 7, sep)
        few = context.frame_concat(df, order=[F.col("i")], tokenizer=tokenizer, max_elements=3, max_length=max_length, max_per_context=40, truncation_rate=7)
        assert few.first()["qcontext"] == whole_text(texts[:3], size, cut, max_length, 40, 7, sep)
    assert context.frame_concat(df, order=[F.col("i")], max_elements=2).first()["qcontext"] == "\n".join(texts[:2])
    assert context.frame_concat(df.limit(0), tokenizer="chars", max_length=9).first()["qcontext"] == ""


def test_exemplars_by_permutation(spark):
    table = spark.createDataFrame([(i, f"example {i} " + "x" * i) for i in range(11)], "id int, text string")
    docs = spark.createDataFrame([(f"d{i}", "t") for i in range(60)] + [("d1", "again")], "docno string, text string")
    got = {r["docno"]: r["exemplars"] for r in kg.exemplars(docs, table, 4).collect()}
    assert len(got) == 60 and all(len({*t.split("\n")[1:]}) == 4 for t in got.values()) and len({*got.values()}) > 40
    assert {r["docno"]: r["exemplars"] for r in kg.exemplars(docs.repartition(7), table.repartition(3), 4).collect()} == got
    every = kg.exemplars(docs, table, 99, max_chars=1 << 20).first()["exemplars"]
    assert {x.split()[1] for x in every.split("\n")[1:]} == {str(i) for i in range(11)}
    cut = {r["docno"]: r["exemplars"] for r in kg.exemplars(docs, table, 4, max_chars=40).collect()}
    assert all(len(t) <= 40 and got[d].startswith(t) for d, t in cut.items())
    assert "Exchange SinglePartition" not in plan(kg.exemplars(docs, table, 4)).split("BroadcastExchange")[0]
    assert kg.exemplars(docs, table.limit(0), 4).first()["exemplars"] == "" and kg.exemplars(docs.limit(0), table, 4).count() == 0
    with pytest.raises(ValueError, match="characters"):
        kg.exemplars(docs, table.withColumn("text", F.repeat("text", 1 << 24)), 4)


def test_steps_shared_by_systems(spark):
    topics = spark.createDataFrame([(f"q{i}", f"what {i}") for i in range(6)], "qid string, query string")
    gold = topics.select("qid", F.array("query").alias("gold_answer"))
    ran = {k: spark.sparkContext.accumulator(0) for k in ("retrieve", "rerank")}

    def counted(name, score):
        def run(batches):
            for b in batches:
                ran[name].add(b.num_rows)
                yield b

        return Transformer(lambda df: df.withColumn("docno", F.lit(name)).withColumn("score", F.lit(score)).mapInArrow(run, "qid string, query string, docno string, score double"), name)

    retrieve, rerank = counted("retrieve", 1.0), counted("rerank", 2.0)
    answer = lambda text: Transformer(lambda df: df.select("qid", text.alias("qanswer")))
    right, wrong = answer(F.col("query")), answer(F.lit("no"))
    base = retrieve % 3
    systems = [base >> right, base >> rerank >> right, base >> rerank >> wrong, retrieve % 2 >> wrong, lambda t: t.select("qid", F.col("query").alias("qanswer"))]
    out = {r["name"]: (r["EM"], r["F1"]) for r in evaluation.compared(systems, topics, gold, names="abcde", share=True).collect()}
    assert {k: v.value for k, v in ran.items()} == {"retrieve": 6, "rerank": 6}
    assert out == {"a": (1.0, 1.0), "b": (1.0, 1.0), "c": (0.0, 0.0), "d": (0.0, 0.0), "e": (1.0, 1.0)}
    alone = {r["name"]: (r["EM"], r["F1"]) for r in evaluation.compared(systems, topics, gold, names="abcde").collect()}
    assert alone == out and ran["retrieve"].value > 12
    twice = evaluation.compared([base >> right, base >> right], topics, gold, ("EM",), share=True)
    assert {r["EM"] for r in twice.collect()} == {1.0}


@pytest.fixture
def service():
    """Says 429 with a pause to the first two requests of a prompt that asks for it, refuses long prompts, and notes when requests come."""
    seen: list = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = body["prompt"]
            seen.append((time.monotonic(), prompt))
            times = sum(p == prompt for _, p in seen)
            code = 429 if "busy" in prompt and times < 3 else 400 if "wrong" in prompt else 500 if "down" in prompt and times < 2 else 400 if len(prompt.split()) > 8 else 200
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "0.3")
            self.end_headers()
            said = {"choices": [{"text": f"said {prompt}"}]} if code == 200 else {"error": "maximum context length" if len(prompt.split()) > 8 else "no"}
            self.wfile.write(json.dumps(said).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_requests_under_a_limit(spark, service):
    url, seen = service
    make = lambda **more: generation.HTTPBackend(base_url=url, api="completions", api_key="k", pause=0.05, **more)
    rows = spark.createDataFrame([("1", "busy a"), ("2", "fine"), ("3", "wrong"), ("4", "down b"), ("5", "one two three four five six seven eight nine ten")], "qid string, prompt string").coalesce(1)
    got = {r["qid"]: r["qanswer"] for r in generation.generated(rows, make(max_input_length=6)).collect()}
    assert got == {"1": "said busy a", "2": "said fine", "3": "ERROR::other", "4": "said down b", "5": "said one two three four five six"}
    busy = [t for t, p in seen if p == "busy a"]
    assert len(busy) == 3 and all(b - a >= 0.29 for a, b in zip(busy, busy[1:])) and sum(p == "wrong" for _, p in seen) == 1 and sum(p == "down b" for _, p in seen) == 2
    assert generation.generated(rows.filter("qid = '5'"), make()).first()["qanswer"] == "ERROR::reduce_length"
    seen.clear()
    many = spark.createDataFrame([(str(i), f"p{i}") for i in range(8)], "qid string, prompt string").coalesce(1)
    generation.generated(many, make(requests_per_second=5), batch_size=4).collect()
    times = sorted(t for t, _ in seen)
    assert len(times) == 8 and times[-1] - times[0] >= 6 / 5
    chat = make().cut([{"role": "system", "content": "a b"}, {"role": "user", "content": "c d " * 600}])
    assert chat[0]["content"] == "a b" and len(chat[1]["content"].split()) == 510


def test_tokens_by_rank(spark):
    df = spark.createDataFrame([("1", [{"b": -1.0, "a": -0.5, "c": -1.0}, {}]), ("2", None)], "qid string, lp array<map<string,double>>")
    got = {r["qid"]: r["t"] for r in df.select("qid", generation.ranked_tokens("lp").alias("t")).collect()}
    assert [[tuple(x) for x in at] for at in got["1"]] == [[("a", -0.5, 1), ("b", -1.0, 2), ("c", -1.0, 3)], []] and got["2"] is None


def test_pairs_are_judged(spark):
    asked = spark.createDataFrame([("1", "why"), ("2", "how"), ("3", "who"), ("4", "when")], "qid string, query string")
    a, b = (asked.select("qid", F.concat(F.lit(x), "query").alias("qanswer")) for x in "AB")
    backend = generation.ColumnBackend(function=lambda p: F.when(F.contains(p, F.lit("Question: why\nA: Awhy\nB: Bwhy")), "first [[B]] then [[A]]").when(F.contains(p, F.lit("how")), "[[C]]").when(F.contains(p, F.lit("who")), "no").otherwise("[[B]]"))
    got = {r["qid"]: r["verdict"] for r in evaluation.judged_pairwise(a, b.filter("qid != '4'"), asked, backend).collect()}
    assert set(got) == {"1", "2", "3"} and got["2"] == "C" and got["3"] is None and got["1"] in ("A", "B")


def test_items_of_any_kind(spark):
    df = spark.sql("select array(1, 2, 3, 4) as n, array(named_struct('text', 'a', 'i', 1), named_struct('text', null, 'i', 2)) as s, array(named_struct('x', 1)) as bare, array(array('p', 'q'), array('r')) as pairs")
    one = lambda field, formatter=None, **limits: context.concat_items(df, field, "t", formatter, **limits).first()["t"]
    assert one("n") == "1\n2\n3\n4" and one("n", lambda x: x * 10, max_elements=2) == "10\n20"
    assert one("s") == "a\n" and one("bare") == ""
    assert one("s", lambda text, i: F.concat(i.cast("string"), F.coalesce(text, F.lit("-")))) == "1a\n2-"
    assert one("pairs", lambda a, b: F.concat_ws("+", b, a)) == "q+p\nr"


def test_aicl_fit_keeps_the_tasks_of_its_examples(spark):
    rows = [(f"q{i}", "a b", f"d{j}", float(i % 7 * 10 - j), f"text {j}") for i in range(40) for j in range(4)]
    found = spark.createDataFrame(rows, "qid string, query string, docno string, score double, text string")
    labelled = aicl.labels(found, found.select("qid", F.lit("text 1").alias("gold_answer")).distinct(), 3)
    made = aicl.AICLContextSelector(3)
    made.fit(found, labelled)
    examples = made._examples(aicl.features(found, 3), labelled, 1)
    assert made.models and examples.count() == 40 and examples.rdd.getNumPartitions() == 1
    assert "Coalesce" not in plan(examples) and "REPARTITION_BY_NUM" in plan(examples)
