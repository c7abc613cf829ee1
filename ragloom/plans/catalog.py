"""The registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions import text as X
from ragloom.operators import agents, aicl, columns, context, evaluation, generation, kg, retrieval
from ragloom.operators.index import TermIndex
from ragloom.operators.vector_index import VectorIndex
from ragloom.plans.pipeline import Transformer, cutoff, first_topics, ranked
from ragloom.session import ship
from ragloom.streaming import streams
from ragloom.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: ship(spark).read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Relations of the data model, in both languages.
def _docs(t):
    return t("documents").select(F.col("doc_id").cast("string").alias("docno"), F.col("source").alias("title"), "text", "n_chars")


def _asked(t):
    return t("benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


def _found(t):
    """Each source as a query that finds its documents, the longest first."""
    d = t("documents")
    return d.select(F.col("source").alias("qid"), F.concat(F.lit("Which text of "), "source").alias("query"), F.col("doc_id").cast("string").alias("docno"), F.col("n_chars").cast("double").alias("score"), F.col("lang").alias("title"), "text")


_FOUND = """found AS (SELECT source AS qid, 'Which text of ' || source AS query, CAST(doc_id AS VARCHAR) AS docno, CAST(n_chars AS DOUBLE) AS score, lang AS title, text,
    row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) - 1 AS rank FROM documents)"""


def _said(t):
    """Assistant turns with the turn before as query."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t("conversations").withColumn("query", F.lag("text").over(w))
    return rows.filter("role = 'assistant' and query is not null").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "conv_id", "turn", "query", F.col("text").alias("qanswer"))


_SAID = """pairs AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS query FROM conversations),
    said AS (SELECT concat_ws('-', conv_id, turn) AS qid, conv_id, turn, query, text AS qanswer FROM pairs WHERE role = 'assistant' AND query IS NOT NULL)"""
# tokens of a text, and the measures on two lists p and g
_PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~"  # for str.format
# by the definition: runs of word characters and runs of others; a run that is an article is a space; then tokens between white space
_RUNS = f"regexp_extract_all(translate(lower({{0}}), '{_PUNCTUATION}', ''), '[\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{M}}}}_]+|[^\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{M}}}}_]+')"
_TOKENS = f"list_filter(regexp_split_to_array(array_to_string(list_transform({_RUNS}, lambda r: CASE WHEN r IN ('a', 'an', 'the') THEN ' ' ELSE r END), ''), '[\\s\\p{{{{Z}}}}]+'), lambda t: t != '')"
_OVERLAP = "COALESCE(list_sum(list_transform(list_distinct({0}), lambda x: least(len(list_filter({0}, lambda y: y = x)), len(list_filter({1}, lambda y: y = x))))), 0)"


def _run(t):
    said = _said(t)
    gold = said.groupBy("conv_id").agg(context.ordered(["qanswer"], [F.col("turn")]).alias("_g")).select("conv_id", F.transform("_g", lambda x: x["qanswer"]).alias("golds"))
    # the gold answers of a turn are all of its conversation
    return said.join(gold, "conv_id").select("qid", F.concat(F.lit("the "), "qanswer").alias("qanswer"), "golds")


_TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t != '')"


@_query(f"""
    WITH q AS (SELECT DISTINCT item_id, text AS query, unnest({_TERMS.format('text')}) AS term FROM benchmark),
    cut AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents), size AS (SELECT doc_id, len(t) AS dl FROM cut),
    whole AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM size), tok AS (SELECT doc_id, unnest(t) AS term FROM cut),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    s AS (SELECT CAST(item_id AS VARCHAR) AS qid, query, CAST(doc_id AS VARCHAR) AS docno,
        round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
        FROM tf JOIN df USING (term) JOIN size USING (doc_id) JOIN q USING (term) CROSS JOIN whole GROUP BY ALL)
    SELECT qid, query, docno, score, CAST(rank - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS rank FROM s) WHERE rank <= 10""")
def bm25_topk(t):
    return retrieval.bm25(_asked(t), _docs(t), 10).select("qid", "query", "docno", "score", "rank")


@_query("""
    WITH q AS (SELECT 'q' || label AS qid, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
    s AS (SELECT q.qid, 'd' || e.vec_id AS docno, round(list_sum(list_transform(list_zip(q.v, e.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score FROM q, embeddings e)
    SELECT qid, docno, score, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS r FROM s) WHERE r <= 10""")
def dense_topk(t):
    e = t("embeddings")
    q = e.groupBy(F.concat(F.lit("q"), "label").alias("qid")).agg(F.min_by("embedding", "vec_id").alias("query_vec"))
    return retrieval.dense(q, e.select(F.concat(F.lit("d"), "vec_id").alias("docno"), F.col("embedding").alias("doc_vec")), 10).select("qid", "docno", "score", "rank")


@_query(f"WITH {_FOUND} SELECT qid, docno, score, CAST(rank AS INTEGER) AS rank FROM found WHERE rank < 3")
def rank_cutoff(t):
    return (Transformer(lambda df: df) % 3)(_found(t)).select("qid", "docno", "score", "rank")


@_query(f"""WITH {_FOUND}, r AS (SELECT qid, docno, length(text) * 1.0 / (1 + length(replace(text, ' ', ''))) AS s FROM found)
    SELECT qid, docno, CAST(round(s, 6) AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, docno) - 1 AS INTEGER) AS rank FROM r""")
def rerank(t):
    spaced = F.round(F.char_length("text") / (1 + F.char_length(F.replace("text", F.lit(" "), F.lit("")))), 6)
    return retrieval.rescored(_found(t), spaced).select("qid", "docno", "score", "rank")


@_query(f"WITH {_FOUND} SELECT qid, f.docno, d.text FROM found f LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS docno, text FROM documents) d USING (docno)")
def text_loader_join(t):
    return retrieval.with_texts(_found(t).select("qid", "docno"), _docs(t)).select("qid", "docno", "text")


@_query("SELECT CAST(item_id AS VARCHAR) AS qid, text AS query_0, list_aggregate(" + _TERMS.format("text") + ", 'string_agg', ' ') AS query FROM benchmark")
def query_rewrite(t):
    return retrieval.bare_queries(_asked(t)).select("qid", "query_0", "query")


@_query(f"WITH {_FOUND} SELECT qid, min(query) AS query, string_agg(text, chr(10) ORDER BY rank) AS qcontext FROM found WHERE rank < 5 GROUP BY qid")
def concat_context(t):
    return context.concatenator(cutoff(_found(t), 5)).select("qid", "query", "qcontext")


@_query(f"WITH {_FOUND} SELECT qid, string_agg(title || ' ' || text, chr(10) ORDER BY rank) AS qcontext FROM found WHERE rank < 2 GROUP BY qid")
def concat_max_elements(t):
    return context.concatenator(_found(t), in_fields=("title", "text"), max_elements=2).select("qid", "qcontext")


@_query(f"""WITH {_FOUND}, g AS (SELECT qid, list(text ORDER BY rank) AS p FROM found WHERE rank < 5 GROUP BY qid),
    c AS (SELECT qid, p, list_filter(list_transform(generate_series(0, 11), lambda i: greatest(512 - i * 50, 0)), lambda c: list_sum(list_transform(p, lambda x: least(length(x), c))) + len(p) - 1 <= 1000) AS caps FROM g)
    SELECT qid, array_to_string(list_transform(p, lambda x: substring(x, 1, COALESCE(caps[1], 0))), chr(10)) AS qcontext FROM c""")
def concat_token_budget(t):
    return context.concatenator(cutoff(_found(t), 5), tokenizer="chars", max_length=1000, max_per_context=512, truncation_rate=50).select("qid", "qcontext")


_PROMPT = "'Use the context to answer the question in a few words.' || chr(10) || 'Context:' || chr(10) || qcontext || chr(10) || 'Question: ' || query"
_CONTEXT = f"{_FOUND}, ctx AS (SELECT qid, min(query) AS query, string_agg(text, chr(10) ORDER BY rank) AS qcontext FROM found WHERE rank < 2 GROUP BY qid)"


def _context(t):
    return context.concatenator(cutoff(_found(t), 2))


@_query(f"WITH {_CONTEXT} SELECT {_PROMPT} AS prompt, qid, query AS query_0 FROM ctx")
def prompt_build(t):
    return generation.prompts(_context(t))


@_query(f"WITH {_CONTEXT} SELECT {_PROMPT} AS prompt, qid, query AS query_0, 'resp:' || {_PROMPT} AS qanswer FROM ctx")
def echo_reader(t):
    return generation.reader(_context(t), generation.EchoBackend())


@_query(f"WITH {_CONTEXT} SELECT qid, 'system' AS role, 'Be brief.' AS content FROM ctx UNION ALL SELECT qid, 'user', {_PROMPT} FROM ctx")
def chat_messages(t):
    return generation.prompts(_context(t), system_message="Be brief.", api="chat").select("qid", F.inline("prompt"))


@_query(f"WITH {_SAID} SELECT qid, CAST(i AS INTEGER) AS response_idx, 'resp:' || query AS qanswer FROM said, (VALUES (0), (1), (2)) v(i)")
def multi_response_explode(t):
    rows = _said(t).select("qid", F.col("query").alias("prompt"))
    return generation.generated(rows, generation.EchoBackend(), num_responses=3).select("qid", "response_idx", "qanswer")


@_query(f"WITH {_SAID} SELECT qid, trim(qanswer, ' ' || chr(9) || chr(10) || chr(13)) AS qanswer, trim(query, ' ' || chr(9) || chr(10) || chr(13)) AS reasoning FROM said")
def reasoning_extract(t):
    rows = _said(t).select("qid", F.concat(F.lit("<think>"), "query", F.lit("</think>\n"), "qanswer").alias("qanswer"))
    return generation.reasoning_extractor(rows)


@_query("SELECT CAST(item_id AS VARCHAR) AS qid, text AS query_1, 'second' AS query_0, 'third' AS query FROM benchmark")
def push_columns(t):
    df = columns.push_columns(_asked(t)).withColumn("query", F.lit("second"))
    return columns.push_columns(df).withColumn("query", F.lit("third")).select("qid", "query_1", "query_0", "query")


@_query(f"WITH {_SAID} SELECT CAST(conv_id AS VARCHAR) AS qid, list(qanswer ORDER BY qanswer)[1] AS first_answer, CAST(count(*) AS INTEGER) AS n_answers FROM said GROUP BY conv_id")
def gold_collect(t):
    rows = evaluation.collected_gold(_said(t).select(F.col("conv_id").cast("string").alias("qid"), F.col("qanswer").alias("gold_answer")))
    return rows.select("qid", F.get("gold_answer", 0).alias("first_answer"), F.size("gold_answer").alias("n_answers"))


@_query(f"WITH {_SAID} SELECT conv_id, turn, qanswer AS gold_answer FROM said")
def gold_explode(t):
    rows = _said(t).groupBy("conv_id").agg(F.collect_list(F.struct("turn", "qanswer")).alias("g"))
    return evaluation.exploded_gold(rows, "g").select("conv_id", "g.turn", F.col("g.qanswer").alias("gold_answer"))


@_query(f"SELECT conv_id, turn, array_to_string({_TOKENS.format('text')}, ' ') AS normalized FROM conversations")
def normalize_answer(t):
    return t("conversations").select("conv_id", "turn", X.normalize_answer("text").alias("normalized"))


_MEASURED = f"""{_SAID}, gold AS (SELECT conv_id, list({_TOKENS.format('qanswer')} ORDER BY turn) AS golds FROM said GROUP BY conv_id),
    run AS (SELECT s.qid, 'the ' || s.qanswer AS qanswer, {_TOKENS.format("'the ' || s.qanswer")} AS p, golds FROM said s JOIN gold USING (conv_id)), pg AS (SELECT qid, qanswer, p, unnest(golds) AS g FROM run),
    m AS (SELECT qid, qanswer, CAST(array_to_string(p, ' ') = array_to_string(g, ' ') AS DOUBLE) AS em,
        CASE WHEN (array_to_string(p, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(g, ' ') IN ('yes', 'no', 'noanswer')) AND array_to_string(p, ' ') != array_to_string(g, ' ') THEN 0
        ELSE COALESCE(2.0 * {_OVERLAP.format('p', 'g')} / nullif(len(p) + len(g), 0), 0) END AS f1 FROM pg)"""


@_query(f"WITH {_MEASURED} SELECT qid, max(em) AS em, round(CAST(max(f1) AS DOUBLE), 6) AS f1, CAST(max(length(qanswer)) AS DOUBLE) AS answer_len, CAST(0 AS DOUBLE) AS answer_zero_len FROM m GROUP BY qid")
def em_f1(t):
    run = _run(t)
    rows = evaluation.by_query(run.drop("golds"), run.select("qid", F.col("golds").alias("gold_answer")), ("EM", "F1", "AnswerLen", "AnswerZeroLen"))
    return rows.select("qid", F.col("EM").alias("em"), F.round("F1", 6).alias("f1"), F.col("AnswerLen").alias("answer_len"), F.col("AnswerZeroLen").alias("answer_zero_len"))


_ROUGE_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda t: t != '')"
_PAIRS = "list_transform(generate_series(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1])"


@_query(f"""WITH {_SAID}, t AS (SELECT qid, {_ROUGE_TOKENS.format('qanswer')} AS p1, {_ROUGE_TOKENS.format('query')} AS g1 FROM said), u AS (SELECT *, {_PAIRS.format('p1')} AS p2, {_PAIRS.format('g1')} AS g2 FROM t)
    SELECT qid, round(COALESCE(CAST({_OVERLAP.format('p1', 'g1')} AS DOUBLE) / nullif(len(p1), 0), 0), 6) AS rouge1_p, round(COALESCE(CAST({_OVERLAP.format('p1', 'g1')} AS DOUBLE) / nullif(len(g1), 0), 0), 6) AS rouge1_r,
    round(COALESCE(CAST({_OVERLAP.format('p2', 'g2')} AS DOUBLE) / nullif(len(p2), 0), 0), 6) AS rouge2_p FROM u""")
def rouge_ngrams(t):
    one, two = X.rouge("qanswer", "query", "rouge1"), X.rouge("qanswer", "query", "rouge2")
    return _said(t).select("qid", F.round(one["P"], 6).alias("rouge1_p"), F.round(one["R"], 6).alias("rouge1_r"), F.round(two["P"], 6).alias("rouge2_p"))


@_query()
def rouge_stemmed(t):
    rows = _said(t)
    return evaluation.by_query(rows, rows.select("qid", F.array("query").alias("gold_answer")), ("ROUGE1P", "ROUGE1R", "ROUGE1F", "ROUGE2F", "ROUGELP", "ROUGELR", "ROUGELF"))


_SYSTEMS = f"""{_SAID}, v AS (
    SELECT 'full' AS system, qid, CAST(length(qanswer) AS DOUBLE) AS value FROM said UNION ALL SELECT 'short', qid, CAST(least(length(qanswer), 40) AS DOUBLE) FROM said)"""


def _values(t):
    said = _said(t)
    runs = {"full": said.select("qid", "qanswer"), "short": said.select("qid", F.substring("qanswer", 1, 40).alias("qanswer"))}
    return evaluation.long_form(runs, said.select("qid", F.array("query").alias("gold_answer")), ("AnswerLen", "AnswerZeroLen"))


@_query(f"WITH {_SYSTEMS} SELECT system, round(avg(value), 6) AS answer_len, CAST(0 AS DOUBLE) AS answer_zero_len FROM v GROUP BY system")
def experiment_pivot(t):
    return evaluation.experiment(_values(t), ("AnswerLen", "AnswerZeroLen")).select("system", F.round("AnswerLen", 6).alias("answer_len"), F.col("AnswerZeroLen").alias("answer_zero_len"))


# P(|T| > x) with v degrees of freedom, by the finite series in cos and sin of atan(x / sqrt(v))
_PRODUCT = "exp(COALESCE(list_sum(list_transform(range(1, k + 1), lambda j: ln({0}))), 0))"
_SUM = "COALESCE(list_sum(list_transform(range(0, CAST({0} AS BIGINT)), lambda k: {1} * pow(c2, k))), 0)"
_EVEN, _ODD = _SUM.format("v // 2", _PRODUCT.format("(2 * j - 1) / (2.0 * j)")), _SUM.format("(v - 1) // 2", _PRODUCT.format("2 * j / (2.0 * j + 1)"))
_P = f"1 - CASE WHEN v % 2 = 0 THEN s * {_EVEN} ELSE 2 / pi() * (angle + s * sqrt(c2) * {_ODD}) END"

@_query(f"""WITH {_SYSTEMS}, d AS (SELECT a.qid, a.value - b.value AS d FROM v a JOIN v b ON a.qid = b.qid AND a.system = 'short' AND b.system = 'full'),
    r AS (SELECT count(*) AS n, count(*) FILTER (d > 0) AS better, count(*) FILTER (d < 0) AS worse, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d),
    a AS (SELECT *, n - 1 AS v, atan(abs(t) / sqrt(n - 1)) AS angle FROM r), b AS (SELECT *, sin(angle) AS s, cos(angle) * cos(angle) AS c2 FROM a)
    SELECT 'short' AS system, n, better, worse, round(t, 6) AS t, round(abs({_P}), 6) AS p FROM b""")
def baseline_ttest(t):
    rows = evaluation.against_baseline(_values(t), "full").filter("measure = 'AnswerLen'")
    return rows.select("system", "n", "better", "worse", F.round("t", 6).alias("t"), F.round("p", 6).alias("p"))


@_query(f"""WITH {_FOUND}, g AS (SELECT qid, list(lower(text) ORDER BY rank) AS texts FROM found WHERE rank < 20 GROUP BY qid), e AS (SELECT qid, texts, unnest(generate_series(1, len(texts))) AS k FROM g)
    SELECT qid, CAST(k AS INTEGER) AS k, CAST(contains(array_to_string(list_slice(texts, 1, k), ' '), 'licensed') OR contains(array_to_string(list_slice(texts, 1, k), ' '), 'all rights reserved') AS INTEGER) AS label FROM e""")
def aicl_labels(t):
    found = cutoff(_found(t), 20)
    gold = found.select("qid").distinct().withColumn("gold_answer", F.array(F.lit("Licensed"), F.lit("All rights reserved")))
    return aicl.labels(found, gold, 20).select("qid", F.posexplode("labels").alias("k", "label")).select("qid", (F.col("k") + 1).alias("k"), "label")


@_query(f"""WITH {_FOUND}, g AS (SELECT qid, list(lower(text) ORDER BY rank) AS texts FROM found WHERE rank < 20 GROUP BY qid), e AS (SELECT qid, texts, unnest(generate_series(1, len(texts))) AS k FROM g)
    SELECT CAST(k AS INTEGER) AS k, round(avg(CAST(contains(array_to_string(list_slice(texts, 1, k), ' '), 'licensed') AS INTEGER)), 6) AS rate FROM e GROUP BY k""")
def answer_in_top_k(t):
    found = cutoff(_found(t), 20)
    gold = found.select("qid").distinct().withColumn("gold_answer", F.array(F.lit("Licensed")))
    return aicl.answer_rate(aicl.labels(found, gold, 20)).select("k", F.round("rate", 6).alias("rate"))


@_query("""WITH g AS (SELECT source, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY source)
    SELECT CAST(count(*) AS BIGINT) AS n_queries, round(sum(n) / count(*), 6) AS mean_docs, round(sum(chars) / sum(n), 6) AS mean_chars, CAST(max(n) AS BIGINT) AS most_docs FROM g""")
def result_stats(t):
    stats = evaluation.result_stats(_found(t))
    return stats.select("n_queries", F.round("mean_docs", 6).alias("mean_docs"), F.round("mean_chars", 6).alias("mean_chars"), F.array_max(F.map_keys("docs_counts")).alias("most_docs"))


@_query("SELECT CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark ORDER BY CAST(item_id AS VARCHAR) LIMIT 10")
def head_topics(t):
    return first_topics(_asked(t), 10)


@_query(f"""WITH {_FOUND}, r AS (SELECT * FROM found WHERE rank < 20)
    SELECT qid, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS deviation, max(score) AS best, min(score) AS least, max(score) - min(score) AS spread, CAST(count(*) AS DOUBLE) AS n, CAST(4 AS DOUBLE) AS words FROM r GROUP BY qid""")
def aicl_features(t):
    f = aicl.features(cutoff(_found(t), 20), 20)
    return f.select("qid", F.round(F.get("features", 0), 4).alias("mean"), F.round(F.get("features", 1), 4).alias("deviation"), F.get("features", 2).alias("best"), F.get("features", 3).alias("least"), F.get("features", 4).alias("spread"), F.get("features", 6).alias("n"), F.get("features", 7).alias("words"))


@_query()
def aicl_predict(t):
    found = cutoff(_found(t), 20)
    gold = found.select("qid").distinct().withColumn("gold_answer", F.array(F.lit("licensed")))
    return aicl.AICLContextSelector(20, 2).fit(found, aicl.labels(found, gold, 20)).transform(found).select("qid", "docno", "rank")


@_query(f"""WITH {_SAID}, r AS (SELECT conv_id, length(query) % 10 + 1 AS r FROM said)
    SELECT CAST(conv_id AS VARCHAR) AS qid, max(r) AS best, min(r) AS least, CAST(sum(r) AS BIGINT) AS total, round(avg(r), 6) AS mean FROM r GROUP BY conv_id""")
def judge_agg(t):
    said = _said(t)
    refs = said.select(F.col("conv_id").cast("string").alias("qid"), "turn", F.lit(3).alias("relevance"), F.col("query").alias("text"))
    run = refs.groupBy("qid").agg(F.lit("answer").alias("qanswer"))
    backend = generation.ColumnBackend(function=lambda p: F.concat((F.char_length(F.substring_index(p, "Ref: ", -1)) % 10 + 1).cast("string"), F.lit(" good")))
    names = {"max": "best", "min": "least", "sum": "total", "avg": "mean"}
    values = {a: evaluation.judged_pointwise(run, refs, backend, agg=a, prompt="Ref: {{ reference }}").withColumnRenamed("value", n) for a, n in names.items()}
    out = values["max"].join(values["min"], "qid").join(values["sum"], "qid").join(values["avg"], "qid")
    return out.select("qid", F.col("best").cast("bigint").alias("best"), F.col("least").cast("bigint").alias("least"), "total", F.round("mean", 6).alias("mean"))


_LETTER_PAIRS = "list_transform({0}, lambda w: list_distinct(list_transform(range(1, greatest(length(w), 2)), lambda i: substr(w, i, 2))))"
_MEAN_BEST = "COALESCE(list_sum(list_transform({0}, lambda x: COALESCE(list_max(list_transform({1}, lambda y: len(list_intersect(x, y)) / sqrt(CAST(len(x) * len(y) AS DOUBLE)))), 0))) / nullif(len({0}), 0), 0)"


@_query(f"""WITH {_SAID}, g AS (SELECT qid, {_LETTER_PAIRS.format(_ROUGE_TOKENS.format('qanswer'))} AS a, {_LETTER_PAIRS.format(_ROUGE_TOKENS.format('query'))} AS b FROM said),
    m AS (SELECT qid, {_MEAN_BEST.format('a', 'b')} AS p, {_MEAN_BEST.format('b', 'a')} AS r FROM g) SELECT qid, round(COALESCE(2 * p * r / nullif(p + r, 0), 0), 6) AS value FROM m""")
def bertscore_hash(t):
    said = _said(t)
    rows = evaluation.bertscore(said.select("qid", "qanswer"), said.select("qid", F.lit(3).alias("relevance"), F.col("query").alias("text")))
    return rows.select("qid", F.round("value", 6).alias("value"))


@_query(f"""WITH {_SAID} SELECT qid, trim(regexp_replace(regexp_replace(query, '["'']|\\.\\.\\.', '', 'g'), '\\s+', ' ', 'g')) AS first_query, trim(qanswer, ' ' || chr(9) || chr(10) || chr(13)) AS last_query FROM said""")
def search_query_extract(t):
    text = F.concat(F.lit("I need <search>"), "query", F.lit("</search> and <search> "), "qanswer", F.lit(" </search>"))
    return _said(t).select("qid", X.first_query(text, "<search>", "</search>").alias("first_query"), X.last_query(text, "<search>", "</search>").alias("last_query"))


@_query(f"""WITH {_SAID} SELECT qid, trim(qanswer, ' ' || chr(9) || chr(10) || chr(13)) AS answer, replace(regexp_extract(query, '[A-Za-z]+'), ' ', '') AS boxed, 'No helpful information found.' AS info FROM said""")
def answer_extract(t):
    text = F.concat(F.lit("so <answer>"), "qanswer", F.lit("</answer>"))
    word = F.regexp_extract("query", "[A-Za-z]+", 0)
    return _said(t).select("qid", X.last_between(text, "<answer>", "</answer>").alias("answer"), X.boxed(F.concat(F.lit("it is \\boxed{\\text{"), word, F.lit("}}"))).alias("boxed"), X.extracted_answer(word, "infogen").alias("info"))


@_query(f"WITH {_SAID} SELECT qid, 'Step 1: ' || upper(substring(qid, 1, 3)) || chr(10) || chr(10) || 'Step 3: new' AS steps FROM said")
def steps_replace(t):
    old = F.concat(F.lit("Step 1: x\n\nStep 2: y\n\nStep 3: old"))
    new = F.concat(F.lit("Step 2: DELETE THIS STEP\nStep 3: new\nStep 1: "), F.upper(F.substring("qid", 1, 3)))
    return _said(t).select("qid", X.replaced_steps(old, new).alias("steps"))


@_query("""WITH p AS (SELECT doc_id, text, regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+') AS w FROM documents)
    SELECT doc_id, CASE WHEN len(w) > 50 THEN array_to_string(list_slice(w, 1, 50), ' ') ELSE text END AS text FROM p""")
def truncate_words(t):
    return t("documents").select("doc_id", X.first_words("text", 50).alias("text"))


@_query("""WITH s AS (SELECT item_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM benchmark) SELECT item_id, CASE WHEN s LIKE '%?' THEN s ELSE s || '?' END AS question FROM s""")
def question_mark(t):
    return t("benchmark").select("item_id", X.as_question("text").alias("question"))


@_query(f"""WITH {_FOUND}, r AS (SELECT * FROM found WHERE rank < 3) SELECT qid, string_agg('Doc ' || (rank + 1) || '(Title: ' || title || ') ' || text || chr(10), '' ORDER BY rank) AS docs,
    string_agg('(' || (rank + 1) || ')' || text || chr(10), '' ORDER BY rank) AS numbered, string_agg('Title: ' || title || chr(10) || 'Text: ' || text || chr(10) || chr(10), '' ORDER BY rank) AS blocks FROM r GROUP BY qid""")
def doc_renderers(t):
    r = cutoff(_found(t), 3)
    out = context.rendered(r, context.render_doc, "docs").join(context.rendered(r, context.render_numbered, "numbered"), "qid")
    return out.join(context.rendered(r, context.render_block, "blocks"), "qid")


@_query(f"""WITH {_FOUND}, r AS (SELECT * FROM found WHERE rank < 3) SELECT qid, query, CAST(rank AS INTEGER) AS pos, 'question: ' || query || ' title: ' || title || ' context: ' || text AS input FROM r""")
def fid_inputs(t):
    return generation.fusion_inputs(cutoff(_found(t), 3)).select("qid", "query", F.posexplode("inputs").alias("pos", "input"))


@_query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: x != '') AS w FROM documents), e AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) // 3, 0))) AS i FROM w)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w[3 * i - 2] AS head, w[3 * i - 1] AS relation, w[3 * i] AS tail FROM e WHERE len(w) >= 3""")
def kg_parse(t):
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != "")
    spans = lambda w: F.transform(F.sequence(F.lit(1), F.floor(F.size(w) / 3).cast("int")), lambda i: F.concat(F.lit("<"), F.get(w, 3 * i - 3), F.lit("; "), F.get(w, 3 * i - 2), F.lit(" ;"), F.get(w, 3 * i - 1), F.lit(">")))
    rows = t("documents").select("doc_id", words.alias("w")).filter(F.size("w") >= 3).select("doc_id", F.concat(F.lit("<a; b> <broken>"), F.array_join(spans(F.col("w")), " ")).alias("said"))
    return rows.select("doc_id", F.posexplode(X.triples("said")).alias("pos", "_t")).select("doc_id", "pos", "_t.*")


@_query("""SELECT doc_id, CASE WHEN contains(lower(text), 'xq') THEN 'xq' ELSE source END AS head FROM documents""")
def kg_head_repair(t):
    one = F.array(F.struct(F.lit("xq").alias("head"), F.lit("r").alias("relation"), F.lit("t").alias("tail")))
    return t("documents").select("doc_id", F.get(X.repaired_heads(one, F.col("source"), F.col("text")), 0)["head"].alias("head"))


@_query("""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, '. '), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s != '') AS s FROM documents), e AS (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM p)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN s[i] LIKE '%.' THEN s[i] ELSE s[i] || '.' END AS sentence FROM e""")
def sentence_split(t):
    return t("documents").select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "sentence"))


@_query("""WITH o AS (SELECT source AS qid, CAST(n_chars % 5 AS INTEGER) AS doc_rank, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents)
    SELECT qid, doc_rank, count(*) AS votes, CAST(min(pos) AS INTEGER) AS pos FROM o GROUP BY ALL""")
def chain_doc_votes(t):
    d = t("documents").select(F.col("source").alias("qid"), "doc_id", (F.col("n_chars") % 5).cast("int").alias("doc_rank"))
    triples = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "doc_rank"))), lambda x: F.struct(F.lit("t").alias("triple"), x["doc_rank"].alias("doc_rank")))
    return kg.doc_votes(d.groupBy("qid").agg(F.array(F.struct(triples.alias("triples"), F.lit(1.0).alias("score"))).alias("chains")))


@_query("""WITH l AS (SELECT o_orderkey AS qid, ln(1 + o_totalprice) AS a, ln(2 + o_custkey) AS b FROM orders), p AS (SELECT qid, exp(a) / (exp(a) + exp(b)) AS pa, exp(b) / (exp(a) + exp(b)) AS pb FROM l),
    r AS (SELECT qid, '-1' AS path, pa AS score, true AS finished FROM p UNION ALL SELECT qid, '7', pb, false FROM p WHERE pb >= 0.01)
    SELECT qid, path, round(score, 6) AS score, finished FROM r WHERE score >= 0.01""")
def beam_step(t):
    o = t("orders").select(F.col("o_orderkey").alias("qid"), F.array().cast("array<int>").alias("path"), F.create_map(F.lit("A"), F.log(1 + F.col("o_totalprice")), F.lit("B"), F.log(2 + F.col("o_custkey").cast("double"))).alias("logprobs"))
    frontier = o.select("qid", "path", F.lit(1.0).alias("score"), F.lit(False).alias("finished"))
    offered = o.select("qid", "path", F.lit(0).alias("choice"), F.lit(7).alias("idx"))
    out = kg.expanded(frontier, offered, o, 5, 0.01, 10)
    return out.select("qid", F.array_join("path", ",").alias("path"), F.round("score", 6).alias("score"), "finished")


@_query("""WITH s AS (SELECT CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark)
    SELECT qid, query, 'found ' || qid AS qanswer, CAST(1 AS INTEGER) AS search_iterations, query AS searched, 'Got answer' AS stop_reason FROM s""")
def agentic_scripted(t):
    asked, docs = _asked(t), _docs(t).select("docno", "title", "text", "n_chars")
    first = asked.select("qid", F.lit(0).alias("turn"), F.concat(F.lit("look <search>"), F.regexp_replace("query", "[\"'<>]|\\.\\.\\.", ""), F.lit("</search>")).alias("text"))
    script = first.unionByName(asked.select("qid", F.lit(1).alias("turn"), F.concat(F.lit("<answer>found "), "qid", F.lit("</answer>")).alias("text")))
    top = docs.select("docno", "title", "text", F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "docno").limit(3)
    backend = generation.ScriptedBackend(script=script)
    agent = agents.AgenticRAG(lambda q: q.join(F.broadcast(top)), backend, top_k=3, max_turn=4, search_query=X.last_query)
    out = agent.transform(asked)
    return out.select("qid", "query", "qanswer", "search_iterations", F.get("search_history", 0).alias("searched"), "stop_reason")


@_query(f"""WITH {_FOUND}, b AS (SELECT qid, docno, score FROM found WHERE rank < 5 UNION ALL SELECT qid, docno, score + 1000 FROM found WHERE rank BETWEEN 3 AND 8), m AS (SELECT qid, docno, max(score) AS score FROM b GROUP BY ALL)
    SELECT qid, docno, score, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS r FROM m) WHERE r <= 6""")
def ircot_merge(t):
    r = ranked(_found(t)).select("qid", "docno", "score", "rank")
    return agents.merged(r.filter("rank < 5"), r.filter("rank between 3 and 8").withColumn("score", F.col("score") + 1000), 6).select("qid", "docno", "score", "rank")


@_query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def semi_join_filter(t):
    return retrieval.only_for(t("documents"), t("labels").filter("quality = 1"), "doc_id").select("doc_id", "source")


@_query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_docno(t):
    return retrieval.distinct_documents(t("documents"), "text", "doc_id")


@_query(f"WITH {_SAID} SELECT qid, regexp_replace(qanswer, '[?].*$', '', 's') AS qanswer FROM (SELECT qid, reverse(regexp_replace(reverse(qanswer), '^[^.]*[.]', '', 's')) AS qanswer, contains(qanswer, '.') AS cut FROM said)")
def stop_trim(t):
    return _said(t).select("qid", F.regexp_replace(X.cut_at_stops("qanswer", ["."]), "(?s)[?].*$", "").alias("qanswer"))


@_query("""SELECT user_id, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_window(t):
    return streams.sessions(t("events"), "user_id").select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("first_ts"))


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def tumbling_window(t):
    return streams.windowed(t("events"), by=("event_type",)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


def index_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrieval of ``bm25_topk`` from a written index, made of the documents in two batches."""
    t = lambda name: ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    index, docs = TermIndex(spark, Tables(spark).root), _docs(t)
    for k in (0, 1):
        index.add(docs.filter(F.pmod(F.xxhash64("docno"), F.lit(2)) == k))
    return index.bm25(_asked(t), 10)


def index_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``dense_topk`` from a written index of vectors, in exact mode."""
    t = lambda name: ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    index, e = VectorIndex(spark, Tables(spark).root), t("embeddings")
    q = e.groupBy(F.concat(F.lit("q"), "label").alias("qid")).agg(F.min_by("embedding", "vec_id").alias("query_vec"))
    index.build(e.select(F.concat(F.lit("d"), "vec_id").alias("docno"), F.col("embedding").alias("doc_vec")), lists=32)
    return index.search(q, 10, probe=4, exact=True).select("qid", "docno", "score", "rank")


QUERIES |= {"index_bm25": index_bm25, "index_dense": index_dense}
ORACLES |= {"index_bm25": ORACLES["bm25_topk"], "index_dense": ORACLES["dense_topk"]}


# the cap is the first of 512, 487, ... at which all texts fit into the limit
@_query("""WITH r AS (SELECT text, doc_id, length(text) AS n FROM documents), c AS (SELECT unnest(range(512, 0, -25)) AS c),
    s AS (SELECT c, sum(least(n, c)) + count(*) - 1 AS total FROM r, c GROUP BY c), cap AS (SELECT COALESCE(max(c) FILTER (total <= 200000), 0) AS cap FROM s)
    SELECT md5(string_agg(substr(text, 1, cap), chr(10) ORDER BY doc_id)) AS digest, CAST(length(string_agg(substr(text, 1, cap), chr(10) ORDER BY doc_id)) AS INTEGER) AS n_chars FROM r, cap""")
def frame_budget(t):
    out = context.frame_concat(t("documents"), order=[F.col("doc_id")], tokenizer="chars", max_length=200_000, max_per_context=512)
    return out.select(F.md5(F.col("qcontext").cast("binary")).alias("digest"), F.char_length("qcontext").alias("n_chars"))


@_query(f"""WITH {_FOUND}, f AS (SELECT qid, query, docno FROM found WHERE rank < 3), s AS (SELECT unnest(['base', 'short', 'same']) AS name)
    SELECT name, CAST(CASE WHEN name = 'short' THEN (SELECT avg(CAST(length(substr(docno, 1, 1)) AS DOUBLE)) FROM f) ELSE (SELECT avg(CAST(length(docno) AS DOUBLE)) FROM f) END AS DOUBLE) AS answer_len FROM s""")
def shared_steps(t):
    found = Transformer(lambda topics: retrieval.only_for(_found(t), topics), "found") % 3
    whole, short = (Transformer(lambda df, c=c: df.select("qid", c.alias("qanswer"))) for c in (F.col("docno"), F.substring("docno", 1, 1)))
    topics = _found(t).select("qid", "query").distinct()
    out = evaluation.compared([found >> whole, found >> short, found >> whole], topics, topics.select("qid", F.array("query").alias("gold_answer")), ("AnswerLen",), names=["base", "short", "same"], share=True)
    return out.select("name", F.col("AnswerLen").alias("answer_len"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to documents, context, prompt, an extractive answer and its measures against the question."""
    t = lambda name: ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    docs = _docs(t)
    retrieve = Transformer(lambda q: retrieval.bm25(q, docs, 10), "bm25") % 3
    with_text = Transformer(lambda r: retrieval.with_texts(r, docs), "texts")
    read = Transformer(lambda c: generation.reader(c, generation.ExtractiveBackend()), "reader")
    asked = _asked(t)
    answers = (retrieve >> with_text >> Transformer(context.concatenator, "context") >> read)(asked).select("qid", "qanswer")
    scores = evaluation.by_query(answers, asked.select("qid", F.array("query").alias("gold_answer")), ("EM", "F1", "AnswerLen"))
    return answers.join(scores, "qid")


QUERIES["flagship"] = flagship
