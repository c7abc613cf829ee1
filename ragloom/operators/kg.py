"""Knowledge graphs of documents, and beam-searched chains of their triples."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as X
from ragloom.operators.agents import cut_lineage
from ragloom.operators.columns import require_columns
from ragloom.operators.generation import Backend, generated

TRIPLES = "array<struct<head:string,relation:string,tail:string>>"
KG_PROMPT = "List the facts of the text, each as <head; relation; tail>.{{ exemplars }}\nTitle: {{ title }}\nText: {{ text }}\nFacts:"
CHAIN_PROMPT = "{{ demos }}Question: {{ query }}\nKnown: {{ known }}\nWhich fact comes next?\n{{ choices }}\nLetter:"


#: Characters of an example table that every task may hold.
MOST_EXAMPLE_CHARS = 1 << 26


def permuted_places(key: Column, size: int, n: int) -> Column:
    """The first n places of a permutation of 0 to size - 1 that depends on the key: multiples of a step modulo the next prime, without those past the size."""
    prime = next(p for p in range(max(size, 2), 2 * size + 3) if all(p % d for d in range(2, math.isqrt(p) + 1)))
    step, first = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(prime - 1)) + 1, F.pmod(F.xxhash64(key, F.lit(2)), F.lit(prime))
    turns = F.sequence(F.lit(0).cast("bigint"), F.lit(min(n + prime - size, prime) - 1).cast("bigint"))
    return F.slice(F.filter(F.transform(turns, lambda j: (first + step * j) % prime), lambda p: p < size), 1, min(n, size))


def exemplars(documents: DataFrame, table: DataFrame, n: int, max_chars: int = 4000) -> DataFrame:
    """(docno, exemplars): n examples (id, text) for each document in an order by its number, from the front only as many as fit into max_chars.

    Examples are few: their texts, ``MOST_EXAMPLE_CHARS`` at most, are held by every task, and a document's are found in its own row.
    """
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars")).first()
    if size["chars"] > MOST_EXAMPLE_CHARS:
        raise ValueError(f"examples have {size['chars']} characters")
    docs = documents.select("docno").distinct()
    if not size["n"] or n < 1:
        return docs.select("docno", F.lit("").alias("exemplars"))
    every = table.agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("_all"))
    places = permuted_places(F.col("docno"), size["n"], n)
    texts = F.transform(places, lambda p: F.concat(F.lit("\n"), F.coalesce(F.get("_all", p.cast("int"))["text"], F.lit(""))))
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def more(a: Column, t: Column) -> Column:
        fits = a["open"] & (F.char_length(a["text"]) + F.char_length(t) <= max_chars)
        return F.struct(F.when(fits, F.concat(a["text"], t)).otherwise(a["text"]).alias("text"), fits.alias("open"))

    chosen = F.aggregate(texts, start, more, lambda a: a["text"])
    return docs.crossJoin(F.broadcast(every)).select("docno", chosen.alias("exemplars"))


def extract_graph(documents: DataFrame, backend: Backend, examples: DataFrame | None = None, prompt: str = KG_PROMPT, cache: str | None = None) -> DataFrame:
    """Documents (docno, title, text) with ``knowledge_graph``; each document number is asked once, and not if ``cache`` (a Parquet path) has it."""
    require_columns(documents, "docno", "text")
    docs = documents if "title" in documents.columns else documents.withColumn("title", F.lit(None).cast("string"))
    todo = docs.groupBy("docno").agg(F.min_by(F.struct("title", "text"), F.struct("title", "text")).alias("_d")).select("docno", "_d.*")
    known = None
    if cache:
        spark = documents.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.parquet(cache)
            todo = todo.join(known, "docno", "left_anti")
    more = todo.join(examples, "docno", "left") if examples is not None else todo.withColumn("exemplars", F.lit(""))
    said = generated(more.withColumn("prompt", X.template(prompt)), backend, output_field="_said", max_new_tokens=512)
    made = said.select("docno", X.repaired_heads(X.triples("_said"), F.coalesce("title", F.lit("")), F.col("text")).alias("knowledge_graph"))
    if cache:
        made.write.mode("append").parquet(cache)
        made = documents.sparkSession.read.parquet(cache).dropDuplicates(["docno"])
    return documents.join(made, "docno", "left")


def flat_triples(docs: DataFrame) -> DataFrame:
    """(qid, idx, head, relation, tail, doc_rank): all triples of a query's documents, numbered from 0 by rank and place."""
    rows = docs.select("qid", F.col("rank").alias("doc_rank"), F.posexplode("knowledge_graph").alias("_at", "_t"))
    idx = F.row_number().over(Window.partitionBy("qid").orderBy("doc_rank", "_at")) - 1
    return rows.select("qid", idx.alias("idx"), "_t.*", "doc_rank")


def best_tokens(logprobs: Column, k: int) -> Column:
    """array<struct<token, p>>: the k most likely tokens of a map, ties to the larger token; p is a softmax over all of the map."""
    entries = F.map_entries(logprobs)
    top = F.array_max(F.map_values(logprobs))
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + F.exp(e["value"] - top))
    order = lambda e: F.struct(e["value"].alias("lp"), e["key"].alias("token"))
    ordered = F.slice(F.sort_array(F.transform(entries, order), asc=False), 1, k)
    return F.transform(ordered, lambda e: F.struct(e["token"].alias("token"), (F.exp(e["lp"] - top) / total).alias("p")))


def expanded(frontier: DataFrame, candidates: DataFrame, answers: DataFrame, num_beams: int, min_prob: float, num_chains: int) -> DataFrame:
    """One hop: the next frontier (qid, path, score, finished).

    ``candidates`` (qid, path, choice, idx) are what each path was offered; ``answers`` (qid, path, logprobs) the first token's
    log-probabilities. 'A' ends a path with -1; another letter appends its candidate; tokens below min_prob or without a
    candidate are left out. More than num_chains paths are cut to the best, ties by path.
    """
    said = answers.select("qid", "path", F.explode(best_tokens(F.col("logprobs"), num_beams)).alias("_t")).filter(F.col("_t.p") >= min_prob)
    said = said.select("qid", "path", F.col("_t.p").alias("p"), X.choice_index("_t.token").alias("choice"))
    open_ = frontier.filter(~F.col("finished"))
    ended = said.filter("choice = -1").join(open_, ["qid", "path"]).select("qid", F.concat("path", F.array(F.lit(-1))).alias("path"), (F.col("score") * F.col("p")).alias("score"), F.lit(True).alias("finished"))
    longer = said.join(candidates, ["qid", "path", "choice"]).join(open_, ["qid", "path"]).select("qid", F.concat("path", F.array("idx")).alias("path"), (F.col("score") * F.col("p")).alias("score"), F.lit(False).alias("finished"))
    rows = frontier.filter("finished").select("qid", "path", "score", "finished").unionByName(ended).unionByName(longer)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "path"))).filter(F.col("_n") <= num_chains).drop("_n")


def reasoning_chains(
    docs: DataFrame, backend: Backend, encoder: Callable[[DataFrame, str, str], DataFrame], max_chain_length: int = 4, num_choices: int = 20, num_beams: int = 5, num_chains: int = 10, min_prob: float = 1e-4, demos: DataFrame | None = None, num_demos: int = 3, prompt: str = CHAIN_PROMPT,
) -> DataFrame:
    """(qid, query, chains): beam search over each query's triples, from rows (qid, query, docno, rank, knowledge_graph).

    ``encoder(df, text column, vector column)`` adds vectors. Used triples are not offered again. Queries without triples have no
    chain; where no path is left there is one empty chain with score 0.1. demos (steps, text) serve hops that they have steps for.
    """
    require_columns(docs, "qid", "query", "rank", "knowledge_graph")
    from ragloom.operators.retrieval import dot

    flat = flat_triples(docs).withColumn("triple", X.triple_text(F.struct("head", "relation", "tail")))
    flat = cut_lineage(encoder(flat, "triple", "doc_vec").select("qid", "idx", "triple", "doc_rank", "doc_vec"))
    asked = docs.select("qid", "query").distinct()
    per_query = flat.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "triple"))), lambda x: x["triple"]).alias("all"))
    frontier = cut_lineage(per_query.select("qid", F.array().cast("array<int>").alias("path"), F.lit(1.0).alias("score"), F.lit(False).alias("finished")))
    for hop in range(max_chain_length):
        open_ = frontier.filter(~F.col("finished"))
        if not open_.limit(1).count():
            break
        known = open_.join(per_query, "qid").join(asked, "qid").withColumn("known", F.array_join(F.transform("path", lambda i: F.get("all", i)), " "))
        text = encoder(known.withColumn("_text", F.concat_ws(" ", "known", "query")), "_text", "query_vec")
        near = text.join(flat, "qid").filter(~F.array_contains("path", F.col("idx"))).withColumn("sim", F.round(dot("doc_vec", "query_vec"), 9))
        by = Window.partitionBy("qid", "path").orderBy(F.desc("sim"), "idx")
        offered = cut_lineage(near.withColumn("choice", F.row_number().over(by) - 1).filter(F.col("choice") < num_choices).select("qid", "path", "query", "known", "choice", "idx", "triple"))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("choice", "triple"))), lambda x: F.concat(X.choice_label(x["choice"]), F.lit(". "), x["triple"]))
        prompts = offered.groupBy("qid", "path", "query", "known").agg(F.array_join(F.concat(F.array(F.lit("A. nothing more is needed")), lines), "\n").alias("choices"))
        shown = "" if demos is None else "\n".join(r["text"] for r in demos.filter(F.size("steps") > hop).orderBy("text").limit(num_demos).collect()) + "\n"
        prompts = prompts.withColumns({"demos": F.lit(shown), "turn": F.lit(hop)}).withColumn("prompt", X.template(prompt))
        said = generated(prompts, backend, output_field="_said", logprobs_field="_lp", max_new_tokens=1).select("qid", "path", F.get("_lp", F.lit(0)).alias("logprobs")).filter("logprobs is not null")
        frontier = cut_lineage(expanded(frontier, offered.select("qid", "path", "choice", "idx"), said, num_beams, min_prob, num_chains))
    used = frontier.select("qid", "score", "path", F.posexplode_outer(F.filter("path", lambda i: i >= 0)).alias("_at", "idx")).join(flat.select("qid", "idx", "triple", "doc_rank"), ["qid", "idx"], "left")
    steps = F.filter(F.array_sort(F.collect_list(F.struct("_at", "triple", "doc_rank"))), lambda x: x["triple"].isNotNull())
    chain = used.groupBy("qid", "path", "score").agg(F.transform(steps, lambda x: F.struct(x["triple"].alias("triple"), x["doc_rank"].alias("doc_rank"))).alias("triples"))
    chains = chain.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("score", "path", "triples")), asc=False), lambda x: F.struct(x["triples"].alias("triples"), x["score"].alias("score"))).alias("chains"))
    kind = "array<struct<triples:array<struct<triple:string,doc_rank:int>>,score:double>>"
    empty = F.array(F.struct(F.array().cast("array<struct<triple:string,doc_rank:int>>").alias("triples"), F.lit(0.1).alias("score"))).cast(kind)
    rest = F.when(F.col("all").isNotNull(), empty).otherwise(F.array().cast(kind))
    return asked.join(per_query, "qid", "left").join(chains, "qid", "left").select("qid", "query", F.coalesce(F.col("chains").cast(kind), rest).alias("chains"))


def chain_texts(chains: DataFrame) -> DataFrame:
    """(qid, query, qcontext): the different triples of all chains in order, one a line."""
    all_triples = F.flatten(F.transform("chains", lambda c: F.transform(c["triples"], lambda t: t["triple"])))
    return chains.select("qid", "query", F.array_join(F.array_distinct(all_triples), "\n").alias("qcontext"))


def doc_votes(chains: DataFrame) -> DataFrame:
    """(qid, doc_rank, votes, pos): how many triples of the chains each document has, first seen at pos."""
    ranks = chains.select("qid", F.posexplode(F.flatten(F.transform("chains", lambda c: F.transform(c["triples"], lambda t: t["doc_rank"])))).alias("_at", "doc_rank"))
    return ranks.groupBy("qid", "doc_rank").agg(F.count("*").alias("votes"), F.min("_at").alias("pos"))


def chain_documents(chains: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, query, qcontext, qcontext_doc_count): texts of the documents that the chains use, most votes first, then first seen."""
    rows = doc_votes(chains).join(docs.select("qid", F.col("rank").alias("doc_rank"), "text"), ["qid", "doc_rank"])
    text = rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "pos", "text"))), lambda x: x["text"]), "\n").alias("qcontext"), F.count("*").cast("int").alias("qcontext_doc_count"))
    return chains.select("qid", "query").join(text, "qid", "left").select("qid", "query", F.coalesce("qcontext", F.lit("")).alias("qcontext"), F.coalesce("qcontext_doc_count", F.lit(0)).alias("qcontext_doc_count"))
