"""Loops over turns: agentic search and interleaved retrieval with chain of thought.

The state of all queries is one DataFrame with a status; each turn is one plan over the active ones,
checkpointed so that the lineage does not grow and a lost executor's part can be read again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as X
from ragloom.operators.columns import require_columns
from ragloom.operators.context import render_block, render_doc, render_numbered, rendered
from ragloom.operators.generation import Backend, generated
from ragloom.plans.pipeline import cutoff
from ragloom.tables import shared_folder

Retriever = Callable[[DataFrame], DataFrame]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's folder; one of its own only where none is set and the session is local."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


@dataclass
class AgenticRAG:
    """Generate, read an answer or a query from the text, search, append the documents, and again.

    ``transform`` takes (qid, query) with unique qids and gives qid, query, context, search_history, search_iterations, qanswer,
    output, stop_reason. A text with the answer tag ends its query, one without a search ends it too.
    """

    retriever: Retriever
    backend: Backend
    search_tags: tuple[str, str] = ("<search>", "</search>")
    result_tags: tuple[str, str] = ("<information>", "</information>")
    answer_tags: tuple[str, str] = ("<answer>", "</answer>")
    prompt_template: str = "{{ question }}"
    top_k: int = 5
    max_turn: int = 10
    stop_sequences: Sequence[str] = ()
    renderer: Callable[[Column, Column, Column], Column] = render_block
    search_query: Callable[[Column, str, str], Column] = field(default=X.first_query)
    answer: Callable[[Column], Column] | None = None
    question: Callable[[Column], Column] = field(default=lambda q: q)
    analysis_template: str | None = None

    def _closed(self, text: Column, start: str, end: str) -> Column:
        """The end tag, if the last start tag has none after it."""
        return F.when(F.contains(F.substring_index(text, start, -1), F.lit(end)), F.lit("")).otherwise(F.lit(end))

    def _documents(self, asked: DataFrame) -> DataFrame:
        """(qid, _docs) of the queries that find some."""
        found = cutoff(self.retriever(asked.select("qid", F.col("_query").alias("query"))), self.top_k)
        docs = rendered(found, self.renderer, "_docs")
        if self.analysis_template:
            rows = docs.join(asked.select("qid", F.col("_query").alias("query"), F.col("output").alias("reasoning")), "qid")
            rows = rows.withColumn("prompt", X.template(self.analysis_template, {"docs": "_docs"}))
            said = generated(rows, self.backend, output_field="_said")
            docs = said.select("qid", X.extracted_answer("_said", "infogen").alias("_docs"))
        return docs

    def transform(self, queries: DataFrame) -> DataFrame:
        require_columns(queries, "qid", "query")
        none = F.lit(None).cast("string")
        state = queries.select(
            F.col("qid").cast("string").alias("qid"), "query", X.template(self.prompt_template, {"question": self.question(F.col("query"))}).alias("context"),
            F.array().cast("array<string>").alias("search_history"), F.lit(0).alias("search_iterations"), none.alias("qanswer"), F.lit("").alias("output"), none.alias("stop_reason"),
        )
        state = cut_lineage(state)
        start_answer, end_answer = self.answer_tags
        for turn in range(self.max_turn):
            active = state.filter("stop_reason is null")
            if not active.limit(1).count():
                break
            asked = active.withColumns({"turn": F.lit(turn), "prompt": F.col("context")})
            said = generated(asked, self.backend, output_field="_said", stop_sequences=self.stop_sequences).drop("turn", "prompt")
            text = F.col("_said")
            answered = F.contains(text, F.lit(start_answer))
            said = said.withColumn("_query", F.when(~answered, self.search_query(text, *self.search_tags)))
            told = F.concat(text, F.when(answered, self._closed(text, *self.answer_tags)).when(F.col("_query").isNotNull(), self._closed(text, *self.search_tags)).otherwise(""))
            answer = X.strip(F.regexp_replace(X.after_first(text, start_answer), rf"(?s)\Q{end_answer}\E.*$", ""))
            stepped = cut_lineage(said.select(
                "qid", "query", "_query", F.concat("context", F.lit("\n\n"), told).alias("context"), F.concat("output", F.lit("\n\n"), told).alias("output"),
                F.when(F.col("_query").isNotNull(), F.concat("search_history", F.array("_query"))).otherwise(F.col("search_history")).alias("search_history"),
                (F.col("search_iterations") + F.col("_query").isNotNull().cast("int")).alias("search_iterations"),
                F.when(answered, self.answer(text) if self.answer else answer).otherwise(F.col("qanswer")).alias("qanswer"),
                F.when(answered, "Got answer").when(F.col("_query").isNull(), "No answer, no search").alias("stop_reason"),
            ))
            docs = self._documents(stepped.filter("stop_reason is null"))
            told = F.concat(F.lit("\n\n" + self.result_tags[0]), F.col("_docs"), F.lit(self.result_tags[1]))
            more = F.when(F.col("_docs").isNotNull(), told).otherwise("")
            done = stepped.join(docs, "qid", "left").select(
                "qid", "query", F.concat("context", more).alias("context"), "search_history", "search_iterations", "qanswer",
                (F.concat("output", more) if self.analysis_template else F.col("output")).alias("output"),
                F.when(F.col("stop_reason").isNull() & F.col("_docs").isNull(), "No retrieval results").otherwise(F.col("stop_reason")).alias("stop_reason"),
            )
            state = cut_lineage(state.filter("stop_reason is not null").unionByName(done))
        return state.withColumn("stop_reason", F.coalesce("stop_reason", F.lit("No answer after max turns")))

    __call__ = transform


SEARCH_PROMPT = "Answer the question. Think between <think> and </think>. To look something up, write <search>query</search>; results come between <information> and </information>. Write the final answer as <answer>answer</answer>.\nQuestion: {{ question }}"
PIPE_PROMPTS = {
    "v0": "Question: {{ question }}\n<think>",
    "v1": "Reason step by step. To search, write <|begin_of_query|>query<|end_of_query|>. Give the answer as <answer>answer</answer>.\nQuestion: {{ question }}",
    "v2": "Reason step by step and search for each fact with <|begin_of_query|>query<|end_of_query|>, one fact at a time. Give the answer as <answer>answer</answer>.\nQuestion: {{ question }}",
    "v3": "Is the statement or question below answered by yes or no? Reason, search with <|begin_of_query|>query<|end_of_query|>, and end with <answer>answer</answer>.\nQuestion: {{ question }}",
}
ANALYSIS_PROMPT = "Earlier reasoning:\n{{ reasoning }}\nQuery: {{ query }}\nPages:\n{{ docs }}\nState what in the pages helps with the query, after the words Final Information."
BOXED_PROMPTS = {
    "single": "Answer the question with few searches, written <|begin_search_query|>query<|end_search_query|>. Give the answer in \\boxed{}.\nQuestion: {{ question }}",
    "multi": "The question needs several facts. Search for each, written <|begin_search_query|>query<|end_search_query|>. Give the answer in \\boxed{}.\nQuestion: {{ question }}",
}


def search_r1(retriever: Retriever, backend: Backend, top_k: int = 3, max_turn: int = 10, **changes) -> AgenticRAG:
    return replace(AgenticRAG(retriever, backend, prompt_template=SEARCH_PROMPT, top_k=top_k, max_turn=max_turn, renderer=render_doc, search_query=X.last_query, question=X.as_question), **changes)


def r1_searcher(retriever: Retriever, backend: Backend, top_k: int = 5, max_turn: int = 10, prompt_type: str = "v1", **changes) -> AgenticRAG:
    if prompt_type not in PIPE_PROMPTS:
        raise ValueError(f"unknown prompt type {prompt_type!r}")
    return replace(AgenticRAG(
        retriever, backend, ("<|begin_of_query|>", "<|end_of_query|>"), ("<|begin_of_documents|>", "<|end_of_documents|>"), prompt_template=PIPE_PROMPTS[prompt_type], top_k=top_k, max_turn=max_turn,
        renderer=render_numbered, stop_sequences=("<|im_end|>", "<|endoftext|>"),
    ), **changes)


def search_o1(retriever: Retriever, backend: Backend, top_k: int = 10, max_turn: int = 10, prompt_type: str = "single", **changes) -> AgenticRAG:
    if prompt_type not in BOXED_PROMPTS:
        raise ValueError(f"unknown prompt type {prompt_type!r}")
    return replace(AgenticRAG(
        retriever, backend, ("<|begin_search_query|>", "<|end_search_query|>"), ("<|begin_search_result|>", "<|end_search_result|>"), ("\\boxed{", "}"), BOXED_PROMPTS[prompt_type], top_k, max_turn,
        renderer=lambda i, title, text: render_block(i, title, X.first_words(text)), answer=X.answer_cascade, analysis_template=ANALYSIS_PROMPT,
    ), **changes)


def forced_search(agent: AgenticRAG, tries: int = 1) -> AgenticRAG:
    """An agent whose first turn searches for the question itself where its text has neither a query nor an answer."""
    plain = agent.search_query

    def query(text: Column, start: str, end: str) -> Column:
        return F.coalesce(plain(text, start, end), F.when(F.col("search_iterations") < tries, X.strip(F.col("query"))))

    return replace(agent, search_query=query)


# What the loop says in place of results.
SEARCH_LIMIT_TEXT = "The maximum search limit is exceeded. You are not allowed to search."
SEARCHED_BEFORE_TEXT = "You have searched this query. Please refer to previous results."
UNKNOWN_ANSWER = "I don't know."


@dataclass
class SearchO1Loop:
    """The loop that goes on after a refused search: (qid, query) with unique qids to qid, query, output, qanswer, iteration, all_queries, history, stop_reason.

    A turn whose output ends with the end tag of a query searches, if there were fewer than ``max_searches`` searches and the query is new; else a
    message stands in place of results and the query goes on. Any other turn ends it. Documents are read by the backend with the reasoning so far, in
    numbered steps of which the middle ones without tags are left out, and what it extracts is the result. ``history`` has every text and message.

    With ``forced_first`` the first turn is made to search: up to three short texts are generated, each up to a blank line or the end of a query (turns -3 to -1 of a scripted backend). If they
    ask or end nothing, the first (after an opened thought the first two) and the start tag of a query are followed by a text that is generated up to its end tag.
    """

    retriever: Retriever
    backend: Backend
    search_tags: tuple[str, str] = ("<|begin_search_query|>", "<|end_search_query|>")
    result_tags: tuple[str, str] = ("<|begin_search_result|>", "<|end_search_result|>")
    prompt_template: str = BOXED_PROMPTS["multi"]
    analysis_template: str = ANALYSIS_PROMPT
    top_k: int = 10
    max_turn: int = 10
    max_searches: int = 5
    renderer: Callable[[Column, Column, Column], Column] = field(default=lambda i, title, text: render_block(i, title, X.first_words(text)))
    forced_first: bool = False

    def _analysed(self, asked: DataFrame) -> DataFrame:
        """(qid, _result) of rows with a query."""
        found = cutoff(self.retriever(asked.select("qid", F.col("_query").alias("query"))), self.top_k)
        steps = F.split(F.regexp_replace("output", "\n\n", "\n"), "\n")
        reasoning = X.shortened_steps(steps, [self.search_tags[0], self.result_tags[0]])
        rows = asked.select("qid", F.col("_query").alias("query"), "turn", reasoning.alias("reasoning")).join(rendered(found, self.renderer, "_docs"), "qid", "left")
        rows = rows.withColumn("prompt", X.template(self.analysis_template, {"docs": "_docs"}))
        said = generated(rows, self.backend, output_field="_said")
        return said.select("qid", X.extracted_answer("_said", "infogen").alias("_result"))

    def _forced(self, active: DataFrame) -> DataFrame:
        """Rows with ``_begun``, the beginning of the first turn."""
        start, end = self.search_tags
        rows = active.withColumn("_steps", F.array().cast("array<string>"))
        for part in range(-3, 0):
            said = generated(rows.withColumns({"turn": F.lit(part), "prompt": F.concat("context", F.array_join("_steps", ""))}), self.backend, output_field="_said")
            rows = cut_lineage(said.select(*active.columns, F.concat("_steps", F.array(X.cut_behind("_said", ["\n\n", end]))).alias("_steps")))
        steps = F.filter("_steps", lambda s: F.lower(X.strip(s)) != "</think>")
        rows = rows.withColumn("_steps", F.when(F.size(steps) > 0, steps).otherwise(F.array(F.lit(""))))
        heads = F.transform(F.sequence(F.lit(1), F.size("_steps")), lambda k: F.array_join(F.slice("_steps", F.lit(1), k), ""))
        asking = F.get(F.filter(heads, lambda h: F.endswith(F.rtrim(F.regexp_replace(h, r"\s+$", "")), F.lit(end))), F.lit(0))
        whole = F.array_join("_steps", "")
        ends = F.contains(whole, F.lit("\\boxed")) | F.contains(whole, F.lit("</think>"))
        few = F.when(F.contains(F.get("_steps", F.lit(0)), F.lit("<think>")), F.array_join(F.slice("_steps", 1, 2), "")).otherwise(F.get("_steps", F.lit(0)))
        return rows.withColumn("_begun", F.coalesce(asking, F.when(ends, whole), F.concat(few, F.lit(start)))).drop("_steps")

    def transform(self, queries: DataFrame) -> DataFrame:
        require_columns(queries, "qid", "query")
        texts = F.array().cast("array<string>")
        state = cut_lineage(queries.select(
            F.col("qid").cast("string").alias("qid"), "query", X.template(self.prompt_template, {"question": F.col("query")}).alias("context"), F.lit("").alias("output"),
            texts.alias("searches"), texts.alias("history"), F.lit(0).alias("iteration"), F.lit(False).alias("done"),
        ))
        start, end = self.search_tags
        told_box = lambda text: F.concat(F.lit(f"\n{self.result_tags[0]}\n"), text, F.lit(f"\n{self.result_tags[1]}\n"))
        result_box = lambda text: F.concat(F.lit(f"\n\n{self.result_tags[0]}"), text, F.lit(f"{self.result_tags[1]}\n\n"))
        for turn in range(self.max_turn):
            active = state.filter("not done")
            if not active.limit(1).count():
                break
            first = self._forced(active) if self.forced_first and turn == 0 else active.withColumn("_begun", F.lit(""))
            # a text that is begun and ends with a query or an answer needs no more
            more = ~F.endswith(X.strip("_begun"), F.lit(end)) if self.forced_first and turn == 0 else F.lit(True)
            asked = first.withColumns({"turn": F.lit(turn), "prompt": F.concat("context", "_begun")})
            said = generated(asked.filter(more), self.backend, output_field="_said").drop("prompt")
            if self.forced_first and turn == 0:
                said = said.withColumn("_said", F.concat("_begun", X.cut_behind("_said", [end])))
                said = said.unionByName(asked.filter(~more).withColumn("_said", F.col("_begun")).drop("prompt"), allowMissingColumns=True)
            said = said.drop("_begun")
            output = F.concat("output", "_said")
            query = F.when(F.endswith(X.strip(output), F.lit(end)), X.last_between("_said", start, end))
            stepped = said.select(
                "qid", "query", "turn", F.concat("context", "_said").alias("context"), output.alias("output"), "searches", F.concat("history", F.array("_said")).alias("history"),
                (F.col("iteration") + 1).alias("iteration"), F.nullif(query, F.lit("")).alias("_query"),
            )
            over, seen = F.size("searches") >= self.max_searches, F.array_contains("searches", F.col("_query"))
            told = F.when(F.col("_query").isNotNull() & over, SEARCH_LIMIT_TEXT).when(F.col("_query").isNotNull() & seen, SEARCHED_BEFORE_TEXT)
            stepped = cut_lineage(stepped.withColumn("_told", told))
            found = self._analysed(stepped.filter("_query is not null and _told is null"))
            more = F.when(F.col("_told").isNotNull(), told_box(F.col("_told"))).otherwise(result_box(F.coalesce("_result", F.lit(""))))
            asked = F.col("_query").isNotNull()
            done = stepped.join(found, "qid", "left").select(
                "qid", "query", F.when(asked, F.concat("context", more)).otherwise(F.col("context")).alias("context"), F.when(asked, F.concat("output", more)).otherwise(F.col("output")).alias("output"),
                F.when(asked & F.col("_told").isNull(), F.concat("searches", F.array("_query"))).otherwise(F.col("searches")).alias("searches"),
                F.when(asked, F.concat("history", F.array(more))).otherwise(F.col("history")).alias("history"), "iteration", (~asked).alias("done"),
            )
            state = cut_lineage(state.filter("done").unionByName(done))
        return state.select(
            "qid", "query", "output", X.answer_cascade("output").alias("qanswer"), "iteration", F.transform("searches", lambda q, i: F.struct(i.alias("iteration"), q.alias("query"))).alias("all_queries"),
            "history", F.when(F.col("done"), "finished").otherwise("many_turns").alias("stop_reason"),
        )

    __call__ = transform


def limited_r1_searcher(retriever: Retriever, backend: Backend, top_k: int = 5, max_searches: int = 9, **changes) -> Callable[[DataFrame], DataFrame]:
    """The one-query-at-a-time form: at most ``max_searches`` searches, the answer of a query that ends without one is unknown, and stop reasons by name."""
    agent = r1_searcher(retriever, backend, top_k, max_searches, **({"prompt_type": "v3"} | changes))
    return lambda queries: standalone(agent.transform(queries), UNKNOWN_ANSWER, reasons=True)


def standalone(out: DataFrame, default_answer: str | None = None, reasons: bool = False) -> DataFrame:
    """The other output form: qid, query, output, qanswer, iteration, all_queries [, stop_reason_final]."""
    final = F.when(F.col("stop_reason") == "Got answer", "finished").when(F.col("stop_reason") == "No answer after max turns", "many_retrieve").when(F.col("stop_reason") == "No answer, no search", "query_inst_error").otherwise("shot_down")
    return out.select(
        "qid", "query", "output", (F.coalesce("qanswer", F.lit(default_answer)) if default_answer else F.col("qanswer")).alias("qanswer"), F.col("search_iterations").alias("iteration"),
        F.transform("search_history", lambda q, i: F.struct(i.alias("iteration"), q.alias("query"))).alias("all_queries"), *([final.alias("stop_reason_final")] if reasons else []),
    )


def merged(old: DataFrame, new: DataFrame, max_docs: int) -> DataFrame:
    """Union of two result lists by query, the best row of each document, the max_docs best."""
    both = old.drop("rank").unionByName(new.drop("rank"), allowMissingColumns=True)
    best = both.groupBy("qid", "docno").agg(F.max_by(F.struct(*(c for c in both.columns if c not in ("qid", "docno"))), "score").alias("_b")).select("qid", "docno", "_b.*")
    return cutoff(best, max_docs)


IRCOT_PROMPT = "Documents:\n{{ qcontext }}\nQuestion: {{ query }}\nThoughts so far: {{ prev }}\nNext thought, or: so the answer is ..."


@dataclass
class IRCOT:
    """Retrieve, read one thought, retrieve with the thought, merge the documents, until the exit condition or the limit: (qid, query, qanswer)."""

    retriever: Retriever
    backend: Backend
    prompt: str = IRCOT_PROMPT
    max_docs: int = 10
    max_iterations: int = -1
    exit_condition: Callable[[Column], Column] = X.says_answer
    safety_limit: int = 50

    def exceeded(self, iteration: int) -> bool:
        return iteration > (self.max_iterations if self.max_iterations > 0 else self.safety_limit) - 1

    def transform(self, queries: DataFrame) -> DataFrame:
        require_columns(queries, "qid", "query")
        state = cut_lineage(queries.select("qid", "query", F.lit("").alias("prev"), F.lit(None).cast("string").alias("qanswer"), F.lit(False).alias("done")))
        docs = cut_lineage(cutoff(self.retriever(state.select("qid", "query")), self.max_docs))
        turn = 0
        while True:
            active = state.filter(~F.col("done"))
            text = rendered(docs, lambda i, title, t: F.concat(F.coalesce(t, F.lit("")), F.lit("\n")), "qcontext")
            asked = active.join(text, "qid", "left").withColumn("turn", F.lit(turn)).withColumn("prompt", X.template(self.prompt))
            said = generated(asked, self.backend, output_field="_said")
            thought = F.col("_said")
            step = said.select("qid", "query", X.strip(F.concat_ws(" ", "prev", thought)).alias("prev"), thought.alias("qanswer"), self.exit_condition(thought).alias("done"))
            state = cut_lineage(state.filter("done").unionByName(step))
            turn += 1
            if self.exceeded(turn) or not state.filter(~F.col("done")).limit(1).count():
                return state.select("qid", "query", "qanswer")
            found = cutoff(self.retriever(state.filter(~F.col("done")).select("qid", F.col("qanswer").alias("query"))), self.max_docs)
            docs = cut_lineage(merged(docs, found, self.max_docs))

    __call__ = transform
