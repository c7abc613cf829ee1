"""Prompts, model backends, generation and readers."""

from __future__ import annotations

import json
import os
import time
import threading
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import text as X
from ragloom.operators.columns import require_columns
from ragloom.operators.context import first_rows, ordered

LOGPROBS = "array<map<string,double>>"
MESSAGES = "array<struct<role:string,content:string>>"


@dataclass
class Backend:
    """Generates a text for each row. A subclass gives ``column`` (Spark expressions) or ``generate`` (Python over batches of prompts)."""

    model_id: str = "model"
    max_input_length: int = 512
    max_new_tokens: int = 32
    supports_logprobs: bool = False
    supports_messages: bool = False
    supports_num_responses: bool = False

    def column(self, prompt: Column, n: int) -> Column | None:
        """array<struct<text, logprobs>> of n responses, or null where the backend is a Python one."""
        return None

    def generate(self, prompts: list, *, return_logprobs=False, max_new_tokens=None, stop_sequences=None, num_responses=1) -> list[list[tuple[str, list | None]]]:
        raise NotImplementedError

    def apply(self, df: DataFrame, prompt: str, n: int, logprobs: bool, max_new_tokens: int | None, stops: Sequence[str], batch_size: int) -> DataFrame:
        """df with ``_out``, the responses of each row."""
        made = self.column(F.col(prompt), n)
        if made is not None:
            return df.withColumn("_out", made)
        kind = f"array<struct<text:string,logprobs:{LOGPROBS}>>"
        generate = self.generate

        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                prompts = [x if isinstance(x, str) or x is None else [dict(m.asDict() if hasattr(m, "asDict") else m) for m in x] for x in s]
                out = []
                for k in range(0, len(prompts), batch_size):
                    out += generate(prompts[k : k + batch_size], return_logprobs=logprobs, max_new_tokens=max_new_tokens or self.max_new_tokens, stop_sequences=list(stops), num_responses=n)
                yield pd.Series([[{"text": t, "logprobs": lp} for t, lp in row] for row in out])

        return df.withColumn("_out", run(prompt))

    def text_generator(self, **options) -> Callable[[DataFrame], DataFrame]:
        return lambda df: generated(df, self, **options)

    def logprobs_generator(self, **options) -> Callable[[DataFrame], DataFrame]:
        if not self.supports_logprobs:
            raise ValueError(f"{self.model_id} gives no log-probabilities")
        return lambda df: generated(df, self, **({"logprobs_field": "qanswer_logprobs"} | options))

    @staticmethod
    def from_dsn(dsn: str) -> Backend:
        """``provider:model key=value ...``; a value may have further equal signs."""
        m = re.fullmatch(r"\s*(\w+):(\S+)((?:\s+\w+=\S+)*)\s*", dsn)
        if not m:
            raise ValueError(f"not a backend: {dsn!r}")
        return get_backend(m[1], m[2], **dict(p.split("=", 1) for p in m[3].split()))


@dataclass
class EchoBackend(Backend):
    """``resp:`` and the prompt, or the contents of its messages."""

    supports_logprobs: bool = True
    supports_messages: bool = True
    supports_num_responses: bool = True

    def column(self, prompt, n):
        one = lambda t: F.struct(t.alias("text"), F.array(F.create_map(t, F.lit(0.0))).cast(LOGPROBS).alias("logprobs"))
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda _: one(F.concat(F.lit("resp:"), prompt)))

    def apply(self, df, prompt, n, logprobs, max_new_tokens, stops, batch_size):
        if dict(df.dtypes)[prompt] != "string":
            df = df.withColumn("_prompt", F.array_join(F.transform(prompt, lambda m: m["content"]), "\n"))
            return super().apply(df, "_prompt", n, logprobs, max_new_tokens, stops, batch_size).drop("_prompt")
        return super().apply(df, prompt, n, logprobs, max_new_tokens, stops, batch_size)


@dataclass
class ColumnBackend(Backend):
    """Any function from the prompt column to a text column."""

    function: Callable[[Column], Column] = field(default=lambda p: p)
    supports_num_responses: bool = True

    def column(self, prompt, n):
        one = F.struct(self.function(prompt).alias("text"), F.lit(None).cast(LOGPROBS).alias("logprobs"))
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda _: one)


def extractive(prompt: Column) -> Column:
    """The context's sentence with most terms of the question; a prompt ends in ``Question: ...``, and its other lines are the context."""
    question = X.normalized_tokens(F.substring_index(prompt, "Question:", -1))
    parts = X.sentences(F.substring_index(prompt, "Question:", 1))
    score = lambda s: F.size(F.array_intersect(X.normalized_tokens(s), question))
    best = F.array_max(F.transform(parts, lambda s, i: F.struct(score(s).alias("n"), (-i).alias("i"), s.alias("s"))))
    return F.coalesce(best["s"], F.lit(""))


@dataclass
class ExtractiveBackend(ColumnBackend):
    function: Callable[[Column], Column] = field(default=extractive)


@dataclass
class ScriptedBackend(Backend):
    """Answers from a table (key, text [, logprobs]) looked up by the prompt or, in loops, by (qid, turn)."""

    script: DataFrame | None = None
    supports_logprobs: bool = True
    supports_messages: bool = True

    def apply(self, df, prompt, n, logprobs, max_new_tokens, stops, batch_size):
        keys = [c for c in ("qid", "turn", "prompt") if c in self.script.columns and c in df.columns]
        lp = F.col("logprobs") if "logprobs" in self.script.columns else F.lit(None).cast(LOGPROBS)
        rows = self.script.select(*keys, F.array(F.struct(F.col("text"), lp.alias("logprobs"))).alias("_out"))
        none = F.array(F.struct(F.lit("").alias("text"), F.lit(None).cast(LOGPROBS).alias("logprobs")))
        return df.join(rows, keys, "left").withColumn("_out", F.coalesce("_out", none))


@dataclass
class FunctionBackend(Backend):
    """A Python function from a list of prompts to a list of texts, called in batches on the executors."""

    function: Callable[[list], list[str]] | None = None

    def generate(self, prompts, *, return_logprobs=False, max_new_tokens=None, stop_sequences=None, num_responses=1):
        return [[(t, None)] * num_responses for t in self.function(prompts)]


def word_pieces(text: str) -> list[str]:
    """Words with the white space before them."""
    return re.findall(r"\s*\S+|\s+$", text)


class Turns:
    """Lets a task's threads go on one after the other, a fixed time apart; the time of the last turn outlives a batch."""

    lock, due = threading.Lock(), 0.0

    def __init__(self, per_second: float):
        self.gap = 1 / per_second

    def __call__(self) -> None:
        with Turns.lock:
            now = time.monotonic()
            wait = max(0.0, Turns.due - now)
            Turns.due = max(now, Turns.due) + self.gap
        time.sleep(wait)


@dataclass
class HTTPBackend(Backend):
    """A service with the chat or completions protocol. Requests run on executors, ``parallel`` at once a task; errors become ``ERROR::`` texts.

    The key is the argument's, else of the environment variable; the number of partitions bounds the load on the service, and a task sends
    at most ``requests_per_second``. After an answer that may be another one later (408, 409, 429, 5xx or none at all) a request is sent again, up to ``max_retries`` times in all,
    after the pause that the service names (Retry-After, in seconds) or else one that doubles from ``pause`` on, ``longest_pause`` at most. Other errors are final. Of a prompt the first
    ``max_input_length`` tokens are sent, of messages those of the last one that the others leave; ``tokenizer`` gives pieces that join to the text.
    """

    base_url: str = "http://localhost:8000/v1"
    api: str = "chat/completions"
    api_key: str | None = None
    key_variable: str = "LLM_API_KEY"
    max_retries: int = 10
    timeout: float = 30.0
    parallel: int = 4
    logprobs_topk: int = 20
    pause: float = 0.5
    longest_pause: float = 60.0
    requests_per_second: float | None = None
    tokenizer: Callable[[str], list[str]] = field(default=word_pieces)
    supports_logprobs: bool = True
    supports_messages: bool = True
    supports_num_responses: bool = True

    def __post_init__(self):
        self.api_key = self.api_key or os.environ.get(self.key_variable)
        if not self.api_key:
            raise ValueError(f"no key: pass api_key or set {self.key_variable}")
        if self.api not in ("chat/completions", "completions"):
            raise ValueError(f"unknown api {self.api!r}")

    def _post(self, body: dict) -> dict:
        request = urllib.request.Request(f"{self.base_url}/{self.api}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def cut(self, prompt):
        """The prompt within ``max_input_length`` tokens."""
        if isinstance(prompt, list):
            room = self.max_input_length - sum(len(self.tokenizer(m["content"] or "")) for m in prompt[:-1])
            return [*prompt[:-1], *({**m, "content": "".join(self.tokenizer(m["content"] or "")[: max(0, room)])} for m in prompt[-1:])]
        return "".join(self.tokenizer(prompt)[: self.max_input_length]) if prompt else prompt

    def _ask(self, prompt, return_logprobs, max_new_tokens, stop_sequences, n, turn=lambda: None):
        chat, prompt = self.api.startswith("chat"), self.cut(prompt)
        body = {"model": self.model_id, "max_tokens": max_new_tokens, "n": n} | ({"stop": stop_sequences} if stop_sequences else {})
        if chat:
            body |= {"messages": prompt if isinstance(prompt, list) else [{"role": "user", "content": prompt}]} | ({"logprobs": True, "top_logprobs": self.logprobs_topk} if return_logprobs else {})
        else:
            body |= {"prompt": prompt} | ({"logprobs": self.logprobs_topk} if return_logprobs else {})
        error, pause = "ERROR::other", self.pause
        for attempt in range(max(1, self.max_retries)):
            if attempt:
                time.sleep(min(pause, self.longest_pause))
                pause = max(pause, self.pause) * 2
            turn()
            try:
                out = []
                for c in self._post(body)["choices"]:
                    lp = c.get("logprobs")
                    if lp and chat:
                        lp = [{t["token"]: t["logprob"] for t in p["top_logprobs"]} for p in lp["content"]]
                    elif lp:
                        lp = lp["top_logprobs"]
                    out.append(((c["message"]["content"] if chat else c["text"]) or "", lp))
                return (out + [("", None)] * n)[:n]
            except urllib.error.HTTPError as e:
                said = e.read().decode(errors="replace").lower()
                error = "ERROR::reduce_length" if "length" in said else "ERROR::response_filtered" if "filter" in said else "ERROR::other"
                if error != "ERROR::other" or not (e.code >= 500 or e.code in (408, 409, 429)):
                    break
                named = (e.headers or {}).get("Retry-After") or ""
                pause = float(named) if named.replace(".", "", 1).isdigit() else pause
            except (OSError, KeyError, ValueError):
                error = "ERROR::other"
        return [(error, None)] * n

    def generate(self, prompts, *, return_logprobs=False, max_new_tokens=None, stop_sequences=None, num_responses=1):
        turn = Turns(self.requests_per_second) if self.requests_per_second else lambda: None
        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(lambda p: self._ask(p, return_logprobs, max_new_tokens, stop_sequences, num_responses, turn), prompts))


def _pretrained(backend: LocalModelBackend) -> Callable[..., list[list[tuple]]]:
    """A causal or sequence-to-sequence model: padded and cut prompts, greedy unless the options say else, the prompt's tokens taken off a causal output."""
    import torch
    import transformers

    auto = transformers.AutoModelForSeq2SeqLM if backend.kind == "seq2seq" else transformers.AutoModelForCausalLM
    tokenizer = transformers.AutoTokenizer.from_pretrained(backend.model_id)
    if tokenizer.pad_token is None:
        tokenizer.pad_token = tokenizer.eos_token
    if backend.kind == "causal":
        tokenizer.padding_side = "left"
    model = auto.from_pretrained(backend.model_id, **backend.model_options)

    def run(prompts, new_tokens, logprobs, stops):
        batch = tokenizer(prompts, return_tensors="pt", padding=True, truncation=True, max_length=backend.max_input_length)
        with torch.no_grad():
            out = model.generate(**batch, **({"do_sample": False, "max_new_tokens": new_tokens} | backend.generation_options))
        if backend.kind == "causal":
            out = out[:, batch["input_ids"].shape[1] :]
        return [(t, None) for t in tokenizer.batch_decode(out, skip_special_tokens=True)]

    return run


def _served(backend: LocalModelBackend) -> Callable[..., list[list[tuple]]]:
    """A model of the batch server library, with the log-probabilities of each step's likeliest tokens."""
    import vllm

    model = vllm.LLM(backend.model_id, **backend.model_options)

    def run(prompts, new_tokens, logprobs, stops):
        options = {"temperature": 0.0, "max_tokens": new_tokens, "stop": list(stops) or None, "logprobs": backend.logprobs_topk if logprobs else None, "truncate_prompt_tokens": backend.max_input_length} | backend.generation_options
        given = vllm.SamplingParams(**options)
        outs = model.chat(prompts, given) if prompts and isinstance(prompts[0], list) else model.generate(prompts, given)
        steps = lambda o: [{x.decoded_token: float(x.logprob) for x in step.values()} for step in o.logprobs] if logprobs else None
        return [(o.outputs[0].text, steps(o.outputs[0])) for o in outs]

    return run


@dataclass
class LocalModelBackend(Backend):
    """A model of an optional library, made once a worker; ``kind`` is causal, seq2seq or vllm.

    ``loader`` makes, in place of the library's, a function of (prompts, new tokens, whether log-probabilities are wanted, stops) that
    gives a pair (text, log-probabilities or None) for each prompt. Texts are cut at the stops. Only vllm has log-probabilities and messages;
    there is one response a prompt.
    """

    kind: str = "causal"
    loader: Callable[[LocalModelBackend], Callable] | None = None
    logprobs_topk: int = 20
    model_options: dict = field(default_factory=dict)
    generation_options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in ("causal", "seq2seq", "vllm"):
            raise ValueError(f"unknown kind {self.kind!r}")
        needed = ("vllm",) if self.kind == "vllm" else ("transformers", "torch")
        if self.loader is None and (missing := [m for m in needed if not available(m)]):
            raise ImportError(f"{self.kind} models need {' and '.join(missing)}, or a loader")
        self.supports_logprobs = self.supports_messages = self.kind == "vllm"
        self._run = None

    def __getstate__(self):
        return self.__dict__ | {"_run": None}

    def generate(self, prompts, *, return_logprobs=False, max_new_tokens=None, stop_sequences=None, num_responses=1):
        if num_responses != 1:
            raise ValueError("local models give one response a prompt")
        if self._run is None:
            self._run = (self.loader or (_served if self.kind == "vllm" else _pretrained))(self)
        stops = tuple(stop_sequences or ())

        def cut(text: str) -> str:
            return text[: min((at for at in (text.find(s) for s in stops) if at >= 0), default=len(text))]

        return [[(cut(text), steps)] for text, steps in self._run(list(prompts), max_new_tokens or self.max_new_tokens, return_logprobs, stops)]


def available(module: str) -> bool:
    import importlib.util

    return importlib.util.find_spec(module) is not None


_KINDS: dict[str, Callable[..., Backend]] = {
    "echo": EchoBackend, "extractive": ExtractiveBackend, "function": FunctionBackend, "http": HTTPBackend, "openai": HTTPBackend,
    **{k: (lambda model_id, kind=k, **o: LocalModelBackend(model_id, kind=kind, **o)) for k in ("causal", "seq2seq", "vllm")}, "huggingface": lambda model_id, **o: LocalModelBackend(model_id, kind="causal", **o),
}


def get_backend(kind: str, model_id: str = "model", **options) -> Backend:
    """A backend by kind; options that are texts take the type of the field they set (False and 0 are false)."""
    if kind not in _KINDS:
        raise ValueError(f"unknown backend {kind!r}; there are {sorted(_KINDS)}")
    cast = {"int": int, "float": float, "bool": lambda v: v.lower() not in ("false", "0", "no", ""), int: int, float: float}
    fields = getattr(_KINDS[kind], "__dataclass_fields__", {})
    for k, v in options.items():
        if isinstance(v, str) and k in fields and fields[k].type in cast:
            options[k] = cast[fields[k].type](v)
    return _KINDS[kind](model_id=model_id, **options)


_default: dict[str, Backend] = {}


def set_default_backend(backend: Backend) -> None:
    _default["backend"] = backend


def default_backend(spark: SparkSession | None = None) -> Backend:
    """The backend set, else that of the session's ``spark.ragloom.backend``; a RuntimeError without either."""
    if "backend" not in _default:
        dsn = spark.conf.get("spark.ragloom.backend", None) if spark else None
        if not dsn:
            raise RuntimeError("no default backend is set")
        _default["backend"] = Backend.from_dsn(dsn)
    return _default["backend"]


def generated(
    df: DataFrame, backend: Backend, input_field: str = "prompt", output_field: str = "qanswer", logprobs_field: str | None = None, batch_size: int = 4, max_new_tokens: int | None = None,
    stop_sequences: Sequence[str] = (), num_responses: int = 1,
) -> DataFrame:
    """df with the generated text, and num_responses rows for each row (then with ``response_idx``)."""
    require_columns(df, input_field)
    messages = dict(df.dtypes)[input_field] != "string"
    for asked, able, what in ((logprobs_field, backend.supports_logprobs, "log-probabilities"), (messages, backend.supports_messages, "messages"), (num_responses > 1, backend.supports_num_responses, "several responses")):
        if asked and not able:
            raise ValueError(f"{backend.model_id} does not support {what}")
    out = backend.apply(df, input_field, num_responses, bool(logprobs_field), max_new_tokens, stop_sequences, batch_size)
    kept = [c for c in df.columns if c not in (output_field, logprobs_field, "response_idx")]
    if num_responses > 1:
        out = out.select(*kept, F.posexplode("_out").alias("response_idx", "_one"))
        kept.append("response_idx")
    else:
        out = out.select(*kept, F.get("_out", F.lit(0)).alias("_one"))
    text = X.cut_at_stops("_one.text", stop_sequences) if stop_sequences else F.col("_one.text")
    return out.select(*kept, text.alias(output_field), *([F.col("_one.logprobs").alias(logprobs_field)] if logprobs_field else []))


#: The default instruction.
QA_PROMPT = "Use the context to answer the question in a few words.\nContext:\n{{ qcontext }}\nQuestion: {{ query }}"


def prompts(
    df: DataFrame, instruction: str | Callable[..., Column] = QA_PROMPT, system_message: str | None = None, api: str | None = None, input_fields: Sequence[str] = ("query", "qcontext"), output_field: str = "prompt", raw: bool = False,
) -> DataFrame:
    """(prompt, qid, query_0): one a query, from the fields of its first row by rank or arrival.

    ``instruction`` is a template or a function of the fields as columns. With ``api`` the prompt is an array of messages, else a
    text, with the system message before it; ``raw`` gives the instruction alone.
    """
    require_columns(df, "qid", "query", *input_fields)
    order = F.col("rank") if "rank" in df.columns else -F.col("score") if "score" in df.columns else F.lit(0)
    first = df.groupBy("qid").agg(F.min_by(F.struct(*dict.fromkeys(["query", *input_fields])), F.struct(order, F.xxhash64(*input_fields))).alias("_f"))
    fields = {f: F.col(f"_f.{f}") for f in input_fields}
    body = X.template(instruction, fields) if isinstance(instruction, str) else instruction(**fields)
    if api and not raw:
        say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
        body = F.array(*([say("system", F.lit(system_message))] if system_message else []), say("user", body))
    elif system_message and not raw:
        body = F.concat(F.lit(system_message + "\n\n"), body)
    return first.select(body.alias(output_field), "qid", F.col("_f.query").alias("query_0"))


def ranked_tokens(logprobs: Column | str) -> Column:
    """Of log-probabilities (a map for each position): for each position its tokens from the likeliest, as structs of token, logprob and rank from 1; equal ones by token."""
    lp = F.col(logprobs) if isinstance(logprobs, str) else logprobs
    ordered_by = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("token"))))
    return F.transform(lp, lambda m: F.transform(ordered_by(m), lambda x, i: F.struct(x["token"].alias("token"), (-x["k"]).alias("logprob"), (i + 1).alias("rank"))))


def reader(df: DataFrame, backend: Backend, instruction: str | Callable[..., Column] = QA_PROMPT, answer: Callable[[Column], Column] | None = None, output_field: str = "qanswer", logprobs: bool = False, system_message: str | None = None, **options) -> DataFrame:
    """Prompt, generate, extract: (prompt, qid, query_0, qanswer). The prompt is messages where the backend takes them and a system message is given."""
    asked = prompts(df, instruction, system_message, "chat" if backend.supports_messages and system_message else None, **options)
    if logprobs:
        if not backend.supports_logprobs:
            raise ValueError(f"{backend.model_id} gives no log-probabilities")
        out = generated(asked, backend, logprobs_field="qanswer_logprobs", max_new_tokens=1)
        text = answer(F.col("qanswer_logprobs")) if answer else F.col("qanswer")
        return out.withColumn(output_field, text)
    out = generated(asked, backend, output_field=output_field)
    return out.withColumn(output_field, answer(F.col(output_field))) if answer else out


def reasoning_extractor(df: DataFrame, answer: str = "qanswer", reasoning: str | None = "reasoning") -> DataFrame:
    said, thought = X.split_reasoning(answer)
    return df.select(*(c for c in df.columns if c not in (answer, reasoning)), said.alias(answer), *([thought.alias(reasoning)] if reasoning else []))


def fusion_inputs(results: DataFrame, num_context: int | str = "auto", text_field: str = "text") -> DataFrame:
    """(qid, query, inputs array<string>): one text for each passage by score; the bare question without passages."""
    title = [F.when(F.col("title").isNotNull(), F.concat(F.lit("title: "), F.col("title")))] if "title" in results.columns else []
    text = F.concat_ws(" ", F.concat(F.lit("question: "), F.col("query")), *title, F.when(F.col(text_field).isNotNull(), F.concat(F.lit("context: "), F.col(text_field))))
    order = [-F.col("score")] if "score" in results.columns else []
    by = [*order, *([F.col("docno")] if "docno" in results.columns else []), F.col("_in")]
    results = results.withColumn("_in", text)
    if num_context != "auto":
        results = first_rows(results, "qid", by, num_context)
    rows = results.groupBy("qid").agg(F.min("query").alias("query"), ordered(["_in"], by).alias("_p"))
    inputs = F.transform("_p", lambda x: x["_in"])
    return rows.select("qid", "query", inputs.alias("inputs"))


def fusion_reader(results: DataFrame, answer: Column | Callable[[pd.Series], pd.Series], num_context: int | str = "auto", text_field: str = "text") -> DataFrame:
    """(qid, query, qanswer): a model over each query's array of passage texts, as a column of ``inputs`` or over Arrow batches."""
    rows = fusion_inputs(results, num_context, text_field)
    return rows.select("qid", "query", (answer if isinstance(answer, Column) else F.pandas_udf(answer, "string")("inputs")).alias("qanswer"))
