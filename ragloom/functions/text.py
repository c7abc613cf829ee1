"""Text functions from Column to Column: answers, tags, steps, triples, prompts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, and the answers that F1 compares as a whole.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLOSED_ANSWERS = ("yes", "no", "noanswer")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(f, *args: Column) -> Column:
    """f(*args) with each argument evaluated once a row, however often f's higher-order functions refer to it."""
    row = F.struct(*(a.alias(f"_{i}") for i, a in enumerate(args)))
    return F.get(F.transform(F.array(row), lambda s: f(*(s[f"_{i}"] for i in range(len(args))))), F.lit(0))


#: The characters with Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(_c(x), F.lit(WHITE_SPACE))


def normalized_tokens(x: Column | str) -> Column:
    """Lower-cased tokens between white space, ASCII punctuation deleted, articles between word boundaries made a space."""
    bare = F.translate(F.lower(_c(x)), PUNCTUATION, "")
    return F.filter(F.split(F.regexp_replace(bare, r"(?U)\b(?:a|an|the)\b", " "), r"(?U)\s+"), lambda t: t != "")


def normalize_answer(x: Column | str) -> Column:
    return F.array_join(normalized_tokens(x), " ")


def exact_match(prediction: Column | str, gold: Column | str) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def overlap(p: Column, g: Column) -> Column:
    """Size of the multiset intersection of two arrays: one walk over both in order, counting each token's runs."""
    marked = lambda a, side: F.transform(a, lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))
    both = F.array_sort(F.concat(marked(p, 0), marked(g, 1)))
    zero = F.lit(0)
    state = lambda t, in_p, in_g, done: F.struct(t.alias("t"), in_p.alias("p"), in_g.alias("g"), done.alias("done"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["t"].eqNullSafe(x["t"])
        before = lambda field: F.when(same, acc[field]).otherwise(zero)
        done = F.when(same, acc["done"]).otherwise(acc["done"] + F.least(acc["p"], acc["g"]))
        return state(x["t"], before("p") + 1 - x["side"], before("g") + x["side"], done)

    return F.aggregate(both, state(F.lit(None).cast("string"), zero, zero, zero), step, lambda acc: acc["done"] + F.least(acc["p"], acc["g"]))


def token_f1(prediction: Column | str, gold: Column | str) -> Column:
    """F1 of token multisets; 0 without a common token, and if either side is a closed answer that the other is not."""
    def score(p: Column, g: Column) -> Column:
        a, b = F.array_join(p, " "), F.array_join(g, " ")
        closed = (a.isin(*CLOSED_ANSWERS) | b.isin(*CLOSED_ANSWERS)) & (a != b)
        return F.when(closed, 0.0).otherwise(F.coalesce(F.try_divide(2.0 * overlap(p, g), F.size(p) + F.size(g)), F.lit(0.0)))

    return once(score, normalized_tokens(prediction), normalized_tokens(gold))


def best_of(measure, prediction: Column | str, golds: Column | str) -> Column:
    """The largest ``measure`` over an array of gold answers; null if there is none."""
    return F.array_max(F.transform(_c(golds), lambda g: measure(prediction, g)))


def answer_length(x: Column | str) -> Column:
    return F.coalesce(F.char_length(_c(x)), F.lit(0))


def is_empty_answer(x: Column | str) -> Column:
    return (answer_length(x) == 0).cast("int")


def ngrams(tokens: Column, n: int) -> Column:
    """Windows of n tokens joined by a space; empty if there are fewer."""
    if n == 1:
        return tokens
    last = F.size(tokens) - n + 1
    spots = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def rouge_tokens(x: Column | str) -> Column:
    return F.filter(F.split(F.lower(_c(x)), "[^a-z0-9]+"), lambda t: t != "")


def _subsequence_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequences by bits: a zero of ``row`` is a step of the table's row, updated for each token of b at once."""

    def length(x, y) -> int:
        places: dict[str, int] = {}
        for i, t in enumerate(x):
            places[t] = places.get(t, 0) | 1 << i
        whole = row = (1 << len(x)) - 1
        for t in y:
            met = row & places.get(t, 0)
            row = ((row + met) | (row - met)) & whole
        return len(x) - row.bit_count()

    return pd.Series([0 if x is None or y is None else length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, 0 if either is null; in Arrow batches, for no built-in can keep a table's row."""
    return F.pandas_udf(_subsequence_lengths, "int")(a, b)


def rouge(prediction: Column | str, gold: Column | str, kind: str = "rouge1", tokens=rouge_tokens) -> dict[str, Column]:
    """Precision, recall and F of rouge1, rouge2 or rougeL as columns P, R, F; ``tokens`` may stem."""
    if kind not in ("rouge1", "rouge2", "rougeL"):
        raise ValueError(f"unknown kind {kind!r}")

    def parts(p: Column, g: Column) -> Column:
        """Hits and the sizes of both sides."""
        return F.struct(overlap(p, g).cast("double").alias("hits"), F.size(p).alias("p"), F.size(g).alias("g"))

    p, g = tokens(prediction), tokens(gold)
    if kind == "rougeL":
        n = {"hits": common_subsequence(p, g).cast("double"), "p": F.size(p), "g": F.size(g)}
    elif kind == "rouge2":
        n = once(lambda p, g: once(parts, ngrams(p, 2), ngrams(g, 2)), p, g)
    else:
        n = once(parts, p, g)
    zero = F.lit(0.0)
    precision, recall = F.coalesce(F.try_divide(n["hits"], n["p"]), zero), F.coalesce(F.try_divide(n["hits"], n["g"]), zero)
    return {"P": precision, "R": recall, "F": F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero)}


def split_reasoning(x: Column | str, start: str = "<think>", end: str = "</think>") -> tuple[Column, Column]:
    """(answer, thoughts): spans between the tags, an open one to the end, are cut out and joined."""
    pattern = rf"(?s)\Q{start}\E(.*?)(?:\Q{end}\E|\z)"
    x = _c(x)
    return strip(F.regexp_replace(x, pattern, "")), strip(F.array_join(F.regexp_extract_all(x, F.lit(pattern), 1), ""))


def after_first(x: Column | str, tag: str) -> Column:
    """Stripped text after the first ``tag``, null without one."""
    x = _c(x)
    return F.when(F.contains(x, F.lit(tag)), strip(F.substring(x, F.instr(x, tag) + len(tag), F.char_length(x))))


def last_between(x: Column | str, start: str, end: str) -> Column:
    """The last shortest span between the tags, stripped; null without one."""
    spans = F.regexp_extract_all(_c(x), F.lit(rf"(?s)\Q{start}\E(.*?)\Q{end}\E"), 1)
    return strip(F.try_element_at(spans, F.lit(-1)))


def first_query(x: Column | str, start: str, end: str) -> Column:
    """Text from the first start tag to the next end tag or the end, without quotes and ellipses, white space squeezed; null if empty."""
    x = _c(x)
    rest = F.when(F.contains(x, F.lit(start)), F.substring(x, F.instr(x, start) + len(start), F.char_length(x)))
    bare = F.regexp_replace(F.substring_index(rest, end, 1), "[\"']|\\.\\.\\.", "")
    return F.nullif(strip(F.regexp_replace(bare, r"(?U)\s+", " ")), F.lit(""))


def last_query(x: Column | str, start: str, end: str) -> Column:
    """Stripped text after the last start tag, up to the next end tag; null without a start tag or if empty."""
    x = _c(x)
    rest = F.when(F.contains(x, F.lit(start)), F.substring_index(F.substring_index(x, start, -1), end, 1))
    return F.nullif(strip(rest), F.lit(""))


def boxed(x: Column | str) -> Column:
    r"""The content of the last ``\boxed{...}`` on its line, an inner ``\text{...}`` opened and outer brackets dropped; empty without one."""
    found = F.try_element_at(F.regexp_extract_all(_c(x), F.lit(r"\\boxed\{(.*)\}"), 1), F.lit(-1))
    inner = F.regexp_extract(found, r"\\text\{(.*)\}", 1)
    return F.coalesce(strip(F.regexp_replace(F.when(inner != "", inner).otherwise(found), r"^[()]+|[()]+$", "")), F.lit(""))


def extracted_answer(x: Column | str, mode: str = "gen") -> Column:
    """Answers by mode: ``codegen`` the last fenced python block, ``infogen`` the final information or the changed steps, else the boxed text."""
    x = _c(x)
    if mode == "codegen":
        return F.coalesce(strip(F.try_element_at(F.regexp_extract_all(x, F.lit(r"(?s)```python(.*?)```"), 1), F.lit(-1))), F.lit(""))
    if mode == "infogen":
        after = lambda mark: strip(F.regexp_replace(F.substring_index(x, mark, -1), r"[\n*]|^\s*:", " "))
        return (
            F.when(F.contains(x, F.lit("Final Information")), after("Final Information"))
            .when(F.contains(x, F.lit("Modified Reasoning Steps")), after("Modified Reasoning Steps"))
            .otherwise("No helpful information found.")
        )
    if mode in ("gen", "qa", "choose"):
        return boxed(x)
    raise ValueError(f"unknown mode {mode!r}")


def answer_cascade(x: Column | str) -> Column:
    """Boxed text, else what follows the first ``</think>``, else the whole, stripped."""
    return F.coalesce(F.nullif(boxed(x), F.lit("")), F.nullif(after_first(x, "</think>"), F.lit("")), strip(x))


def _steps(x: Column) -> Column:
    """Map from step number to text of ``Step n:`` blocks; a later block of the same number counts."""
    spans = F.regexp_extract_all(x, F.lit(r"(?s)(Step \d+:.*?)(?=Step \d+:|\z)"), 1)
    number = lambda s: F.regexp_extract(s, r"^Step (\d+):", 1).cast("int")
    body = lambda s: strip(F.regexp_replace(s, r"^Step \d+:", ""))
    return F.aggregate(spans, F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>")), lambda m, s: F.map_concat(F.map_filter(m, lambda k, _: k != number(s)), F.create_map(number(s), body(s))))


def cut_behind(x: Column | str, stops: Sequence[str]) -> Column:
    """The text up to the first of the stops and with it; all of it where there is none."""
    any_of = "|".join(re.escape(s) for s in stops)
    head = F.regexp_extract(_c(x), f"(?s)^(.*?(?:{any_of}))", 1)
    return F.when(head != "", head).otherwise(_c(x))


def replaced_steps(origin: Column | str, change: Column | str) -> Column:
    """Steps of ``origin`` with those of ``change`` written over them; a step changed to ``DELETE THIS STEP`` goes. By number, blank lines between."""
    old, new = _steps(_c(origin)), _steps(_c(change))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), F.map_filter(new, lambda _, v: ~F.contains(v, F.lit("DELETE THIS STEP"))))
    return once(_numbered, merged)


def _numbered(merged: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_keys(merged)), lambda k: F.concat(F.lit("Step "), k.cast("string"), F.lit(": "), F.element_at(merged, k))), "\n\n")


def shortened_steps(steps: Column | str, marks: Sequence[str]) -> Column:
    """An array of steps, numbered from 1: all if at most five, else the first, the last four and those that contain a mark, with ``...`` once for each gap."""
    steps = _c(steps)
    n = F.size(steps)
    marked = lambda s: F.greatest(*(F.contains(s, F.lit(m)) for m in marks)) if len(marks) > 1 else F.contains(s, F.lit(marks[0]))
    keep = lambda s, i: (n <= 5) | (i == 0) | (i >= n - 4) | marked(s)
    lines = F.transform(steps, lambda s, i: F.when(keep(s, i), F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s)).otherwise(F.lit("...")))
    gap = lambda acc, x: (x == "...") & F.coalesce(F.element_at(acc, -1) == "...", F.lit(False))
    return F.array_join(F.aggregate(lines, F.array(F.lit("")), lambda acc, x: F.when(gap(acc, x), acc).otherwise(F.concat(acc, F.array(x))), lambda acc: F.slice(acc, 2, F.size(acc) - 1)), "\n\n")


def first_words(x: Column | str, n: int = 360) -> Column:
    """The first n words joined by a space; a text with no more is unchanged."""
    cut = lambda parts: F.when(F.size(parts) > n, F.array_join(F.slice(parts, 1, n), " "))
    return F.coalesce(once(cut, F.split(strip(x), r"(?U)\s+")), _c(x))


def as_question(x: Column | str) -> Column:
    """Stripped, with a question mark at the end."""
    s = strip(x)
    return F.when(F.endswith(s, F.lit("?")), s).otherwise(F.concat(s, F.lit("?")))


def triples(x: Column | str) -> Column:
    """array<struct<head, relation, tail>> of ``<head; relation; tail>`` spans; semicolons beyond two belong to the head, spans with fewer are left out."""
    parts = F.transform(F.regexp_extract_all(_c(x), F.lit("<([^>]*)>"), 1), lambda s: F.split(s, ";"))
    good = F.filter(parts, lambda p: F.size(p) > 2)
    head = lambda p: F.when(F.size(p) == 3, F.get(p, 0)).otherwise(F.array_join(F.slice(p, F.lit(1), F.size(p) - 2), ";"))
    return F.transform(good, lambda p: F.struct(strip(head(p)).alias("head"), strip(F.element_at(p, -2)).alias("relation"), strip(F.element_at(p, -1)).alias("tail")))


def repaired_heads(found: Column, title: Column | str, text: Column | str) -> Column:
    """Triples whose head is neither the title nor in the text, by lower case, get the title as head."""
    title, text = _c(title), _c(text)
    wrong = lambda h: (F.lower(h) != F.lower(title)) & ~F.contains(F.lower(text), F.lower(h))
    return F.transform(found, lambda t: F.struct(F.when(wrong(t["head"]), title).otherwise(t["head"]).alias("head"), t["relation"].alias("relation"), t["tail"].alias("tail")))


def triple_text(t: Column) -> Column:
    return F.concat(F.lit("<"), t["head"], F.lit("; "), t["relation"], F.lit("; "), t["tail"], F.lit(">"))


def sentences(x: Column | str) -> Column:
    """Parts between ``'. '``, stripped, the period put back, without blank ones."""
    parts = F.filter(F.transform(F.split(_c(x), r"\. "), strip), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(F.endswith(s, F.lit(".")), s).otherwise(F.concat(s, F.lit("."))))


def aligned_sentence(parts: Column, t: Column) -> Column:
    """Index, from 0, of the sentence with most words of the triple; the first of equal ones."""
    words = F.filter(F.split(F.lower(F.concat_ws(" ", t["head"], t["relation"], t["tail"])), r"\s+"), lambda w: w != "")
    score = lambda s: F.size(F.filter(words, lambda w: F.contains(F.lower(s), w)))
    return -F.array_max(F.transform(parts, lambda s, i: F.struct(score(s).alias("n"), (-i).alias("i"))))["i"]


def choice_label(i: Column) -> Column:
    """B for 0, C for 1, ..."""
    return F.char(i + 66)


def choice_index(x: Column | str) -> Column:
    """Index of a one-letter choice, -1 for A, null for anything else."""
    x = _c(x)
    return F.when((F.char_length(x) == 1) & F.rlike(x, F.lit("[A-Z]")), F.ascii(x) - 66)


def rating(x: Column | str) -> Column:
    """The first word as a whole number, or the number of ``[[n]]``; null if neither."""
    x = _c(x)
    return F.coalesce(F.get(F.split(strip(x), r"\s+"), 0).try_cast("int"), F.regexp_extract(x, r"\[\[(\d+)\]\]", 1).try_cast("int"))


def verdict(x: Column | str) -> Column:
    """A, B or C of the last ``[[A]]``, ``[[B]]`` or ``[[C]]``; null without one."""
    return F.try_element_at(F.regexp_extract_all(_c(x), F.lit(r"\[\[([ABC])\]\]"), 1), F.lit(-1))


def cut_at_stops(x: Column | str, stops: Sequence[str]) -> Column:
    """For each stop sequence in turn, the text before its last occurrence."""
    out = _c(x)
    for stop in stops:
        quoted = rf"\Q{stop}\E"
        out = F.regexp_replace(out, rf"(?s){quoted}(?!.*{quoted}).*$", "")
    return out


def says_answer(x: Column | str) -> Column:
    return F.contains(F.lower(_c(x)), F.lit("so the answer is"))


def template(text: str, fields: Mapping[str, Column | str] | None = None, optional: Mapping[str, str] | None = None) -> Column:
    """A string with ``{{ name }}`` filled by columns; nulls are empty. ``optional`` maps a name to text that stands only if the column is not null."""
    fields = dict(fields or {})
    value = lambda name: F.coalesce(_c(fields.get(name, name)).cast("string"), F.lit(""))
    parts = [F.lit(p) if k % 2 == 0 else value(p) for k, p in enumerate(re.split(r"\{\{\s*(\w+)\s*\}\}", text)) if k % 2 or p]
    for name, more in (optional or {}).items():
        parts.append(F.when(_c(fields.get(name, name)).isNotNull(), template(more, fields)).otherwise(""))
    return F.concat(*parts) if parts else F.lit("")


def template_fields(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{\{\s*(\w+)\s*\}\}", text)))
