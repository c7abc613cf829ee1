"""Context building: the texts of a query joined in rank order, within limits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from inspect import signature

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ragloom.functions.text import once
from ragloom.operators.columns import require_columns


def ordered(fields: Sequence[str], by: Sequence[Column]) -> Column:
    """Aggregate: an array of structs of ``fields`` in the order of ``by``."""
    keys = [c.alias(f"_k{i}") for i, c in enumerate(by)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, F.struct(*fields).alias("_v")))), lambda x: x["_v"])


def first_rows(df: DataFrame, group: str, by: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each partition before the shuffle."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(*by))).filter(F.col("_nth") <= k).drop("_nth")


def cap_for(sizes: Column, max_length: int, cap: int, step: int, separator: int = 1) -> Column:
    """The first of cap, cap - step, ... 0 at which pieces cut to it fit into max_length, separators counted; 0 if none does."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(-(-cap // step))), lambda i: F.greatest(F.lit(cap) - i * step, F.lit(0)))
    fits = lambda c: F.aggregate(sizes, F.lit(0), lambda a, x: a + F.least(x, c)) + (F.size(sizes) - 1) * separator <= max_length
    return F.coalesce(F.try_element_at(F.filter(tries, fits), F.lit(1)), F.lit(0))


def concat(pieces: Column | str, max_elements: int = -1, max_length: int = -1, max_per_context: int = 512, truncation_rate: int = 50, tokenizer: str | Callable | None = None, joiner: str = "\n") -> Column:
    """Pieces (array<string>) joined: the first max_elements; with a tokenizer each cut to one length at which all fit.

    ``chars`` and ``words`` are counted by Spark; a function from text to tokens that can be joined by ``""`` runs in
    Arrow batches. Without a tokenizer max_length does nothing. Where no length fits, pieces are empty.
    """
    pieces = F.col(pieces) if isinstance(pieces, str) else pieces
    if max_elements > 0:
        pieces = F.slice(pieces, 1, max_elements)
    if tokenizer is None or max_length <= 0:
        return F.array_join(pieces, joiner)
    if tokenizer == "chars":
        cap = once(lambda sizes: cap_for(sizes, max_length, max_per_context, truncation_rate), F.transform(pieces, F.char_length))
        return once(lambda ps, c: F.array_join(F.transform(ps, lambda p: F.substring(p, F.lit(1), c)), joiner), pieces, cap)
    if tokenizer == "words":
        parts = F.transform(pieces, lambda p: F.filter(F.split(p, r"\s+"), lambda w: w != ""))
        cap = once(lambda sizes: cap_for(sizes, max_length, max_per_context, truncation_rate, 0), F.transform(parts, F.size))
        return once(lambda ps, c: F.array_join(F.transform(ps, lambda p: F.array_join(F.slice(p, F.lit(1), c), " ")), joiner), parts, cap)

    @F.pandas_udf("string")
    def by_tokens(column: pd.Series) -> pd.Series:
        def one(texts):
            if texts is None:
                return None
            tokens, cap = [list(tokenizer(t)) for t in texts], max_per_context
            while cap > 0 and len(tokenizer(joiner.join("".join(t[:cap]) for t in tokens))) > max_length:
                cap -= truncation_rate
            return joiner.join("".join(t[: max(cap, 0)]) for t in tokens)

        return column.map(one)

    return by_tokens(pieces)


def format_item(item: Column, kind: DataType, formatter: Callable[..., Column] | None = None) -> Column:
    """An item as text. A formatter takes a struct's fields by name, an array's elements in order (as many as it has parameters), or the item; without one a struct is its ``text`` or empty, anything else its string."""
    if formatter is None:
        if isinstance(kind, StructType):
            return F.coalesce(item["text"].cast("string"), F.lit("")) if "text" in kind.names else F.lit("")
        return item.cast("string")
    if isinstance(kind, StructType):
        return formatter(**{f.name: item[f.name] for f in kind.fields})
    if isinstance(kind, ArrayType):
        return formatter(*(F.get(item, F.lit(k)) for k in range(len(signature(formatter).parameters))))
    return formatter(item)


def concat_items(df: DataFrame, field: str, out: str, formatter: Callable[..., Column] | None = None, **limits) -> DataFrame:
    """df with ``out``, the items of an array column formatted by ``format_item`` and joined by ``concat``."""
    kind = df.schema[field].dataType.elementType
    return df.withColumn(out, concat(F.transform(field, lambda x: format_item(x, kind, formatter).cast("string")), **limits))


def concatenator(
    results: DataFrame, in_fields: Sequence[str] = ("text",), out_field: str = "qcontext", formatter: Callable[..., Column] | None = None, documents: DataFrame | None = None,
    ordering: Sequence[Column] | None = None, aggregate: Callable[[Column], Column] | None = None, **limits,
) -> DataFrame:
    """(qcontext, qid, query): one row a query, its rows' fields formatted and joined by score, then document.

    ``documents`` (docno, fields) supplies fields that the rows lack. ``formatter`` takes the fields as columns; without one they are
    joined by a space. ``aggregate`` takes the array of formatted texts in place of ``concat``.
    """
    if missing := [f for f in in_fields if f not in results.columns]:
        if documents is None:
            raise ValueError(f"missing columns {missing}")
        results = results.join(documents.select("docno", *missing), "docno", "left")
    require_columns(results, "qid", "query")
    by = list(ordering or [*([-F.col("score")] if "score" in results.columns else []), *([F.col("docno")] if "docno" in results.columns else [])])
    text = formatter(*map(F.col, in_fields)) if formatter else F.concat_ws(" ", *in_fields)
    # equal keys go by text, so that the order is total
    results = results.withColumn("_text", F.coalesce(text, F.lit("")))
    if aggregate is None and limits.get("max_elements", -1) > 0:
        results = first_rows(results, "qid", [*by, F.col("_text")], limits["max_elements"])
    groups = results.groupBy("qid").agg(F.min("query").alias("query"), ordered(["_text"], [*by, F.col("_text")]).alias("_p"))
    pieces = F.transform("_p", lambda x: x["_text"])
    return groups.select((aggregate(pieces) if aggregate else concat(pieces, **limits)).alias(out_field), "qid", "query")


def frame_concat(df: DataFrame, fields: Sequence[str] = ("text",), by_query: bool = False, order: Sequence[Column] = (), truncation_rate: int = 25, **limits) -> DataFrame:
    """One row of all rows' texts (qcontext), or one for each qid with its query; rows without ``order`` are in the frame's.

    Of a whole frame under a limit only what is inside it meets in one task: the first max_elements rows, and of a limit of ``chars`` or ``words`` the pieces cut
    to the length at which all fit, which the sums of the rows' sizes tell. Without a limit, or with a tokenizer of one's own, all texts meet.
    """
    df = df.withColumn("_text", F.concat_ws(" ", *fields))
    by = [*order, F.col("_text")] if order else [F.monotonically_increasing_id()]
    if not by_query and limits.get("max_elements", -1) > 0:
        df = df.withColumns({f"_o{i}": c for i, c in enumerate(by)})
        by = [F.col(f"_o{i}") for i in range(len(by))]
        df = df.orderBy(*by).limit(limits.pop("max_elements"))
    if not by_query and limits.get("tokenizer") in ("chars", "words") and limits.get("max_length", -1) > 0:
        return _fitted(df, by, truncation_rate, **limits)
    agg = [ordered(["_text"], by).alias("_p")]
    groups = df.groupBy("qid").agg(F.min("query").alias("query"), *agg) if by_query else df.groupBy().agg(*agg)
    return groups.select(*(["qid", "query"] if by_query else []), concat(F.transform("_p", lambda x: x["_text"]), truncation_rate=truncation_rate, **limits).alias("qcontext"))


def _fitted(df: DataFrame, by: Sequence[Column], step: int, tokenizer: str, max_length: int, max_per_context: int = 512, joiner: str = "\n") -> DataFrame:
    """``concat`` of a whole frame: the cap is the first at which the sum of the sizes cut to it fits, from one row of sums."""
    words = F.filter(F.split("_text", r"\s+"), lambda w: w != "")
    size, separator = (F.char_length("_text"), 1) if tokenizer == "chars" else (F.size(words), 0)
    tries = list(range(max_per_context, 0, -step))
    sums = df.agg(F.count("*").alias("n"), *(F.sum(F.least(size, F.lit(c)).cast("bigint")).alias(f"c{c}") for c in tries))
    cap = F.coalesce(*(F.when(F.col(f"c{c}") + (F.col("n") - 1) * separator <= max_length, c) for c in tries), F.lit(0))
    fits = sums.select("n", cap.alias("cap"))
    cut = F.substring("_text", F.lit(1), F.col("cap")) if tokenizer == "chars" else F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("cap"), F.lit(1))), " ")
    kept = df.withColumns({f"_b{i}": c for i, c in enumerate(by)}).crossJoin(F.broadcast(fits)).filter("cap > 0").withColumn("_text", cut)
    text = kept.groupBy().agg(F.array_join(F.transform(ordered(["_text"], [F.col(f"_b{i}") for i in range(len(by))]), lambda x: x["_text"]), joiner).alias("_t"))
    # where no length fits, all pieces are empty
    bare = F.repeat(F.lit(joiner), F.greatest(F.col("n") - 1, F.lit(0)).cast("int"))
    return text.crossJoin(F.broadcast(fits)).select(F.when(F.col("cap") > 0, F.col("_t")).otherwise(bare).alias("qcontext"))


# Renderers of a retrieved document; i is its place from 1.
def render_doc(i: Column, title: Column, text: Column) -> Column:
    return F.concat(F.lit("Doc "), i.cast("string"), F.lit("(Title: "), F.coalesce(title, F.lit("")), F.lit(") "), F.coalesce(text, F.lit("")), F.lit("\n"))


def render_numbered(i: Column, title: Column, text: Column) -> Column:
    return F.concat(F.lit("("), i.cast("string"), F.lit(")"), F.coalesce(text, F.lit("")), F.lit("\n"))


def render_block(i: Column, title: Column, text: Column) -> Column:
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nText: "), F.coalesce(text, F.lit("")), F.lit("\n\n"))


def render_plain(df: DataFrame) -> Column:
    """The first of text, body, raw, contents, title that df has and is not null, else the identifying columns."""
    found = [F.col(c) for c in ("text", "body", "raw", "contents", "title") if c in df.columns]
    rest = F.concat_ws(" | ", *(F.col(c).cast("string") for c in ("docno", "docid", "rank", "score") if c in df.columns))
    return F.coalesce(*found, rest)


def rendered(results: DataFrame, renderer: Callable[[Column, Column, Column], Column], out: str = "docs") -> DataFrame:
    """(qid, docs): each query's documents in rank order, rendered and joined."""
    title = F.col("title") if "title" in results.columns else F.lit(None).cast("string")
    rows = results.withColumn("_title", title).groupBy("qid").agg(ordered(["_title", "text"], [F.col("rank"), F.col("docno")]).alias("_p"))
    return rows.select("qid", F.array_join(F.transform("_p", lambda x, i: renderer(i + 1, x["_title"], x["text"])), "").alias(out))
