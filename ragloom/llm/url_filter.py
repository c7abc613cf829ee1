"""URL filter: rules first, then a character language-model ratio. DataFrame functions only.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give each
character a probability from the contexts of 0 to ``ORDER`` characters before it: a context's own
relative frequency, mixed with the next shorter context's probability by ``STRENGTH`` pseudo-counts,
down to a uniform one. A URL's score is the mean over its characters of the log-probability under
the accepted model less that under the rejected one, so length does not count. URLs that score below
a threshold are rejected; the threshold is calibrated on labelled URLs that the models did not see.

Counts are exact: a written table has each n-gram of ORDER + 1 characters of the URLs, with its counts in
both classes, and grows with the input; the counts of shorter n-grams and of contexts are sums of its rows.
All that a URL's character adds to its score depends on its n-gram, so URLs' n-grams are joined to a table
of these terms. N-grams with more than one in ``HOT`` of all characters are dealt to ``SALTS`` parts.
Examples are labelled URLs that the caller gives, or else what the rules make of the URLs with a host: blocked ones are
rejected examples, allowed ones and those that pass every rule accepted. Every labelled URL is counted, those whose hash is 0 modulo 5 for the calibration and
the others for the models. The models see the whole URL, its scheme, query and fragment included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.scratch import Scratch

ORDER, STRENGTH, ALPHABET = 3, 4.0, 64.0
HOT, SALTS = 100, 64
BINS, SPAN = 400, 4.0
#: (verdict, host, path): the host and its subdomains, paths that start so.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, path up to ``?`` or ``#``; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host and path together) that fits, else nulls. Of equally long ones the first stated wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, r_host, r_path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == r_host) | F.endswith(host, F.lit("." + r_host))) & F.startswith(path, F.lit(r_path))
        rule, verdict = F.when(fits, r_host + r_path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _grams(text: Column) -> Column:
    """For each character of a text and its end mark: the ORDER characters before it, with pad marks at the start, and itself."""
    chars = F.concat(F.array_repeat(F.lit("^"), ORDER), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit("\n")))
    # one lambda argument, so that a text is cut up once
    windows = lambda c: F.transform(F.sequence(F.lit(ORDER), F.size(c) - 1), lambda i: F.concat(*(F.get(c, i - k) for k in reversed(range(ORDER + 1)))))
    return F.get(F.transform(F.array(chars), windows), 0)


def _model(urls: DataFrame) -> DataFrame:
    """(gram, n, term) of each n-gram of ORDER + 1 characters of the keys: how often it is there and the log of its last character's probability under the accepted model less that under the rejected one.

    urls has (key, good, held); models count the rows where good is not null and held is false.
    """
    learnt = ~F.coalesce("held", F.lit(True))
    spots = urls.select((learnt & F.col("good")).alias("a"), (learnt & ~F.col("good")).alias("b"), F.explode(_grams(F.col("key"))).alias("gram"))
    grams = Scratch(urls.sparkSession).save(spots.groupBy("gram").agg(F.count("*").alias("n"), F.count_if("a").alias("g1"), F.count_if("b").alias("g0")))
    # counts of the last n characters, for n from ORDER + 1 down
    counts = {ORDER + 1: grams.select("gram", "g1", "g0")}
    for n in range(ORDER, 0, -1):
        counts[n] = counts[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.sum("g1").alias("g1"), F.sum("g0").alias("g0"))
    table = counts[1].crossJoin(F.broadcast(counts[1].agg(F.sum("g1").alias("c1"), F.sum("g0").alias("c0"))))
    for n in range(1, ORDER + 2):
        if n > 1:
            context = counts[n].groupBy(F.substring("gram", 1, n - 1).alias("context")).agg(F.sum("g1").alias("c1"), F.sum("g0").alias("c0"))
            shorter = table.select(F.col("gram").alias("suffix"), "p1", "p0")
            table = counts[n].withColumn("context", F.substring("gram", 1, n - 1)).withColumn("suffix", F.substring("gram", 2, n - 1)).join(context, "context").join(shorter, "suffix")
        p1, p0 = (F.col(f"p{k}") if n > 1 else F.lit(1.0 / ALPHABET) for k in (1, 0))
        table = table.select("gram", *(((F.col(f"g{k}") + p * STRENGTH) / (F.col(f"c{k}") + STRENGTH)).alias(f"p{k}") for k, p in ((1, p1), (0, p0))))
    return grams.select("gram", "n").join(table.select("gram", F.log(F.col("p1") / F.col("p0")).alias("term")), "gram")


def _scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(row, score) of urls (row, key): the mean term over the characters of ``key``, its end included. row names a row of the table."""
    # more than one in HOT each, so there are fewer than HOT of them
    hot = model.crossJoin(F.broadcast(model.agg(F.sum("n").alias("total")))).filter(F.col("n") * HOT > F.col("total")).select("gram", F.lit(SALTS).alias("salts"))
    terms = model.select("gram", "term").join(F.broadcast(hot), "gram", "left").select("gram", "term", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    spots = urls.select("row", F.posexplode(_grams(F.col("key"))).alias("at", "gram")).join(F.broadcast(hot), "gram", "left")
    salted = spots.select("row", "gram", F.coalesce(F.pmod(F.col("row") + F.col("at"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))
    return salted.join(terms, ["gram", "salt"]).groupBy("row").agg(F.avg("term").alias("score"))


def examples(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(_id, mine, key, host, path, rule, ruled, good, held): the URLs to judge (mine) with what the rules say, and the examples, where good tells their label and held whether they calibrate.

    labelled has (url, good); those rows are then the only examples. Without it URLs with a host are, those that no rule blocks as good ones. A null url has an empty key.
    """
    parts = ["_id", "mine", "key", "good"]
    urls = pages.select(F.col(id_col).alias("_id"), F.lit(True).alias("mine"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("key"), F.lit(None).cast("boolean").alias("good"))
    if labelled is not None:
        more = labelled.filter("url is not null").select(F.lit(False).alias("mine"), F.col("url").cast("string").alias("key"), F.col("good").cast("boolean").alias("good"))
        urls = urls.unionByName(more, allowMissingColumns=True).select(parts)
    host, path = host_and_path(F.col("key"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    told = urls.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        told = told.withColumn("good", F.when(F.col("host") != "", F.coalesce("ruled", F.lit("allow")) == "allow"))
    return told.withColumn("held", F.when(F.col("good").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(5)) == 0))


def threshold(scored: DataFrame) -> DataFrame:
    """One row ``cut``: of the bin edges on scored (good, score) rows, the one with the least sum of the share of good rows below and the share of bad rows not below.

    Of equally good edges the lowest counts, which rejects least. Without rows of both classes it is minus infinity.
    """
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) * BINS / (2 * SPAN)))).cast("int")
    seen = scored.select("good", at.alias("bin")).groupBy("bin").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    hist = seen.groupBy().agg(F.collect_list(F.struct("bin", "g", "b")).alias("bins"), F.sum("g").alias("g"), F.sum("b").alias("b"))
    below = lambda field, edge: F.aggregate(F.filter("bins", lambda x: x["bin"] < edge), F.lit(0).cast("bigint"), lambda a, x: a + x[field])
    loss = F.transform(F.sequence(F.lit(0), F.lit(BINS)), lambda e: F.round(below("g", e) / F.col("g") + 1 - below("b", e) / F.col("b"), 9))
    best = hist.filter("g > 0 and b > 0").select(loss.alias("loss")).select((F.array_position("loss", F.array_min("loss")) - 1).alias("edge"))
    return best.select((F.col("edge") * (2.0 * SPAN / BINS) - SPAN).alias("cut")).groupBy().agg(F.coalesce(F.max("cut"), F.lit(float("-inf"))).alias("cut"))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score, model_verdict) of every row; verdict is allow or block: the longest fitting rule's, else the models' (model_verdict).

    A null or empty url is allowed, with a null score. One without ``://`` has empty host and path and no rule, and is scored
    like any other. Repeated rows are judged alike. Without examples of both classes the models block nothing.
    labelled (url, good) replaces the rules' own verdicts as examples.
    """
    scratch = Scratch(pages.sparkSession)
    rows = scratch.save(examples(pages, id_col, url_col, rules, labelled).withColumn("row", F.monotonically_increasing_id()))
    model = scratch.save(_model(rows))
    scored = scratch.save(_scored(rows, model))
    cut = scratch.save(threshold(rows.filter("held").join(scored, "row").select("good", "score")))
    score = F.when(F.col("key") != "", F.col("score"))
    out = rows.filter("mine").join(scored, "row", "left").withColumn("score", score)
    by_model = F.when(F.coalesce(F.col("score") < cut.scalar(), F.lit(False)), "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score", by_model.alias("model_verdict"))
