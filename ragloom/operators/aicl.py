"""Adaptive context: labels, features, a classifier for each k, and the cut-off it predicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.operators.context import first_rows, ordered
from ragloom.plans.pipeline import ranked


def labels(results: DataFrame, answers: DataFrame, k_max: int = 20, answer_col: str = "gold_answer") -> DataFrame:
    """(qid, labels array<int>): label k is 1 if one of the gold answers, lower-cased, is in the joined lower-cased texts of the k best rows.

    Answers are one row each or arrays. The array is as long as there are rows, k_max at most; a missing text is empty.
    """
    gold = answers if dict(answers.dtypes)[answer_col].startswith("array") else answers.groupBy("qid").agg(F.collect_list(answer_col).alias(answer_col))
    gold = gold.select("qid", F.transform(answer_col, F.lower).alias("_gold"))
    by = [-F.col("score"), F.col("docno"), F.col("_t")]
    rows = first_rows(results.withColumn("_t", F.lower(F.coalesce("text", F.lit("")))), "qid", by, k_max).groupBy("qid").agg(ordered(["_t"], by).alias("_p"))
    rows = rows.join(gold, "qid", "left").withColumn("_texts", F.transform("_p", lambda x: x["_t"])).withColumn("_joined", F.array_join("_texts", " "))
    # the joined texts of k rows begin those of all rows, so an answer is in them if its first place in all ends within their length
    ends = F.transform(F.filter("_gold", lambda g: F.contains("_joined", g)), lambda g: F.instr(F.col("_joined"), g) + F.char_length(g) - 1)
    lengths = F.aggregate("_texts", F.array().cast("array<int>"), lambda a, t: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + 1, F.lit(0)) + F.char_length(t))))
    rows = rows.select("qid", F.array_min(ends).alias("_end"), lengths.alias("_lengths"))
    hits = F.transform("_lengths", lambda n: F.coalesce(n >= F.col("_end"), F.lit(False)).cast("int"))
    return rows.select("qid", hits.alias("labels"))


def answer_rate(labelled: DataFrame) -> DataFrame:
    """(k, rate): the share of queries of which one of the k best rows has an answer, over the queries with k rows or more; k from 1."""
    return labelled.select(F.posexplode("labels").alias("k", "label")).groupBy((F.col("k") + 1).alias("k")).agg(F.avg("label").alias("rate"))


def features(results: DataFrame, k_max: int = 20) -> DataFrame:
    """(qid, features array<double>, n): mean, population deviation, max, min, range, lead of the first score, min(n, k_max), query words, then k_max scores with zeros."""
    rows = results.groupBy("qid").agg(F.min("query").alias("query"), F.sort_array(F.collect_list(F.col("score").cast("double")), asc=False).alias("s"))
    n = F.size("s")
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / n
    deviation = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / n)
    lead = F.when(n > 1, F.get("s", 0) - F.get("s", 1)).otherwise(0.0)
    words = F.size(F.filter(F.split("query", r"(?U)\s+"), lambda w: w != "")).cast("double")
    head = F.array(F.col("mean"), deviation, F.get("s", 0), F.element_at("s", -1), F.get("s", 0) - F.element_at("s", -1), lead, F.least(n, F.lit(k_max)).cast("double"), words)
    return rows.withColumn("mean", mean).select("qid", F.slice(F.concat(head, F.slice("s", 1, k_max), F.array_repeat(F.lit(0.0), k_max)), 1, 8 + k_max).alias("features"), n.alias("n"))


class AICLContextSelector:
    """One logistic regression for each k on standardised features; a query keeps its k best rows, k the largest predicted 1."""

    def __init__(self, k_max: int = 20, fallback_k: int | None = None):
        self.k_max, self.fallback_k, self.models = k_max, fallback_k or k_max, None

    def _standardised(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        means, scales = (F.array(*map(F.lit, v)) for v in (self.means, self.scales))
        centred = F.zip_with("features", means, lambda x, m: x - m)
        return df.withColumn("x", array_to_vector(F.zip_with(centred, scales, lambda x, s: x / s)))

    def fit(self, results: DataFrame, labelled: DataFrame) -> AICLContextSelector:
        from pyspark.ml.classification import LogisticRegression

        f = features(results, self.k_max)
        at = range(8 + self.k_max)
        stats = f.agg(F.count("*").alias("n"), *(F.avg(F.get("features", i)).alias(f"m{i}") for i in at), *(F.stddev_pop(F.get("features", i)).alias(f"s{i}") for i in at)).first()
        self.means, self.scales = [stats[f"m{i}"] for i in at], [stats[f"s{i}"] or 1.0 for i in at]
        data = self._examples(f, labelled, max(1, stats["n"] // 10000)).persist()
        try:
            ones = data.agg(*(F.sum(F.get("labels", k)).alias(f"k{k}") for k in range(self.k_max)), F.count("*").alias("n")).first()
            self.models = []
            for k in range(self.k_max):
                if ones[f"k{k}"] in (0, ones["n"]):
                    self.models.append(int(ones[f"k{k}"] > 0))
                else:
                    lr = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / ones["n"], elasticNetParam=0.0, standardization=False, predictionCol=f"p{k}", probabilityCol="_pr", rawPredictionCol="_raw")
                    self.models.append(lr.fit(data.withColumn("y", F.get("labels", k).cast("double"))))
        finally:
            data.unpersist()
        return self

    def _examples(self, f: DataFrame, labelled: DataFrame, parts: int) -> DataFrame:
        """(x, labels) in ``parts`` partitions. Only these rows are shuffled to them: a coalesce would sort the texts of all queries in as many tasks, which keep every partition's pages to their end."""
        # labels are padded with their last value
        y = labelled.select("qid", F.slice(F.concat("labels", F.array_repeat(F.element_at("labels", -1), self.k_max)), 1, self.k_max).alias("labels"))
        return self._standardised(f).join(y, "qid").select("qid", "x", "labels").repartition(parts, "qid").select("x", "labels")

    def predict_k(self, results: DataFrame) -> DataFrame:
        """(qid, k): at most the number of the query's rows; the fallback where no k is predicted."""
        if self.models is None:
            raise RuntimeError("fit first")
        df = self._standardised(features(results, self.k_max))
        for k, m in enumerate(self.models):
            df = df.withColumn(f"p{k}", F.lit(float(m))) if isinstance(m, int) else m.transform(df).drop("_pr", "_raw")
        best = F.greatest(*(F.when(F.col(f"p{k}") > 0.5, k + 1).otherwise(0) for k in range(self.k_max)), F.lit(0))
        return df.select("qid", F.least(F.when(best > 0, best).otherwise(self.fallback_k), "n").alias("k"))

    def transform(self, results: DataFrame) -> DataFrame:
        rows = results if "rank" in results.columns else ranked(results)
        return rows.join(self.predict_k(results), "qid").filter(F.col("rank") < F.col("k")).drop("k").select(*results.columns)
