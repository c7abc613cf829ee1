"""A corpus through five stages: quality, language, repeated lines, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm import language_id, line_dedup, ngram_join, packing, quality
from ragloom.llm.scratch import Scratch, if_small
from ragloom.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_LANGUAGE_SCORE = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn_from = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    scored = quality.scores(docs.select(*COLUMNS), quality.train(docs, labels, learn_from=learn_from), out="_score")
    return scored.filter(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and is sure of; a null lang becomes the predicted one."""
    ship(spark)
    learn_from = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    told = language_id.languages(docs.select(*COLUMNS), language_id.train(docs, learn_from=learn_from), out=("_lang", "_score"))
    sure = told.filter((F.col("_lang") != language_id.UNKNOWN) & (F.col("_score") >= LEAST_LANGUAGE_SCORE))
    return sure.withColumn("lang", F.coalesce("lang", "_lang")).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier line; n_chars is counted anew."""
    ship(spark)
    return line_dedup.deduplicated(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles at a similarity of 0.8, the one with the least id; one of rows with equal id and text.

    Texts that share an id and are not linked all stay, as do rows without an id and texts without words.
    """
    ship(spark)
    docs = docs.select(*COLUMNS).withColumn("key", ngram_join.text_key())
    marks = ngram_join.redundant(docs, shingle=5, similarity=(8, 10))
    known, out = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    out = out.unionByName(known.join(if_small(marks.select("doc_id", "key")), ["doc_id", "key"], "left_anti").select(*docs.columns))
    if marks.filter("stays").limit(1).count():
        nth = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("source", "lang", "n_chars"))
        repeated = known.join(marks.filter("stays").select("doc_id", "key"), ["doc_id", "key"], "left_semi")
        out = out.unionByName(repeated.withColumn("nth", nth).filter("nth = 1").select(*docs.columns))
    return out.select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of the permitted lengths."""
    ship(spark)
    return packing.packed_texts(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("packing", packed),
]

#: The first two stages are fitted models, so SQL can't express the rows; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents table, each written and read again; a stage's table goes when the next one is written."""
    scratch = Scratch(ship(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
            if k:
                scratch.drop(before)
    return docs
