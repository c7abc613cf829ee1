"""Datasets of questions, gold answers and corpora, read with stated schemas."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ragloom.sources.archives import archive_lines, archive_texts

#: A line up to this number, from 0, must be JSON; later ones that are not are left out.
EARLY = 10

ARCHIVE_SUFFIX = r"\.(tar|tar\.gz|tgz|tar\.bz2|tbz2|tar\.xz|zip)$"


class RAGDataset(Protocol):
    def topics(self, variant: str) -> DataFrame: ...
    def answers(self, variant: str) -> DataFrame: ...
    def corpus(self) -> DataFrame: ...


def _by_archive(paths: str | list[str]) -> tuple[list[str], dict[str, list[str]]]:
    """Plain paths, and the members by archive of those that are ``archive#member``."""
    plain, packed = [], {}
    for p in [paths] if isinstance(paths, str) else paths:
        archive, _, member = p.partition("#")
        if member:
            packed.setdefault(archive, []).append(member)
        else:
            plain.append(p)
    return plain, packed


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines (file, part, nth, value) of files and members of archives, and (file, part, first): a line's number in its file, from 0, is first + nth.

    A file's splits are its parts. They are counted by split, and a split begins where the lines of the splits before it end.
    """
    plain, packed = _by_archive(paths)
    lines = None
    if plain:
        rows = spark.read.text(plain).withColumns({"_file": F.col("_metadata.file_path"), "_part": F.col("_metadata.file_block_start"), "_nth": F.monotonically_increasing_id()})
        lines = rows.select(F.col("_file").alias("file"), F.col("_part").alias("part"), F.col("_nth").alias("nth"), "value")
    for archive, names in packed.items():
        rows = archive_lines(spark, archive, names).select(F.concat_ws("#", "archive", "member").alias("file"), F.lit(0).cast("bigint").alias("part"), F.col("no").alias("nth"), "value")
        lines = rows if lines is None else lines.unionByName(rows)
    parts = lines.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("nth").alias("least"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return lines, parts.select("file", "part", (F.coalesce(before, F.lit(0)) - F.col("least")).alias("first"))


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return lines.filter(F.trim("value") != "").select("file", "part", "nth", F.from_json("value", schema + ", _bad string", options).alias("_r")).select("file", "part", "nth", "_r.*")


def malformed_lines(spark: SparkSession, paths: str | list[str], schema: str = "id string") -> DataFrame:
    """(file, no, value) of the lines that are no JSON object, numbered from 0; blank lines count as lines and are left out."""
    lines, parts = numbered_lines(spark, paths)
    bad = _parsed(lines, schema).filter(F.col("_bad").isNotNull())
    return bad.join(parts, ["file", "part"]).select("file", (F.col("first") + F.col("nth")).alias("no"), F.col("_bad").alias("value"))


def _json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines of files (also .gz and .bz2) and members of archives (``archive#member``). A line that is no JSON object is an error up to number ``EARLY`` of its file, which is then hardly of this kind; later ones are left out, and listed by ``malformed_lines``."""
    early = malformed_lines(spark, path, schema).filter(F.col("no") <= EARLY).agg(F.count("*").alias("n")).scalar()
    rows = _parsed(numbered_lines(spark, path)[0], schema)
    return rows.filter(F.col("_bad").isNull() & F.assert_true(early == 0, F.lit(f"a malformed line among the first {EARLY + 1} of a file")).isNull()).drop("_bad", "file", "part", "nth")


def _json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Objects of files and members of archives that are one JSON array each."""
    plain, packed = _by_archive(path)
    parts = [spark.read.schema(schema).option("multiLine", True).json(plain)] if plain else []
    parts += [archive_texts(spark, a, names).select(F.inline(F.from_json("value", f"array<struct<{schema}>>"))) for a, names in packed.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) from lines {id, question}."""
    return _json(spark, path, "id string, question string").select(F.col("id").alias("qid"), F.col("question").alias("query"))


def read_answers(spark: SparkSession, path: str, explode: bool = True) -> DataFrame:
    """(qid, gold_answer), one row an answer, an empty list being one null; or arrays."""
    rows = _json(spark, path, "id string, golden_answers array<string>")
    return rows.select(F.col("id").alias("qid"), (F.explode_outer("golden_answers") if explode else F.col("golden_answers")).alias("gold_answer"))


def read_wiki_passages(spark: SparkSession, path: str) -> DataFrame:
    """(docno, title, text, contents) from lines {id, contents}, cut at the first line feed."""
    at = F.instr("contents", "\n")
    title = F.when(at > 0, F.substring_index("contents", "\n", 1)).otherwise(F.col("contents"))
    return _json(spark, path, "id string, contents string").select(F.col("id").alias("docno"), title.alias("title"), F.when(at > 0, F.substring("contents", at + 1, F.char_length("contents"))).otherwise("").alias("text"), "contents")


def read_wiki_abstracts(spark: SparkSession, path: str) -> DataFrame:
    """(docno, title, text) from lines with an array of sentences; other fields are not read."""
    return _json(spark, path, "id string, title string, text array<string>").select(F.col("id").alias("docno"), "title", F.array_join("text", " ").alias("text"))


def read_reading_topics(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, docno, title, text) from a JSON array of questions whose context is a list of [title, [sentences]]."""
    rows = _json_array(spark, path, "_id string, question string, context string")
    items = F.posexplode(F.from_json("context", "array<string>")).alias("_at", "_item")
    rows = rows.select(F.col("_id").alias("qid"), F.col("question").alias("query"), items)
    pair = F.parse_json("_item")
    return rows.select("qid", "query", F.format_string("%s_%02d", "qid", "_at").alias("docno"), F.variant_get(pair, "$[0]", "string").alias("title"), F.array_join(F.variant_get(pair, "$[1]", "array<string>"), " ").alias("text"))


def read_reading_answers(spark: SparkSession, path: str) -> DataFrame:
    """(qid, type, gold_answer)."""
    return _json_array(spark, path, "_id string, type string, answer string").select(F.col("_id").alias("qid"), "type", F.col("answer").alias("gold_answer"))


def members(archive: str, names: Iterable[str]) -> dict[str, str]:
    """The spec ``archive#member`` of each member of an archive, by name; empty names and repeats are left out."""
    return {n: f"{archive}#{n}" for n in map(str.strip, names) if n}


def members_listed(spark: SparkSession, path: str, archive: str) -> dict[str, str]:
    """``members`` of a text file with a name a line, in any store that Spark reads. The driver holds the names, so the list must fit there."""
    return members(archive, (r["value"] for r in spark.read.text(path).toLocalIterator()))


def _local_name(archive: str) -> str:
    """Of an address the last part."""
    return archive.split("?", 1)[0].rstrip("/").rsplit("/", 1)[-1] if "://" in archive else archive


def unpacked(spec: str) -> str:
    """Where a spec's file is if archives are unpacked: a member is in a folder of the archive's name without its suffix; of an address the last part counts."""
    archive, _, member = spec.partition("#")
    archive = _local_name(archive)
    return f"{re.sub(ARCHIVE_SUFFIX, '', archive)}/{member}" if member else archive


def located(spark: SparkSession, root: str, spec: str) -> str:
    """The path of a spec under a root, in any store that Spark reads: ``archive#member`` if the archive is there, else the unpacked file."""
    archive, _, member = spec.partition("#")
    whole = f"{root}/{_local_name(archive)}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(whole)
    if member and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return f"{whole}#{member}"
    return f"{root}/{unpacked(spec)}"


@dataclass
class FileDataset:
    """Files by kind and variant under a root; the corpus may be another dataset's, by name. A file may be given as ``archive#member`` or by an address; archives are read where they are, or from where they were unpacked to."""

    spark: SparkSession
    root: str
    files: dict[str, dict[str, str]]
    topics_reader: Callable[[SparkSession, str], DataFrame] = read_topics
    answers_reader: Callable[[SparkSession, str], DataFrame] = read_answers
    corpus_reader: Callable[[SparkSession, str], DataFrame] = read_wiki_passages
    corpus_name: str | None = None

    def _path(self, kind: str, variant: str | None) -> str:
        if variant not in self.files.get(kind, {}):
            raise ValueError(f"{kind} have no variant {variant!r}; there are {sorted(self.files.get(kind, {}))}")
        return located(self.spark, self.root, self.files[kind][variant])

    def topics(self, variant: str | None = None) -> DataFrame:
        return self.topics_reader(self.spark, self._path("topics", variant))

    def answers(self, variant: str | None = None) -> DataFrame:
        return self.answers_reader(self.spark, self._path("answers", variant))

    def corpus(self) -> DataFrame:
        if "corpus" in self.files:
            paths = [located(self.spark, self.root, f) for f in self.files["corpus"].values()]
            return self.corpus_reader(self.spark, paths if len(paths) > 1 else paths[0])
        if self.corpus_name is None:
            raise NotImplementedError("this dataset names no corpus")
        return get_dataset(self.corpus_name).corpus()


@dataclass
class TableDataset:
    """Topics, answers and corpus as DataFrames or qrels."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def topics(self, variant: str | None = None) -> DataFrame:
        return self.tables["topics"]

    def answers(self, variant: str | None = None) -> DataFrame:
        return self.tables["answers"]

    def corpus(self) -> DataFrame:
        return self.tables["corpus"]


_SPLITS = {k: {v: f"{v}.jsonl" for v in ("train", "dev", "test")} for k in ("topics", "answers")}


def question_files(spark: SparkSession, root: str, corpus_name: str | None = None) -> FileDataset:
    """A folder with train.jsonl, dev.jsonl and test.jsonl of {id, question, golden_answers}."""
    return FileDataset(spark, root, _SPLITS, corpus_name=corpus_name)


def reading_files(spark: SparkSession, root: str) -> FileDataset:
    """A folder with train.json, dev.json and test.json; test has no answers."""
    names = {"topics": {v: f"{v}.json" for v in ("train", "dev", "test")}, "answers": {v: f"{v}.json" for v in ("train", "dev")}}
    return FileDataset(spark, root, names, read_reading_topics, read_reading_answers)


def answers_of_qrels(qrels: DataFrame, documents: DataFrame, least: int = 1) -> DataFrame:
    """(qid, gold_answer) from relevance rows (qid, docno, label): the texts of documents of label ``least`` or more."""
    return qrels.filter(F.col("label") >= least).join(documents.select("docno", F.col("text").alias("gold_answer")), "docno").select("qid", "gold_answer")


# Names of question sets, and of the corpus that some of them use.
QUESTION_SETS = {"nq": "nq_wiki", "hotpotqa": "hotpotqa_wiki", "triviaqa": None, "musique": None, "web_questions": None, "wow": None, "popqa": None}
CORPORA = {"nq_wiki": read_wiki_passages, "hotpotqa_wiki": read_wiki_abstracts}
READING_SETS = ("2wikimultihopqa",)


def known_datasets(spark: SparkSession, root: str) -> list[str]:
    """Register the known names, each a folder of that name under ``root`` in any store that Spark reads; nothing is downloaded. Returns the names."""
    for name, corpus in QUESTION_SETS.items():
        register_dataset(name, lambda name=name, corpus=corpus: question_files(spark, f"{root}/{name}", corpus))
    for name, reader in CORPORA.items():
        register_dataset(name, lambda name=name, reader=reader: FileDataset(spark, f"{root}/{name}", {"corpus": {"all": "corpus.jsonl*"}}, corpus_reader=reader))
    for name in READING_SETS:
        register_dataset(name, lambda name=name: reading_files(spark, f"{root}/{name}"))
    return [*QUESTION_SETS, *CORPORA, *READING_SETS]


_catalog: dict[str, Callable[[], RAGDataset]] = {}


def register_dataset(name: str, make: Callable[[], RAGDataset]) -> None:
    _catalog[name] = make


def get_dataset(name: str) -> RAGDataset:
    if name not in _catalog:
        raise KeyError(f"no dataset {name!r}; there are {list_datasets()}")
    return _catalog[name]()


def list_datasets() -> list[str]:
    return sorted(_catalog)


class QuestionSource(DataSource):
    """``spark.read.format("rag_questions").load(path)``: (qid, query, gold_answer) of a folder's *.jsonl. Register it with ``spark.dataSource.register``.

    The folder is in any store that Arrow opens by its address (files, hdfs, s3, gs). Files are read in ranges of ``range_bytes`` (64 MB), a partition each.
    With option ``push_filters`` (which needs the session's spark.sql.python.filterPushdown.enabled), filters that a qid equals or is one of some values leave rows out as they are read. Option ``bad_lines`` says what a line is that is no JSON object with an id:
    ``fail`` (an error, the default) or ``skip``. Blank lines are left out.
    """

    @classmethod
    def name(cls):
        return "rag_questions"

    def schema(self):
        return "qid string, query string, gold_answer array<string>"

    def reader(self, schema):
        reader = _FilteringReader if self.options.get("push_filters", "false") == "true" else _QuestionReader
        return reader(self.options["path"], int(self.options.get("range_bytes", 1 << 26)), self.options.get("bad_lines", "fail"))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__(path)
        self.path, self.start, self.stop = path, start, stop


def _store(path: str):
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


class _QuestionReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, bad_lines: str):
        if bad_lines not in ("fail", "skip"):
            raise ValueError(f"bad_lines is {bad_lines!r}")
        self.path, self.range_bytes, self.bad_lines, self.qids = path, max(1, range_bytes), bad_lines, None

    def partitions(self):
        from pyarrow import fs

        store, path = _store(self.path)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith(".jsonl"))
        return [_Range(p, at, min(at + self.range_bytes, size)) for p, size in found for at in range(0, size, self.range_bytes)]

    def read(self, partition):
        import io
        import json

        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as file, io.BufferedReader(file, 1 << 16) as raw:
            # a line belongs to the range that it starts in
            at = max(0, partition.start - 1)
            raw.seek(at)
            if partition.start:
                at += len(raw.readline())
            while at < partition.stop and (line := raw.readline()):
                at += len(line)
                if not line.strip():
                    continue
                try:
                    r = json.loads(line.decode("utf-8", "replace"))
                    row = r["id"], r.get("question"), r.get("golden_answers")
                except (ValueError, TypeError, KeyError, AttributeError) as e:
                    if self.bad_lines == "fail":
                        raise ValueError(f"{partition.path}: no JSON object with an id before byte {at}") from e
                    continue
                if self.qids is None or row[0] in self.qids:
                    yield row


class _FilteringReader(_QuestionReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("qid",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.qids = values if self.qids is None else self.qids & values
            else:
                yield f
