import bz2
import gzip
import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from ragloom.sources import archives, datasets


def jsonl(rows):
    return "".join(json.dumps(r) + "\n" for r in rows).encode()


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    """Topics and a corpus, as files and in archives, under a path that only Spark's readers open."""
    root = tmp_path_factory.mktemp("packed")
    rng = random.Random(1)
    files = {
        "qa/dev.jsonl": jsonl({"id": f"q{i}", "question": f"what is {i}?\r\n\x85", "golden_answers": [str(i)]} for i in range(500)),
        "wiki.jsonl": jsonl({"id": f"d{i}", "contents": f"Title {i}\nBody {rng.random()} é" * 9} for i in range(3000)),
        "reading.json": json.dumps([{"_id": "r1", "question": "why", "type": "x", "answer": "so", "context": [["T", ["a.", "b."]], ["U", ["c."]]]}], indent=1).encode(),
        "noise.bin": bytes(rng.randrange(256) for _ in range(200_000)),
        "empty.jsonl": b"",
    }
    nested = {"AA/one.bz2": bz2.compress(jsonl([{"id": "1", "title": "T", "text": ["x", "y"], "charoffset": []}])), "AB/two.bz2": bz2.compress(jsonl([{"id": "2", "title": "U", "text": []}]))}
    for name, data in files.items():
        (root / "plain" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "plain" / name).write_bytes(data)

    def tar(mode, members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode=mode) as t:
            for name, data in members.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    def zipped(stream, method):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            for name, data in files.items():
                if stream:
                    with z.open(name, "w", force_zip64=name.startswith("wiki")) as f:
                        f.write(data)
                else:
                    z.writestr(name, data)
        return out.getvalue()

    class Forward(io.RawIOBase):
        """A file that can't be sought, for which zips have descriptors after their members."""

        def __init__(self):
            self.data = bytearray()

        def writable(self):
            return True

        def write(self, b):
            self.data += b
            return len(b)

    forward = Forward()
    with zipfile.ZipFile(forward, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            with z.open(name, "w", force_zip64=name.startswith("wiki")) as f:
                f.write(data)
    (root / "a.tar.gz").write_bytes(tar("w:gz", files))
    (root / "a.tgz").write_bytes(gzip.compress(tar("w", files)[:100_000]) + gzip.compress(tar("w", files)[100_000:]))
    (root / "a.tar").write_bytes(tar("w", files))
    (root / "a.tar.bz2").write_bytes(tar("w:bz2", files))
    (root / "a.tar.xz").write_bytes(tar("w:xz", files))
    (root / "a.zip").write_bytes(zipped(False, zipfile.ZIP_DEFLATED))
    (root / "stored.zip").write_bytes(zipped(False, zipfile.ZIP_STORED))
    (root / "stream.zip").write_bytes(bytes(forward.data))
    (root / "abstracts.tar.bz2").write_bytes(tar("w:bz2", nested))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.packed.link./in", f"file://{root}")
    return "viewfs://packed/in"


ARCHIVES = ["a.tar.gz", "a.tgz", "a.tar", "a.tar.bz2", "a.tar.xz", "a.zip", "stored.zip", "stream.zip"]


@pytest.mark.parametrize("archive", ARCHIVES)
def test_members_equal_the_unpacked_files(spark, packed, archive):
    files = {"topics": {"dev": f"https://x.example/{archive}?dl=1#qa/dev.jsonl"}, "answers": {"dev": f"{archive}#qa/dev.jsonl"}, "corpus": {"all": f"{archive}#wiki.jsonl"}}
    d = datasets.FileDataset(spark, packed, files)
    plain = datasets.FileDataset(spark, f"{packed}/plain", {"topics": {"dev": "qa/dev.jsonl"}, "answers": {"dev": "qa/dev.jsonl"}, "corpus": {"all": "wiki.jsonl"}})
    for a, b in ((d.topics("dev"), plain.topics("dev")), (d.answers("dev"), plain.answers("dev")), (d.corpus(), plain.corpus())):
        assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != []
    for read in (datasets.read_reading_topics, datasets.read_reading_answers):
        assert sorted(map(tuple, read(spark, f"{packed}/{archive}#reading.json").collect())) == sorted(map(tuple, read(spark, f"{packed}/plain/reading.json").collect())) != []


def test_members_that_are_compressed_themselves(spark, packed):
    specs = datasets.members("https://x.example/abstracts.tar.bz2", ["AA/one.bz2", "AB/two.bz2"])
    got = datasets.FileDataset(spark, packed, {"corpus": specs}, corpus_reader=datasets.read_wiki_abstracts).corpus()
    assert sorted(map(tuple, got.collect())) == [("1", "T", "x y"), ("2", "U", "")]


def test_archives_in_splits_and_bounded_pieces(spark, packed, monkeypatch):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        lines = archives.archive_lines(spark, [f"{packed}/a.tar", f"{packed}/stored.zip", f"{packed}/a.tar.bz2"])
        counts = {(r["archive"].rsplit("/", 1)[1], r["member"]): r["n"] for r in lines.groupBy("archive", "member").agg(F.count("*").alias("n")).collect()}
        assert {counts[a, "wiki.jsonl"] for a in ("a.tar", "stored.zip", "a.tar.bz2")} == {3000}
        assert lines.filter("member = 'wiki.jsonl'").groupBy("archive").agg(F.countDistinct("no").alias("n"), F.max("no").alias("m")).filter("n = 3000 and m = 2999").count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_archives_are_errors(spark, tmp_path, packed):
    with pytest.raises(Exception, match="cut off|truncated|unexpected end|EOF"):
        whole = io.BytesIO()
        with tarfile.open(fileobj=whole, mode="w:gz") as t:
            info = tarfile.TarInfo("x")
            info.size = 100_000
            t.addfile(info, io.BytesIO(random.Random(2).randbytes(100_000)))
        (tmp_path / "cut.tgz").write_bytes(whole.getvalue()[:50_000])
        archives.archive_lines(spark, str(tmp_path / "cut.tgz")).count()


def test_early_bad_lines_are_errors_and_late_ones_are_left_out(spark, tmp_path):
    rows = [json.dumps({"id": str(i), "contents": f"T{i}\nB" + "x" * 200}) for i in range(3000)]
    for name, at in (("early", 3), ("last_early", 10), ("first_late", 11), ("late", 1000)):
        lines = list(rows)
        lines[at] = "no json" if at % 2 else '["a list"]'
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = lambda *names: datasets.read_wiki_passages(spark, [str(tmp_path / f"{n}.jsonl") for n in names])
        assert read("late").select(F.spark_partition_id()).distinct().count() > 3
        assert read("late", "first_late").count() == 2 * 2999
        bad = datasets.malformed_lines(spark, [str(tmp_path / f"{n}.jsonl") for n in ("late", "first_late", "early")], "id string, contents string")
        assert {(r["file"].rsplit("/", 1)[1], r["no"]) for r in bad.collect()} == {("late.jsonl", 1000), ("first_late.jsonl", 11), ("early.jsonl", 3)}
        for name in ("early", "last_early"):
            with pytest.raises(Exception, match="malformed line"):
                read("late", name).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_question_source_by_ranges(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(jsonl({"id": f"q{i}", "question": "é" * (i % 40), "golden_answers": [str(i)] if i % 3 else None} for i in range(400)))
    (tmp_path / "b.jsonl").write_bytes(b'\n{"id": "last", "question": "no line feed"}')
    (tmp_path / "c.txt").write_text("not read")
    spark.dataSource.register(datasets.QuestionSource)
    want = sorted((r["qid"], r["query"]) for r in datasets.read_topics(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]).collect())
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for size in (997, 5000, 1 << 26):
        rows = spark.read.format("rag_questions").option("range_bytes", size).option("push_filters", "true").load(str(tmp_path))
        assert sorted((r["qid"], r["query"]) for r in rows.collect()) == want
    assert rows.filter("qid = 'q7' and query is not null").collect()[0]["gold_answer"] == ["7"]
    assert {r["qid"] for r in rows.filter("qid in ('q1', 'q2', 'x')").collect()} == {"q1", "q2"}
    assert spark.read.format("rag_questions").load(f"file://{tmp_path}").count() == 401
    (tmp_path / "d.jsonl").write_text('{"id": "ok", "question": "x"}\n["bad"]\n')
    assert spark.read.format("rag_questions").option("bad_lines", "skip").load(str(tmp_path)).count() == 402
    with pytest.raises(Exception, match="no JSON object with an id"):
        spark.read.format("rag_questions").load(str(tmp_path)).count()
