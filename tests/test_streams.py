import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ragloom.streaming import streams

DAY = dt.datetime(2024, 1, 1)


def at(minute):
    return DAY + dt.timedelta(minutes=minute)


class Files:
    """A folder that gets a file for each micro-batch, and the stream of it."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0

    def add(self, *rows):
        self.n += 1
        part = f"{self.folder}/staged/{self.n}"
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.parquet(part)
        os.makedirs(f"{self.folder}/in", exist_ok=True)
        file = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        target = f"{self.folder}/in/{self.n:03}.parquet"
        os.rename(f"{part}/{file}", target)
        os.utime(target, (1_700_000_000 + self.n, 1_700_000_000 + self.n))

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")


def run(df, folder, mode="append"):
    """All files that are there, one a micro-batch; the rows of every run so far."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out").collect()


def test_state_of_queries_over_batches_and_restarts(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    files = Files(spark, str(tmp_path), "qid string, ts timestamp, text string")
    make = lambda: streams.agent_turns(files.stream(), max_turn=3, timeout_ms=600_000, late="0 seconds")
    try:
        files.add(("answers", at(0), "I search"), ("limit", at(0), "one"), ("slow", at(0), "only this"), ("once", at(0), "<answer> now </answer>"))
        files.add(("answers", at(2), "so <answer>blue</answer>"), ("limit", at(1), "two"), ("limit", at(2), "three"))
        assert {tuple(r) for r in run(make(), str(tmp_path))} == {("once", 1, "now", "Got answer"), ("answers", 2, "blue", "Got answer"), ("limit", 3, None, "No answer after max turns")}
        # after a restart the state is still there; later events let the timer of the silent query run out
        files.add(("late", at(30), "x"))
        files.add(("late", at(31), None))
        files.add(("late", at(32), "<answer>y"))
        got = {tuple(r) for r in run(make(), str(tmp_path))}
        assert ("slow", 1, None, "No text in time") in got and ("late", 3, "y", "Got answer") in got and len(got) == 5
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    files = Files(spark, str(tmp_path), "ts timestamp, value double")
    files.add((at(5), 1.0), (at(50), 3.0))
    files.add((at(130), 5.0))
    files.add((at(131), 9.0))  # a batch leaves out what the watermark before its last one excludes
    files.add((at(10), 100.0), (at(125), 7.0))
    files.add((at(400), 0.0))
    got = {(r["start"], r["n"], r["mean"]) for r in run(streams.windowed(files.stream(), late="10 minutes"), str(tmp_path))}
    assert got == {(at(0), 2, 2.0), (at(120), 3, 7.0)}


def test_repeats_are_dropped_over_batches(spark, tmp_path):
    files = Files(spark, str(tmp_path), "qid string, ts timestamp, query string")
    files.add(("1", at(0), "a"), ("2", at(0), "b"))
    files.add(("1", at(1), "again"), ("3", at(2), "c"))
    files.add(("2", at(3), "again"))
    assert sorted(r["qid"] for r in run(streams.distinct_queries(files.stream()), str(tmp_path))) == ["1", "2", "3"]


def test_sessions_close_when_the_watermark_passes(spark, tmp_path):
    files = Files(spark, str(tmp_path), "user_id bigint, ts timestamp")
    files.add((1, at(0)), (2, at(0)))
    files.add((1, at(20)))
    files.add((1, at(45)), (2, at(90)))
    files.add((3, at(300)))
    got = {(r["user_id"], r["start"], r["end"], r["n"]) for r in run(streams.sessions(files.stream(), "user_id"), str(tmp_path))}
    assert got == {(1, at(0), at(75), 3), (2, at(0), at(30), 1), (2, at(90), at(120), 1)}


def test_batches_are_answered_by_a_pipeline(spark, tmp_path):
    files = Files(spark, str(tmp_path), "qid string, query string")
    files.add(("1", "a"))
    files.add(("2", "b"))
    q = streams.each_batch(files.stream(), lambda df: df.withColumn("qanswer", F.upper("query")), str(tmp_path / "answers"), str(tmp_path / "c"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r["qid"], r["qanswer"]) for r in spark.read.parquet(str(tmp_path / "answers")).collect()) == [("1", "A"), ("2", "B")]
