"""Streams of questions and answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ragloom.operators.generation import Backend, generated


def answered(queries: DataFrame, backend: Backend, prompt: Column, **options) -> DataFrame:
    """A stream of (qid, query) with answers; all steps are without state."""
    return generated(queries.withColumn("prompt", prompt), backend, **options)


def each_batch(stream: DataFrame, pipeline: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Run a batch pipeline, retrieval included, on each micro-batch; a batch that runs again overwrites its own folder."""
    write = lambda df, n: pipeline(df).write.mode("overwrite").parquet(f"{path}/batch={n}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def distinct_queries(stream: DataFrame, ts: str = "ts", within: str = "10 minutes", key: str = "qid") -> DataFrame:
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, value: str = "value", ts: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """(start, end, *by, n, mean): tumbling windows, or sliding ones; rows later than ``late`` are left out of a stream."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "mean")


def sessions(stream: DataFrame, by: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


#: Fixed value: the state store that keeps state by key with timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TURNS = "qid string, turns int, qanswer string, stop_reason string"


class _Turns(StatefulProcessor):
    """The turns of a query so far, and a timer that a new text sets anew. A query that has ended begins again with its next text."""

    def __init__(self, max_turn: int, start: str, timeout_ms: int):
        self.max_turn, self.start, self.timeout_ms = max_turn, start, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.turns = handle, handle.getValueState("turns", "n int")

    def _ended(self, key, turns: int, answer: str | None, why: str) -> pd.DataFrame:
        self.turns.clear()
        return pd.DataFrame({"qid": [key[0]], "turns": [turns], "qanswer": [answer], "stop_reason": [why]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = self.turns.get()[0] if self.turns.exists() else 0
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        seen = pd.concat(list(rows)).sort_values("at", kind="stable")
        for text in seen["text"]:
            turns += 1
            if text is not None and self.start in text:
                yield self._ended(key, turns, text.split(self.start, 1)[1].split("</", 1)[0].strip(), "Got answer")
                turns = 0
            elif turns >= self.max_turn:
                yield self._ended(key, turns, None, "No answer after max turns")
                turns = 0
        if turns:
            self.turns.update((turns,))
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), int(seen["at"].iloc[-1])) + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turns = self.turns.get()[0] if self.turns.exists() else 0
        if turns:
            yield self._ended(key, turns, None, "No text in time")

    def close(self) -> None:
        pass


def agent_turns(events: DataFrame, max_turn: int = 10, start: str = "<answer>", timeout_ms: int = 600_000, late: str = "1 minute") -> DataFrame:
    """(qid, turns, qanswer, stop_reason) from a stream of (qid, ts, text): one row when an answer comes, the turns are used up, or the watermark passes a query's last text by the timeout.

    The state of a query is the number of its turns, kept over micro-batches and restarts. Texts of one micro-batch count in the order of ts. The session gets the state store with timers.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = events.select("qid", "ts", F.unix_millis("ts").alias("at"), "text").withWatermark("ts", late)
    return rows.groupBy("qid").transformWithStateInPandas(_Turns(max_turn, start, timeout_ms), TURNS, "append", "EventTime")
