"""Pipeline algebra: ``a >> b`` applies b to a's rows, ``a % k`` keeps the k best rows of each query."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.tables import Tables


@dataclass(frozen=True)
class Step:
    """A step of a pipeline. Steps are the same if they are one function, or cut-offs at one rank."""

    function: Callable[[DataFrame], DataFrame] = field(compare=False)
    key: object


class Transformer:
    """A function from DataFrame to DataFrame, as the steps that it is made of; nothing runs until an action does."""

    def __init__(self, function: Callable[[DataFrame], DataFrame] | None = None, name: str = "", steps: tuple[Step, ...] = ()):
        self.steps = steps or (Step(function, function),)
        self.name = name or getattr(function, "__name__", "transformer")

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.function(df)
        return df

    __call__ = transform

    def __rshift__(self, other: Transformer) -> Transformer:
        return Transformer(name=f"{self.name} >> {other.name}", steps=self.steps + other.steps)

    def __mod__(self, k: int) -> Transformer:
        return Transformer(name=f"{self.name} % {k}", steps=(*self.steps, Step(lambda df: cutoff(df, k), ("cutoff", k))))

    def search(self, spark: SparkSession, query: str, qid: str = "1") -> DataFrame:
        return self.transform(queries(spark, [query], [qid]))


def shared_runs(systems: Sequence[Callable[[DataFrame], DataFrame]], topics: DataFrame, tables: Tables) -> list[DataFrame]:
    """What each system makes of the topics; steps that several systems begin with run once, into a written table that all of them read.

    Systems form a tree by their steps. A node that more than one system goes through and that they leave in different ways, or where one
    ends, is written; other steps stay in the plans of those that follow.
    """
    runs: list[DataFrame | None] = [None] * len(systems)
    chains = [s.steps if isinstance(s, Transformer) else (Step(s, s),) for s in systems]

    def grow(members: list[int], at: int, df: DataFrame) -> None:
        by_step: dict[object, list[int]] = {}
        for k in members:
            if len(chains[k]) == at:
                runs[k] = df
            else:
                by_step.setdefault(chains[k][at], []).append(k)
        for step, own in by_step.items():
            made, end = step.function(df), at + 1
            while len({chains[k][end] if len(chains[k]) > end else None for k in own}) == 1 and len(chains[own[0]]) > end:
                made, end = chains[own[0]][end].function(made), end + 1
            grow(own, end, tables.save(made) if len(own) > 1 else made)

    grow(list(range(len(systems))), 0, topics)
    return runs


def queries(spark: SparkSession, texts: list[str], qids: list[str] | None = None) -> DataFrame:
    qids = qids or [str(i + 1) for i in range(len(texts))]
    return spark.createDataFrame(list(zip(qids, texts, strict=True)), "qid string, query string")


def first_topics(df: DataFrame, n: int) -> DataFrame:
    """The n topics with the least qids."""
    return df.orderBy("qid").limit(n)


def ranked(df: DataFrame, group: str = "qid", score: str = "score", tie: str = "docno", k: int | None = None) -> DataFrame:
    """df with ``rank`` from 0 by score, then by document; with k only the k best of each group.

    The limit is on the bare row number, which Spark turns into a limit of each partition before the shuffle (for k up to
    spark.sql.optimizer.windowGroupLimitThreshold), so a group costs a task k rows of each partition.
    """
    numbered = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie)))
    return (numbered if k is None else numbered.filter(F.col("rank") <= k)).withColumn("rank", F.col("rank") - 1)


def cutoff(df: DataFrame, k: int) -> DataFrame:
    """Rows with rank < k; ranks are made where there are none."""
    return df.filter(F.col("rank") < k) if "rank" in df.columns else ranked(df, k=k)
