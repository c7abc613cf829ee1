"""Column contracts: required columns, and versions of a column (query, query_0, query_1, ...)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str, any_of: Iterable[Iterable[str]] = ()) -> DataFrame:
    """df, or a ValueError when the plan is built: all ``names``, and all of one of ``any_of``."""
    missing = [n for n in names if n not in df.columns]
    choices = [list(c) for c in any_of]
    if missing or (choices and not any(set(c) <= set(df.columns) for c in choices)):
        raise ValueError(f"missing columns {missing or choices}; there are {df.columns}")
    return df


def _pushes(columns: Iterable[str], base: str) -> dict[str, str]:
    """New names: base to base_0, base_0 to base_1, and so on up to the first gap."""
    have = set(columns)
    if base not in have:
        raise KeyError(base)
    out, k = {base: f"{base}_0"}, 0
    while f"{base}_{k}" in have:
        out[f"{base}_{k}"] = f"{base}_{k + 1}"
        k += 1
    return out


def _renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """All at once: ``withColumnsRenamed`` would rename a new name again."""
    return df.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns))


def push_columns(df: DataFrame, keep_original: bool = False, base: str = "query") -> DataFrame:
    out = _renamed(df, _pushes(df.columns, base))
    return out.withColumn(base, F.col(f"{base}_0")) if keep_original else out


def pop_columns(df: DataFrame, base: str = "query") -> DataFrame:
    """The inverse: base_0 to base, base_1 to base_0; the present base column goes."""
    if f"{base}_0" not in df.columns:
        raise KeyError(f"{base}_0")
    df, names, k = df.drop(base), {f"{base}_0": base}, 1
    while f"{base}_{k}" in df.columns:
        names[f"{base}_{k}"] = f"{base}_{k - 1}"
        k += 1
    return _renamed(df, names)


def push_record(record: Mapping, keep_original: bool = False, base: str = "query") -> dict:
    names = _pushes(record, base)
    out = {names.get(k, k): v for k, v in record.items()}
    return out | {base: record[base]} if keep_original else out


def find_maximum_push(columns: Iterable[str], base: str = "query") -> tuple[str | None, int]:
    """(name, N) of the highest base_N, (None, -1) without one."""
    found = [(int(m[1]), c) for c in columns if (m := re.fullmatch(re.escape(base) + r"_(\d+)", c))]
    return (max(found)[1], max(found)[0]) if found else (None, -1)


def push_map(record: Column, base: str = "query") -> Column:
    """The same renaming of the keys of a map column."""
    numbered = lambda k: F.concat(F.lit(base + "_"), (F.regexp_extract(k, r"_(\d+)$", 1).cast("int") + 1).cast("string"))
    return F.transform_keys(record, lambda k, _: F.when(k == base, F.lit(base + "_0")).when(F.rlike(k, F.lit(rf"^{base}_\d+$")), numbered(k)).otherwise(k))


def same_query(df: DataFrame, group: str = "qid", query: str = "query") -> DataFrame:
    """df with a check, when it runs, that all rows of a group have one query."""
    per = df.groupBy(F.col(group).alias("_g")).agg(F.min(query).alias("_lo"), F.max(query).alias("_hi"))
    checked = per.filter(F.assert_true(F.col("_lo").eqNullSafe(F.col("_hi")), F.lit("rows of one group differ in their query")).isNull())
    return df.join(checked.select("_g"), F.col(group) == F.col("_g")).drop("_g")
