"""Vectors held as arrays."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_finite(vector: Column) -> Column:
    """Whether no item is null, NaN or infinite."""
    return ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def finite(value: Column) -> Column:
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def from_text(value: Column) -> Column:
    """A vector from its text form, "[1.0, 2.0]" or "1.0 2.0" in brackets."""
    commas = F.regexp_replace(F.regexp_replace(F.trim(value), r"[\s,]+", ","), r"^\[,|,\]$", "")
    return F.from_json(F.concat(F.lit("["), F.regexp_replace(commas, r"^\[|\]$", ""), F.lit("]")), "array<double>")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(value: pd.Series) -> pd.Series:
    """A vector from its little-endian 32-bit form."""
    return value.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def wide_columns(columns: list[str], pattern: str) -> dict[str, list[str]]:
    """Columns by the prefix that the pattern's first group has, in the order of the number in its second."""
    found: dict[str, list[tuple[int, str]]] = {}
    for c in columns:
        if m := re.fullmatch(pattern, c):
            found.setdefault(m[1], []).append((int(m[2]), c))
    return {k: [c for _, c in sorted(v)] for k, v in found.items()}


def wide_vector(df: DataFrame, names: list[str], *, steps: list[int] | None = None, order: str = "variable", out: str = "features") -> DataFrame:
    """Adds one vector of the columns name_step: all steps of a name together, or all names of a step. Every name must have the same steps."""
    groups = wide_columns(df.columns, "(" + "|".join(map(re.escape, names)) + r")_(\d+)")
    have = {n: [int(c.rsplit("_", 1)[1]) for c in groups.get(n, [])] for n in names}
    want = steps or have[names[0]]
    for n, s in have.items():
        if s != want:
            raise ValueError(f"{n} has {len(s)} intervals {s}; expected {want}")
    pairs = [(n, s) for n in names for s in want] if order == "variable" else [(n, s) for s in want for n in names]
    return df.withColumn(out, F.array(*[F.col(f"{n}_{s}").cast("double") for n, s in pairs]))


def complete(columns: list[str]) -> Column:
    """Whether none of the columns is null or NaN."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & finite(F.col(c))
    return ok


def long_form(df: DataFrame, keys: list[str], vector: str, digits: int | None = 6) -> DataFrame:
    """A row for each position of the vectors."""
    out = df.select(*keys, F.posexplode(vector).alias("pos", "value"))
    return out.withColumn("value", F.round(F.col("value").cast("double"), digits)) if digits is not None else out


def stats_by_position(df: DataFrame, keys: list[str], vector: str, width: int, *extra: Column) -> DataFrame:
    """One row per group: n, and mean and population deviation of each position as arrays ``m`` and ``s``.

    Each position is an aggregate of its own, so that rows are not multiplied and map-side partial aggregation leaves one
    row a group and task; above 256 positions the vectors are exploded instead.
    """
    item = [F.element_at(vector, k + 1).cast("double") for k in range(min(width, 256))]
    if width <= 256:
        return df.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.avg(x) for x in item]).alias("m"), F.array(*[F.stddev_pop(x) for x in item]).alias("s"), *extra)
    long = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "m", "s")))
    out = long.groupBy(*keys).agg(F.max("n").alias("n"), rows.alias("r")).select(*keys, "n", F.col("r.m").alias("m"), F.col("r.s").alias("s"))
    return out.join(df.groupBy(*keys).agg(*extra), keys) if extra else out
