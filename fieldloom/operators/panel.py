"""Joining and comparing panel tables by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from .audit import duplicate_check, key_difference, require, row_checks


def attach_labels(features: DataFrame, labels: DataFrame, keys: list[str], *, check: bool = True) -> DataFrame:
    """Inner join of one row a key on both sides; labels that are null go first."""
    labels = labels.dropna()
    if check:
        require(duplicate_check(features, keys, "features"), duplicate_check(labels, keys, "labels"))
    return features.join(labels, keys)


def lookup_codes(rows: DataFrame, codes: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their code, one row with the numbers of matched and unmatched rows)."""
    both = rows.join(codes.withColumn("_hit", F.lit(True)), on, "left")
    counts = both.agg(F.count("_hit").alias("matched"), F.count_if(F.expr("_hit is null")).alias("unmatched"))
    return both.where("_hit").drop("_hit"), counts


def fuse(left: DataFrame, right: DataFrame, keys: list[str], vector: str = "features") -> DataFrame:
    """Inner join by key, the right vector after the left one."""
    return left.join(right.select(*keys, F.col(vector).alias("_more")), keys).withColumn(vector, F.concat(vector, "_more")).drop("_more")


def companions(tiles: DataFrame, partners: DataFrame, keys: list[str]) -> DataFrame:
    """Each tile with its partner of the same keys; a tile without one is an error."""
    require(key_difference(tiles, partners, keys, "companion").where("check_name = 'companion_missing'"))
    return tiles.join(partners, keys)


def restrict(df: DataFrame, cohort: DataFrame, key: str, *, name: str = "cohort") -> tuple[DataFrame, DataFrame]:
    """(rows of the cohort, one row with the number of excluded rows); a cohort key without rows is an error."""
    wanted = cohort.select(key).distinct()
    require(wanted.join(df, key, "left_anti").agg(F.lit(f"{name}_missing").alias("check_name"), F.count("*").alias("n_bad"), F.min(F.col(key).cast("string")).alias("sample")))
    return df.join(wanted, key, "left_semi"), df.join(wanted, key, "left_anti").agg(F.count("*").alias("excluded"))


def restrict_report(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """One row: keys of the list that are used and ignored, and rows outside it."""
    want = wanted.select(key).distinct()
    used = want.join(df.select(key).distinct().withColumn("_there", F.lit(1)), key, "left").agg(F.count("_there").alias("used"), F.count_if(F.expr("_there is null")).alias("ignored"))
    return used.join(df.join(want, key, "left_anti").agg(F.count("*").alias("outside")))


def with_roles(df: DataFrame, manifest: DataFrame, key: str = "key") -> DataFrame:
    """Every row in every fold with its role, all folds in one join."""
    return df.join(manifest.select(key, "fold", "split"), key)


def row_reconciliation(expected: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and found row numbers of each cell (column n of ``expected``)."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("found"))
    both = expected.join(found, keys, "left")
    return both.select(*keys, "n", F.coalesce("found", F.lit(0)).alias("found"), F.col("n").eqNullSafe(F.coalesce("found", F.lit(0))).alias("equal"))


def coverage(wanted: DataFrame, have: DataFrame, key: str, complete: Column) -> DataFrame:
    """covered, partial, missing or extra, for each key of either side; ``complete`` is a condition on ``have``."""
    h = have.groupBy(key).agg(F.max(complete).alias("_complete"), F.count("*").alias("tiles"))
    both = wanted.select(key).distinct().withColumn("_w", F.lit(1)).join(h, key, "full")
    state = F.when(F.col("_w").isNull(), "extra").when(F.col("tiles").isNull(), "missing").when(F.col("_complete"), "covered").otherwise("partial")
    return both.select(key, state.alias("state"), F.coalesce("tiles", F.lit(0)).alias("tiles"))


def aligned(df: DataFrame, keys: DataFrame, key: str, position: str) -> DataFrame:
    """Rows in the order of a key list; a key without a row is an error."""
    require(keys.join(df, key, "left_anti").agg(F.lit("aligned_missing").alias("check_name"), F.count("*").alias("n_bad"), F.min(F.col(key).cast("string")).alias("sample")))
    return keys.join(df, key).orderBy(position)


def filtered_or_all(shapes: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Shapes of present keys; all of them if none is present."""
    some = shapes.join(present.select(key).distinct(), key, "left_semi")
    return shapes if some.isEmpty() else some


def common_keys(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that every source has: a tagged union and one shuffle, however many sources there are."""
    return _tagged(sources, key).groupBy(key).agg(F.count_distinct("source").alias("n")).where(F.col("n") == len(sources)).select(key)


def _tagged(sources: dict[str, DataFrame], key: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(key, F.lit(name).alias("source")) for name, df in sources.items()])


def common_report(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Per source: distinct keys, common ones, excluded ones."""
    held = _tagged(sources, key).groupBy(key).agg(F.collect_set("source").alias("in"))
    common = F.size("in") == len(sources)
    rows = held.select(F.explode("in").alias("source"), common.alias("common"))
    return rows.groupBy("source").agg(F.count("*").alias("n_keys"), F.count_if("common").alias("n_common"), F.count_if(~F.col("common")).alias("n_excluded"))


def source_audit(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Per pair of sources: keys of both, and keys that only one has."""
    held = _tagged(sources, key).groupBy(key).agg(F.collect_set("source").alias("in"))
    names = list(sources)
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.array_contains("in", a).alias("x"), F.array_contains("in", b).alias("y")) for k, a in enumerate(names) for b in names[k + 1 :]]
    long = held.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return long.groupBy("a", "b").agg(F.count_if(F.col("x") & F.col("y")).alias("shared"), F.count_if(F.col("x") & ~F.col("y")).alias("only_a"), F.count_if(~F.col("x") & F.col("y")).alias("only_b"))


def overlaps(manifest: DataFrame, cell: list[str], key: str) -> DataFrame:
    """Keys that have more than one role in a cell."""
    return manifest.groupBy(*cell, key).agg(F.count_distinct("split").alias("roles")).where("roles > 1")


def years_of_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """The distinct years of the keys and how many keys each has; a malformed key is an error."""
    years = df.select(F.col(key).alias("_key"), ids.key_year(F.col(key)).alias("year"))
    require(row_checks(years, {"malformed_key": F.col("year").isNull()}, F.col("_key")))
    return years.groupBy("year").agg(F.count("*").alias("n"))


def united(frames: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows of all frames, with the frame's name; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in frames.items()])
