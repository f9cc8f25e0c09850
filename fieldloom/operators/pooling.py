"""Pooling patch-timestep vectors to one vector per region and year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import stats_by_position

GROUP = ["county_id", "year"]


def complete_patches(df: DataFrame, steps: list[int]) -> DataFrame:
    """(county_id, year, patch_id) of patches whose timesteps are exactly ``steps``, each once."""
    found = df.groupBy(*GROUP, "patch_id").agg(F.array_sort(F.collect_list("timestep")).alias("steps"))
    return found.where(F.col("steps") == F.array(*[F.lit(s).cast("int") for s in sorted(steps)])).select(*GROUP, "patch_id")


def only_complete(df: DataFrame, steps: list[int]) -> DataFrame:
    return df.join(complete_patches(df, steps), [*GROUP, "patch_id"], "left_semi")


def spatial_pool(df: DataFrame, width: int, *, deviation: bool = True) -> DataFrame:
    """Per region, year and timestep: n and the vector of means, with population deviations after them if asked for."""
    out = stats_by_position(df, [*GROUP, "timestep"], "embedding", width)
    return out.select(*GROUP, "timestep", "n", (F.concat("m", "s") if deviation else F.col("m")).alias("features"))


def temporal_mean(pooled: DataFrame, width: int) -> DataFrame:
    out = stats_by_position(pooled, GROUP, "features", width)
    return out.select(*GROUP, F.col("m").alias("features"))


def temporal_concat(pooled: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("timestep", "features")))
    return pooled.groupBy(*GROUP).agg(rows.alias("r")).select(*GROUP, F.flatten(F.col("r.features")).alias("features"))


def joint_pool(df: DataFrame, width: int) -> DataFrame:
    """Means and population deviations over all patches and timesteps together, in one aggregate."""
    out = stats_by_position(df, GROUP, "embedding", width)
    return out.select(*GROUP, "n", F.concat("m", "s").alias("features"))


def joint_of_steps(pooled: DataFrame, width: int) -> DataFrame:
    """The joint pool from per-timestep means and deviations, where each timestep has as many patches."""
    m = [F.element_at("features", k + 1) for k in range(width)]
    s = [F.element_at("features", width + k + 1) for k in range(width)]
    spread = [F.sqrt(F.greatest(F.avg(b * b + a * a) - F.pow(F.avg(a), 2), F.lit(0.0))) for a, b in zip(m, s)]
    return pooled.groupBy(*GROUP).agg(F.array(*[F.avg(a) for a in m], *spread).alias("features"))


def sequence_pool(df: DataFrame, width: int) -> DataFrame:
    """Vectors that stand for a whole sequence (timestep 0 alone): the spatial pool with no temporal one."""
    return spatial_pool(only_complete(df, [0]), width).drop("timestep")


def sum_cube(df: DataFrame, width: int) -> DataFrame:
    """Mergeable state per region, year and timestep: n, sums and sums of squares of each position."""
    item = [F.element_at("embedding", k + 1).cast("double") for k in range(width)]
    return df.groupBy(*GROUP, "timestep").agg(F.count("*").alias("n"), F.array(*[F.sum(x) for x in item]).alias("s1"), F.array(*[F.sum(x * x) for x in item]).alias("s2"))


def cube_gaps(cube: DataFrame, steps: list[int]) -> DataFrame:
    """Region, year and timestep combinations that have no rows."""
    grid = cube.select(*GROUP).distinct().withColumn("timestep", F.explode(F.array(*[F.lit(s).cast("int") for s in steps])))
    return grid.join(cube.select(*GROUP, "timestep"), [*GROUP, "timestep"], "left_anti")


def patch_sets(df: DataFrame) -> DataFrame:
    return df.groupBy(*GROUP).agg(F.count_distinct("patch_id").alias("n_patches"), F.array_sort(F.collect_set("patch_id")).alias("patch_ids"))


def cohort_hash(df: DataFrame, key: str) -> DataFrame:
    """SHA-256 of the sorted keys, one a line. The cohort is one value, as large as its keys."""
    return df.agg(F.count_distinct(key).alias("n_keys"), F.sha2(F.array_join(F.array_sort(F.collect_set(key)), "\n"), 256).alias("sha256"))


def patch_hash(df: DataFrame) -> DataFrame:
    """SHA-256 of lines of a key and its patch ids, set apart by the unit separator."""
    line = F.concat_ws("\x1f", "key", "patch_ids")
    return df.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"))


def interval_histogram(df: DataFrame, column: str = "timestep") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("files"), F.count_distinct("patch_id").alias("patches"))


def describe_patches(df: DataFrame, steps: list[int]) -> DataFrame:
    """One row: files, files outside the schedule, patches, complete ones, and patches per region and year (smallest, median, largest)."""
    inside = F.col("timestep").isin(*steps)
    files = df.agg(F.count("*").alias("files"), F.count_if(~inside).alias("excluded_files"), F.count_distinct("county_id", "year", "patch_id").alias("patches"))
    done = complete_patches(df.where(inside), steps)
    per = done.groupBy(*GROUP).count()
    counts = per.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("complete_patches"), F.min("count").alias("patches_min"), F.percentile("count", F.lit(0.5)).alias("patches_median"), F.max("count").alias("patches_max"))
    return files.join(counts)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
