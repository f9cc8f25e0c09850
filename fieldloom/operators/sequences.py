"""Operators on short sequences of timesteps: truncation, correlation with lags, trajectories, carrying forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .metrics import pearson
from .numbering import numbered


def prefixes(df: DataFrame, steps: int, step: str = "timestep") -> DataFrame:
    """Each row once for every k of 1..steps whose first k timesteps it is in."""
    return df.withColumn("k", F.explode(F.sequence(F.greatest(F.col(step) + 1, F.lit(1)), F.lit(steps)))).where(F.col(step) < F.col("k"))


def leave_one_out(df: DataFrame, steps: int, step: str = "timestep") -> DataFrame:
    """Each row once for every dropped timestep that isn't its own; dropped 0 keeps all."""
    return df.withColumn("dropped", F.explode(F.sequence(F.lit(0), F.lit(steps)))).where(F.col("dropped") != F.col(step) + 1)


def flattened(df: DataFrame, keys: list[str], vector: str = "features", step: str = "timestep") -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(step, vector)))
    return df.groupBy(*keys).agg(rows.alias("r")).select(*keys, F.flatten(F.col(f"r.{vector}")).alias(vector))


def correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson correlation of two columns in each group, null where a side is constant."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    return s.select(*keys, "n", F.try_divide("c", F.sqrt(F.col("vx") * F.col("vy"))).alias("r"))


def lagged(df: DataFrame, key: list[str], a: str, b: str, lags: list[int], step: str = "timestep") -> DataFrame:
    """Per key and lag, the correlation of a at t with b at t + lag, by an equi-join on the shifted timestep."""
    left = df.select(*key, F.col(step), F.col(a).alias("_a")).withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags]))).withColumn("_t", F.col(step) + F.col("lag"))
    right = df.select(*key, F.col(step).alias("_t"), F.col(b).alias("_b"))
    return correlation(left.join(right, [*key, "_t"]), [*key, "lag"], "_a", "_b")


def best_lag(correlations: DataFrame) -> DataFrame:
    """The lag with the largest mean correlation; of equal ones the first."""
    per = correlations.groupBy("lag").agg(F.avg("r").alias("mean_r"), F.count("r").alias("n"))
    best = per.agg(F.max_by("lag", F.struct(F.round("mean_r", 12), -F.col("lag"))).alias("best"))
    return per.join(F.broadcast(best)).select("lag", "mean_r", "n", (F.col("lag") == F.col("best")).alias("chosen"))


def correlation_summary(correlations: DataFrame, keys: list[str], limit: float = 0.9) -> DataFrame:
    """Mean, median, population deviation, and the share above ``limit``, in which undefined correlations count as below."""
    return correlations.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.median("r").alias("median"), F.stddev_pop("r").alias("std"), F.avg(F.coalesce((F.col("r") > limit).cast("double"), F.lit(0.0))).alias("share_above"))


def trajectory(df: DataFrame, keys: list[str], value: str, step: str = "timestep") -> DataFrame:
    """Mean curve scaled to 0..1 by its own range, with the deviation scaled alike, and whether a step is the peak."""
    per = df.groupBy(*keys, step).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    all_steps = W.Window.partitionBy(*keys)
    low, span = F.min("mean").over(all_steps), F.max("mean").over(all_steps) - F.min("mean").over(all_steps)
    peak = F.max(F.struct("mean", -F.col(step))).over(all_steps)
    out = per.select(*keys, step, F.try_divide(F.col("mean") - low, span).alias("scaled"), F.try_divide(F.col("std"), span).alias("scaled_std"), (F.struct("mean", -F.col(step)) == peak).alias("peak"))
    return out


def oriented(df: DataFrame, value: str, reference: str, step: str = "timestep") -> DataFrame:
    """``value`` with its sign turned if the mean curves of the two columns are negatively correlated."""
    curves = df.groupBy(step).agg(F.avg(value).alias("_v"), F.avg(reference).alias("_r"))
    sign = correlation(curves, [], "_v", "_r").select(F.when(F.col("r") < 0, -1.0).otherwise(1.0).alias("sign"))
    return df.join(F.broadcast(sign)).withColumn(value, F.col(value) * F.col("sign"))


def carried_forward(df: DataFrame, keys: list[str], steps: int, value: str, step: str = "timestep") -> DataFrame:
    """All steps 0..steps-1 of each sequence; an absent one has the last value before it, or the first value there is."""
    grid = df.select(*keys).distinct().withColumn(step, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    rows = grid.join(df.select(*keys, step, value), [*keys, step], "left")
    order = W.Window.partitionBy(*keys).orderBy(step)
    last = F.last(value, ignorenulls=True).over(order.rowsBetween(W.Window.unboundedPreceding, 0))
    first = F.first(value, ignorenulls=True).over(order.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing))
    return rows.withColumns({"carried": F.col(value).isNull(), value: F.coalesce(last, first)})


def smallest_path(tiles: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    return tiles.groupBy(*keys).agg(F.min(path).alias(path), F.count("*").alias("copies"))


def evenly_spaced(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows at even places of the order; all tasks number the rows."""
    ranked = numbered(df.select(*order).distinct(), order, "_i")
    n = ranked.count()
    if n <= most:
        return df
    places = df.sparkSession.range(most).select(F.floor(F.col("id") * (n - 1) / max(most - 1, 1)).cast("long").alias("_i")).distinct()
    return df.join(ranked.join(F.broadcast(places), "_i").drop("_i"), order, "left_semi")


def deterministic_sample(df: DataFrame, keys: list[str], item: str, k: int, salt: str) -> DataFrame:
    """k items per key by the order of a salted hash: the same in each run, whatever the order of the rows."""
    mark = F.sha2(F.concat_ws("-", *[F.col(c).cast("string") for c in keys], F.lit(salt), F.col(item).cast("string")), 256)
    order = W.Window.partitionBy(*keys).orderBy("_mark")
    n = F.count("*").over(W.Window.partitionBy(*keys))
    out = df.withColumn("_mark", mark).withColumns({"rank": F.row_number().over(order), "replacement": n < k}).where(F.col("rank") <= k)
    return out.drop("_mark")

