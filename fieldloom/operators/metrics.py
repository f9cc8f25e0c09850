"""Metrics, their summaries, within-region skill and cluster statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

METRICS = ["r2", "rmse", "mae"]


def metrics(df: DataFrame, keys: list[str], observed: str = "observed", predicted: str = "predicted", *, nrmse: bool = False) -> DataFrame:
    """n, r2 = 1 - SSE / SST (null with fewer than two rows or no variance), rmse, mae, and rmse over the mean if asked for."""
    y, e = F.col(observed), F.col(observed) - F.col(predicted)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count("*")).alias("sst"), F.avg(F.abs(e)).alias("mae"), F.avg(y).alias("_mean"))
    r2 = F.when(F.col("n") >= 2, 1 - F.try_divide("sse", "sst"))
    cols = [r2.alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae"]
    if nrmse:
        cols.append(F.try_divide(F.sqrt(F.col("sse") / F.col("n")), F.abs("_mean")).alias("nrmse"))
    return out.select(*keys, "n", *cols)


def summary(per_seed: DataFrame, cell: list[str], level: str, values: list[str] = METRICS) -> tuple[DataFrame, DataFrame]:
    """Two levels: over seeds to (cell, level), then over levels to the cell; means and population deviations."""
    by = per_seed.groupBy(*cell, level).agg(F.count_distinct("seed").alias("seeds"), F.first("n").alias("n"), *[F.avg(v).alias(v) for v in values], *[F.stddev_pop(v).alias(f"{v}_seed_std") for v in values])
    return by, by.groupBy(*cell).agg(F.count("*").alias("levels"), F.sum("n").alias("n_total"), *[F.avg(v).alias(f"{v}_mean") for v in values], *[F.stddev_pop(v).alias(f"{v}_std") for v in values])


def macro_and_pooled(predictions: DataFrame, rep: str, unit: str) -> DataFrame:
    """Per representation: means over units of their metrics, beside the metrics of all rows together."""
    per = metrics(predictions, [rep, unit])
    macro = per.groupBy(rep).agg(F.count("*").alias("units"), *[F.avg(m).alias(f"macro_{m}") for m in METRICS], *[F.stddev_pop(m).alias(f"macro_{m}_std") for m in METRICS])
    pooled = metrics(predictions, [rep])
    return macro.join(pooled.select(rep, "n", *[F.col(m).alias(f"pooled_{m}") for m in METRICS]), rep)


def cluster_stats(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Sums from which any pooled metric follows."""
    y, e = F.col("observed"), F.col("observed") - F.col("predicted")
    return predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y).alias("sum_y"), F.sum(y * y).alias("sum_y2"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"))


def coverage_counts(keys: DataFrame, column: str, least: int) -> DataFrame:
    per = keys.groupBy(column).agg(F.count("*").alias("n_keys"))
    return per.withColumn("eligible", F.col("n_keys") >= least)


def partition_counts(manifest: DataFrame) -> DataFrame:
    out = manifest.groupBy("fold").pivot("split", ["train", "val", "test"]).count()
    return out.select("fold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("train", "val", "test")])


def variance_shares(df: DataFrame, value: str, group: str) -> DataFrame:
    """Total population variance and its shares between and within groups that have more than one row."""
    per = W.Window.partitionBy(group)
    rows = df.withColumns({"_m": F.avg(value).over(per), "_n": F.count("*").over(per)}).where("_n > 1")
    out = rows.agg(F.count("*").alias("n"), F.var_pop(value).alias("total"), F.var_pop("_m").alias("between"), F.avg(F.pow(F.col(value) - F.col("_m"), 2)).alias("within"))
    return out.select("n", "total", F.try_divide("between", "total").alias("between_share"), F.try_divide("within", "total").alias("within_share"))


def marginal_loss(results: DataFrame, value: str, dropped: str = "dropped") -> DataFrame:
    """Loss against the row in which nothing is dropped."""
    full = F.max(F.when(F.col(dropped) == 0, F.col(value))).over(W.Window.partitionBy())
    return results.withColumn("loss", full - F.col(value))


def anomalies(df: DataFrame, cell: list[str], region: str = "county_id") -> DataFrame:
    """Observed and predicted values less their means within a region; regions with one row in a cell are left out."""
    per = W.Window.partitionBy(*cell, region)
    rows = df.withColumn("_n", F.count("*").over(per)).where("_n > 1").drop("_n")
    per = W.Window.partitionBy(*cell, region)
    return rows.withColumns({c: F.col(c) - F.avg(c).over(per) for c in ("observed", "predicted")})


def skill_curves(predictions: DataFrame, cell: list[str], fold: str = "fold") -> DataFrame:
    """Per cell: mean and population deviation over folds of r2 and rmse, of values, of anomalies, and rmse of no anomaly at all."""
    full = metrics(predictions, [*cell, fold]).withColumn("kind", F.lit("yield"))
    own = anomalies(predictions, [*cell, fold])
    inner = metrics(own, [*cell, fold]).withColumn("kind", F.lit("anomaly"))
    zero = metrics(own.withColumn("predicted", F.lit(0.0)), [*cell, fold]).withColumn("kind", F.lit("zero_anomaly"))
    rows = full.unionByName(inner).unionByName(zero)
    return rows.groupBy(*cell, "kind").agg(F.count("*").alias("folds"), F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"), F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; null where a side has no variance."""
    return F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest((n * sxx - sx * sx) * (n * syy - sy * sy), F.lit(0.0))))


def bootstrap(predictions: DataFrame, rep: str, cluster: str, *, repetitions: int, seed: int) -> DataFrame:
    """Deviation of pooled metrics over draws of clusters with replacement; all representations share the draws.

    A draw is the hash of (seed, repetition, number), so it is the same on any cluster and in SQL. Only the sums of a
    cluster are joined to the draws, never its rows.
    """
    stats = cluster_stats(predictions, [rep, cluster])
    names = stats.select(cluster).distinct()
    number = F.row_number().over(W.Window.orderBy(cluster)) - 1
    names = names.select(cluster, number.alias("nth"))
    k = names.count()
    draws = predictions.sparkSession.range(repetitions * max(k, 1)).select((F.col("id") / max(k, 1)).cast("int").alias("rep_no"), (F.col("id") % max(k, 1)).cast("int").alias("draw"))
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), "rep_no", "draw").cast("binary"))
    draws = draws.withColumn("nth", (F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % max(k, 1)).cast("int"))
    times = draws.groupBy("rep_no", "nth").agg(F.count("*").alias("times")).join(names, "nth")
    sums = times.join(stats, cluster).groupBy(rep, "rep_no").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("n", "sum_y", "sum_y2", "sse", "sae")])
    sst = F.col("sum_y2") - F.col("sum_y") * F.col("sum_y") / F.col("n")
    each = sums.select(rep, (1 - F.try_divide(F.col("sse"), sst)).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sae") / F.col("n")).alias("mae"))
    return each.groupBy(rep).agg(F.count("*").alias("repetitions"), *[F.stddev_samp(m).alias(f"{m}_std") for m in METRICS])
