"""The grid of runs: representation x fold x head x seed, ridge once per fold.

Predictions are a table with a partition per cell. A call works out which cells of the plan have no partition yet and fits only
these, a head at a time; Spark commits a cell's partition with the job that wrote it, so a killed run goes on where it was, and a
finished one does nothing. A cell is written over if it is asked for again (``redo``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear, trees

CELL = ["representation", "regressor", "fold", "seed"]
PREDICTIONS = "key string, observed double, predicted double, representation string, regressor string, fold int, seed int"
RIDGE = "ridge"


def plan(panel: DataFrame, heads: list[str], folds: list[int], seeds: list[int]) -> DataFrame:
    """The cells of the grid that have test rows; ridge has one seed, 0."""
    have = panel.where("split = 'test'").select("representation", F.col("fold").cast("int").alias("fold")).distinct().where(F.col("fold").isin(list(folds)))
    each = F.array(*[F.struct(F.lit(h).alias("regressor"), F.lit(s).cast("int").alias("seed")) for h in heads for s in ([0] if h == RIDGE else seeds)])
    return have.select("representation", "fold", F.explode(each).alias("e")).select("representation", "e.regressor", "fold", "e.seed")


def written(spark, path: str) -> DataFrame:
    """The predictions that are there."""
    try:
        return spark.read.schema(PREDICTIONS).parquet(path)
    except AnalysisException:  # nothing yet
        return spark.createDataFrame([], PREDICTIONS)


def missing(panel: DataFrame, path: str, heads: list[str], folds: list[int], seeds: list[int]) -> DataFrame:
    """Cells of the plan without a partition."""
    return plan(panel, heads, folds, seeds).join(written(panel.sparkSession, path).select(*CELL).distinct(), CELL, "left_anti")


def _ridge(panel: DataFrame, cells: DataFrame, options: dict) -> DataFrame:
    fits = linear.fit_roles(panel.join(cells.select("representation").distinct(), "representation", "left_semi"), **options)
    wanted = panel.where("split = 'test'").join(cells.select("representation", "fold"), ["representation", "fold"], "left_semi")
    out = linear.predict(wanted, fits, "representation", "fold")
    return out.select("representation", F.col("key").cast("string").alias("key"), F.col("fold").cast("int").alias("fold"), F.lit(RIDGE).alias("regressor"), F.lit(0).alias("seed"), F.col("target").cast("double").alias("observed"), "predicted")


def run(panel: DataFrame, path: str, heads: dict[str, dict], folds: list[int], seeds: list[int], *, redo: bool = False) -> DataFrame:
    """Fits the cells that are missing at ``path`` and returns all predictions there. ``panel``: representation, key, fold, split, features,
    target; ``heads``: names of tree heads, or ridge, with their options."""
    for head, options in heads.items():
        cells = plan(panel, [head], folds, seeds) if redo else missing(panel, path, [head], folds, seeds)
        cells = panel.sparkSession.createDataFrame(cells.collect(), cells.schema)  # a row for each cell
        if cells.isEmpty():
            continue
        if head == RIDGE:
            out = _ridge(panel, cells, options)
        else:
            own = panel.join(cells.select("representation", "fold").distinct(), ["representation", "fold"], "left_semi")
            found = cells.select("fold", "seed").distinct().collect()
            out = trees.evaluate(own, {head: options}, sorted({r["fold"] for r in found}), sorted({r["seed"] for r in found})).join(cells, CELL, "left_semi")
        out.select(*[c.split()[0] for c in PREDICTIONS.split(", ")]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CELL).parquet(path)
    return written(panel.sparkSession, path)
