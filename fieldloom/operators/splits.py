"""Fold manifests: grouped folds, held-out states and years, and checks for leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .audit import row_checks


def _placed(loads: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` groups of one size each fold gets when the lightest fold, of equal ones the lowest, takes the next group."""
    below = lambda top: [max(0, (top - x) // size + 1) for x in loads]
    low, high = min(loads), max(loads) + n * size
    while low < high:  # the cost of the last group
        middle = (low + high) // 2
        low, high = (low, middle) if sum(below(middle)) >= n else (middle + 1, high)
    counts = below(low - 1)
    ties = [i for i, x in enumerate(loads) if low >= x and (low - x) % size == 0]
    for i in ties[: n - sum(counts)]:
        counts[i] += 1
    return counts


def grouped_folds(keys: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): the largest group goes to the lightest fold; ties by group in descending order, then by the lowest fold.

    Groups of one size are placed together: the j-th further group of size s in fold i costs that fold load + (j - 1) s, so the
    groups, numbered in their order, take the cells (fold, j) in the order of that cost. The driver has one row per distinct size
    and works out the loads; one join gives every group its cell.
    """
    sizes = keys.groupBy(group).agg(F.count("*").alias("size"))
    numbered = sizes.withColumn("nth", F.row_number().over(W.Window.partitionBy("size").orderBy(F.desc(group))))
    loads, rows = [0] * k, []
    for r in sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():
        counts = _placed(loads, r["size"], r["n"])
        rows.append((r["size"], list(loads), counts))
        loads = [x + c * r["size"] for x, c in zip(loads, counts)]
    plan = keys.sparkSession.createDataFrame(rows, "size long, loads array<long>, counts array<long>")
    cells = plan.select("size", "loads", F.posexplode("counts").alias("fold", "count")).where(F.col("count") > 0)
    cells = cells.select("size", "loads", "fold", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("j"))
    cost = F.element_at("loads", F.col("fold") + 1) + F.col("j") * F.col("size")

    def before(load, i):
        """Cells of fold i that come before a cell: cheaper ones, and one of equal cost in a lower fold."""
        gap = cost - load
        tie = (gap >= 0) & (gap % F.col("size") == 0) & (i < F.col("fold"))
        return F.when(gap > 0, F.ceil(gap / F.col("size"))).otherwise(F.lit(0)) + F.when(tie, 1).otherwise(0)

    place = F.aggregate(F.transform("loads", before), F.lit(1).cast("long"), lambda a, b: a + b)
    return numbered.join(cells.select("size", "fold", place.alias("nth")), ["size", "nth"]).select(group, "fold")


def manifest(keys: DataFrame, folds: DataFrame, group: str, k: int, offset: int = 1) -> DataFrame:
    """Every key in every fold with its role: the fold itself is test, the one ``offset`` after it val, the others train."""
    rows = keys.join(folds.withColumnRenamed("fold", "county_outer_fold"), group).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rows = rows.withColumn("validation_fold", (F.col("fold") + offset) % k)
    role = F.when(F.col("county_outer_fold") == F.col("fold"), "test").when(F.col("county_outer_fold") == F.col("validation_fold"), "val").otherwise("train")
    return rows.withColumn("split", role)


def held_out_states(keys: DataFrame, state: str, least: int) -> DataFrame:
    """Every key in every fold of an eligible state (at least ``least`` keys): that state is test, the next one in order val."""
    per = keys.groupBy(state).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    order = W.Window.orderBy(state)
    everything = W.Window.partitionBy()
    folds = per.select(F.col(state).alias("held_out"), (F.row_number().over(order) - 1).alias("fold"), F.coalesce(F.lead(state).over(order), F.min(state).over(everything)).alias("next"))
    rows = keys.join(per.select(state), state, "left_semi").crossJoin(F.broadcast(folds))  # one row a state
    return rows.withColumn("split", F.when(F.col(state) == F.col("held_out"), "test").when(F.col(state) == F.col("next"), "val").otherwise("train")).drop("next")


def held_out_years(keys: DataFrame) -> DataFrame:
    years = keys.select(F.col("year").alias("held_out_year")).distinct()
    return keys.crossJoin(F.broadcast(years)).withColumn("split", F.when(F.col("year") == F.col("held_out_year"), "test").otherwise("train"))


def inner_years(outer: DataFrame) -> DataFrame:
    """For each held-out year, each other year as the inner validation one; rows of the held-out year are left out."""
    years = outer.select(F.col("year").alias("inner_year")).distinct()
    rows = outer.where("split = 'train'").crossJoin(F.broadcast(years)).where("inner_year <> held_out_year")
    return rows.withColumn("inner_split", F.when(F.col("year") == F.col("inner_year"), "val").otherwise("train"))


def one_fold(man: DataFrame, fold: int, key: str = "key", offset: int = 1) -> DataFrame:
    """(key, split) of one fold. Where it has no val rows, the test keys of the fold ``offset`` places further in the sorted list are val."""
    folds = man.select("fold").distinct().withColumn("place", F.row_number().over(W.Window.orderBy("fold")) - 1)
    n = F.count("*").over(W.Window.partitionBy())
    own = folds.withColumn("n", n).where(F.col("fold") == fold).select(((F.col("place") + offset) % F.col("n")).alias("place"))
    other = folds.join(own, "place").select("fold")
    derived = man.where("split = 'test'").join(F.broadcast(other), "fold", "left_semi").select(key, F.lit(True).alias("_val"))
    rows = man.where(F.col("fold") == fold).select(key, "split")
    has_val = rows.agg(F.count_if(F.col("split") == "val").alias("_has"))
    both = rows.join(derived, key, "left").join(F.broadcast(has_val))
    return both.select(key, F.when((F.col("_has") == 0) & F.col("_val") & (F.col("split") != "test"), "val").otherwise(F.col("split")).alias("split"))


def fold_checks(man: DataFrame, k: int, *, group: str = "county_id", key: str = "key") -> DataFrame:
    """Each group has one role in a fold and is tested once; each key is in every fold."""
    roles = man.groupBy("fold", group).agg(F.count_distinct("split").alias("n"))
    tested = man.groupBy(group).agg(F.count_distinct(F.when(F.col("split") == "test", F.col("fold"))).alias("n"))
    keys = man.groupBy(key).agg(F.count_distinct("fold").alias("n"), F.count_if(F.col("split") == "test").alias("t"))
    a = row_checks(roles, {"one_role_per_fold": F.col("n") != 1}, F.concat_ws("-", "fold", group))
    b = row_checks(tested, {"one_test_fold": F.col("n") != 1}, F.col(group))
    c = row_checks(keys, {"in_every_fold": F.col("n") != k, "tested_once": F.col("t") != 1}, F.col(key))
    return a.unionByName(b).unionByName(c)


def years_per_partition(man: DataFrame) -> DataFrame:
    """Per fold and role: rows, groups, and whether every year of the manifest is in it."""
    years = man.select("year").distinct().agg(F.count("*").alias("all_years"))
    per = man.groupBy("fold", "split").agg(F.count("*").alias("n"), F.count_distinct("county_id").alias("counties"), F.count_distinct("year").alias("years"))
    return per.join(F.broadcast(years)).withColumn("complete", F.col("years") == F.col("all_years")).drop("all_years")


def state_fold_checks(man: DataFrame, state: str) -> DataFrame:
    """Held-out states: one state is tested in a fold, and a state in one fold."""
    test = man.where("split = 'test'")
    a = row_checks(test.groupBy("fold").agg(F.count_distinct(state).alias("n")), {"one_state_per_fold": F.col("n") != 1}, F.col("fold"))
    b = row_checks(test.groupBy(state).agg(F.count_distinct("fold").alias("n")), {"one_fold_per_state": F.col("n") != 1}, F.col(state))
    return a.unionByName(b)
