"""Checks that fail closed: each gives a row (check_name, n_bad, sample), and ``require`` raises if any n_bad is above zero.

All row checks of a table are one aggregate, so that validating it costs one job and one for its keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import finite, is_finite

EXAMPLES = 5


class CheckFailed(ValueError):
    """A check found rows that must not exist."""


def row_checks(df: DataFrame, checks: dict[str, Column], key: Column) -> DataFrame:
    """A row per named condition that marks bad rows, with the smallest key as example: one aggregate with two numbers a condition."""
    bad = df.select(key.cast("string").alias("_key"), *[F.coalesce(c, F.lit(True)).alias(f"_{k}") for k, c in enumerate(checks.values())])
    sums = [x for k in range(len(checks)) for x in (F.count_if(f"_{k}").alias(f"_n{k}"), F.min(F.when(F.col(f"_{k}"), F.col("_key"))).alias(f"_s{k}"))]
    rows = [F.struct(F.lit(name).alias("check_name"), F.col(f"_n{k}").alias("n_bad"), F.col(f"_s{k}").alias("sample")) for k, name in enumerate(checks)]
    return bad.agg(*sums).select(F.inline(F.array(*rows)))


def duplicate_check(df: DataFrame, keys: list[str], name: str = "duplicate_key") -> DataFrame:
    """Keys that have more than one row."""
    twice = df.groupBy(*keys).count().where("count > 1")
    return twice.agg(F.lit(name).alias("check_name"), F.count("*").alias("n_bad"), F.min(F.concat_ws("-", *[F.col(k).cast("string") for k in keys])).alias("sample"))


def key_difference(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys of either side that the other lacks (two rows: missing and extra)."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, keys, "full")
    text = F.concat_ws("-", *[F.col(k).cast("string") for k in keys])
    gone = both.agg(F.count_if(F.expr("_l is null")).alias("extra"), F.count_if(F.expr("_r is null")).alias("missing"), F.min(F.when(F.col("_l").isNull(), text)).alias("e"), F.min(F.when(F.col("_r").isNull(), text)).alias("m"))
    return gone.select(F.explode(F.array(F.struct(F.lit(f"{name}_missing").alias("check_name"), F.col("missing").alias("n_bad"), F.col("m").alias("sample")), F.struct(F.lit(f"{name}_extra").alias("check_name"), F.col("extra").alias("n_bad"), F.col("e").alias("sample")))).alias("x")).select("x.*")


def examples(df: DataFrame, bad: Column, key: str, n: int = EXAMPLES) -> DataFrame:
    """The first keys in order that a condition holds for."""
    return df.where(bad).select(key).distinct().orderBy(key).limit(n)


def finite_checks(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Numbers that must be neither null, NaN nor infinite."""
    return row_checks(df, {f"finite_{c}": ~finite(F.col(c)) for c in columns}, F.col(key))


def combine(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(*checks: DataFrame) -> None:
    bad = [r for r in combine(*checks).where("n_bad > 0").orderBy("check_name").collect()]
    if bad:
        raise CheckFailed("; ".join(f"{r['check_name']}: {r['n_bad']} (e.g. {r['sample']})" for r in bad))


def embedding_checks(df: DataFrame) -> DataFrame:
    """An embedding table: key columns filled, steps not negative, vectors non-empty and finite, one width, unique keys."""
    for c in ("county_id", "year", "patch_id", "timestep", "backbone", "embedding"):
        if c not in df.columns:
            raise CheckFailed(f"missing column {c}")
    keys = ["county_id", "year", "patch_id", "timestep", "backbone"]
    rows = row_checks(
        df,
        {
            "null_key": reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]),
            "negative_timestep": F.col("timestep") < 0,
            "empty_vector": F.size("embedding") < 1,
            "not_finite": ~is_finite(F.col("embedding")),
        },
        F.concat_ws("-", *keys),
    )
    width = df.agg(F.lit("width").alias("check_name"), F.greatest(F.count_distinct(F.size("embedding")) - 1, F.lit(0)).alias("n_bad"), F.concat_ws(",", F.array_sort(F.collect_set(F.size("embedding").cast("string")))).alias("sample"))
    return combine(rows, width, duplicate_check(df, keys))


def uniform(df: DataFrame, column: str) -> DataFrame:
    """One row: the number of distinct values of a column, and the smallest and the largest."""
    return df.agg(F.lit(column).alias("column_name"), F.count_distinct(column).alias("n_values"), F.min(F.col(column).cast("string")).alias("low"), F.max(F.col(column).cast("string")).alias("high"))


def representation_checks(df: DataFrame, *, backbone: str, scope: str = "timestep", forbidden: tuple[str, ...] = ("daymet", "era5", "climate")) -> DataFrame:
    """An unfused representation: one backbone, one scope, no climate modality."""
    checks = {"backbone": F.col("backbone") != backbone}
    if "representation_scope" in df.columns:
        checks["scope"] = F.col("representation_scope") != scope
    if "input_modalities" in df.columns:
        checks["climate_modality"] = F.lower("input_modalities").rlike("|".join(forbidden))
    if "fusion_stage" in df.columns:
        checks["fused"] = F.coalesce(F.col("fusion_stage"), F.lit("none")) != "none"
    return row_checks(df, checks, F.concat_ws("-", "county_id", "year", "patch_id"))


def encoder_checks(df: DataFrame, *, backbone: str = "presto_s2_era5", family: str = "auxiliary_climate_fusion", source: str = "era5") -> DataFrame:
    """An encoder that reads climate: its backbone, its experiment family, and one list of modalities that names the source."""
    checks = {"backbone": F.col("backbone") != backbone}
    if "experiment_family" in df.columns:
        checks["family"] = F.lower("experiment_family") != family
    if "input_modalities" in df.columns:
        checks["climate_source"] = ~F.lower("input_modalities").contains(source)
    rows = row_checks(df, checks, F.concat_ws("-", "county_id", "year", "patch_id"))
    if "input_modalities" not in df.columns:
        return rows
    one = uniform(df, "input_modalities").select(F.lit("one_modality_list").alias("check_name"), F.greatest(F.col("n_values") - 1, F.lit(0)).alias("n_bad"), F.col("low").alias("sample"))
    return combine(rows, one)


def matched_checks(reference: DataFrame, other: DataFrame, name: str, *, tolerance: float = 0.0) -> DataFrame:
    """Two representations of one cohort: the same keys, equal targets, the same patches. Columns key, target, n_patches, patch_ids."""
    right = other.select("key", F.col("target").alias("t2"), F.col("n_patches").alias("n2"), F.col("patch_ids").alias("p2"))
    both = reference.join(right, "key")
    rows = row_checks(both, {
        f"{name}_target": ~(F.abs(F.col("target") - F.col("t2")) <= tolerance), f"{name}_patch_count": ~F.col("n_patches").eqNullSafe(F.col("n2")), f"{name}_patch_ids": ~F.col("patch_ids").eqNullSafe(F.col("p2")),
    }, F.col("key"))
    return combine(key_difference(reference, other, ["key"], f"{name}_key"), rows)


def reported_checks(calculated: DataFrame, reported: DataFrame, keys: list[str], metrics: list[str], *, rtol: float = 1e-5, atol: float = 1e-5) -> DataFrame:
    """Reported metrics equal the recomputed ones within the tolerances; absent rows count as bad."""
    r = reported.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics], F.lit(1).alias("_there"))
    both = calculated.join(r, keys, "left")
    close = lambda m: F.abs(F.col(m) - F.col(f"_{m}")) <= atol + rtol * F.abs(F.col(f"_{m}"))
    same = lambda m: (F.col(m).isNull() & F.col(f"_{m}").isNull() & F.col("_there").isNotNull()) | F.coalesce(close(m), F.lit(False))
    return row_checks(both, {f"reported_{m}": ~same(m) for m in metrics}, F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))


def equal_columns_check(df: DataFrame, left: str, right: str, key: str, tolerance: float = 1e-9) -> DataFrame:
    return row_checks(df, {f"{left}_{right}": ~(F.abs(F.col(left) - F.col(right)) <= tolerance)}, F.col(key))


def grid_check(found: DataFrame, axes: dict[str, DataFrame], name: str = "grid") -> DataFrame:
    """Cells of the product of the axes (small tables with the named column) that have no run."""
    grid = None
    for column, values in axes.items():
        v = values.select(column).distinct()
        grid = v if grid is None else grid.crossJoin(v)
    lost = grid.join(found.select(*axes).distinct(), list(axes), "left_anti")
    return lost.agg(F.lit(name).alias("check_name"), F.count("*").alias("n_bad"), F.min(F.concat_ws("-", *[F.col(c).cast("string") for c in axes])).alias("sample"))


def signature(fields: list[Column]) -> Column:
    """A hash of chosen fields of a contract."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def same_signature_check(df: DataFrame, fields: list[str], key: str, name: str = "signature") -> DataFrame:
    """All rows have the signature of the row with the smallest key."""
    marked = df.select(F.col(key).cast("string").alias("key"), signature([F.col(f) for f in fields]).alias("sig"))
    lead = marked.agg(F.min_by("sig", "key").alias("lead"))
    return row_checks(marked.join(F.broadcast(lead), F.lit(True)), {name: F.col("sig") != F.col("lead")}, F.col("key"))


def target_drift_check(predictions: DataFrame, key: str = "key", observed: str = "observed", tolerance: float = 1e-9) -> DataFrame:
    spread = predictions.groupBy(key).agg((F.max(observed) - F.min(observed)).alias("spread"))
    return row_checks(spread, {"target_drift": F.col("spread") > tolerance}, F.col(key))


def coverage_check(df: DataFrame, cell: list[str], column: str, expected: int, name: str) -> DataFrame:
    """Cells whose number of distinct values of a column isn't the expected one."""
    n = df.groupBy(*cell).agg(F.count_distinct(column).alias("n"))
    return row_checks(n, {name: F.col("n") != expected}, F.concat_ws("-", *[F.col(c).cast("string") for c in cell]))


def contract_differences(contracts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each field of each contract against the first contract: (key, field, value, reference, equal)."""
    text = [F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f).alias("v")), {"ignoreNullFields": "false"}).alias("value")) for f in fields]
    long = contracts.select(F.col(key).alias("contract"), F.explode(F.array(*text)).alias("f")).select("contract", "f.*")
    lead = long.groupBy("field").agg(F.min_by("value", "contract").alias("reference"))
    return long.join(lead, "field").select("contract", "field", "value", "reference", F.col("value").eqNullSafe(F.col("reference")).alias("equal"))
