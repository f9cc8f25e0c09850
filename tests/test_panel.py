"""Functions, pooling, joins, folds and audits on small fixtures with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import ids, places, vectors
from fieldloom.operators import audit, panel, pooling, sequences, splits
from fieldloom.plans import queries as plans
from fieldloom.plans.domain import Domain
from fieldloom.sources import tables

EMB = "county_id string, year int, patch_id string, timestep int, backbone string, embedding array<float>"


def embeddings(spark, offsets, steps=7):
    rows = [("17001", 2020, p, t, "b", [float(o + t)]) for p, o in offsets.items() for t in range(steps)]
    return spark.createDataFrame(rows, EMB)


def one(df, column):
    return df.first()[column]


@pytest.mark.parametrize("raw,want", [("17001.0", "17001"), (" 101 ", "00101"), ("1234567", "1234567"), ("ab", "ab"), (None, ""), ("1.5", "1.5")])
def test_region_id(spark, raw, want):
    assert one(spark.createDataFrame([(raw,)], "x string").select(ids.region_id(F.col("x")).alias("y")), "y") == want


@pytest.mark.parametrize("raw,want", [("1.5", 1.5), (" na ", None), ("unknown", None), ("inf", None), ("x", None), (None, None)])
def test_safe_double(spark, raw, want):
    assert one(spark.createDataFrame([(raw,)], "x string").select(ids.safe_double(F.col("x")).alias("y")), "y") == want


def test_label_ids_fill_without_a_digit_test(spark):
    assert one(spark.createDataFrame([("ab.0",)], "x string").select(ids.label_region_id(F.col("x")).alias("y")), "y") == "000ab"


def test_haversine_of_a_quarter(spark):
    km = one(spark.range(1).select(places.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("y")), "y")
    assert km == pytest.approx(places.EARTH_KM * math.pi / 2)


def test_climate_bands(spark):
    df = spark.createDataFrame([("T2M", 200.0, 300.0), ("tp", 0.0, 9.0), ("other", -1.0, 1.0)], "b string, lo double, hi double").withColumn("c", places.climate_band(F.col("b")))
    got = df.select("c", places.plausible(F.col("c"), F.col("lo"), F.col("hi")).alias("ok")).collect()
    assert [tuple(r) for r in got] == [("temperature", True), ("precipitation", False), ("other", True)]


def test_two_stage_and_joint_pool(spark):
    df = pooling.only_complete(embeddings(spark, {"a": 0, "b": 2}), list(range(7)))
    pooled = pooling.spatial_pool(df, 1)
    assert one(pooling.temporal_mean(pooled, 2), "features") == [4.0, 1.0]
    joint = one(pooling.joint_pool(df, 1), "features")
    assert joint == pytest.approx([4.0, math.sqrt(5)])
    assert one(pooling.joint_of_steps(pooled, 1), "features") == pytest.approx(joint)


def test_incomplete_and_extra_steps_disqualify(spark):
    df = embeddings(spark, {"a": 0}).union(embeddings(spark, {"b": 1000}, 6)).union(embeddings(spark, {"c": 1000}, 8))
    assert [r["patch_id"] for r in pooling.complete_patches(df, list(range(7))).collect()] == ["a"]


def test_sequence_scope(spark):
    df = spark.createDataFrame([("1", 2020, p, 0, "b", [v]) for p, v in (("a", 2.0), ("b", 4.0))], EMB)
    row = pooling.sequence_pool(df, 1).first()
    assert row["features"] == [3.0, 1.0] and row["n"] == 2


def test_wide_pool_lowerings_agree(spark):
    rows = [("1", 2020, f"p{k}", 0, "b", [float((k * j) % 11) for j in range(300)]) for k in range(5)]
    df = spark.createDataFrame(rows, EMB)
    wide = vectors.stats_by_position(df, ["county_id"], "embedding", 300).first()
    narrow = vectors.stats_by_position(df.withColumn("embedding", F.slice("embedding", 1, 200)), ["county_id"], "embedding", 200).first()
    assert wide["m"][:200] == pytest.approx(narrow["m"]) and wide["s"][:200] == pytest.approx(narrow["s"])


def test_row_order_does_not_matter(spark):
    df = embeddings(spark, {"a": 0, "b": 2})
    assert pooling.joint_pool(df, 1).collect() == pooling.joint_pool(df.orderBy(F.rand(3)), 1).collect()


def test_wide_vector_wants_equal_steps(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "tmax_4 double, tmax_5 double, tmin_4 double")
    with pytest.raises(ValueError, match="tmin has 1 intervals"):
        vectors.wide_vector(df, ["tmax", "tmin"])


def test_wide_vector_orders(spark):
    df = spark.createDataFrame([tuple(float(k) for k in range(4))], "a_10 double, a_9 double, b_9 double, b_10 double")
    assert one(vectors.wide_vector(df, ["a", "b"]), "features") == [1.0, 0.0, 2.0, 3.0]
    assert one(vectors.wide_vector(df, ["a", "b"], order="time"), "features") == [1.0, 2.0, 0.0, 3.0]


def test_vector_forms(spark):
    import numpy as np

    df = spark.createDataFrame([("[1.5, 2]", bytearray(np.array([1, 2], "<f4").tobytes()))], "t string, b binary")
    row = df.select(vectors.from_text(F.col("t")).alias("t"), vectors.from_bytes("b").alias("b")).first()
    assert row["t"] == [1.5, 2.0] and row["b"] == [1.0, 2.0]


def test_checks_reject(spark):
    good = embeddings(spark, {"a": 0})
    audit.require(audit.embedding_checks(good))
    for bad in (good.union(good), good.withColumn("embedding", F.array(F.lit(float("nan")).cast("float"))), good.withColumn("timestep", F.col("timestep") - 3), good.withColumn("embedding", F.when(F.col("timestep") == 0, F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))).otherwise(F.col("embedding")))):
        with pytest.raises(audit.CheckFailed):
            audit.require(audit.embedding_checks(bad))


def test_duplicate_labels_reject(spark):
    labels = spark.createDataFrame([("1", 2020, "3"), ("1", 2020, "4")], "county_id string, year int, y string")
    with pytest.raises(audit.CheckFailed):
        tables.strict_labels(labels, ["county_id", "year"], "y")
    assert one(tables.label_lookup(labels.withColumn("n", F.monotonically_increasing_id()), ["county_id", "year"], "y", "n"), "y") in (3.0, 4.0)


def test_missing_companion_rejects(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(audit.CheckFailed, match="companion_missing"):
        panel.companions(a, b, ["k"])
    with pytest.raises(audit.CheckFailed):
        panel.restrict(b, a, "k")


def greedy(sizes, k):
    load, fold = [0] * k, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], [-ord(c) for c in g])):
        f = load.index(min(load))
        fold[g], load[f] = f, load[f] + sizes[g]
    return fold


@pytest.mark.parametrize("seed", range(4))
def test_grouped_folds_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    sizes = {f"g{i:03d}": rng.randint(1, 6) for i in range(rng.randint(5, 40))}
    keys = spark.createDataFrame([(g, f"{g}-{j}") for g, n in sizes.items() for j in range(n)], "county_id string, key string")
    assert {r["county_id"]: r["fold"] for r in splits.grouped_folds(keys, "county_id", 3).collect()} == greedy(sizes, 3)


def test_fold_checks_find_leaks(spark):
    man = spark.createDataFrame([("a-1", "a", 0, "test"), ("a-2", "a", 0, "train"), ("a-1", "a", 1, "train"), ("a-2", "a", 1, "train")], "key string, county_id string, fold int, split string")
    bad = {r["check_name"]: r["n_bad"] for r in splits.fold_checks(man, 2).collect()}
    assert bad["one_role_per_fold"] == 1 and bad["tested_once"] == 1 and bad["in_every_fold"] == 0


def test_one_fold_keeps_its_own_validation(spark):
    man = spark.createDataFrame([("a", 0, "test"), ("b", 0, "val"), ("a", 1, "train"), ("b", 1, "test")], "key string, fold int, split string")
    assert {tuple(r) for r in splits.one_fold(man, 0).collect()} == {("a", "test"), ("b", "val")}
    without = man.where("split <> 'val'").union(spark.createDataFrame([("b", 0, "train")], "key string, fold int, split string"))
    assert {tuple(r) for r in splits.one_fold(without, 0).collect()} == {("a", "test"), ("b", "val")}


def test_carry_forward_seeds_with_the_first(spark):
    df = spark.createDataFrame([("p", 2, 5.0), ("p", 4, 7.0)], "k string, timestep int, v double")
    got = sequences.carried_forward(df, ["k"], 6, "v").orderBy("timestep").collect()
    assert [r["v"] for r in got] == [5.0, 5.0, 5.0, 5.0, 7.0, 7.0] and [r["carried"] for r in got] == [True, True, False, True, False, True]


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0)], "k int, a double, b double")
    assert one(sequences.correlation(df, ["k"], "a", "b"), "r") is None


def test_samples_do_not_depend_on_order(spark):
    df = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("i"))
    a = sequences.deterministic_sample(df, ["k"], "i", 5, "s").select("i").collect()
    assert sorted(a) == sorted(sequences.deterministic_sample(df.orderBy(F.desc("id")), ["k"], "i", 5, "s").select("i").collect()) and len(a) == 5


def test_plans_prune_and_avoid_products(spark):
    from fieldloom.plans import queries as plans

    for name in ("j03_late_fusion", "a05_joint_pool", "f02_manifest"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
    plan = plans.QUERIES["j01_labelled"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in plan and "o_orderpriority" not in plan and "PushedFilters" in plan


def test_families_and_bands(spark):
    df = spark.createDataFrame([("s2,ERA5", "late"), ("s2", "late"), ("era5", None), ("s2", None)], "m string, f string")
    assert [r["x"] for r in df.select(ids.experiment_family(F.col("m"), F.col("f")).alias("x")).collect()] == ["both", "late_fusion", "input_fusion", "unfused"]
    assert one(spark.range(1).select(ids.band_name(F.lit(" b2 ")).alias("x")), "x") == "B02"


def test_matched_checks_name_each_difference(spark):
    df = spark.createDataFrame([("a", 1.0, 1, ["p"]), ("b", 2.0, 1, ["q"])], "key string, target double, n_patches int, patch_ids array<string>")
    assert {r["n_bad"] for r in audit.matched_checks(df, df, "x").collect()} == {0}
    for column, value, name in (("target", F.col("target") + 1, "x_target"), ("n_patches", F.lit(2), "x_patch_count"), ("patch_ids", F.array(F.lit("z")), "x_patch_ids")):
        bad = {r["check_name"]: r["n_bad"] for r in audit.matched_checks(df, df.withColumn(column, value), "x").collect()}
        assert bad[name] == 2 and sum(bad.values()) == 2
    assert {r["check_name"]: r["n_bad"] for r in audit.matched_checks(df, df.where("key = 'a'"), "x").collect()}["x_key_missing"] == 1


def test_reported_metrics_and_grid_reject(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, r2 double")
    assert audit.reported_checks(df, df, ["k"], ["r2"]).first()["n_bad"] == 0
    assert audit.reported_checks(df, df.where("k = 'a'"), ["k"], ["r2"]).first()["n_bad"] == 1
    grid = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "m string, f int")
    row = audit.grid_check(grid, {"m": grid, "f": grid}).first()
    assert (row["n_bad"], row["sample"]) == (1, "b-2")


def test_matched_cohorts_read_one_table_of_labels(spark, monkeypatch):
    """Prices that differ by a last digit whenever they are worked out, as sums over shuffles may, don't differ from themselves."""
    table = Domain.table
    shaken = F.udf(lambda x: x * (1 + 1e-12 * random.random()), "double").asNondeterministic()
    monkeypatch.setattr(Domain, "table", lambda d, name: table(d, name).withColumn("o_totalprice", shaken("o_totalprice")) if name == "orders" else table(d, name))
    got = {r["check_name"]: r["n_bad"] for r in plans.QUERIES["v02_matched_cohorts"](spark, "/root/testdata/sf0.001").collect()}
    labels = Domain(spark, "/root/testdata/sf0.001").labels()
    assert got["b_target"] == labels.where("year = 1997").count() > 0 and got["b_key_extra"] == 0
