"""Registered queries over the domain tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, places, vectors
from ..operators import audit, grid, linear, metrics, panel, pooling, sequences, splits, tiles, trees
from ..operators.numbering import numbered
from ..sources import tables
from ..streaming import patches
from ..sources import tiles as tile_files
from .domain import CLIMATE, FOLDS, INDEX, STEPS, Domain, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WIDTH = 64


def r6(df: DataFrame) -> DataFrame:
    """Six places, and no negative zeros."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, *uses: str):
    def register(f: Callable[[Domain], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_tables(sql, *uses) if uses else sql
        return f

    return register


# Identifiers, names, numbers, dates, places


@query(r"""WITH m AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS VARCHAR) || '.0' WHEN 1 THEN '  ' || CAST(c_custkey AS VARCHAR) || ' ' WHEN 2 THEN 'c' || CAST(c_custkey AS VARCHAR) WHEN 3 THEN CAST(c_custkey * 1000 AS VARCHAR) END AS raw FROM customer),
t AS (SELECT *, trim(coalesce(raw, '')) AS x FROM m), u AS (SELECT *, CASE WHEN regexp_full_match(x, '\d+\.0') THEN regexp_replace(x, '\.0$', '') ELSE x END AS y, regexp_replace(trim(raw), '\.0$', '') AS z, regexp_extract(raw, '(\d+)', 1) AS d FROM t)
SELECT c_custkey, CASE WHEN regexp_full_match(y, '\d+') AND length(y) < 5 THEN lpad(y, 5, '0') ELSE y END AS full_id, CASE WHEN length(z) < 5 THEN lpad(z, 5, '0') ELSE z END AS label_id, CASE WHEN length(d) < 5 THEN lpad(d, 5, '0') ELSE d END AS digits_id FROM u""")
def p01_region_ids(d: Domain) -> DataFrame:
    key = F.col("c_custkey")
    raw = F.when(key % 5 == 0, F.concat(key.cast("string"), F.lit(".0"))).when(key % 5 == 1, F.concat(F.lit("  "), key.cast("string"), F.lit(" "))).when(key % 5 == 2, F.concat(F.lit("c"), key.cast("string"))).when(key % 5 == 3, (key * 1000).cast("string"))
    return d.table("customer").select("c_custkey", ids.region_id(raw).alias("full_id"), ids.label_region_id(raw).alias("label_id"), ids.digits_region_id(raw).alias("digits_id"))


@query(r"""SELECT n_nationkey, regexp_replace(regexp_replace(lower(trim('  ' || n_name || '   COUNTY ')), '\s+county$', ''), '\s+', ' ', 'g') AS name, lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS fips FROM nation""")
def p03_names_and_codes(d: Domain) -> DataFrame:
    return d.table("nation").select("n_nationkey", ids.region_name(F.concat(F.lit("  "), "n_name", F.lit("   COUNTY "))).alias("name"), ids.fips(F.col("n_regionkey"), F.col("n_nationkey")).alias("fips"))


@query("SELECT key, split_part(key, '-', 1) AS region, TRY_CAST(nullif(regexp_extract(key, '^.+-(\\d{4})$', 1), '') AS INT) AS key_year, substr(key, 1, 2) AS state FROM labels", "labels")
def p05_keys(d: Domain) -> DataFrame:
    k = F.col("key")
    return d.labels().select("key", ids.key_region(k).alias("region"), ids.key_year(k).alias("key_year"), ids.state_of(k).alias("state"))


@query("""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' Validation ' WHEN 1 THEN 'TRAIN' WHEN 2 THEN 'hold_out' ELSE 'test' END AS raw FROM orders)
SELECT o_orderkey, CASE replace(lower(trim(raw)), '_', '-') WHEN 'validation' THEN 'val' ELSE replace(lower(trim(raw)), '_', '-') END AS role FROM v""")
def p07_role_names(d: Domain) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, " Validation ").when(k % 4 == 1, "TRAIN").when(k % 4 == 2, "hold_out").otherwise("test")
    return d.table("orders").select("o_orderkey", ids.role_name(raw).alias("role"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 IN (0, 1, 2) THEN NULL ELSE round(c_acctbal, 2) END AS number, count(*) OVER (PARTITION BY c_custkey % 7 IN (0, 1, 2)) AS n_alike FROM customer""")
def p08_safe_numbers(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 7 == 0, " n/a ").when(k % 7 == 1, "nan").when(k % 7 == 2, "").otherwise(F.round("c_acctbal", 2).cast("string"))
    out = d.table("customer").select("c_custkey", ids.safe_double(text).alias("number")).withColumn("missing", F.col("number").isNull())
    alike = out.groupBy("missing").agg(F.count("*").alias("n_alike"))  # two rows
    return out.join(F.broadcast(alike), "missing").select("c_custkey", "number", "n_alike")


@query("""SELECT event_id, CAST(month(ts) - 1 AS INT) AS month_index, CAST(year(ts) AS DOUBLE) AS year_part, CAST(dayofyear(ts) - 1 AS DOUBLE) AS day_part, round(sin(weekofyear(ts) * 2 * pi() / 52), 6) + 0.0 AS week_sin, round(cos(weekofyear(ts) * 2 * pi() / 52), 6) + 0.0 AS week_cos,
round(sin((hour(ts) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0) * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos((hour(ts) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0) * 2 * pi() / 24), 6) + 0.0 AS hour_cos FROM events""")
def p12_calendar(d: Domain) -> DataFrame:
    ts = F.col("ts")
    out = d.table("events").select("event_id", places.month_index(ts).alias("month_index"), places.year_day(ts).alias("y"), places.week_hour(ts).alias("w"))
    return r6(out.select("event_id", "month_index", F.col("y")[0].alias("year_part"), F.col("y")[1].alias("day_part"), *[F.col("w")[k].alias(n) for k, n in enumerate(("week_sin", "week_cos", "hour_sin", "hour_cos"))]))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 2 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS parsed FROM lineitem""")
def p11_dates(d: Domain) -> DataFrame:
    k = F.col("l_orderkey")
    text = F.when(k % 3 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("l_shipdate", "yyyyMMdd")).otherwise("no date")
    return d.table("lineitem").select("l_orderkey", "l_linenumber", places.date_of(text).cast("string").alias("parsed"))


GEO = "SELECT c_custkey, CAST(c_custkey % 200 AS DOUBLE) - 100 AS lat, CAST(c_custkey * 7 % 400 AS DOUBLE) - 200 AS lon FROM customer"


def _geo(d: Domain) -> DataFrame:
    return d.table("customer").select("c_custkey", ((F.col("c_custkey") % 200).cast("double") - 100).alias("lat"), ((F.col("c_custkey") * 7 % 400).cast("double") - 200).alias("lon"))


@query(f"""WITH g AS ({GEO}), h AS (SELECT *, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS ok FROM g)
SELECT c_custkey, ok, CASE WHEN ok THEN round(sin(radians(lat)), 6) END AS lat_sin, CASE WHEN ok THEN round(cos(radians(lon)), 6) END AS lon_cos,
CASE WHEN ok THEN round(2 * 6371.0088 * asin(sqrt(least(pow(sin(radians(40 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin(radians(-90 - lon) / 2), 2), 1.0))), 3) END AS km FROM h""")
def p14_places(d: Domain) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    out = _geo(d).withColumns({"ok": places.in_range(lat, lon), "c": places.lat_lon_circle(lat, lon), "km": places.haversine_km(lat, lon, F.lit(40.0), F.lit(-90.0))})
    return out.select("c_custkey", "ok", F.round(F.col("c")[0], 6).alias("lat_sin"), F.round(F.col("c")[3], 6).alias("lon_cos"), F.when(F.col("ok"), F.round("km", 3)).alias("km"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CASE WHEN vec_id % 2 = 0 THEN 10000 ELSE 1 END) AS p FROM embeddings), u AS (SELECT vec_id, p, list_max(list_transform(p, lambda x: abs(x))) > 2.0 AS dn FROM e)
SELECT vec_id, CASE WHEN dn THEN 'dn' ELSE 'reflectance' END AS unit, round(list_sum(list_transform(p, lambda x: least(greatest(x / CASE WHEN dn THEN 10000.0 ELSE 1.0 END, 0.0), 1.0))), 6) AS total FROM u""")
def p17_units(d: Domain) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("vec_id") % 2 == 0, 10000).otherwise(1))
    out = d.table("embeddings").select("vec_id", scaled.alias("p"))
    total = F.aggregate(places.reflectance(F.col("p")), F.lit(0.0), lambda s, x: s + x)
    return out.select("vec_id", places.unit_of(F.col("p")).alias("unit"), F.round(total, 6).alias("total"))


@query("""SELECT county_id, year, list_min(CASE WHEN list_min(present) >= 1 AND list_max(present) <= 7 THEN [1, 2, 3, 4, 5, 6, 7] ELSE [0, 1, 2, 3, 4, 5, 6] END) AS first_step, CAST(len(present) AS INT) AS n_present
FROM (SELECT county_id, year, list_sort(list(DISTINCT timestep + year % 2)) AS present FROM measures GROUP BY ALL)""", "measures")
def p20_schedule(d: Domain) -> DataFrame:
    rows = d.measures().groupBy("county_id", "year").agg(F.collect_set(F.col("timestep") + F.col("year") % 2).alias("present"))
    return rows.select("county_id", "year", F.array_min(tile_files.expected_schedule(F.col("present"), 7)).alias("first_step"), F.size("present").alias("n_present"))


@query("""SELECT o_orderkey, CASE WHEN t = e + p + 1 THEN 'early_stopping' WHEN t >= c THEN 'epoch_cap_reached' END AS termination
FROM (SELECT o_orderkey, o_orderkey % 50 AS e, o_orderkey % 60 + 6 AS t, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 5 END AS p, 40 AS c FROM orders) WHERE p IS NOT NULL
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 11 = 0""")
def p22_termination(d: Domain) -> DataFrame:
    k = F.col("o_orderkey")
    rows = d.table("orders").select("o_orderkey", (k % 50).alias("epoch"), (k % 60 + 6).alias("epochs_trained"), F.when(k % 11 != 0, 5).alias("patience"), F.lit(40).alias("max_epochs_configured"))
    return tiles.termination(rows).select("o_orderkey", "termination")


def _wide_sql(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT county_id, year, {7 * k} + timestep AS pos, {n} AS value FROM whole" for k, n in enumerate(names))


WHOLE = "whole AS (SELECT * FROM measures SEMI JOIN (SELECT county_id, year FROM measures GROUP BY ALL HAVING count(*) = 7) USING (county_id, year))"


def _index_vectors(d: Domain, names: list[str]) -> DataFrame:
    wide = vectors.wide_vector(d.wide(names), names, steps=[s + 4 for s in STEPS])
    return wide.where(vectors.complete([c for c in wide.columns if c not in ("county_id", "year", "features")])).select("county_id", "year", "features")


@query(f"SELECT county_id, year, CAST(pos AS INT) AS pos, round(value, 6) AS value FROM (WITH {WHOLE} {_wide_sql(INDEX)})", "measures")
def p23_index_vectors(d: Domain) -> DataFrame:
    return vectors.long_form(_index_vectors(d, INDEX), ["county_id", "year"], "features")


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, CAST(len(embedding) AS INT) AS width, vec_id % 9 <> 0 AS finite FROM embeddings""")
def p10_vector_text(d: Domain) -> DataFrame:
    text = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ", "), F.lit("]"))
    back = d.table("embeddings").select("vec_id", vectors.from_text(text).alias("v"))
    spoilt = F.when(F.col("vec_id") % 9 == 0, F.array_append("v", F.lit(float("nan")))).otherwise(F.col("v"))
    return back.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.size("v").alias("width"), vectors.is_finite(spoilt).alias("finite"))


# Sources


@query("""SELECT county_id, year, max(round(v, 6)) AS target FROM (SELECT county_id, year, last(target ORDER BY k) AS v FROM (SELECT county_id, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS target, o_orderkey AS k FROM orders JOIN regions ON o_custkey = c_custkey WHERE o_orderkey % 10 <> 0) GROUP BY ALL) GROUP BY ALL""", "regions")
def s24_label_lookup(d: Domain) -> DataFrame:
    rows = d.table("orders").join(d.regions(), F.col("o_custkey") == F.col("c_custkey")).select("county_id", F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 10 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("target"), "o_orderkey")
    return r6(tables.label_lookup(rows, ["county_id", "year"], "target", "o_orderkey"))


@query("SELECT county_id, year, round(target, 6) AS target FROM labels", "labels")
def s25_strict_labels(d: Domain) -> DataFrame:
    rows = d.labels().select("county_id", "year", F.col("target").cast("string").alias("target"))
    return r6(tables.strict_labels(rows, ["county_id", "year"], "target"))


@query("""SELECT county_id, year, 'county' AS patch_id, CAST(0 AS INT) AS timestep, 'wide' AS backbone, CAST(timestep AS INT) AS pos, round(CAST(CAST(evi AS FLOAT) AS DOUBLE), 4) AS value FROM measures SEMI JOIN (SELECT county_id, year FROM measures GROUP BY ALL HAVING count(*) = 7) USING (county_id, year)""", "measures")
def s09_wide_adapter(d: Domain) -> DataFrame:
    wide = d.wide(["evi"]).dropna()
    wide = wide.select(F.col("county_id").alias("GEOID"), F.lit("name").alias("county"), "year", *[F.col(f"evi_{s + 4}").alias(f"mean_A{s:02d}") for s in STEPS])
    return vectors.long_form(tables.adapt_wide(wide, backbone="wide", width=7), ["county_id", "year", "patch_id", "timestep", "backbone"], "embedding", 4)


@query("SELECT check_name, CAST(0 AS BIGINT) AS n_bad FROM (VALUES ('null_key'), ('negative_timestep'), ('empty_vector'), ('not_finite'), ('width'), ('duplicate_key')) v(check_name)")
def v01_embedding_checks(d: Domain) -> DataFrame:
    return audit.embedding_checks(d.embeddings()).select("check_name", "n_bad")


# Pooling


@query("SELECT county_id, year, patch_id FROM done", "done")
def a01_complete_patches(d: Domain) -> DataFrame:
    return pooling.complete_patches(d.embeddings(), STEPS)


@query("SELECT county_id, year, patch_id, 7 AS steps, round(sum(x * (1 + timestep)), 4) AS weighted FROM cells GROUP BY ALL", "cells")
def a01_streamed_patches(d: Domain) -> DataFrame:
    """Complete patches of a stream that brings the rows in four batches, and a fifth of them twice."""
    number = F.regexp_extract("patch_id", r"(\d+)", 1).cast("long") * 7 + F.col("timestep")
    rows = d.embeddings().select("county_id", "year", "patch_id", "timestep", "embedding", F.timestamp_seconds(10**9 + number).alias("event_time"))
    twice = rows.unionByName(rows.where(number % 5 == 0)).withColumn("_batch", F.pmod(F.xxhash64("patch_id", "timestep", F.rand(3)), F.lit(4)))
    folder, out, checkpoint = (tables.scratch_dir(d.spark) for _ in range(3))
    twice.repartition(4, "_batch").drop("_batch").write.parquet(folder)
    made = patches.replay(rows, folder, out, checkpoint, lambda s: patches.streamed_patches(s, len(STEPS), late="3650 days"))
    weights = F.expr("transform(embedding, (x, i) -> x * (1 + i div 64))")
    return made.select("county_id", "year", "patch_id", "steps", F.round(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x), 4).alias("weighted"))


def _whole(d: Domain) -> DataFrame:
    return pooling.only_complete(d.embeddings(), STEPS)


SPATIAL = "SELECT county_id, year, timestep, pos, avg(x) AS m, stddev_pop(x) AS s FROM cells GROUP BY ALL"


@query(f"WITH p AS ({SPATIAL}) SELECT county_id, year, timestep, CAST(pos AS INT) AS pos, round(m, 6) AS value FROM p UNION ALL SELECT county_id, year, timestep, CAST(pos + 64 AS INT), round(s, 6) FROM p".replace("WITH p AS", "SELECT * FROM (WITH p AS", 1) + ")", "cells")
def a02_spatial_pool(d: Domain) -> DataFrame:
    return vectors.long_form(pooling.spatial_pool(_whole(d), WIDTH), ["county_id", "year", "timestep"], "features")


@query(f"SELECT * FROM (WITH p AS ({SPATIAL}) SELECT county_id, year, CAST(pos AS INT) AS pos, round(avg(m), 6) AS value FROM p GROUP BY ALL UNION ALL SELECT county_id, year, CAST(pos + 64 AS INT), round(avg(s), 6) FROM p GROUP BY ALL)", "cells")
def a03_temporal_mean(d: Domain) -> DataFrame:
    return vectors.long_form(pooling.temporal_mean(pooling.spatial_pool(_whole(d), WIDTH), 2 * WIDTH), ["county_id", "year"], "features")


@query(f"SELECT * FROM (WITH p AS ({SPATIAL}) SELECT county_id, year, CAST(timestep * 64 + pos AS INT) AS pos, round(m, 6) AS value FROM p)", "cells")
def a04_temporal_concat(d: Domain) -> DataFrame:
    return vectors.long_form(pooling.temporal_concat(pooling.spatial_pool(_whole(d), WIDTH, deviation=False)), ["county_id", "year"], "features")


JOINT = "SELECT * FROM (SELECT county_id, year, CAST(pos AS INT) AS pos, round(avg(x), 6) AS value FROM {0} GROUP BY ALL UNION ALL SELECT county_id, year, CAST(pos + 64 AS INT), round(stddev_pop(x), 6) FROM {0} GROUP BY ALL)"


@query(JOINT.format("cells"), "cells")
def a05_joint_pool(d: Domain) -> DataFrame:
    return vectors.long_form(pooling.joint_pool(_whole(d), WIDTH), ["county_id", "year"], "features")


@query(JOINT.format("cells"), "cells")
def a05_joint_of_steps(d: Domain) -> DataFrame:
    return vectors.long_form(pooling.joint_of_steps(pooling.spatial_pool(_whole(d), WIDTH), WIDTH), ["county_id", "year"], "features")


@query(JOINT.format("(SELECT county_id, year, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM emb)"), "emb")
def a06_flat_pool(d: Domain) -> DataFrame:
    return vectors.long_form(pooling.joint_pool(d.embeddings(), WIDTH), ["county_id", "year"], "features")


@query(JOINT.format("(SELECT county_id, year, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM emb WHERE timestep = 0)"), "emb")
def a07_sequence_pool(d: Domain) -> DataFrame:
    return vectors.long_form(pooling.sequence_pool(d.embeddings().where("timestep = 0"), WIDTH), ["county_id", "year"], "features")


@query("SELECT county_id, year, timestep, CAST(pos AS INT) AS pos, count(*) AS n, round(sum(x), 5) AS s1, round(sum(x * x), 5) AS s2 FROM cells GROUP BY ALL", "cells")
def a08_sum_cube(d: Domain) -> DataFrame:
    cube = pooling.sum_cube(_whole(d), WIDTH)
    return tables.rounded(cube.select("county_id", "year", "timestep", "n", F.posexplode(F.arrays_zip("s1", "s2")).alias("pos", "v")).select("county_id", "year", "timestep", "pos", "n", "v.s1", "v.s2"), 5)


@query("SELECT * FROM (SELECT DISTINCT county_id, year FROM emb), (SELECT CAST(k AS INT) AS timestep FROM range(0, 8) r(k)) ANTI JOIN emb USING (county_id, year, timestep)".replace("SELECT * FROM (", "SELECT county_id, year, timestep FROM (SELECT county_id, year, timestep FROM (", 1).replace(" ANTI JOIN", ") ANTI JOIN", 1), "emb")
def a08_cube_gaps(d: Domain) -> DataFrame:
    return pooling.cube_gaps(d.embeddings().groupBy("county_id", "year", "timestep").count(), [*STEPS, 7])


@query("SELECT county_id, year, count(DISTINCT patch_id) AS n_patches, array_to_string(list_sort(list(DISTINCT patch_id)), ',') AS patch_ids FROM emb SEMI JOIN done USING (county_id, year, patch_id) GROUP BY ALL", "done")
def a09_patch_sets(d: Domain) -> DataFrame:
    return pooling.patch_sets(_whole(d)).withColumn("patch_ids", F.array_join("patch_ids", ","))


@query("SELECT count(DISTINCT key) AS n_keys, sha256(array_to_string(list_sort(list(DISTINCT key)), chr(10))) AS sha256 FROM labels", "labels")
def a20_cohort_hash(d: Domain) -> DataFrame:
    return pooling.cohort_hash(d.labels(), "key")


@query("SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS sha256 FROM (SELECT county_id || '-' || CAST(year AS VARCHAR) || chr(31) || array_to_string(list_sort(list(DISTINCT patch_id)), chr(31)) AS line FROM emb SEMI JOIN done USING (county_id, year, patch_id) GROUP BY county_id, year)", "done")
def a21_patch_hash(d: Domain) -> DataFrame:
    sets = pooling.patch_sets(_whole(d)).withColumn("key", ids.panel_key(F.col("county_id"), F.col("year")))
    return pooling.patch_hash(sets)


@query("SELECT timestep, count(*) AS files, count(DISTINCT patch_id) AS patches FROM emb GROUP BY ALL", "emb")
def a19_interval_histogram(d: Domain) -> DataFrame:
    return pooling.interval_histogram(d.embeddings())


@query("""SELECT (SELECT count(*) FROM emb) AS files, (SELECT count(*) FROM emb WHERE timestep NOT BETWEEN 0 AND 6) AS excluded_files, (SELECT count(DISTINCT (county_id, year, patch_id)) FROM emb) AS patches,
(SELECT count(*) FROM done) AS complete_patches, min(n) AS patches_min, median(n) AS patches_median, max(n) AS patches_max FROM (SELECT count(*) AS n FROM done GROUP BY county_id, year)""", "done")
def t18_describe_patches(d: Domain) -> DataFrame:
    return pooling.describe_patches(d.embeddings(), STEPS)


@query("SELECT county_id, year, CAST(pos AS INT) AS pos, count(*) AS n, round(avg(x), 6) AS mean FROM cells GROUP BY ALL", "cells")
def t16_sampled_mean(d: Domain) -> DataFrame:
    rows = tiles.sampled_mean(_whole(d), WIDTH).select("county_id", "year", "n", F.posexplode("embedding").alias("pos", "x"))
    return r6(rows.groupBy("county_id", "year", "pos").agg(F.sum("n").alias("n"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean")))


# Joins and sets


@query("SELECT county_id, year, key, round(target, 6) AS target, round(evi, 6) AS evi FROM panel", "panel")
def j01_labelled(d: Domain) -> DataFrame:
    features = d.measures().groupBy("county_id", "year").agg(F.avg("evi").alias("evi"), F.count("*").alias("n")).where("n = 7").drop("n")
    return r6(panel.attach_labels(features, d.labels(), ["county_id", "year"]).select("county_id", "year", "key", "target", "evi"))


@query("SELECT count(n_name) AS matched, count(*) - count(n_name) AS unmatched FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey")
def j02_code_lookup(d: Domain) -> DataFrame:
    codes = d.table("nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return panel.lookup_codes(d.table("supplier"), codes, ["s_nationkey"])[1]


@query(f"SELECT county_id, year, CAST(pos AS INT) AS pos, round(value, 6) AS value FROM (WITH {WHOLE} {_wide_sql(INDEX + CLIMATE)})", "measures")
def j03_late_fusion(d: Domain) -> DataFrame:
    return vectors.long_form(panel.fuse(_index_vectors(d, INDEX), _index_vectors(d, CLIMATE), ["county_id", "year"]), ["county_id", "year"], "features")


@query("SELECT count(*) AS excluded FROM labels WHERE year < 1997", "labels")
def j05_restrict(d: Domain) -> DataFrame:
    return panel.restrict(d.labels(), d.labels().where("year >= 1997").select("key"), "key")[1]


@query("SELECT key, fold, split, round(target, 6) AS target FROM manifest JOIN (SELECT key, target FROM panel) USING (key)", "manifest")
def j07_with_roles(d: Domain) -> DataFrame:
    return r6(panel.with_roles(d.panel().select("key", "target"), d.manifest()).select("key", "fold", "split", "target"))


@query("SELECT fold, n, found, n = found AS equal FROM (SELECT fold, count(*) AS n FROM folds JOIN panel USING (county_id) GROUP BY ALL) JOIN (SELECT fold, count(*) AS found FROM predictions WHERE representation = 'year_mean' GROUP BY ALL) USING (fold)", "predictions")
def j09_row_reconciliation(d: Domain) -> DataFrame:
    expected = d.panel().join(d.folds(), "county_id").groupBy("fold").agg(F.count("*").alias("n"))
    return panel.row_reconciliation(expected, d.predictions().where("representation = 'year_mean'"), ["fold"])


@query("""SELECT coalesce(w.key, h.key) AS key, CASE WHEN w.key IS NULL THEN 'extra' WHEN h.key IS NULL THEN 'missing' WHEN h.whole THEN 'covered' ELSE 'partial' END AS state, coalesce(h.tiles, 0) AS tiles
FROM (SELECT DISTINCT key FROM labels WHERE year <= 1999) w FULL JOIN (SELECT county_id || '-' || CAST(year AS VARCHAR) AS key, count(*) AS tiles, max(prcp) >= 12 AS whole FROM measures WHERE year >= 1997 GROUP BY county_id, year) h ON w.key = h.key""", "measures", "labels")
def j11_coverage(d: Domain) -> DataFrame:
    have = d.measures().where("year >= 1997").withColumn("key", ids.panel_key(F.col("county_id"), F.col("year")))
    return panel.coverage(d.labels().where("year <= 1999"), have, "key", F.col("prcp") >= 12)


@query("SELECT nth AS place, key, round(target, 6) AS target FROM (SELECT key, target, CAST(row_number() OVER (ORDER BY key DESC) AS INT) AS nth FROM labels)", "labels")
def j14_aligned(d: Domain) -> DataFrame:
    order = numbered(d.labels().select("key"), [F.desc("key")], start=1).withColumn("place", F.col("place").cast("int"))
    return r6(panel.aligned(d.labels().select("key", "target"), order, "key", "place").select("place", "key", "target"))


@query("SELECT n_nationkey, n_name FROM nation SEMI JOIN (SELECT DISTINCT s_nationkey AS n_nationkey FROM supplier) USING (n_nationkey)")
def j15_present_shapes(d: Domain) -> DataFrame:
    present = d.table("supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return panel.filtered_or_all(d.table("nation").select("n_nationkey", "n_name"), present, "n_nationkey")


def _sources(d: Domain) -> dict[str, DataFrame]:
    key = ids.panel_key(F.col("county_id"), F.col("year")).alias("key")
    return {"labels": d.labels().select("key"), "index": d.measures().where("timestep = 3").select(key), "late": d.labels().where("year >= 1998").select("key")}


KEYS = "labels_k AS (SELECT key FROM labels), index_k AS (SELECT county_id || '-' || CAST(year AS VARCHAR) AS key FROM measures WHERE timestep = 3), late_k AS (SELECT key FROM labels WHERE year >= 1998)"


@query(f"SELECT * FROM (WITH {KEYS} SELECT key FROM labels_k INTERSECT SELECT key FROM index_k INTERSECT SELECT key FROM late_k)", "labels", "measures")
def u01_common_keys(d: Domain) -> DataFrame:
    return panel.common_keys(_sources(d), "key")


@query(f"""SELECT * FROM (WITH {KEYS}, c AS (SELECT key FROM labels_k INTERSECT SELECT key FROM index_k INTERSECT SELECT key FROM late_k), a AS (SELECT DISTINCT 'labels' AS source, key FROM labels_k UNION ALL SELECT DISTINCT 'index', key FROM index_k UNION ALL SELECT DISTINCT 'late', key FROM late_k)
SELECT source, count(*) AS n_keys, count(c.key) AS n_common, count(*) - count(c.key) AS n_excluded FROM a LEFT JOIN c ON a.key = c.key GROUP BY source)""", "labels", "measures")
def u01_common_report(d: Domain) -> DataFrame:
    return panel.common_report(_sources(d), "key")


@query("SELECT count(*) FILTER (year = 1996) AS used, CAST(0 AS BIGINT) AS ignored, count(*) FILTER (year <> 1996) AS outside FROM labels", "labels")
def u04_restrict_report(d: Domain) -> DataFrame:
    return panel.restrict_report(d.labels(), d.labels().where("year = 1996"), "key")


@query(f"""SELECT * FROM (WITH {KEYS}, h AS (SELECT key, bool_or(s = 'labels') AS l, bool_or(s = 'index') AS i, bool_or(s = 'late') AS t FROM (SELECT 'labels' AS s, key FROM labels_k UNION ALL SELECT 'index', key FROM index_k UNION ALL SELECT 'late', key FROM late_k) GROUP BY key)
SELECT 'labels' AS a, 'index' AS b, count(*) FILTER (l AND i) AS shared, count(*) FILTER (l AND NOT i) AS only_a, count(*) FILTER (i AND NOT l) AS only_b FROM h UNION ALL
SELECT 'labels', 'late', count(*) FILTER (l AND t), count(*) FILTER (l AND NOT t), count(*) FILTER (t AND NOT l) FROM h UNION ALL SELECT 'index', 'late', count(*) FILTER (i AND t), count(*) FILTER (i AND NOT t), count(*) FILTER (t AND NOT i) FROM h)""", "labels", "measures")
def u05_source_audit(d: Domain) -> DataFrame:
    return panel.source_audit(_sources(d), "key")


@query("SELECT 'cohort_missing' AS check_name, count(*) FILTER (year < 1998) AS n_bad, min(key) FILTER (year < 1998) AS sample FROM labels UNION ALL SELECT 'cohort_extra', CAST(0 AS BIGINT), NULL", "labels")
def u06_key_difference(d: Domain) -> DataFrame:
    return audit.key_difference(d.labels(), d.labels().where("year >= 1998"), ["key"], "cohort")


@query("SELECT fold, key, count(DISTINCT split) AS roles FROM (SELECT fold, key, split FROM manifest UNION ALL SELECT fold, key, 'test' FROM manifest WHERE year = 1996) GROUP BY ALL HAVING count(DISTINCT split) > 1", "manifest")
def u08_overlaps(d: Domain) -> DataFrame:
    man = d.manifest().select("fold", "key", "year", "split")
    return panel.overlaps(man.unionByName(man.where("year = 1996").withColumn("split", F.lit("test"))), ["fold"], "key")


# Folds


@query("SELECT county_id, fold FROM folds", "folds")
def f01_grouped_folds(d: Domain) -> DataFrame:
    return d.folds()


@query("SELECT key, county_id, year, county_outer_fold, fold, validation_fold, split FROM manifest", "manifest")
def f02_manifest(d: Domain) -> DataFrame:
    return d.manifest().select("key", "county_id", "year", "county_outer_fold", "fold", "validation_fold", "split")


@query("""SELECT * FROM (WITH s AS (SELECT substr(county_id, 1, 2) AS state, count(*) AS n FROM panel GROUP BY ALL HAVING count(*) >= 14), f AS (SELECT state AS held_out, CAST(row_number() OVER (ORDER BY state) - 1 AS INT) AS fold, coalesce(lead(state) OVER (ORDER BY state), min(state) OVER ()) AS nxt FROM s)
SELECT key, substr(county_id, 1, 2) AS state, held_out, fold, CASE WHEN substr(county_id, 1, 2) = held_out THEN 'test' WHEN substr(county_id, 1, 2) = nxt THEN 'val' ELSE 'train' END AS split FROM panel JOIN s ON substr(county_id, 1, 2) = s.state, f)""", "panel")
def f03_held_out_states(d: Domain) -> DataFrame:
    keys = d.panel().select("key", ids.state_of(F.col("county_id")).alias("state"))
    return splits.held_out_states(keys, "state", 14).select("key", "state", "held_out", "fold", "split")


@query("SELECT key, year, y AS held_out_year, CASE WHEN year = y THEN 'test' ELSE 'train' END AS split FROM panel, (SELECT DISTINCT year AS y FROM panel)", "panel")
def f04_held_out_years(d: Domain) -> DataFrame:
    return splits.held_out_years(d.panel().select("key", "year"))


@query("SELECT o.y AS held_out_year, i.y AS inner_year, CASE WHEN year = i.y THEN 'val' ELSE 'train' END AS inner_split, count(*) AS n FROM panel, (SELECT DISTINCT year AS y FROM panel) o, (SELECT DISTINCT year AS y FROM panel) i WHERE year <> o.y AND i.y <> o.y GROUP BY ALL", "panel")
def f05_inner_years(d: Domain) -> DataFrame:
    rows = splits.inner_years(splits.held_out_years(d.panel().select("key", "year")))
    return rows.groupBy("held_out_year", "inner_year", "inner_split").agg(F.count("*").alias("n"))


@query("SELECT key, split FROM manifest WHERE fold = 2", "manifest")
def f06_one_fold(d: Domain) -> DataFrame:
    """The manifest without val rows: fold 3's test keys take their place."""
    man = d.manifest().select("key", "fold", F.when(F.col("split") == "val", "train").otherwise(F.col("split")).alias("split"))
    return splits.one_fold(man, 2)


@query("SELECT check_name, CAST(0 AS BIGINT) AS n_bad FROM (VALUES ('one_role_per_fold'), ('one_test_fold'), ('in_every_fold'), ('tested_once')) v(check_name)")
def f09_fold_checks(d: Domain) -> DataFrame:
    return splits.fold_checks(d.manifest(), FOLDS).select("check_name", "n_bad")


@query("SELECT fold, split, count(*) AS n, count(DISTINCT county_id) AS counties, count(DISTINCT year) AS years, count(DISTINCT year) = (SELECT count(DISTINCT year) FROM panel) AS complete FROM manifest GROUP BY ALL", "manifest")
def f10_years_per_partition(d: Domain) -> DataFrame:
    return splits.years_per_partition(d.manifest())


@query("SELECT check_name, CAST(0 AS BIGINT) AS n_bad FROM (VALUES ('one_state_per_fold'), ('one_fold_per_state')) v(check_name)")
def f12_state_folds(d: Domain) -> DataFrame:
    keys = d.panel().select("key", ids.state_of(F.col("county_id")).alias("state"))
    return splits.state_fold_checks(splits.held_out_states(keys, "state", 14), "state").select("check_name", "n_bad")


# Metrics


SUMS = "SELECT {0}, count(*) AS n, 1 - sum(pow(observed - predicted, 2)) / nullif(var_pop(observed) * count(*), 0) AS r2, sqrt(avg(pow(observed - predicted, 2))) AS rmse, avg(abs(observed - predicted)) AS mae FROM {1} GROUP BY ALL"
ROUND3 = "round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae"


@query(f"SELECT representation, fold, n, {ROUND3} FROM ({SUMS.format('representation, fold', 'predictions')})", "predictions")
def a10_metrics(d: Domain) -> DataFrame:
    return r6(metrics.metrics(d.predictions(), ["representation", "fold"]))


@query("SELECT representation, state, count(*) AS n, round(1 - sum(pow(observed - predicted, 2)) / nullif(var_pop(observed) * count(*), 0), 6) AS r2, round(sqrt(avg(pow(observed - predicted, 2))), 6) AS rmse, round(avg(abs(observed - predicted)), 6) AS mae, round(sqrt(avg(pow(observed - predicted, 2))) / abs(avg(observed)), 6) AS nrmse FROM predictions GROUP BY ALL", "predictions")
def a11_metrics_nrmse(d: Domain) -> DataFrame:
    return r6(metrics.metrics(d.predictions(), ["representation", "state"], nrmse=True))


SEEDS = SUMS.format("representation, fold, seed", "seeded")


@query(f"SELECT representation, fold, count(DISTINCT seed) AS seeds, any_value(n) AS n, round(avg(r2), 6) AS r2, round(avg(rmse), 6) AS rmse, round(avg(mae), 6) AS mae, round(stddev_pop(r2), 6) AS r2_seed_std, round(stddev_pop(rmse), 6) AS rmse_seed_std, round(stddev_pop(mae), 6) AS mae_seed_std FROM ({SEEDS}) GROUP BY representation, fold", "seeded")
def a12_by_fold(d: Domain) -> DataFrame:
    return r6(metrics.summary(metrics.metrics(d.seeded(), ["representation", "fold", "seed"]), ["representation"], "fold")[0])


def _summary_sql(level: str) -> str:
    inner = SUMS.format(f"representation, {level}, seed", "seeded")
    means = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in metrics.METRICS)
    return f"SELECT representation, count(*) AS levels, CAST(sum(n) AS BIGINT) AS n_total, {means} FROM (SELECT representation, {level}, any_value(n) AS n, avg(r2) AS r2, avg(rmse) AS rmse, avg(mae) AS mae FROM ({inner}) GROUP BY representation, {level}) GROUP BY representation"


@query(_summary_sql("fold"), "seeded")
def a12_summary(d: Domain) -> DataFrame:
    return r6(metrics.summary(metrics.metrics(d.seeded(), ["representation", "fold", "seed"]), ["representation"], "fold")[1])


@query(_summary_sql("year"), "seeded")
def a13_year_summary(d: Domain) -> DataFrame:
    return r6(metrics.summary(metrics.metrics(d.seeded(), ["representation", "year", "seed"]), ["representation"], "year")[1])


READOUTS = "(SELECT *, CASE representation WHEN 'year_mean' THEN 'mean' ELSE 'concat' END AS strategy FROM seeded)"


@query("SELECT strategy, fold, count(DISTINCT seed) AS seeds, any_value(n) AS n, round(avg(r2), 6) AS r2, round(avg(rmse), 6) AS rmse, round(avg(mae), 6) AS mae, round(stddev_pop(r2), 6) AS r2_seed_std, round(stddev_pop(rmse), 6) AS rmse_seed_std, round(stddev_pop(mae), 6) AS mae_seed_std FROM (" + SUMS.format("strategy, fold, seed", READOUTS) + ") GROUP BY strategy, fold", "seeded")
def a14_readout_summary(d: Domain) -> DataFrame:
    rows = d.seeded().withColumn("strategy", F.when(F.col("representation") == "year_mean", "mean").otherwise("concat"))
    return r6(metrics.summary(metrics.metrics(rows, ["strategy", "fold", "seed"]), ["strategy"], "fold")[0])


@query("SELECT model, count(*) AS levels, CAST(sum(n) AS BIGINT) AS n_total, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in metrics.METRICS) + " FROM (SELECT model, fold, any_value(n) AS n, avg(r2) AS r2, avg(rmse) AS rmse, avg(mae) AS mae FROM (" + SUMS.format("model, fold, seed", "(SELECT *, representation || '_model' AS model FROM seeded)") + ") GROUP BY model, fold) GROUP BY model", "seeded")
def a15_model_summary(d: Domain) -> DataFrame:
    rows = d.seeded().withColumn("model", F.concat("representation", F.lit("_model")))
    return r6(metrics.summary(metrics.metrics(rows, ["model", "fold", "seed"]), ["model"], "fold")[1])


@query(f"""SELECT representation, units, round(m1, 6) AS macro_r2, round(m2, 6) AS macro_rmse, round(m3, 6) AS macro_mae, round(s1, 6) AS macro_r2_std, round(s2, 6) AS macro_rmse_std, round(s3, 6) AS macro_mae_std, n, round(r2, 6) AS pooled_r2, round(rmse, 6) AS pooled_rmse, round(mae, 6) AS pooled_mae
FROM (SELECT representation, count(*) AS units, avg(r2) AS m1, avg(rmse) AS m2, avg(mae) AS m3, stddev_pop(r2) AS s1, stddev_pop(rmse) AS s2, stddev_pop(mae) AS s3 FROM ({SUMS.format('representation, state', 'predictions')}) GROUP BY representation) JOIN ({SUMS.format('representation', 'predictions')}) USING (representation)""", "predictions")
def a16_macro_and_pooled(d: Domain) -> DataFrame:
    return r6(metrics.macro_and_pooled(d.predictions(), "representation", "state"))


@query("SELECT representation, state, count(*) AS n, round(sum(observed), 5) AS sum_y, round(sum(observed * observed), 4) AS sum_y2, round(sum(pow(observed - predicted, 2)), 4) AS sse, round(sum(abs(observed - predicted)), 5) AS sae FROM predictions GROUP BY ALL", "predictions")
def a17_cluster_stats(d: Domain) -> DataFrame:
    out = metrics.cluster_stats(d.predictions(), ["representation", "state"])
    return out.select("representation", "state", "n", F.round("sum_y", 5).alias("sum_y"), F.round("sum_y2", 4).alias("sum_y2"), F.round("sse", 4).alias("sse"), F.round("sae", 5).alias("sae"))


@query("SELECT fold, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM manifest GROUP BY ALL", "manifest")
def a18_partition_counts(d: Domain) -> DataFrame:
    return metrics.partition_counts(d.manifest())


@query("SELECT state, count(*) AS n_keys, count(*) >= 14 AS eligible FROM (SELECT substr(county_id, 1, 2) AS state FROM labels) GROUP BY ALL", "labels")
def a18_coverage_counts(d: Domain) -> DataFrame:
    return metrics.coverage_counts(d.labels().select(ids.state_of(F.col("county_id")).alias("state")), "state", 14)


@query("""SELECT count(*) AS n, round(var_pop(target), 6) AS total, round(var_pop(m) / var_pop(target), 6) AS between_share, round(avg(pow(target - m, 2)) / var_pop(target), 6) AS within_share
FROM (SELECT target, avg(target) OVER (PARTITION BY county_id) AS m, count(*) OVER (PARTITION BY county_id) AS k FROM panel) WHERE k > 1""", "panel")
def a22_variance_shares(d: Domain) -> DataFrame:
    return r6(metrics.variance_shares(d.panel(), "target", "county_id"))


@query("SELECT 'backbone' AS column_name, count(DISTINCT backbone) AS n_values, min(backbone) AS low, max(backbone) AS high FROM emb UNION ALL SELECT 'planted', count(DISTINCT p), min(p), max(p) FROM (SELECT CASE WHEN timestep = 3 AND year = 1996 THEN 'tuned' WHEN timestep <> 5 THEN backbone END AS p FROM emb)", "emb")
def a23_uniform(d: Domain) -> DataFrame:
    """A column with one value, and one with a second value and nulls planted in it."""
    planted = F.when((F.col("timestep") == 3) & (F.col("year") == 1996), "tuned").when(F.col("timestep") != 5, F.col("backbone"))
    rows = d.embeddings().withColumn("planted", planted)
    return audit.uniform(rows, "backbone").unionByName(audit.uniform(rows, "planted"))


@query("SELECT dropped, round(value, 6) AS value, round(max(value) FILTER (dropped = 0) OVER () - value, 6) AS loss FROM (SELECT CAST(k AS INT) AS dropped, avg(evi) AS value FROM measures, range(0, 8) r(k) WHERE k <> timestep + 1 GROUP BY k)", "measures")
def a24_marginal_loss(d: Domain) -> DataFrame:
    results = sequences.leave_one_out(d.measures(), 7).groupBy("dropped").agg(F.avg("evi").alias("value"))
    return r6(metrics.marginal_loss(results, "value"))


@query("""SELECT representation, fold, key, round(observed - avg(observed) OVER g, 6) AS observed, round(predicted - avg(predicted) OVER g, 6) AS predicted FROM (SELECT *, count(*) OVER (PARTITION BY representation, fold, county_id) AS k FROM predictions WHERE year <> 1996) WHERE k > 1 WINDOW g AS (PARTITION BY representation, fold, county_id)""", "predictions")
def w01_anomalies(d: Domain) -> DataFrame:
    return r6(metrics.anomalies(d.predictions().where("year <> 1996"), ["representation", "fold"]).select("representation", "fold", "key", "observed", "predicted"))


def _curve_sql(kind: str, rows: str) -> str:
    return f"SELECT representation, '{kind}' AS kind, count(*) AS folds, round(avg(r2), 6) + 0.0 AS r2_mean, round(stddev_pop(r2), 6) AS r2_std, round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std FROM ({SUMS.format('representation, fold', rows)}) GROUP BY representation"


ANOMALY = "(SELECT * FROM (SELECT representation, fold, observed - avg(observed) OVER g AS observed, {0} AS predicted, count(*) OVER g AS k FROM predictions WINDOW g AS (PARTITION BY representation, fold, county_id)) WHERE k > 1)"


@query(" UNION ALL ".join([_curve_sql("yield", "predictions"), _curve_sql("anomaly", ANOMALY.format("predicted - avg(predicted) OVER g")), _curve_sql("zero_anomaly", ANOMALY.format("CAST(0 AS DOUBLE)"))]), "predictions")
def w02_skill_curves(d: Domain) -> DataFrame:
    return r6(metrics.skill_curves(d.predictions(), ["representation"]))


# Sequences


@query("SELECT CAST(k AS INT) AS k, county_id, year, count(*) AS n, round(avg(evi), 6) AS evi FROM measures, range(1, 8) r(k) WHERE timestep < k GROUP BY ALL", "measures")
def w03_prefixes(d: Domain) -> DataFrame:
    return r6(sequences.prefixes(d.measures(), 7).groupBy("k", "county_id", "year").agg(F.count("*").alias("n"), F.avg("evi").alias("evi")))


@query("SELECT CAST(k AS INT) AS dropped, county_id, year, count(*) AS n, round(avg(evi), 6) AS evi FROM measures, range(0, 8) r(k) WHERE k <> timestep + 1 GROUP BY ALL", "measures")
def w04_leave_one_out(d: Domain) -> DataFrame:
    return r6(sequences.leave_one_out(d.measures(), 7).groupBy("dropped", "county_id", "year").agg(F.count("*").alias("n"), F.avg("evi").alias("evi")))


CORR = "SELECT {0}, count(*) AS n, CASE WHEN var_pop(a) * var_pop(b) > 0 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END AS r FROM {1} GROUP BY ALL"


@query(f"SELECT county_id, year, n, round(r, 6) AS r FROM ({CORR.format('county_id, year', '(SELECT county_id, year, evi AS a, dayl AS b FROM measures)')})", "measures")
def w05_correlation(d: Domain) -> DataFrame:
    return r6(sequences.correlation(d.measures(), ["county_id", "year"], "evi", "dayl"))


LAGGED = "(SELECT m.county_id, m.year, m.lag, m.evi AS a, o.dayl AS b FROM (SELECT *, CAST(g AS INT) AS lag FROM measures, range(-2, 3) r(g)) m JOIN measures o ON o.county_id = m.county_id AND o.year = m.year AND o.timestep = m.timestep + m.lag)"
LAG_CORR = CORR.format("county_id, year, lag", LAGGED)


@query(f"SELECT lag, round(mean_r, 6) AS mean_r, n, lag = first_value(lag) OVER (ORDER BY round(mean_r, 12) DESC, lag) AS chosen FROM (SELECT lag, avg(r) AS mean_r, count(r) AS n FROM ({LAG_CORR}) GROUP BY lag)", "measures")
def w06_best_lag(d: Domain) -> DataFrame:
    return r6(sequences.best_lag(sequences.lagged(d.measures(), ["county_id", "year"], "evi", "dayl", [-2, -1, 0, 1, 2])))


@query(f"SELECT lag, count(*) AS n, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(stddev_pop(r), 6) AS std, round(avg(CASE WHEN r > 0.9 THEN 1.0 ELSE 0.0 END), 6) AS share_above FROM ({LAG_CORR}) GROUP BY lag", "measures")
def w07_correlation_summary(d: Domain) -> DataFrame:
    return r6(sequences.correlation_summary(sequences.lagged(d.measures(), ["county_id", "year"], "evi", "dayl", [-2, -1, 0, 1, 2]), ["lag"]))


@query("""SELECT * FROM (WITH c AS (SELECT year, timestep, avg(evi) AS m, stddev_pop(evi) AS s FROM measures GROUP BY ALL)
SELECT year, timestep, round((m - min(m) OVER y) / (max(m) OVER y - min(m) OVER y), 6) AS scaled, round(s / (max(m) OVER y - min(m) OVER y), 6) AS scaled_std, row_number() OVER (PARTITION BY year ORDER BY m DESC, timestep) = 1 AS peak FROM c WINDOW y AS (PARTITION BY year))""", "measures")
def w08_trajectory(d: Domain) -> DataFrame:
    return r6(sequences.trajectory(d.measures(), ["year"], "evi"))


@query("""SELECT * FROM (WITH c AS (SELECT timestep, avg(lai) AS a, avg(evi) AS b FROM measures GROUP BY ALL), s AS (SELECT CASE WHEN covar_pop(a, b) < 0 THEN -1.0 ELSE 1.0 END AS sign FROM c)
SELECT county_id, year, timestep, round(lai * CAST(sign AS DOUBLE), 6) AS lai FROM measures, s)""", "measures")
def w10_oriented(d: Domain) -> DataFrame:
    return r6(sequences.oriented(d.measures(), "lai", "evi").select("county_id", "year", "timestep", "lai"))


@query("SELECT l_orderkey, min(l_shipmark) AS path, count(*) AS copies FROM (SELECT l_orderkey, strftime(l_shipdate, '%Y%m%d') || '_' || CAST(l_linenumber AS VARCHAR) AS l_shipmark FROM lineitem) GROUP BY ALL")
def w11_smallest_path(d: Domain) -> DataFrame:
    rows = d.table("lineitem").select("l_orderkey", F.concat_ws("_", F.date_format("l_shipdate", "yyyyMMdd"), "l_linenumber").alias("path"))
    return sequences.smallest_path(rows, ["l_orderkey"])


@query("""SELECT county_id, year, timestep, x IS NULL AS carried, round(coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY county_id, year ORDER BY timestep ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY county_id, year ORDER BY timestep ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 6) AS evi
FROM (SELECT county_id, year, timestep, evi AS x FROM (SELECT county_id, year, CAST(k AS INT) AS timestep FROM (SELECT DISTINCT county_id, year FROM measures WHERE prcp > 9), range(0, 7) r(k)) LEFT JOIN (SELECT * FROM measures WHERE prcp > 9) USING (county_id, year, timestep))""", "measures")
def t09_carried_forward(d: Domain) -> DataFrame:
    out = sequences.carried_forward(d.measures().where("prcp > 9"), ["county_id", "year"], 7, "evi")
    return r6(out.select("county_id", "year", "timestep", "carried", "evi"))


@query("""SELECT county_id, year, patch_id, CAST(rank AS INT) AS rank, n < 3 AS replacement FROM (SELECT *, row_number() OVER (PARTITION BY county_id, year ORDER BY sha256(concat_ws('-', county_id, CAST(year AS VARCHAR), '7:1', patch_id))) AS rank, count(*) OVER (PARTITION BY county_id, year) AS n FROM (SELECT DISTINCT county_id, year, patch_id FROM emb)) WHERE rank <= 3""", "emb")
def t13_patch_sample(d: Domain) -> DataFrame:
    return tiles.patch_sample(d.embeddings(), 3, seed=7, epoch=1)


@query("SELECT county_id, year, timestep, count(*) AS n, round(avg((x - m) / s), 4) AS mean, round(min((x - m) / s), 4) AS low, round(max((x - m) / s), 4) AS high FROM cells, (SELECT avg(x) AS m, stddev_pop(x) AS s FROM cells) GROUP BY ALL", "cells")
def t11_unit_scale(d: Domain) -> DataFrame:
    """Pixels standardised by the statistics of all patches and pixels of their band."""
    rows = _whole(d).select("county_id", "year", "patch_id", "timestep", F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("pixels"), F.lit("train").alias("split"))
    stats = tiles.channel_statistics(rows, patches=1 << 30, pixels=64, seed=1)
    out = tiles.standardised(rows, stats).select("county_id", "year", "timestep", F.explode("pixels").alias("x")).withColumn("x", F.col("x").cast("double"))
    return out.groupBy("county_id", "year", "timestep").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.min("x"), 4).alias("low"), F.round(F.max("x"), 4).alias("high"))


@query("SELECT key, round((target - m) / s, 6) AS target FROM panel, (SELECT avg(target) AS m, stddev_pop(target) AS s FROM panel WHERE year <= 1998)", "panel")
def t12_target_scale(d: Domain) -> DataFrame:
    rows = d.panel().select("key", "target", F.when(F.col("year") <= 1998, "train").otherwise("test").alias("split"))
    return r6(tiles.scaled_target(rows, tiles.target_scale(rows, "target"), "target").select("key", "target"))


@query("SELECT county_id, year, patch_id, CAST(timestep AS INT) AS band, 64 * count(*) AS n, round(avg(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 6) AS mean FROM emb GROUP BY ALL", "emb")
def t07_band_means(d: Domain) -> DataFrame:
    """A patch's timesteps stand for the bands of one tile, whose pixels are all positions."""
    steps = F.array_sort(F.collect_list(F.struct("timestep", "embedding")))
    rows = d.embeddings().groupBy("county_id", "year", "patch_id").agg(steps.alias("r")).select("county_id", "year", "patch_id", F.lit(0).alias("timestep"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.flatten("r.embedding").alias("pixels"))
    return r6(tiles.band_means(rows.withColumn("valid", F.transform("pixels", lambda _: F.lit(True)))).select("county_id", "year", "patch_id", "band", "n", "mean"))


@query("SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) WHERE i IN (SELECT CAST(floor(k * ((SELECT count(*) FROM customer) - 1) / 9.0) AS BIGINT) FROM range(0, 10) r(k))")
def o04_evenly_spaced(d: Domain) -> DataFrame:
    return sequences.evenly_spaced(d.table("customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 10)


@query("SELECT key, round(target, 6) AS target FROM labels ORDER BY target DESC, key LIMIT 12", "labels")
def o03_first_after_order(d: Domain) -> DataFrame:
    return r6(d.labels().select("key", "target").orderBy(F.desc("target"), "key").limit(12))


# Models


RIDGE1 = """SELECT * FROM (WITH RECURSIVE x AS (SELECT key, county_id, fold, evi, target FROM panel JOIN folds USING (county_id)), f AS (SELECT CAST(k AS INT) AS f FROM range(0, 5) r(k)),
t AS (SELECT f, avg(evi) AS mx, stddev_pop(evi) AS sx, avg(target) AS my, count(*) AS n FROM x, f WHERE fold <> f GROUP BY f),
w AS (SELECT f, any_value(mx) AS mx, any_value(sx) AS sx, any_value(my) AS my, sum((evi - mx) / sx * (target - my)) / (any_value(n) + 10.0) AS b FROM x JOIN t ON x.fold <> t.f GROUP BY f)
SELECT key, fold, round(target, 6) AS observed, round(my + b * (evi - mx) / sx, 5) AS predicted FROM x JOIN w ON x.fold = w.f)"""


def _ridge_rows(d: Domain, features: list) -> DataFrame:
    return d.panel().join(d.folds(), "county_id").select("key", "county_id", "year", "fold", "target", F.lit("index").alias("representation"), F.array(*features).alias("features"))


@query(RIDGE1, "panel", "folds")
def m01_ridge_folds(d: Domain) -> DataFrame:
    """One feature and one penalty, which SQL has in closed form."""
    rows = _ridge_rows(d, ["evi"])
    fits = linear.fit_folds(linear.grams(rows, "representation", "fold", "target"), alphas=(10.0,))
    out = linear.predict(rows, fits, "representation", "fold")
    return out.select("key", "fold", F.round("target", 6).alias("observed"), F.round("predicted", 5).alias("predicted"))


@query(RIDGE1.replace("fold, evi", "substr(county_id, 1, 2) AS fold, evi").replace("f AS (SELECT CAST(k AS INT) AS f FROM range(0, 5) r(k))", "f AS (SELECT DISTINCT substr(county_id, 1, 2) AS f FROM panel)").replace("SELECT key, fold,", "SELECT key, fold AS state,"), "panel", "folds")
def m02_ridge_states(d: Domain) -> DataFrame:
    """Held-out states, with one feature and one penalty."""
    rows = _ridge_rows(d, ["evi"]).withColumn("state", ids.state_of(F.col("county_id")))
    fits = linear.fit_folds(linear.grams(rows, "representation", "state", "target"), alphas=(10.0,))
    out = linear.predict(rows, fits, "representation", "state")
    return out.select("key", "state", F.round("target", 6).alias("observed"), F.round("predicted", 5).alias("predicted"))


@query()
def m04_tree_heads(d: Domain) -> DataFrame:
    """The three tree heads as in production, on all folds and seeds: metrics per head, fold and seed."""
    rows = panel.with_roles(d.panel().select("key", "target", F.array(*[F.col(n) for n in INDEX]).alias("features")), d.manifest())
    heads: dict[str, dict] = {"random_forest": {}, "boosted": {}, "additive": {}}
    return r6(metrics.metrics(trees.evaluate(rows, heads, list(range(FOLDS)), trees.SEEDS), ["regressor", "fold", "seed"]))


@query()
def m01_ridge_metrics(d: Domain) -> DataFrame:
    """21 index features, penalties chosen on the validation fold; tested against numpy."""
    features = _index_vectors(d, INDEX)
    rows = features.join(d.labels(), ["county_id", "year"]).join(d.folds(), "county_id").withColumn("representation", F.lit("index"))
    fits = linear.fit_folds(linear.grams(rows, "representation", "fold", "target"))
    out = linear.predict(rows, fits, "representation", "fold").select("fold", F.col("target").alias("observed"), "predicted")
    return r6(metrics.metrics(out, ["fold"]).join(fits.select(F.col("fold").cast("int").alias("fold"), "alpha", "train_n"), "fold"))


@query()
def m03_ridge_years(d: Domain) -> DataFrame:
    """Held-out years with inner held-out years for the penalty; tested against numpy."""
    rows = _ridge_rows(d, INDEX)
    fits = linear.fit_years(linear.grams(rows, "representation", "year", "target"))
    out = linear.predict(rows, fits, "representation", "year").select("year", F.col("target").alias("observed"), "predicted")
    return r6(metrics.metrics(out, ["year"]).join(fits.select(F.col("fold").cast("int").alias("year"), "alpha"), "year"))


def _sequences(d: Domain) -> DataFrame:
    """Regions and years with all seven composites, in order: 7 x 3 features, target and fold."""
    steps = d.measures().select("county_id", "year", "timestep", F.array(*[F.col(n) for n in INDEX]).alias("features"))
    rows = sequences.flattened(steps, ["county_id", "year"]).where(F.size("features") == len(STEPS) * len(INDEX))
    return rows.join(d.labels(), ["county_id", "year"]).join(d.folds(), "county_id").withColumn("representation", F.lit("index"))


def _ridge_curve(d: Domain, subsets: list[list[int]], axis: str, first: int) -> DataFrame:
    """Ridge on subsets of the composites, all from one scan's moments."""
    rows = d.once("sequences", lambda: _sequences(d))
    fits = linear.fit_folds(linear.grams(rows, "representation", "fold", "target"), subsets=subsets)
    out = linear.predict(rows, fits, "representation", "fold")
    return out.select((F.col("subset") + first).alias(axis), "fold", "county_id", F.col("target").alias("observed"), "predicted")


@query()
def m08_inseason_curve(d: Domain) -> DataFrame:
    """Ridge on the first k composites, all k and folds; tested against numpy."""
    width = len(INDEX)
    return r6(metrics.skill_curves(_ridge_curve(d, [list(range(width * k)) for k in range(1, len(STEPS) + 1)], "k", 1), ["k"]))


@query()
def m08_boosted_curve(d: Domain) -> DataFrame:
    """Boosted trees on the first k composites: predictions averaged over seeds, then metrics by fold."""
    rows = d.once("sequences", lambda: _sequences(d))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.lit(len(STEPS))), lambda k: F.struct(k.alias("k"), F.slice("features", F.lit(1), k * len(INDEX)).alias("features"))))
    each = rows.select("key", "target", cut.alias("c")).select("key", "target", F.col("c.k").cast("string").alias("representation"), F.col("c.features").alias("features"))
    out = trees.evaluate(panel.with_roles(each, d.manifest()), {"boosted": {}}, list(range(FOLDS)), trees.SEEDS)
    mean = out.groupBy("representation", "fold", "key").agg(F.first("observed").alias("observed"), F.avg("predicted").alias("predicted"))
    mean = mean.select(F.col("representation").cast("int").alias("k"), "fold", ids.key_region(F.col("key")).alias("county_id"), "observed", "predicted")
    return r6(metrics.skill_curves(mean, ["k"]))


@query()
def m09_recoverability(d: Domain) -> DataFrame:
    """How well two measures give a third at each composite; tested against numpy."""
    rows = d.measures().withColumn("key", ids.panel_key(F.col("county_id"), F.col("year")))
    rows = panel.with_roles(rows.select("key", "timestep", F.array("evi", "dayl").alias("features"), F.col("srad").alias("target")), d.manifest())
    return r6(linear.recoverability(rows))


@query()
def m10_first_component(d: Domain) -> DataFrame:
    """Projection of the spatial means on their first component; tested against numpy."""
    pooled = pooling.spatial_pool(_whole(d), WIDTH, deviation=False)
    _, share, rows = linear.first_component(pooled, "features")
    return r6(rows.select("county_id", "year", "timestep", "pc1", F.lit(share).alias("share")))


@query("""SELECT round((a + c + sqrt(pow(a - c, 2) + 4 * b * b)) / 2 / (a + c), 6) AS share FROM (SELECT var_pop(srad) AS a, var_pop(evi) AS c, covar_pop(srad, evi) AS b FROM measures)""", "measures")
def m10_two_measures(d: Domain) -> DataFrame:
    """The variance share of the first component of two measures, which SQL has in closed form."""
    rows = d.measures().select(F.array("srad", "evi").alias("features"))
    return rows.sparkSession.createDataFrame([(round(linear.first_component(rows, "features")[1], 6),)], "share double")


@query("""SELECT CAST(timestep AS INT) AS timestep, count(r2) AS folds, round(avg(r2), 5) AS r2_mean, round(stddev_pop(r2), 5) AS r2_std FROM (
WITH m AS (SELECT county_id, timestep, evi AS x, srad AS y, fold FROM measures JOIN panel p USING (county_id, year) JOIN folds USING (county_id)), k AS (SELECT CAST(k AS INT) AS f FROM range(0, 5) r(k)), al AS (SELECT unnest([0.1, 1.0, 10.0, 100.0])::DOUBLE AS alpha),
t AS (SELECT timestep, f, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n, covar_pop(x, y) * count(*) / stddev_pop(x) AS sxy FROM m, k WHERE fold <> f GROUP BY timestep, f),
e AS (SELECT timestep, f, alpha, avg(pow((y - my - sxy / (n + alpha) * (x - mx) / sx) / (1 - 1 / n - pow((x - mx) / sx, 2) / (n + alpha)), 2)) AS loo FROM m JOIN t USING (timestep), al WHERE fold <> f GROUP BY ALL),
b AS (SELECT timestep, f, arg_min(alpha, (loo, alpha)) AS alpha FROM e GROUP BY ALL)
SELECT timestep, f, 1 - sum(pow(y - my - sxy / (n + alpha) * (x - mx) / sx, 2)) / (var_pop(y) * count(*)) AS r2 FROM m JOIN t USING (timestep) JOIN b USING (timestep, f) WHERE fold = f GROUP BY timestep, f) GROUP BY timestep""".replace("evi AS x", "measures.evi AS x").replace("srad AS y", "measures.srad AS y"), "measures", "panel", "folds")
def m09_one_measure(d: Domain) -> DataFrame:
    """Recoverability from one measure, which SQL has in closed form."""
    rows = d.measures().withColumn("key", ids.panel_key(F.col("county_id"), F.col("year")))
    rows = panel.with_roles(rows.select("key", "timestep", F.array("evi").alias("features"), F.col("srad").alias("target")), d.manifest())
    out = linear.recoverability(rows)
    return out.select("timestep", "folds", F.round("r2_mean", 5).alias("r2_mean"), F.round("r2_std", 5).alias("r2_std"))


def _grid_rows(d: Domain, **features: list[str]) -> DataFrame:
    base = d.once("wide", lambda: d.measures().groupBy("county_id", "year").agg(*[F.avg(n).alias(n) for n in {n for names in features.values() for n in names}]))
    rows = base.join(d.panel().select("county_id", "year", "key", "target"), ["county_id", "year"])
    reps = F.explode(F.array(*[F.struct(F.lit(r).alias("representation"), F.array(*names).alias("features")) for r, names in features.items()]))
    return panel.with_roles(rows.select("key", "target", reps.alias("r")).select("key", "target", "r.*"), d.manifest())


@query("""SELECT representation, 'ridge' AS regressor, fold, 0 AS seed, count(*) AS n, round(1 - sum(pow(target - my - sxy / (n + 10) * (x - mx) / sx, 2)) / (var_pop(target) * count(*)), 5) AS r2, round(sqrt(avg(pow(target - my - sxy / (n + 10) * (x - mx) / sx, 2))), 5) AS rmse FROM (
WITH w AS (SELECT county_id, year, avg(evi) AS e, avg(prcp) AS p FROM measures GROUP BY ALL), x AS (SELECT representation, fold, target, CASE representation WHEN 'index' THEN e ELSE p END AS x FROM w JOIN panel USING (county_id, year) JOIN folds USING (county_id), (VALUES ('index'), ('climate')) v(representation)),
f AS (SELECT CAST(k AS INT) AS f FROM range(0, 5) r(k)), t AS (SELECT representation, f, avg(x) AS mx, stddev_pop(x) AS sx, avg(target) AS my, count(*) AS n, covar_pop(x, target) * count(*) / stddev_pop(x) AS sxy FROM x, f WHERE fold <> f GROUP BY ALL)
SELECT x.*, t.* EXCLUDE (representation) FROM x JOIN t ON x.representation = t.representation AND x.fold = t.f) GROUP BY representation, fold""", "panel", "folds")
def m07_ridge_grid(d: Domain) -> DataFrame:
    """The grid's ridge cells, once each, for two representations of one feature; the second call finds all cells written."""
    rows, path = _grid_rows(d, index=["evi"], climate=["prcp"]), tables.scratch_dir(d.spark)
    for _ in range(2):
        out = grid.run(rows, path, {"ridge": {"alphas": (10.0,)}}, list(range(FOLDS)), trees.SEEDS)
    return metrics.metrics(out, ["representation", "regressor", "fold", "seed"]).select("representation", "regressor", "fold", "seed", "n", F.round("r2", 5).alias("r2"), F.round("rmse", 5).alias("rmse"))


@query()
def m07_grid(d: Domain) -> DataFrame:
    """Ridge and the additive head over two representations, five folds and three seeds."""
    out = grid.run(_grid_rows(d, index=INDEX, climate=CLIMATE), tables.scratch_dir(d.spark), {"ridge": {}, "additive": {}}, list(range(FOLDS)), trees.SEEDS)
    return r6(metrics.metrics(out, ["representation", "regressor", "fold", "seed"]))


@query("SELECT timestep, CAST(pos AS INT) AS pos, round(avg(m), 6) AS mean, round(CASE WHEN stddev_pop(m) < 1e-8 THEN 1.0 ELSE stddev_pop(m) END, 6) AS std FROM (SELECT county_id, year, timestep, pos, avg(x) AS m FROM cells GROUP BY ALL) WHERE year = 1995 GROUP BY ALL", "cells")
def m12_sequence_scaler(d: Domain) -> DataFrame:
    pooled = pooling.spatial_pool(_whole(d), WIDTH, deviation=False)
    return r6(linear.sequence_scaler(pooled, train="year = 1995"))


BOOT = """SELECT * FROM (WITH c AS (SELECT state, row_number() OVER (ORDER BY state) - 1 AS nth FROM (SELECT DISTINCT state FROM predictions)), k AS (SELECT count(*) AS k FROM c),
g AS (SELECT rep_no, ('0x' || substr(md5('17|' || CAST(rep_no AS VARCHAR) || '|' || CAST(draw AS VARCHAR)), 1, 8))::BIGINT % k AS nth FROM (SELECT rep_no, unnest(range(0, k)) AS draw, k FROM range(0, 200) r(rep_no), k)),
s AS (SELECT representation, state, count(*) AS n, sum(observed) AS y, sum(observed * observed) AS y2, sum(pow(observed - predicted, 2)) AS sse, sum(abs(observed - predicted)) AS sae FROM predictions GROUP BY ALL),
b AS (SELECT representation, rep_no, sum(n) AS n, sum(y) AS y, sum(y2) AS y2, sum(sse) AS sse, sum(sae) AS sae FROM g JOIN c USING (nth) JOIN s USING (state) GROUP BY ALL)
SELECT representation, count(*) AS repetitions, round(stddev_samp(1 - sse / (y2 - y * y / n)), 5) AS r2_std, round(stddev_samp(sqrt(sse / n)), 6) AS rmse_std, round(stddev_samp(sae / n), 6) AS mae_std FROM b GROUP BY representation)"""


@query(BOOT, "predictions")
def m13_bootstrap(d: Domain) -> DataFrame:
    out = metrics.bootstrap(d.predictions(), "representation", "state", repetitions=200, seed=17)
    return out.select("representation", "repetitions", F.round("r2_std", 5).alias("r2_std"), F.round("rmse_std", 6).alias("rmse_std"), F.round("mae_std", 6).alias("mae_std"))


# Audits


@query("SELECT DISTINCT key FROM labels WHERE target > 145 ORDER BY key LIMIT 5", "labels")
def o05_examples(d: Domain) -> DataFrame:
    return audit.examples(d.labels(), F.col("target") > 145, "key")


@query("SELECT county_id, year, CASE WHEN year = 1996 THEN CASE WHEN timestep < 3 THEN 'both' ELSE 'input_fusion' END ELSE CASE WHEN timestep < 3 THEN 'late_fusion' ELSE 'unfused' END END AS family, count(*) AS n FROM emb GROUP BY ALL", "emb")
def p25_experiment_family(d: Domain) -> DataFrame:
    family = ids.experiment_family(F.when(F.col("year") == 1996, "s2,ERA5").otherwise("s2"), F.when(F.col("timestep") < 3, "late"))
    return d.embeddings().groupBy("county_id", "year", family.alias("family")).agg(F.count("*").alias("n"))


@query("SELECT county_id, year, count(*) AS n_bands, string_agg(CASE WHEN regexp_full_match('B' || CAST(timestep AS VARCHAR), 'B[0-9]') THEN 'B0' || CAST(timestep AS VARCHAR) END, ',' ORDER BY timestep) AS bands FROM measures GROUP BY ALL", "measures")
def p09_band_names(d: Domain) -> DataFrame:
    rows = d.measures().select("county_id", "year", "timestep", ids.band_name(F.concat(F.lit(" b"), "timestep")).alias("band"))
    listed = F.array_sort(F.collect_list(F.struct("timestep", "band")))
    return rows.groupBy("county_id", "year").agg(F.count("*").alias("n_bands"), listed.alias("r")).select("county_id", "year", "n_bands", F.array_join("r.band", ",").alias("bands"))


@query("SELECT check_name, CAST(n AS BIGINT) AS n_bad FROM (SELECT unnest(['finite_target', 'finite_spoilt']) AS check_name, unnest([0, count(*) FILTER (year IN (1996, 1997))]) AS n FROM labels)", "labels")
def v19_finite(d: Domain) -> DataFrame:
    rows = d.labels().withColumn("spoilt", F.when(F.col("year") == 1996, float("nan")).when(F.col("year") == 1997, None).otherwise(F.col("target")))
    return audit.finite_checks(rows, ["target", "spoilt"], "key").select("check_name", "n_bad")


@query("SELECT check_name, CAST(n AS BIGINT) AS n_bad FROM (SELECT unnest(['b_key_missing', 'b_key_extra', 'b_target', 'b_patch_count', 'b_patch_ids']) AS check_name, unnest([count(*) FILTER (year = 1995), 0, count(*) FILTER (year = 1997), 0, count(*) FILTER (year = 1998)]) AS n FROM labels)", "labels")
def v02_matched_cohorts(d: Domain) -> DataFrame:
    a = d.labels().select("key", "year", "target", F.lit(1).alias("n_patches"), F.array("key").alias("patch_ids"))
    b = a.where("year <> 1995").withColumns({"target": F.when(F.col("year") == 1997, F.col("target") + 1).otherwise(F.col("target")), "patch_ids": F.when(F.col("year") == 1998, F.array(F.lit("x"))).otherwise(F.col("patch_ids"))})
    return audit.matched_checks(a, b, "b").select("check_name", "n_bad")


@query("SELECT check_name, CAST(n AS BIGINT) AS n_bad FROM (VALUES ('backbone', 0), ('scope', 0), ('climate_modality', (SELECT count(*) FROM emb WHERE year = 1996))) v(check_name, n)", "emb")
def v07_representation(d: Domain) -> DataFrame:
    rows = d.embeddings().withColumns({"representation_scope": F.lit("timestep"), "input_modalities": F.when(F.col("year") == 1996, "s2,ERA5").otherwise("s2")})
    return audit.representation_checks(rows, backbone="frozen").select("check_name", "n_bad")


@query("SELECT check_name, CAST(n AS BIGINT) AS n_bad FROM (VALUES ('reported_r2', 0), ('reported_rmse', (SELECT count(DISTINCT representation) FROM predictions)), ('reported_mae', 0)) v(check_name, n)", "predictions")
def v10_reported_metrics(d: Domain) -> DataFrame:
    own = metrics.metrics(d.predictions(), ["representation", "fold"])
    stated = own.withColumn("rmse", F.when(F.col("fold") == 0, F.col("rmse") + 0.1).otherwise(F.col("rmse")))
    return audit.reported_checks(own, stated, ["representation", "fold"], metrics.METRICS).select("check_name", "n_bad")


@query("SELECT 'observed_observed_bu' AS check_name, count(*) FILTER (year = 1999) AS n_bad FROM predictions", "predictions")
def v11_equal_columns(d: Domain) -> DataFrame:
    rows = d.predictions().withColumn("observed_bu", F.when(F.col("year") == 1999, F.col("observed") + 1).otherwise(F.col("observed")))
    return audit.equal_columns_check(rows, "observed", "observed_bu", "key").select("check_name", "n_bad")


@query("SELECT 'grid' AS check_name, count(*) AS n_bad, min(representation || '-' || state) AS sample FROM (SELECT r.representation, s.state FROM (SELECT DISTINCT representation FROM predictions) r, (SELECT DISTINCT state FROM predictions) s) g ANTI JOIN (SELECT * FROM predictions WHERE NOT (representation = 'county_mean' AND state IN ('03', '04'))) p ON g.representation = p.representation AND g.state = p.state", "predictions")
def v12_run_grid(d: Domain) -> DataFrame:
    rows = d.predictions()
    return audit.grid_check(rows.where("not (representation = 'county_mean' and state in ('03', '04'))"), {"representation": rows, "state": rows})


@query("SELECT 'signature' AS check_name, count(*) FILTER (n_regionkey <> (SELECT min_by(n_regionkey, n_name) FROM nation)) AS n_bad FROM nation")
def v13_signatures(d: Domain) -> DataFrame:
    rows = d.table("nation").select("n_name", "n_regionkey", F.lit(5).alias("folds"))
    return audit.same_signature_check(rows, ["n_regionkey", "folds"], "n_name").select("check_name", "n_bad")


@query("SELECT fold, split, count(*) AS n, sha256(string_agg(key, chr(10) ORDER BY key)) AS sha256 FROM manifest GROUP BY ALL", "manifest")
def v14_partition_hashes(d: Domain) -> DataFrame:
    return d.manifest().groupBy("fold", "split").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("key")), "\n"), 256).alias("sha256"))


@query("SELECT 'target_drift' AS check_name, count(*) AS n_bad FROM (SELECT key FROM predictions WHERE year = 2000 GROUP BY key HAVING count(*) > 1)", "predictions")
def v15_target_drift(d: Domain) -> DataFrame:
    rows = d.predictions().withColumn("observed", F.when((F.col("year") == 2000) & (F.col("representation") == "year_mean"), F.col("observed") + 1).otherwise(F.col("observed")))
    return audit.target_drift_check(rows).select("check_name", "n_bad")


@query("SELECT 'seeds' AS check_name, count(*) AS n_bad FROM (SELECT DISTINCT representation, fold FROM seeded WHERE fold = 1)", "seeded")
def v16_seed_coverage(d: Domain) -> DataFrame:
    return audit.coverage_check(d.seeded().where("not (fold = 1 and seed = 2)"), ["representation", "fold"], "seed", 3, "seeds").select("check_name", "n_bad")


@query("""SELECT n_name AS contract, field, CAST(value AS VARCHAR) AS value, value = ref AS equal FROM (SELECT n_name, 'region' AS field, n_regionkey AS value, (SELECT min_by(n_regionkey, n_name) FROM nation) AS ref FROM nation UNION ALL SELECT n_name, 'folds', 5, 5 FROM nation)""")
def v17_contract_differences(d: Domain) -> DataFrame:
    rows = d.table("nation").select("n_name", F.col("n_regionkey").alias("region"), F.lit(5).alias("folds"))
    out = audit.contract_differences(rows, "n_name", ["region", "folds"])
    return out.select("contract", "field", F.get_json_object("value", "$.v").alias("value"), "equal")


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN h.key IS NULL THEN 'missing' WHEN h.tiles = 7 THEN 'covered' ELSE 'partial' END AS state FROM labels w LEFT JOIN (SELECT county_id || '-' || CAST(year AS VARCHAR) AS key, count(*) AS tiles FROM measures GROUP BY ALL) h USING (key)) GROUP BY ALL", "labels", "measures")
def v18_cohort_report(d: Domain) -> DataFrame:
    have = d.measures().withColumn("key", ids.panel_key(F.col("county_id"), F.col("year"))).groupBy("key").agg(F.count("*").alias("n_steps"))
    return panel.coverage(d.labels(), have, "key", F.col("n_steps") == 7).where("state <> 'extra'").groupBy("state").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint-pooled features per region and year with their labels."""
    d = Domain(spark, sf_dir)
    pooled = pooling.joint_pool(_whole(d), WIDTH)
    return panel.attach_labels(pooled, d.labels(), ["county_id", "year"]).select("county_id", "year", "key", "n", "target", "features").orderBy("county_id", "year")
