"""Registered queries of tile names, tile files, tile arrays, readers and sinks, each beside its SQL.

Tiles are the vectors of ``embeddings``: one per patch and timestep, with a name that says where and when. Queries about files
write them to the scratch folder first, through Spark, and read them back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, places, vectors
from ..operators import audit, panel, sequences, tiles, trees
from ..sources import tables
from ..sources import tiles as files
from .domain import INDEX, Domain
from .queries import query, r6

KEYS = ["county_id", "year", "patch_id", "timestep"]


def _number() -> F.Column:
    """The number in a patch id such as p12."""
    return F.substring("patch_id", 2, 9).cast("int")


#: The tile table in SQL: name, place and number of each tile.
TILES = """t AS (SELECT *, CAST(substr(patch_id, 2) AS INT) AS p, 'x' || CAST(CAST(substr(patch_id, 2) AS INT) % 7 AS VARCHAR) || '_y' || substr(patch_id, 2) AS place,
'county_' || county_id || '_year_' || CAST(year AS VARCHAR) || '_x' || CAST(CAST(substr(patch_id, 2) AS INT) % 7 AS VARCHAR) || '_y' || substr(patch_id, 2) || '_stack_COG_t' || CAST(timestep AS VARCHAR) || '_' || strftime(DATE '1995-04-15' + CAST(28 * timestep AS INT), '%Y-%m-%d') || '.npz' AS name FROM emb)"""


def _tiles(d: Domain) -> DataFrame:
    """The embedding rows with the number and the name of their tile."""
    date = F.date_format(F.date_add(F.lit("1995-04-15").cast("date"), 28 * F.col("timestep")), "yyyy-MM-dd")
    name = F.concat(F.lit("county_"), "county_id", F.lit("_year_"), "year", F.lit("_x"), F.col("p") % 7, F.lit("_y"), "p", F.lit("_stack_COG_t"), "timestep", F.lit("_"), date, F.lit(".npz"))
    return d.embeddings().withColumn("p", _number()).withColumn("name", name)


def _cube(d: Domain) -> DataFrame:
    """Tiles of four bands and 4 x 4 pixels."""
    return _tiles(d).select(*KEYS, "p", F.col("name").alias("path"), F.lit(4).alias("c"), F.lit(4).alias("h"), F.lit(4).alias("w"), F.col("embedding").alias("pixels"), F.array(*[F.lit(b) for b in ("B04", "B03", "B02", "B08")]).alias("bands"))


def tile_query(sql: str, *uses: str):
    """``sql`` may use the tile table t."""
    return query(f"SELECT * FROM (WITH {TILES} {sql})", "emb", *uses)


_FOLDERS: dict[tuple[str, str], str] = {}


def _folder(d: Domain, kind: str, rows) -> str:
    """The scratch folder with the files of ``rows()``, written once a session and data folder."""
    if (d.dir, kind) not in _FOLDERS:
        path = tables.scratch_dir(d.spark)
        files.write_npz(rows(), path)
        _FOLDERS[d.dir, kind] = path
    return _FOLDERS[d.dir, kind]


def _tile_folder(d: Domain) -> str:
    """Tiles of 4 x 8 pixels and two bands, bands last; those of every tenth patch lack the pixels."""
    meta = F.to_json(F.create_map(F.lit("county_fips"), F.col("county_id"), F.lit("year"), F.col("year").cast("string"), F.lit("yield_bu_per_acre"), (F.col("p") + 100).cast("string")))
    pixels = F.when(F.col("p") % 10 == 9, F.lit("other")).otherwise(F.lit("pixels"))
    return _folder(d, "tiles", lambda: _tiles(d).select(F.col("name").alias("file"), F.array(files.member("x", [4, 8, 2], F.col("embedding")).withField("name", pixels), files.member("band_names", [2], texts=F.array(F.lit("B02"), F.lit("B03"))), files.member("metadata", [], texts=F.array(meta))).alias("members")))


def _named(path: str = "path"):
    return F.regexp_extract(path, r"([^/]+)$", 1)


# Names


@tile_query("SELECT name, county_id, year, place AS patch_id, timestep, strftime(DATE '1995-04-15' + CAST(28 * timestep AS INT), '%Y-%m-%d') AS named_date FROM t")
def s12_tile_index(d: Domain) -> DataFrame:
    index = files.tile_index(files.list_files(d.spark, _tile_folder(d)), strict=True)
    return index.select(_named().alias("name"), "county_id", "year", "patch_id", "timestep", F.col("named_date").cast("string").alias("named_date"))


@query("""SELECT c_custkey, lpad(CAST(c_custkey % 99999 AS VARCHAR), 5, '0') AS county_id, CASE WHEN c_custkey % 6 = 5 THEN -1 ELSE 2020 END AS year,
CASE c_custkey % 6 WHEN 0 THEN 'x1_y2' WHEN 1 THEN 'x-3_y4' WHEN 2 THEN 'r5_c6' WHEN 3 THEN 'ab7' WHEN 4 THEN 'county_' || CAST(c_custkey % 99999 AS VARCHAR) || '_2020' ELSE 'x8_y9' END AS patch_id, CASE c_custkey % 6 WHEN 2 THEN 123 WHEN 5 THEN -1 ELSE 3 END AS timestep FROM customer""")
def s13_name_variants(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    start = F.concat(F.lit("/d/county_"), (k % 99999).cast("string"))
    ends = ["_2020_x1_y2_t3_2020-05-01", "-2020_x_-3_deep_y_4_T_3", "_year_2020_r5_c6_interval_123", "_year-2020_patch_ab7_timestep3", "_2020_stack_COG_t3_20200501", "_x8_y9"]
    name = start
    for n, end in enumerate(ends):
        name = F.when(k % 6 == n, F.concat(start, F.lit(end + ".npz"))).otherwise(name)
    known = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return files.tile_index(d.table("customer").select("c_custkey", name.alias("path"))).select("c_custkey", "county_id", known("year"), "patch_id", known("timestep"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey % 100 AS INT) WHEN 1 THEN CAST(c_custkey % 100 AS INT) WHEN 2 THEN CAST(c_custkey % 100 AS INT) ELSE -1 END AS timestep FROM customer")
def p28_intervals(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    n = (k % 100).cast("string")
    stem = F.when(k % 4 == 0, F.concat(F.lit("a_t"), n)).when(k % 4 == 1, F.concat(F.lit("Interval_"), n, F.lit("_b"))).when(k % 4 == 2, F.concat(F.lit("x_timestep-"), n, F.lit("_2020"))).otherwise(F.concat(F.lit("part"), n))
    return d.table("customer").select("c_custkey", F.coalesce(ids.interval_of(stem), F.lit(-1)).alias("timestep"))


@tile_query("""SELECT check_name, CAST(n AS BIGINT) AS n_bad FROM (VALUES ('county_differs', (SELECT count(*) + count(*) FILTER (timestep = 5) FROM t WHERE p % 8 = 1)), ('year_differs', (SELECT count(*) + count(*) FILTER (timestep = 5) FROM t WHERE p % 8 = 2)), ('date_differs', (SELECT count(*) + count(*) FILTER (timestep = 5) FROM t WHERE p % 8 = 3)),
('duplicate_tile', (SELECT count(*) FROM t WHERE timestep = 5))) v(check_name, n)""")
def p29_identity_checks(d: Domain) -> DataFrame:
    """Names and metadata disagree in some patches, and the tiles of one timestep are there twice."""
    k = F.col("p") % 8
    meta = F.create_map(F.lit("county_fips"), F.when(k == 1, "99999").otherwise(F.col("county_id")), F.lit("year"), F.when(k == 2, "1901").otherwise(F.col("year").cast("string")), F.lit("date"), F.when(k == 3, "1901-01-01"))
    rows = _tiles(d).select("timestep", F.col("name").alias("path"), meta.alias("meta"))
    again = rows.where("timestep = 5").withColumn("path", F.replace("path", F.lit("county_"), F.lit("copy_county_")))
    return files.identity_checks(rows.unionByName(again).drop("timestep")).select("check_name", "n_bad")


@tile_query("SELECT check_name, CAST(n AS BIGINT) AS n_bad FROM (VALUES ('no_county_id', (SELECT count(*) FROM t WHERE p % 9 = 1)), ('no_year', (SELECT count(*) FROM t WHERE p % 9 = 2)), ('no_timestep', (SELECT count(*) FROM t WHERE p % 9 = 3))) v(check_name, n)")
def v09_unnamed_tiles(d: Domain) -> DataFrame:
    """Names without a part."""
    k = F.col("p") % 9
    path = F.when(k == 1, F.replace("name", F.lit("county_"), F.lit("c_"))).when(k == 2, F.regexp_replace("name", "_year_[0-9]+", "")).when(k == 3, F.regexp_replace("name", "_t[0-9]_", "_")).otherwise(F.col("name"))
    return files.unnamed(files.tile_index(_tiles(d).select(path.alias("path")))).select("check_name", "n_bad")


@query("SELECT CAST(year AS INT) AS year, count(*) AS n FROM labels GROUP BY ALL", "labels")
def p06_years_of_keys(d: Domain) -> DataFrame:
    return panel.years_of_keys(d.labels())


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'temperature' WHEN 1 THEN 'precipitation' WHEN 2 THEN 'temperature' ELSE 'wind' END AS band, CASE c_custkey % 4 WHEN 1 THEN c_acctbal / 1000 BETWEEN 0 AND 5 WHEN 3 THEN true ELSE c_acctbal / 20 BETWEEN 180 AND 340 END AS plausible FROM customer""")
def p18_climate_bands(d: Domain) -> DataFrame:
    k, x = F.col("c_custkey") % 4, F.col("c_acctbal")
    rows = d.table("customer").select("c_custkey", places.climate_band(F.when(k == 0, " T2M").when(k == 1, "TP ").when(k == 2, "tmean").otherwise("Wind")).alias("band"), F.when(k == 1, x / 1000).otherwise(x / 20).alias("v"))
    return rows.select("c_custkey", "band", places.plausible(F.col("band"), F.col("v"), F.col("v")).alias("plausible"))


@query("SELECT CAST(shift AS INT) AS shift, CAST(shift AS INT) AS base, CAST(shift AS INT) AS origin, count(*) AS n FROM emb, (VALUES (0), (1)) v(shift) GROUP BY ALL", "emb")
def p19_timestep_base(d: Domain) -> DataFrame:
    """Schedules from 0 and from 1."""
    parts = [d.embeddings().withColumn("timestep", F.col("timestep") + shift) for shift in (0, 1)]
    return panel.united({str(k): x.agg(F.lit(files.timestep_base(x, 7)).alias("base"), F.lit(files.interval_origin(x, 7)).alias("origin"), F.count("*").alias("n")) for k, x in enumerate(parts)}, "shift").withColumn("shift", F.col("shift").cast("int"))


@query("SELECT CASE WHEN n1 > n0 THEN 1 ELSE 0 END AS origin FROM (SELECT count(*) FILTER (len(list_filter([0, 1, 2, 3, 4, 5], lambda x: NOT list_contains(s, x))) = 0) AS n0, count(*) FILTER (len(list_filter([1, 2, 3, 4, 5, 6], lambda x: NOT list_contains(s, x))) = 0) AS n1 FROM (SELECT list(timestep) AS s FROM emb WHERE NOT (timestep = 0 AND CAST(substr(patch_id, 2) AS INT) % 2 = 0) GROUP BY county_id, year, patch_id))", "emb")
def p21_interval_origin(d: Domain) -> DataFrame:
    rows = d.embeddings().where(~((F.col("timestep") == 0) & (_number() % 2 == 0)))
    return rows.agg(F.lit(files.interval_origin(rows, 6)).alias("origin"))


# Tile files


@tile_query("""SELECT name, CAST(pos AS INT) AS pos, round(CAST(embedding[(pos % 32) * 2 + pos // 32 + 1] AS DOUBLE), 6) AS value FROM t, range(0, 64) r(pos) WHERE p % 10 <> 9""")
def s15_decoded_tiles(d: Domain) -> DataFrame:
    """Pixels come bands first, whichever way the file has them."""
    rows = files.read_tiles(d.spark, _tile_folder(d), glob="*_y*[0-8]_stack*.npz").withColumn("name", _named())
    return vectors.long_form(rows, ["name"], "pixels")


@tile_query("""SELECT name, CASE WHEN p % 10 = 9 THEN 'missing pixels' END AS failure FROM t UNION ALL SELECT 'lost_' || CAST(n_nationkey AS VARCHAR) || '.npz', 'empty or absent' FROM nation""")
def s18_integrity(d: Domain) -> DataFrame:
    folder = _tile_folder(d)
    top = F.concat(F.lit("file:" + folder.removeprefix("file://").removeprefix("file:") + "/"), F.col("name")).alias("path")
    lost = d.table("nation").select(F.concat(F.lit("lost_"), "n_nationkey", F.lit(".npz")).alias("name"))
    report = files.integrity(d.spark, folder, expected=_tiles(d).select("name").unionByName(lost).select(top))
    return report.select(_named().alias("name"), "failure")


@tile_query("SELECT name, 4 AS h, 8 AS w FROM t WHERE p % 10 <> 9")
def s17_shapes(d: Domain) -> DataFrame:
    return files.read_shapes(d.spark, _tile_folder(d), glob="*_y*[0-8]_stack*.npz").select(_named().alias("name"), "h", "w")


@tile_query("SELECT county_id, year, place AS patch_id, CAST(p + 100 AS DOUBLE) AS target, CAST(count(*) AS INT) AS n, list_min(list(timestep)) AS first_step FROM t WHERE p % 10 <> 9 GROUP BY ALL HAVING count(*) = 7")
def s14_patch_sequences(d: Domain) -> DataFrame:
    rows = files.patch_sequences(files.read_metadata(d.spark, _tile_folder(d), glob="*_y*[0-8]_stack*.npz"), None, 7)
    return rows.select("county_id", "year", "patch_id", "target", F.size("files").alias("n"), F.array_min("steps").alias("first_step"))


@tile_query("SELECT county_id, year, place AS patch_id, CASE WHEN year = 1995 THEN 7.5 ELSE CAST(p AS DOUBLE) END AS target FROM t WHERE p % 3 > 0 OR year = 1995 GROUP BY ALL HAVING count(*) = 7")
def j13_own_labels(d: Domain) -> DataFrame:
    """A label table for one year; the tiles' own values, which some lack, are second."""
    labels = d.embeddings().where("year = 1995").select("county_id", "year", F.lit(7.5).alias("target")).distinct()
    meta = F.create_map(F.lit("yield_bu_per_acre"), F.when(F.col("p") % 3 == 0, "n/a").otherwise(F.col("p").cast("string")))
    return files.patch_sequences(_tiles(d).select(F.col("name").alias("path"), meta.alias("meta")), labels, 7, authoritative=False).select("county_id", "year", "patch_id", "target")


def _bundle_folder(d: Domain) -> str:
    """A file per patch with two steps of one band of 4 x 8 pixels; crops alternate."""
    def rows() -> DataFrame:
        two = _tiles(d).where("timestep < 2").groupBy("county_id", "year", "p").agg(F.flatten(F.array_sort(F.collect_list(F.struct("timestep", "embedding"))).getField("embedding")).alias("v"), F.count("*").alias("n")).where("n = 2")
        one = lambda name, value: files.member(name, [], texts=F.array(value.cast("string")))
        members = [files.member("patches", [1, 2, 2, 4, 8], F.col("v")), files.member("band_names", [2], texts=F.array(F.lit("B02"), F.lit("B03"))), one("county_fips", F.col("county_id")), one("year", F.col("year")), one("crop", F.when(F.col("p") % 2 == 0, "Corn").otherwise("soy")), one("yield_bu_per_acre", F.col("p"))]
        return two.select(F.concat(F.lit("bundle_"), "p", F.lit(".npz")).alias("file"), F.array(*members).alias("members"))

    return _folder(d, "bundles", rows)


@tile_query("SELECT county_id, year, CAST(p AS DOUBLE) AS target, timestep, 2 AS c, 4 AS h, 8 AS w, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM t WHERE timestep < 2 AND p % 2 = 0 AND p IN (SELECT p FROM t WHERE timestep = 1)")
def s16_bundles(d: Domain) -> DataFrame:
    rows = files.read_bundles(d.spark, _bundle_folder(d))
    return rows.select("county_id", "year", "target", "timestep", "c", "h", "w", F.round(F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def _vector_folder(d: Domain) -> str:
    """Files with one vector, and files with one vector a timestep."""
    def rows() -> DataFrame:
        t = _tiles(d)
        single = t.where("p % 2 = 0").select(F.col("name").alias("file"), F.array(files.member("embedding", [64], F.col("embedding"))).alias("members"))
        joint = t.where("p % 2 = 1").groupBy("county_id", "year", "p").agg(F.flatten(F.array_sort(F.collect_list(F.struct("timestep", "embedding"))).getField("embedding")).alias("v"), F.count("*").alias("n")).where("n = 7")
        name = F.concat(F.lit("county_"), "county_id", F.lit("_year_"), "year", F.lit("_x"), F.col("p") % 7, F.lit("_y"), "p", F.lit(".npz"))
        return single.unionByName(joint.select(name.alias("file"), F.array(files.member("features", [7, 64], F.col("v"))).alias("members")))

    return _folder(d, "vectors", rows)


@tile_query("SELECT name AS file, 0 AS row, 1 AS rows, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM t WHERE p % 2 = 0")
def s10_table_function(d: Domain) -> DataFrame:
    """Single-vector files, opened by a table function in SQL."""
    files.register_functions(d.spark)
    d.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_vector_folder(d)).createOrReplaceTempView("npz_files")
    out = d.spark.sql("SELECT path, e.row, e.rows, e.embedding FROM npz_files f, LATERAL embedding_rows(f.content) e WHERE e.rows = 1")
    return out.select(_named().alias("file"), "row", "rows", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@tile_query("SELECT county_id, year, timestep, place AS patch_id, 'npz' AS backbone, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM t WHERE p % 2 = 0 UNION ALL SELECT county_id, year, CAST(timestep AS INT), place || '', 'npz', round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) FROM t WHERE p % 2 = 1 AND p IN (SELECT p FROM t GROUP BY p HAVING count(*) = 7)")
def s10_embedding_files(d: Domain) -> DataFrame:
    """Files with one vector, and files with one vector a timestep."""
    out = files.read_embedding_files(d.spark, _vector_folder(d), backbone="npz")
    return out.select("county_id", "year", "timestep", "patch_id", "backbone", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


MATCHED = "SELECT t.* FROM t JOIN (SELECT county_id, year, patch_id FROM t GROUP BY ALL HAVING count(*) = 7) USING (county_id, year, patch_id) WHERE year = 1995"


def _matched(d: Domain) -> DataFrame:
    index = files.tile_index(_tiles(d).select(F.col("name").alias("path"), (1000 + F.col("timestep")).cast("long").alias("length")), strict=True)
    cohort = d.embeddings().where("year = 1995").select("county_id", "year").distinct()
    return files.matched_files(index, cohort, 7)


@tile_query(f"SELECT name AS path, CAST(1000 + timestep AS BIGINT) AS length FROM ({MATCHED})")
def j12_matched_files(d: Domain) -> DataFrame:
    return _matched(d)


@tile_query(f"SELECT count(*) AS files, CAST(sum(1000 + timestep) AS BIGINT) AS bytes, min(name) AS low, max(name) AS high FROM ({MATCHED})")
def s28_file_list(d: Domain) -> DataFrame:
    """Written as lines and read back."""
    found, path = _matched(d), tables.scratch_dir(d.spark)
    files.write_file_list(found, path)
    return files.volume(found).join(d.spark.read.text(path).agg(F.min("value").alias("low"), F.max("value").alias("high")))


@tile_query("SELECT 'file_count' AS check_name, abs(count(*) - 100) AS n_bad FROM t")
def v08_file_count(d: Domain) -> DataFrame:
    return files.file_count_check(files.list_files(d.spark, _tile_folder(d)), 100).select("check_name", "n_bad")


# Tile arrays


def _long(df: DataFrame) -> DataFrame:
    return vectors.long_form(df, KEYS, "pixels")


def _pixels_sql(pick: str, n: int) -> str:
    return f"SELECT county_id, year, patch_id, timestep, CAST(pos AS INT) AS pos, {pick} AS value FROM t, range(0, {n}) r(pos)"


@tile_query(_pixels_sql("round(CAST(embedding[[2, 1, 0, 3][pos // 16 + 1] * 16 + pos % 16 + 1] AS DOUBLE), 6)", 64))
def t01_band_order(d: Domain) -> DataFrame:
    return _long(tiles.reindexed(_cube(d), ["B02", "B03", "B04", "B08"]))


@tile_query(_pixels_sql("CASE pos // 16 WHEN 1 THEN 0 ELSE round(CAST(embedding[CASE pos // 16 WHEN 0 THEN 48 ELSE 32 END + pos % 16 + 1] AS DOUBLE), 6) END", 48))
def t02_padded_bands(d: Domain) -> DataFrame:
    return _long(tiles.reindexed(_cube(d), ["B08", "B11", "B02"], pad=True))


@tile_query(_pixels_sql("round(CAST(embedding[(pos // 4) * 16 + (1 + (pos % 4) // 2) * 4 + 1 + pos % 2 + 1] AS DOUBLE), 6)", 16))
def t03_centre_crop(d: Domain) -> DataFrame:
    return _long(tiles.cropped(_cube(d), 4, 2))


@tile_query("SELECT county_id, year, patch_id, bool_and(NOT (p % 5 = 0 AND timestep = 2)) AS kept, count(*) AS tiles FROM t GROUP BY ALL")
def t04_screened(d: Domain) -> DataFrame:
    """One small tile drops its whole patch."""
    rows = _cube(d).withColumn("h", F.when((F.col("p") % 5 == 0) & (F.col("timestep") == 2), 1).otherwise(4))
    kept, _ = tiles.screen_undersized(rows, 4)
    patches = rows.groupBy("county_id", "year", "patch_id").agg(F.count("*").alias("tiles"))
    return patches.join(kept.select("county_id", "year", "patch_id", F.lit(True).alias("k")).distinct(), ["county_id", "year", "patch_id"], "left").select("county_id", "year", "patch_id", F.coalesce("k", F.lit(False)).alias("kept"), "tiles")


def _spoilt(d: Domain) -> DataFrame:
    bad = F.transform("pixels", lambda x: F.when(x > 0.1, float("nan")).when(x < -0.2, float("inf")).when((x > 0.05) & (x < 0.06), None).otherwise(x).cast("float"))
    return _cube(d).withColumn("pixels", bad)


GOOD = "list_filter(embedding, lambda x: NOT (x > CAST(0.1 AS DOUBLE) OR x < CAST(-0.2 AS DOUBLE) OR (x > CAST(0.05 AS DOUBLE) AND x < CAST(0.06 AS DOUBLE))))"


@tile_query(f"SELECT county_id, year, patch_id, timestep, CAST(64 - len({GOOD}) AS INT) AS n_bad, round(coalesce(list_sum(list_transform({GOOD}, lambda x: CAST(x AS DOUBLE))), 0), 4) AS total, round(len({GOOD}) / 64.0, 6) AS valid_fraction FROM t")
def t05_nonfinite(d: Domain) -> DataFrame:
    out = tiles.valid_fraction(tiles.without_nonfinite(_spoilt(d), "mask"))
    return r6(out.select(*KEYS, F.size(F.filter("valid", lambda v: ~v)).alias("n_bad"), F.round(F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), "valid_fraction"))


@tile_query("""SELECT county_id, year, patch_id, CAST(count(*) FILTER (ok) AS INT) AS n_valid, array_to_string(list(CASE WHEN ok THEN '1' ELSE '0' END ORDER BY pos), '') AS mask FROM
(SELECT county_id, year, patch_id, pos, bool_and(NOT (x > CAST(0.1 AS DOUBLE) OR x < CAST(-0.2 AS DOUBLE) OR (x > CAST(0.05 AS DOUBLE) AND x < CAST(0.06 AS DOUBLE)))) AS ok FROM (SELECT county_id, year, patch_id, unnest(range(0, 64)) AS pos, unnest(embedding) AS x FROM t) GROUP BY ALL) GROUP BY county_id, year, patch_id""")
def t06_sequence_masks(d: Domain) -> DataFrame:
    out = tiles.sequence_masks(tiles.without_nonfinite(_spoilt(d), "mask"))
    return out.select("county_id", "year", "patch_id", "n_valid", F.array_join(F.transform("mask", lambda v: F.when(v, "1").otherwise("0")), "").alias("mask"))


HASHED = "('0x' || substr(md5(concat_ws('-', county_id, CAST(year AS VARCHAR), patch_id, 's', {})), 1, 8))::BIGINT"


@tile_query(f"""SELECT county_id, year, patch_id, n < 4 AS replacement, CAST(rank AS INT) AS rank, CAST(CASE WHEN n < 4 THEN {HASHED.format('CAST(rank AS VARCHAR)')} ELSE {HASHED.format("'start'")} + rank * [2147483647, 2147483629, 2147483587, 2147483579][{HASHED.format("'stride'")} % 4 + 1] END % n AS INT) AS pixel
FROM (SELECT DISTINCT county_id, year, patch_id, CAST(1 + p % 9 AS BIGINT) AS n FROM t), range(0, 4) r(rank)""")
def t08_pixel_sample(d: Domain) -> DataFrame:
    rows = _tiles(d).select("county_id", "year", "patch_id", (1 + F.col("p") % 9).alias("n_pixels")).distinct()
    return tiles.pixel_sample(rows, 4, "s")


@tile_query("SELECT CAST(pos // 16 AS INT) AS band, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM t WHERE year = 1995) GROUP BY ALL")
def t10_channel_statistics(d: Domain) -> DataFrame:
    return r6(tiles.channel_statistics(_cube(d), patches=1_000_000, pixels=16, seed=1, train="year = 1995"))


@tile_query("SELECT county_id, year, patch_id, timestep, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top FROM t")
def t14_encoded(d: Domain) -> DataFrame:
    def encoder(rows: pd.DataFrame) -> list:
        return [[np.asarray(x, float).sum(), np.max(x)] for x in rows["pixels"]]

    out = tiles.encoded(_cube(d), encoder, batch=16)
    return out.select(*KEYS, F.round(F.col("embedding")[0].cast("double"), 4).alias("total"), F.round(F.col("embedding")[1].cast("double"), 6).alias("top"))


@tile_query(" UNION ALL ".join(f"SELECT county_id, year, patch_id, timestep, '{n}' AS pooling, CAST(pos AS INT) AS pos, round(CAST(CAST(({v}) AS FLOAT) AS DOUBLE), 6) AS value FROM t, range(0, 16) r(pos)" for n, v in (("cls", "CAST(embedding[pos + 1] AS DOUBLE)"), ("spatial_mean", "(CAST(embedding[17 + pos] AS DOUBLE) + embedding[33 + pos] + embedding[49 + pos]) / 3"), ("mean", "(CAST(embedding[1 + pos] AS DOUBLE) + embedding[17 + pos] + embedding[33 + pos] + embedding[49 + pos]) / 4"))))
def t15_pooled_tokens(d: Domain) -> DataFrame:
    rows = _tiles(d).select(*KEYS, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, F.lit(16))).alias("tokens"))
    both = panel.united({n: tiles.pooled_tokens(rows, n).drop("tokens").withColumn("embedding", F.col("embedding").cast("array<double>")) for n in ("cls", "spatial_mean", "mean")}, "pooling")
    return vectors.long_form(both, [*KEYS, "pooling"], "embedding")


@tile_query("SELECT check_name, CAST(n AS BIGINT) AS n_bad FROM (VALUES ('dates_not_increasing', (SELECT count(*) FROM t WHERE p % 6 = 0 AND timestep = 4)), ('position_moves', (SELECT count(*) FROM t WHERE p % 7 = 0 AND timestep = 2))) v(check_name, n)")
def t19_chronology(d: Domain) -> DataFrame:
    """A date that repeats the one before, and a place that moves."""
    step = F.when((F.col("p") % 6 == 0) & (F.col("timestep") == 4), 3).otherwise(F.col("timestep"))
    rows = _tiles(d).select(*KEYS, F.date_add(F.lit("1995-04-15").cast("date"), 28 * step).alias("date"), F.when((F.col("p") % 7 == 0) & (F.col("timestep") == 2), 40.1).otherwise(40.0).alias("lat"), F.lit(-90.0).alias("lon"))
    return tiles.chronology_checks(rows).select("check_name", "n_bad")


@tile_query("""SELECT county_id, year, patch_id, CAST(s AS INT) AS timestep, CAST(coalesce(max(timestep) FILTER (timestep <= s), min(timestep)) AS INT) AS shown FROM (SELECT * FROM t WHERE (p + timestep) % 4 > 0), range(0, 7) r(s) GROUP BY ALL""")
def t09_assembled_tiles(d: Domain) -> DataFrame:
    """Whole arrays carried to the steps that lack them; an array's own step tells it."""
    rows = _tiles(d).where((F.col("p") + F.col("timestep")) % 4 > 0).select("county_id", "year", "patch_id", "timestep", F.array(F.col("timestep")).alias("pixels"))
    return tiles.assembled(rows, 7).select("county_id", "year", "patch_id", "timestep", F.col("pixels")[0].alias("shown"))


# Tables, readers and sinks


@query("SELECT kind, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer, (VALUES ('csv'), ('parquet')) v(kind)")
def s01_read_table(d: Domain) -> DataFrame:
    rows, top = d.table("customer").select("c_custkey", "c_name"), tables.scratch_dir(d.spark)
    rows.write.csv(f"{top}/a.csv", header=True)
    rows.write.parquet(f"{top}/a.parquet")
    return panel.united({k: tables.read_table(d.spark, f"{top}/a.{k}").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name") for k in ("csv", "parquet")}, "kind")


@query("SELECT n_nationkey AS county_id, n_name AS name FROM nation")
def s02_resolved_columns(d: Domain) -> DataFrame:
    rows = d.table("nation").select(F.col("n_nationkey").alias(" GEOID "), F.col("n_regionkey").alias("fips_old"), F.col("n_name").alias("Label"), F.col("n_comment").alias("text") if "n_comment" in d.table("nation").columns else F.lit("").alias("text"))
    return tables.resolve_columns(rows, {"county_id": ["fips", "geoid"], "name": ["title", "label", "text"]})


@query("SELECT n_nationkey AS first, n_regionkey AS exact FROM nation")
def s03_exact_first(d: Domain) -> DataFrame:
    rows = d.table("nation").select(F.col("n_nationkey").alias("GeoID"), F.col("n_regionkey").alias("fips"))
    names = ["geoid", "fips"]
    found = [tables.resolve(rows.columns, names), tables.resolve(rows.columns, names, exact_first=True)]
    return rows.select(F.col(found[0]).alias("first"), F.col(found[1]).alias("exact"))


SUMMED = "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total"


def _summed(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def _written(d: Domain) -> str:
    path = tables.scratch_dir(d.spark)
    tables.write_embeddings(d.embeddings(), path)
    return path


@query(f"SELECT county_id, year, patch_id, timestep, backbone, {SUMMED} FROM emb", "emb")
def s04_read_embeddings(d: Domain) -> DataFrame:
    return _summed(tables.read_embeddings(d.spark, _written(d)), *KEYS, "backbone")


@query("SELECT county_id, year, count(*) AS n, CAST(1 AS BIGINT) AS files FROM emb GROUP BY ALL", "emb")
def s05_write_embeddings(d: Domain) -> DataFrame:
    """A region and year are in one file, below the backbone's folder."""
    rows = d.spark.read.parquet(_written(d) + "/backbone=frozen").withColumn("file", F.input_file_name())
    return rows.groupBy("county_id", "year").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


@query(f"SELECT county_id, year, patch_id, timestep, {SUMMED} FROM emb", "emb")
def s06_text_vectors(d: Domain) -> DataFrame:
    """Vectors that a writer left as text."""
    text = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), " "), F.lit("]"))
    return _summed(tables.typed_embeddings(d.embeddings().withColumn("embedding", text).withColumn("year", F.col("year").cast("string"))), *KEYS)


@query(f"SELECT county_id, year, patch_id, timestep, 'old' AS backbone, {SUMMED} FROM emb", "emb")
def s07_legacy_table(d: Domain) -> DataFrame:
    """Other column names, and a year and a region as numbers."""
    rows = d.embeddings().select(F.col("county_id").cast("int").alias("FIPS"), F.col("year").cast("double").alias("Year"), F.col("patch_id").alias("tile"), F.col("timestep").cast("string").alias("interval"), F.col("embedding").alias("features"))
    return _summed(tables.adapt_embeddings(rows, backbone="old"), *KEYS, "backbone")


@query(f"SELECT county_id, year, patch_id, timestep, 'pairs' AS backbone, {SUMMED} FROM (SELECT * REPLACE (CAST(0 AS INT) AS timestep) FROM emb WHERE timestep = 2)", "emb")
def s08_vector_pairs(d: Domain) -> DataFrame:
    """Vectors and their places in two tables."""
    rows = d.embeddings().where("timestep = 2")
    row = F.substring("patch_id", 2, 9).cast("long").alias("row_id")
    meta = rows.select(row, F.concat_ws("_", "county_id", "year", "patch_id").alias("location"))
    return _summed(tables.adapt_pairs(rows.select(row, "embedding"), meta, backbone="pairs"), *KEYS, "backbone")


@query("SELECT 'wide' AS backbone, 7 AS width, count(*) AS rows, count(DISTINCT county_id) AS counties, array_to_string(list_sort(list(DISTINCT year)), ',') AS years FROM (SELECT county_id, year FROM measures GROUP BY ALL HAVING count(*) = 7)", "measures")
def s11_converted(d: Domain) -> DataFrame:
    wide = d.wide(["evi"]).dropna()
    wide = wide.select(F.col("county_id").alias("GEOID"), "year", *[F.col(f"evi_{s + 4}").alias(f"mean_A{s:02d}") for s in range(7)])
    return tables.convert_wide(wide, backbone="wide", width=7)[1].withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_nationkey AS DOUBLE) END AS x FROM nation")
def s19_contract(d: Domain) -> DataFrame:
    """JSON lines; numbers that JSON lacks are null."""
    path = tables.scratch_dir(d.spark)
    x = F.when(F.col("n_nationkey") % 3 == 0, float("nan")).otherwise(F.col("n_nationkey").cast("double"))
    tables.write_contract(d.table("nation").select(F.col("n_name").alias("name"), x.alias("x")), path)
    return d.spark.read.text(path).select(F.from_json("value", "name string, x double", {"mode": "FAILFAST"}).alias("r")).select("r.*")


@query("SELECT key, round(target / 7, 4) AS target FROM labels", "labels")
def s20_results(d: Domain) -> DataFrame:
    path = tables.scratch_dir(d.spark)
    tables.write_results(d.labels().select("key", (F.col("target") / 7).alias("target")), path, ["key"])
    return tables.read_table(d.spark, path + "/*.csv").select("key", F.col("target").cast("double").alias("target"))


@query("SELECT DISTINCT key, nth FROM (SELECT key, CAST(row_number() OVER (ORDER BY key) AS INT) AS nth FROM labels)", "labels")
def o01_written_order(d: Domain) -> DataFrame:
    """The lines of the files, one file after another, are in key order: a line's place is its key's."""
    from ..operators.numbering import numbered

    path = tables.scratch_dir(d.spark)
    tables.write_results(d.labels().select("key", "target"), path, ["key"])
    lines = d.spark.read.text(path + "/*.csv", wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text")).where("line > 0 and text <> ''")
    return numbered(lines, ["file", "line"], start=1).select(F.split_part("text", F.lit(","), F.lit(1)).alias("key"), F.col("place").cast("int").alias("nth"))


@query("SELECT representation, state, key, round(observed, 6) AS observed, round(predicted, 6) AS predicted FROM predictions", "predictions")
def s21_run_grid(d: Domain) -> DataFrame:
    path = tables.scratch_dir(d.spark)
    tables.write_run_grid(d.predictions().select("representation", "state", "key", "observed", "predicted"), path)
    return r6(tables.read_run_grid(d.spark, path).select("representation", "state", "key", F.col("observed").cast("double").alias("observed"), F.col("predicted").cast("double").alias("predicted")))


@query("SELECT n_name, CAST(n_regionkey AS INT) AS n_regionkey, 'yes' AS checked FROM nation")
def s22_contract_columns(d: Domain) -> DataFrame:
    return tables.with_contract(d.table("nation").select("n_name", F.col("n_regionkey").cast("int").alias("n_regionkey")), {"n_regionkey": -1, "checked": "yes"})


@query("SELECT DISTINCT key FROM labels WHERE year <= 1997", "labels")
def s23_key_list(d: Domain) -> DataFrame:
    """Keys in a text file, with blanks around, comments, empty lines and repeats."""
    path = tables.scratch_dir(d.spark)
    line = F.when(F.col("year") == 1998, F.concat(F.lit("# "), "key")).when(F.col("year") > 1998, "  ").otherwise(F.concat(F.lit(" "), "key", F.lit("  ")))
    rows = d.labels().select(line.alias("value"))
    rows.unionAll(rows).write.text(path)
    return tables.load_keys(d.spark, path)


@query("""SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS fips, 0 AS ring, CAST(i AS INT) AS place, n_nationkey + [0.0, 1.0, 1.0, 0.0][i + 1]::DOUBLE AS lon, n_regionkey + [0.0, 0.0, 1.5, 0.0][i + 1]::DOUBLE AS lat FROM nation, range(0, 4) r(i)""")
def s26_boundaries(d: Domain) -> DataFrame:
    """A GeoJSON file per region; its polygons have their code under differing names."""
    k, path = F.col("n_nationkey"), tables.scratch_dir(d.spark)
    point = lambda a, b: F.array(k + a, F.col("n_regionkey") + b).cast("array<double>")
    ring = F.array(point(0.0, 0.0), point(1.0, 0.0), point(1.0, 1.5), point(0.0, 0.0))
    code = ids.zfill(k, 5)
    one = lambda *pairs: F.to_json(F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in pairs]))
    props = F.when(k % 3 == 0, one("GEOID", code)).when(k % 3 == 1, one("fips", code)).otherwise(one("STATEFP", F.substring(code, 1, 2), "COUNTYFP", F.substring(code, 3, 3)))
    polygon = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"'), F.when(k % 2 == 0, "Polygon").otherwise("MultiPolygon"), F.lit('","coordinates":'), F.when(k % 2 == 0, F.to_json(F.array(ring))).otherwise(F.to_json(F.array(F.array(ring)))), F.lit("}}"))
    texts = d.table("nation").groupBy("n_regionkey").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(polygon), ","), F.lit("]}")).alias("value"))
    texts.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return files.boundary_segments(d.spark, path)


@tile_query("SELECT county_id, CAST(year AS VARCHAR) AS year, patch_id, string_agg(CAST(timestep AS VARCHAR), ';' ORDER BY timestep) AS intervals FROM t GROUP BY ALL")
def s27_points(d: Domain) -> DataFrame:
    path = tables.scratch_dir(d.spark)
    files.write_points(d.embeddings().groupBy("county_id", "year", "patch_id").agg(F.array_sort(F.collect_set("timestep")).alias("intervals")), path)
    return tables.read_table(d.spark, path + "/*.csv").select("county_id", "year", "patch_id", "intervals")


# Joins, unions, models and provenance


@query("SELECT a.county_id, a.year, a.patch_id, a.timestep, round(CAST(a.embedding[1] AS DOUBLE) + b.embedding[2], 5) AS both FROM emb a JOIN emb b ON a.county_id = b.county_id AND a.year = b.year AND a.patch_id = b.patch_id AND a.timestep = b.timestep WHERE a.timestep < 4", "emb")
def j04_companions(d: Domain) -> DataFrame:
    """Tiles with the climate tile of the same keys, of which there are more."""
    rows = d.embeddings()
    both = panel.companions(rows.where("timestep < 4").select(*KEYS, F.col("embedding")[0].alias("a")), rows.select(*KEYS, F.col("embedding")[1].alias("b")), KEYS)
    return both.select(*KEYS, F.round(F.col("a").cast("double") + F.col("b"), 5).alias("both"))


@query("SELECT key, round(target, 6) AS target FROM labels SEMI JOIN panel USING (key)", "panel", "labels")
def j06_covering(d: Domain) -> DataFrame:
    """A table that must cover the cohort, restricted to it."""
    return r6(panel.restrict(d.labels().select("key", "target"), d.panel().select("key"), "key")[0])


@query("SELECT source, county_id, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT 'a' AS source, county_id, sum(target) AS x, NULL AS y FROM labels GROUP BY county_id UNION ALL SELECT 'b', county_id, sum(evi), max(evi) FROM measures GROUP BY county_id)", "labels", "measures")
def u07_union(d: Domain) -> DataFrame:
    a = d.labels().groupBy("county_id").agg(F.sum("target").alias("x"))
    b = d.measures().groupBy("county_id").agg(F.sum("evi").alias("x"), F.max("evi").alias("y"))
    return r6(panel.united({"a": a, "b": b}, "source").select("source", "county_id", "x", "y"))


@query("SELECT representation AS regressor, CAST(CASE representation WHEN 'year_mean' THEN 1 ELSE 0 END AS BIGINT) AS missing_cells, CAST(count(*) FILTER (representation = 'county_mean' AND fold = 2 AND year = 1996) AS BIGINT) AS repeated_keys FROM seeded GROUP BY representation", "seeded")
def m14_run_cells(d: Domain) -> DataFrame:
    """One cell is absent, and some keys were predicted twice."""
    rows = d.seeded().withColumnRenamed("representation", "regressor")
    there = rows.where("not (regressor = 'year_mean' and fold = 1 and seed = 2)")
    return trees.cell_checks(there.unionByName(rows.where("regressor = 'county_mean' and fold = 2 and year = 1996")), 5, 3)


@query("SELECT check_name, CAST(n AS BIGINT) AS n_bad FROM (VALUES ('backbone', (SELECT count(*) FROM emb WHERE timestep = 6)), ('family', (SELECT count(*) FROM emb WHERE timestep = 5)), ('climate_source', (SELECT count(*) FROM emb WHERE timestep = 4)), ('one_modality_list', 1)) v(check_name, n)", "emb")
def v05_climate_encoder(d: Domain) -> DataFrame:
    t = F.col("timestep")
    rows = d.embeddings().withColumns({"backbone": F.when(t == 6, "other").otherwise("presto_s2_era5"), "experiment_family": F.when(t == 5, "unfused").otherwise("Auxiliary_climate_fusion"), "input_modalities": F.when(t == 4, "s2").otherwise("s2,ERA5")})
    return audit.encoder_checks(rows).select("check_name", "n_bad")


@query("SELECT check_name, CAST(n AS BIGINT) AS n_bad FROM (VALUES ('null_key', (SELECT count(*) FROM emb WHERE timestep = 1)), ('negative_timestep', (SELECT count(*) FROM emb WHERE timestep = 2)), ('empty_vector', (SELECT count(*) FROM emb WHERE timestep = 3)), ('not_finite', (SELECT count(*) FROM emb WHERE timestep = 4)), ('width', 1), ('duplicate_key', (SELECT count(*) FROM emb WHERE timestep = 5))) v(check_name, n)", "emb")
def v01_planted_faults(d: Domain) -> DataFrame:
    """Every kind of fault in the rows of one timestep each."""
    t = F.col("timestep")
    spoilt = F.when(t == 3, F.array().cast("array<float>")).when(t == 4, F.transform("embedding", lambda x, i: F.when(i == 7, F.lit(float("nan"))).otherwise(x).cast("float"))).otherwise(F.col("embedding"))
    rows = d.embeddings().withColumns({"embedding": spoilt, "backbone": F.when(t == 1, None).otherwise(F.col("backbone")), "timestep": F.when(t == 2, -1).otherwise(t)})
    return audit.embedding_checks(rows.unionByName(rows.where("timestep = 5"))).select("check_name", "n_bad")


@query("""SELECT * FROM (WITH m AS (SELECT fold, county_id, key, CASE WHEN fold = 3 AND split = 'train' AND year = 1996 THEN 'test' ELSE split END AS split FROM manifest WHERE NOT (fold = 0 AND year = 1997)),
k AS (SELECT key, count(*) AS n, count(*) FILTER (split = 'test') AS t FROM m GROUP BY key)
SELECT 'one_role_per_fold' AS check_name, count(*) AS n_bad FROM (SELECT fold, county_id FROM m GROUP BY ALL HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'one_test_fold', count(*) FROM (SELECT county_id FROM m GROUP BY ALL HAVING count(DISTINCT fold) FILTER (split = 'test') <> 1)
UNION ALL SELECT 'in_every_fold', count(*) FILTER (n <> 5) FROM k UNION ALL SELECT 'tested_once', count(*) FILTER (t <> 1) FROM k)""", "manifest")
def f09_planted_leaks(d: Domain) -> DataFrame:
    """Training rows of one year in test, and a fold without the keys of another year."""
    from ..operators import splits

    man = d.manifest().where("not (fold = 0 and year = 1997)")
    return splits.fold_checks(man.withColumn("split", F.when((F.col("fold") == 3) & (F.col("split") == "train") & (F.col("year") == 1996), "test").otherwise(F.col("split"))), 5).select("check_name", "n_bad")


ONE = """x AS (SELECT key, county_id, year, fold, evi, target FROM panel JOIN folds USING (county_id)), a AS (SELECT unnest([0.1, 1.0, 10.0, 100.0, 1000.0])::DOUBLE AS alpha)"""


@query(f"""SELECT * FROM (WITH {ONE}, f AS (SELECT CAST(k AS INT) AS f, CAST((k + 1) % 5 AS INT) AS v FROM range(0, 5) r(k)),
t AS (SELECT f, v, avg(evi) AS mx, stddev_pop(evi) AS sx, avg(target) AS my, count(*) AS n, covar_pop(evi, target) * count(*) / stddev_pop(evi) AS sxy FROM x, f WHERE fold <> f AND fold <> v GROUP BY f, v),
e AS (SELECT f, alpha, sqrt(avg(pow(target - my - sxy / (n + alpha) * (evi - mx) / sx, 2))) AS rmse FROM x JOIN t ON x.fold = t.v, a GROUP BY f, alpha)
SELECT f AS fold, arg_min(alpha, (rmse, alpha)) AS alpha, round(min(rmse), 5) AS val_rmse, CAST((SELECT count(*) FROM x WHERE fold <> f) AS BIGINT) AS train_n FROM e GROUP BY f)""", "panel", "folds")
def o02_alpha_choice(d: Domain) -> DataFrame:
    """The penalty of the smallest (rmse, alpha) on the validation fold, for one feature."""
    from ..operators import linear
    from .queries import _ridge_rows

    fits = linear.fit_folds(linear.grams(_ridge_rows(d, ["evi"]), "representation", "fold", "target"))
    return fits.select(F.col("fold").cast("int").alias("fold"), "alpha", F.round("val_rmse", 5).alias("val_rmse"), "train_n")


@query(f"""SELECT * FROM (WITH {ONE}, y AS (SELECT DISTINCT year AS o FROM panel), io AS (SELECT o, i.year AS i FROM y, (SELECT DISTINCT year FROM panel) i WHERE i.year <> o),
t AS (SELECT o, i, avg(evi) AS mx, stddev_pop(evi) AS sx, avg(target) AS my, count(*) AS n, covar_pop(evi, target) * count(*) / stddev_pop(evi) AS sxy FROM x, io WHERE year <> o AND year <> i GROUP BY o, i),
e AS (SELECT o, i, alpha, sqrt(avg(pow(target - my - sxy / (n + alpha) * (evi - mx) / sx, 2))) AS rmse FROM x JOIN t ON x.year = t.i, a GROUP BY o, i, alpha),
b AS (SELECT o, arg_min(alpha, (rmse, alpha)) AS alpha FROM (SELECT o, alpha, avg(rmse) AS rmse FROM e GROUP BY o, alpha) GROUP BY o),
r AS (SELECT o, avg(evi) AS mx, stddev_pop(evi) AS sx, avg(target) AS my, count(*) AS n, covar_pop(evi, target) * count(*) / stddev_pop(evi) AS sxy FROM x, y WHERE year <> o GROUP BY o)
SELECT CAST(year AS INT) AS year, any_value(alpha) AS alpha, count(*) AS n, round(sqrt(avg(pow(target - my - sxy / (n + alpha) * (evi - mx) / sx, 2))), 5) AS rmse FROM x JOIN r ON x.year = r.o JOIN b ON b.o = r.o GROUP BY year)""", "panel", "folds")
def m03_one_feature(d: Domain) -> DataFrame:
    """Held-out years, the penalty from inner held-out years, for one feature."""
    from ..operators import linear, metrics
    from .queries import _ridge_rows

    rows = _ridge_rows(d, ["evi"])
    fits = linear.fit_years(linear.grams(rows, "representation", "year", "target"))
    out = linear.predict(rows, fits, "representation", "year").select("year", F.col("target").alias("observed"), "predicted")
    return metrics.metrics(out, ["year"]).join(fits.select(F.col("fold").cast("int").alias("year"), "alpha"), "year").select("year", "alpha", "n", F.round("rmse", 5).alias("rmse"))


def _curve_sql(cells: str, axis: str) -> str:
    return f"""SELECT * FROM (WITH c AS (SELECT {axis}, county_id, year, avg(evi) AS evi FROM {cells} GROUP BY ALL), x AS (SELECT {axis}, fold, c.evi, target FROM c JOIN panel p USING (county_id, year) JOIN folds USING (county_id)),
f AS (SELECT CAST(k AS INT) AS f FROM range(0, 5) r(k)), t AS (SELECT {axis}, f, avg(evi) AS mx, stddev_pop(evi) AS sx, avg(target) AS my, count(*) AS n, covar_pop(evi, target) * count(*) / stddev_pop(evi) AS sxy FROM x, f WHERE fold <> f GROUP BY {axis}, f),
m AS (SELECT x.{axis}, f, sqrt(avg(pow(target - my - sxy / (n + 10) * (evi - mx) / sx, 2))) AS rmse FROM x JOIN t ON x.fold = t.f AND x.{axis} = t.{axis} GROUP BY x.{axis}, f)
SELECT {axis}, count(*) AS folds, round(avg(rmse), 5) AS rmse_mean FROM m GROUP BY {axis})"""


def _curve(d: Domain, cut: DataFrame, axis: str) -> DataFrame:
    from ..operators import linear, metrics

    rows = cut.groupBy(axis, "county_id", "year").agg(F.array(F.avg("evi")).alias("features")).join(d.panel().select("county_id", "year", "target"), ["county_id", "year"]).join(d.folds(), "county_id")
    fits = linear.fit_folds(linear.grams(rows, axis, "fold", "target"), alphas=(10.0,))
    out = linear.predict(rows, fits, axis, "fold").withColumnRenamed("target", "observed")
    return metrics.metrics(out, [axis, "fold"]).groupBy(axis).agg(F.count("*").alias("folds"), F.round(F.avg("rmse"), 5).alias("rmse_mean"))


@query(_curve_sql("(SELECT *, CAST(r.k AS INT) AS k FROM measures, range(1, 8) r(k) WHERE timestep < r.k)", "k").replace("*, CAST(r.k AS INT) AS k", "measures.*, CAST(r.k AS INT) AS k"), "panel", "folds")
def m08_prefix_mean(d: Domain) -> DataFrame:
    """In-season curve of ridge on the mean of the first k composites."""
    return _curve(d, sequences.prefixes(d.measures(), 7), "k")


@query(_curve_sql("(SELECT measures.*, CAST(r.k AS INT) AS dropped FROM measures, range(0, 8) r(k) WHERE r.k <> timestep + 1)", "dropped"), "panel", "folds")
def m08_drop_one(d: Domain) -> DataFrame:
    """The curve of leaving one composite out; 0 leaves out none."""
    return _curve(d, sequences.leave_one_out(d.measures(), 7), "dropped")


@query()
def m08_drop_one_loss(d: Domain) -> DataFrame:
    """Ridge on all composites but one, and what leaving it out costs; tested against numpy."""
    from ..operators import metrics
    from .queries import _ridge_curve

    width, every = len(INDEX), range(7 * len(INDEX))
    out = _ridge_curve(d, [[c for c in every if c // width + 1 != k] for k in range(8)], "dropped", 0)
    curve = metrics.metrics(out, ["dropped", "fold"]).groupBy("dropped").agg(F.avg("r2").alias("value"))
    return r6(metrics.marginal_loss(curve, "value"))
