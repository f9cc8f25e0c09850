"""Tile files, tile arrays and the remaining sources and sinks."""

import datetime
import io
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import audit, tiles
from fieldloom.sources import tables
from fieldloom.sources import tiles as files
from fieldloom.sources.tiles import register_functions
from fieldloom.streaming.patches import replay, streamed_patches
from fieldloom.streaming.pooling import streamed_cube

BANDS = ["B02", "B03", "B04"]


def name(x, t, fips="17001", date="20200415"):
    return f"county_{fips}_year_2020_x{x}_y1_stack_COG_t{t}_{date}.npz"


@pytest.fixture
def folder(tmp_path):
    for x, steps in ((1, range(3)), (2, range(2))):
        for t in steps:
            pixels = np.arange(6 * 6 * 3, dtype=np.float32).reshape(6, 6, 3) + t
            meta = json.dumps({"county_fips": "17001", "year": "2020", "date": "2020-04-15", "yield_bu_per_acre": "180"})
            np.savez(tmp_path / name(x, t), pixels=pixels, band_names=BANDS[::-1], metadata=np.array(meta))
    return str(tmp_path)


def test_identity_from_names(spark):
    paths = ["/d/" + name(3, 4), "county_17001_year_2020_r2_c-7_interval_03.npz", "county_101_year_2019_patch_ab_t1.npz", "county_17001_year_2020_stem_timestep2.npz"]
    rows = [tuple(r)[:4] for r in files.tile_index(spark.createDataFrame([(p,) for p in paths], "path string")).select("county_id", "year", "patch_id", "timestep").collect()]
    assert rows[:3] == [("17001", 2020, "x3_y1", 4), ("17001", 2020, "r2_c-7", 3), ("00101", 2019, "ab", 1)]
    assert rows[3][0] == "17001" and rows[3][3] == 2


def test_index_decode_and_sequences(spark, folder):
    index = files.tile_index(files.list_files(spark, folder))
    assert index.count() == 5
    decoded = files.read_tiles(spark, folder)
    row = decoded.orderBy("path").first()
    assert (row["c"], row["h"], row["w"]) == (3, 6, 6) and row["bands"] == BANDS[::-1] and row["pixels"][:2] == [0.0, 3.0]
    audit.require(files.identity_checks(decoded))
    whole = files.patch_sequences(decoded, None, 3).collect()
    assert [(r["patch_id"], r["target"], len(r["files"])) for r in whole] == [("x1_y1", 180.0, 3)]
    cohort = spark.createDataFrame([("17001", 2020)], "county_id string, year int")
    assert files.matched_files(index, cohort, 3).count() == 3
    assert {(r["h"], r["w"]) for r in files.read_shapes(spark, folder).collect()} == {(6, 6)}
    assert files.timestep_base(index, 3) == 0 and files.interval_origin(index, 3) == 0
    files.file_count(index, 5)
    with pytest.raises(audit.CheckFailed):
        files.file_count(index, 6)


def test_name_and_metadata_disagree(spark, tmp_path):
    np.savez(tmp_path / name(1, 0), pixels=np.zeros((3, 2, 2)), metadata=np.array(json.dumps({"county_fips": "17003", "date": "2020-05-01"})))
    bad = {r["check_name"]: r["n_bad"] for r in files.identity_checks(files.read_tiles(spark, str(tmp_path))).collect()}
    assert bad["county_differs"] == 1 and bad["date_differs"] == 1 and bad["year_differs"] == 0


def test_integrity(spark, folder, tmp_path):
    (tmp_path / "empty.npz").write_bytes(b"")
    (tmp_path / "broken.npz").write_bytes(b"not a zip file")
    np.savez(tmp_path / "other.npz", something=np.zeros(2))
    expected = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in ("empty.npz", "other.npz")], "path string")
    got = {r["path"].rsplit("/", 1)[1]: r["failure"] for r in files.integrity(spark, str(tmp_path), expected=expected).collect()}
    assert got["empty.npz"] == "empty or absent" and got["broken.npz"].startswith("unreadable") and got["other.npz"] == "missing pixels"
    assert files.integrity_summary(files.integrity(spark, str(tmp_path))).where("failure is null").first()["files"] == 5


def test_bands_crop_and_mask(spark, folder):
    df = files.tile_index(files.read_tiles(spark, folder))
    one = tiles.reindexed(df, BANDS).orderBy("path").first()
    assert one["pixels"][0] == 2.0 and one["bands"] == BANDS
    padded = tiles.reindexed(df, [*BANDS, "B12"], pad=True).first()
    assert padded["c"] == 4 and padded["pixels"][-1] == 0.0
    with pytest.raises(audit.CheckFailed, match="missing_bands"):
        tiles.reindexed(df, ["B12"])
    cut = tiles.cropped(df, 4, 2).orderBy("path").first()
    assert (cut["h"], cut["w"]) == (2, 2) and len(cut["pixels"]) == 12 and cut["pixels"][0] == 3.0 * (2 * 6 + 2)
    with pytest.raises(audit.CheckFailed, match="undersize"):
        tiles.cropped(df, 8)
    kept, dropped = tiles.screen_undersized(df.withColumn("h", F.when(F.col("timestep") == 1, 2).otherwise(F.col("h"))), 4)
    assert kept.count() == 0 and dropped.count() == 2


def test_missing_pixels(spark):
    df = spark.createDataFrame([("f", "1", 2020, "p", t, 1, 2, [v, 4.0]) for t, v in ((0, float("nan")), (1, 2.0))], "path string, county_id string, year int, patch_id string, timestep int, h int, w int, pixels array<float>")
    with pytest.raises(audit.CheckFailed, match="not_finite"):
        tiles.without_nonfinite(df)
    masked = tiles.valid_fraction(tiles.without_nonfinite(df, "mask"))
    assert [r["valid_fraction"] for r in masked.orderBy("timestep").collect()] == [0.5, 1.0]
    assert tiles.sequence_masks(masked).first()["mask"] == [False, True]
    assert [r["mean"] for r in tiles.band_means(masked).orderBy("timestep").collect()] == [4.0, 3.0]
    assert tiles.without_nonfinite(df, "zero").orderBy("timestep").first()["pixels"] == [0.0, 4.0]


def test_channel_statistics_and_samples(spark):
    df = spark.createDataFrame([("1", 2020, f"p{k}", 0, 2, 2, [1.0] * 4 + [float(k)] * 4, "train") for k in range(4)], "county_id string, year int, patch_id string, timestep int, h int, w int, pixels array<float>, split string")
    stats = {r["band"]: (r["mean"], r["std"]) for r in tiles.channel_statistics(df, patches=10, pixels=4, seed=1).collect()}
    assert stats[0] == (1.0, 1.0) and stats[1] == pytest.approx((1.5, np.std(range(4))))
    assert tiles.pixel_sample(df.withColumn("n_pixels", F.lit(4)), 3, "s").count() == 12
    assert all(r["replacement"] for r in tiles.pixel_sample(df.withColumn("n_pixels", F.lit(2)), 3, "s").collect())


def test_encoder_and_tokens(spark):
    df = spark.createDataFrame([("1", 2020, "p", t, [float(t), 1.0]) for t in range(5)], "county_id string, year int, patch_id string, timestep int, pixels array<float>")
    out = tiles.encoded(df, lambda part: [np.asarray(x) * 2 for x in part["pixels"]], batch=2)
    assert sorted(r["embedding"][0] for r in out.collect()) == [0.0, 2.0, 4.0, 6.0, 8.0]
    with pytest.raises(Exception, match="the encoder returned"):
        tiles.encoded(df, lambda part: []).collect()
    tokens = spark.createDataFrame([([[1.0, 1.0], [2.0, 4.0], [4.0, 8.0]],)], "tokens array<array<double>>")
    assert [tiles.pooled_tokens(tokens, p).first()["embedding"] for p in ("cls", "spatial_mean", "mean")] == [[1.0, 1.0], [3.0, 6.0], pytest.approx([7 / 3, 13 / 3])]


def test_chronology(spark):
    df = spark.createDataFrame([("1", 2020, "p", t, d, 1.0 + t, 2.0) for t, d in ((0, "2020-04-15"), (1, "2020-04-15"))], "county_id string, year int, patch_id string, timestep int, date string, lat double, lon double")
    bad = {r["check_name"]: r["n_bad"] for r in tiles.chronology_checks(df.withColumn("date", F.to_date("date"))).collect()}
    assert bad == {"dates_not_increasing": 1, "position_moves": 1}


def test_bundles(spark, tmp_path):
    np.savez(tmp_path / "county_17001_year_2020.npz", patches=np.ones((2, 7, 3, 4, 4), np.float32), county_fips="17001", year=2020, crop="Corn", yield_bu_per_acre=170.0, band_names=BANDS)
    np.savez(tmp_path / "county_17003_year_2020.npz", patches=np.ones((1, 7, 3, 4, 4), np.float32), county_fips="17003", year=2020, crop="soy", yield_bu_per_acre=50.0, band_names=BANDS)
    rows = files.read_bundles(spark, str(tmp_path))
    assert rows.count() == 14 and rows.first()["target"] == 170.0 and rows.select("county_id").distinct().count() == 1


def test_embedding_files(spark, tmp_path):
    np.savez(tmp_path / name(1, 3), embedding=np.ones(4))
    np.savez(tmp_path / "county_17001_year_2020_x9_y1.npz", embeddings=np.ones((7, 4)))
    rows = files.read_embedding_files(spark, str(tmp_path), backbone="b")
    assert rows.where("patch_id = 'x1_y1'").first()["timestep"] == 3 and rows.where("patch_id = 'x9_y1'").count() == 7


def test_tables_round_trip(spark, tmp_path):
    rows = [("17001", 2020, f"p{k}", t, "b", [1.0, float(k)]) for k in range(2) for t in range(3)]
    df = spark.createDataFrame(rows, tables.EMBEDDING)
    tables.write_embeddings(df, str(tmp_path / "e.parquet"))
    back = tables.read_embeddings(spark, str(tmp_path / "e.parquet"))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    text = df.withColumn("embedding", F.col("embedding").cast("string"))
    text.write.parquet(str(tmp_path / "t.parquet"))
    assert tables.read_embeddings(spark, str(tmp_path / "t.parquet")).count() == 6
    alias = df.select(F.col("county_id").alias("FIPS"), "year", F.col("patch_id").alias("Tile"), F.col("timestep").alias("interval"), F.col("embedding").alias("vector"))
    assert tables.adapt_embeddings(alias, backbone="x").first()["backbone"] == "x"
    with pytest.raises(audit.CheckFailed):
        tables.adapt_embeddings(alias.drop("vector"), backbone="x")


def test_pairs_wide_and_contract(spark, tmp_path):
    v = spark.createDataFrame([(0, [1.0, 2.0])], "row_id int, embedding array<double>")
    m = spark.createDataFrame([(0, "17001_2020_p3")], "row_id int, location string")
    r = tables.adapt_pairs(v, m, backbone="b").first()
    assert (r["county_id"], r["year"], r["patch_id"]) == ("17001", 2020, "p3")
    wide = spark.createDataFrame([("Adams", "17001.0", 2020, 1.0, 2.0)], "county string, GEOID string, year int, mean_A00 double, mean_A01 double")
    rows, report = tables.convert_wide(wide, backbone="w", width=2)
    assert rows.first()["county_id"] == "17001" and report.first()["years"] == [2020]
    with pytest.raises(audit.CheckFailed):
        tables.convert_wide(wide.union(wide), backbone="w", width=2)
    tables.write_contract(spark.createDataFrame([(float("nan"), "x")], "a double, b string"), str(tmp_path / "c"))
    assert json.loads(spark.read.text(str(tmp_path / "c")).first()[0]) == {"a": None, "b": "x"}
    assert tables.with_contract(m, {"scope": "s", "location": "kept"}).first()["location"] == "17001_2020_p3"


def test_run_grid_keys_and_results(spark, tmp_path):
    df = spark.createDataFrame([("k", 1.23456)], "key string, observed double")
    df.coalesce(1).toPandas().to_csv((tmp_path / "rep/IL").mkdir(parents=True) or tmp_path / "rep/IL/predictions.csv", index=False)
    row = tables.read_run_grid(spark, str(tmp_path)).first()
    assert (row["representation"], row["state"]) == ("rep", "IL")
    (tmp_path / "keys.txt").write_text("# cohort\n17001-2020\n\n17001-2020\n17003-2020 \n")
    assert sorted(r["key"] for r in tables.load_keys(spark, str(tmp_path / "keys.txt")).collect()) == ["17001-2020", "17003-2020"]
    tables.write_results(df, str(tmp_path / "out.csv"), ["key"])
    assert tables.read_table(spark, str(tmp_path / "out.csv")).first()["observed"] == "1.2346"


def test_boundaries(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    feature = lambda props, kind, xy: {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": xy}}
    data = {"type": "FeatureCollection", "features": [feature({"GEOID": "17001"}, "Polygon", [square]), feature({"STATEFP": "17", "COUNTYFP": "003"}, "MultiPolygon", [[square], [square]]), feature({"fips": "17005"}, "LineString", square)]}
    (tmp_path / "b.json").write_text(json.dumps(data, indent=1))
    rows = files.boundary_segments(spark, str(tmp_path / "b.json"))
    assert {r["fips"]: r["count"] for r in rows.groupBy("fips").count().collect()} == {"17001": 4, "17003": 8, "17005": 4}


def test_streamed_cube(spark, tmp_path):
    df = spark.createDataFrame([("1", 2020, "p", t % 2, "b", [float(t)]) for t in range(6)], tables.EMBEDDING)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streamed_cube(stream, 1).writeStream.outputMode("complete").format("memory").queryName("cube").start()
    q.processAllAvailable()
    q.stop()
    assert {r["timestep"]: (r["n"], r["s1"][0]) for r in spark.table("cube").collect()} == {0: (3, 6.0), 1: (3, 9.0)}
    with pytest.raises(ValueError):
        streamed_cube(df, 1)


def test_streamed_patches(spark, tmp_path):
    """A patch comes out once, with the batch that completes it; repeats, other steps, nulls and late rows change nothing."""
    schema = "county_id string, year int, patch_id string, timestep int, embedding array<double>, event_time timestamp"
    at = lambda minute: datetime.datetime(2020, 1, 1) + datetime.timedelta(minutes=minute)
    row = lambda p, t, v, minute: ("c", 2020, p, t, None if v is None else [v, -v], at(minute))
    batches = [
        [row("a", 1, 1.0, 0), row("a", 1, 9.0, 0), row("b", 0, 5.0, 1), row("a", 7, 9.0, 1), ("c", 2020, None, 0, [1.0], at(1))],
        [row("a", 0, 0.5, 2), row("b", 2, 7.0, 2), row("d", 0, None, 2)],
        [row("a", 2, 2.0, 3), row("b", 0, 6.0, 3)],
        [row("a", 2, 3.0, 4), row("e", 0, 1.0, 600)],
        [row("b", 1, 6.0, 5), row("e", 1, 2.0, 601), row("e", 2, 3.0, 602)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.1 if k else 0)
    df = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    out = replay(df, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), lambda s: streamed_patches(s, 3, late="10 minutes"))
    got = {r["patch_id"]: list(r["embedding"]) for r in out.collect()}
    assert got == {"a": [0.5, -0.5, 1.0, -1.0, 2.0, -2.0], "e": [1.0, -1.0, 2.0, -2.0, 3.0, -3.0]}  # b's last row was late
    with pytest.raises(ValueError):
        streamed_patches(df, 3)


def test_table_function(spark):
    data = io.BytesIO()
    np.savez(data, embedding=np.arange(6, dtype=np.float32).reshape(2, 3))
    register_functions(spark)
    spark.createDataFrame([("x", bytearray(data.getvalue())), ("y", None)], "path string, content binary").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT f.path, e.* FROM some_files f, LATERAL embedding_rows(f.content) e ORDER BY row").collect()
    assert [tuple(r) for r in got] == [("x", 0, 2, [0.0, 1.0, 2.0]), ("x", 1, 2, [3.0, 4.0, 5.0])]


def test_npz_files_are_numpys(tmp_path):
    """Written files open in numpy, and numpy's files of any order, kind and compression give the same arrays."""
    rng = np.random.default_rng(1)
    arrays = {"pixels": rng.normal(size=(2, 3, 4)).astype(np.float32), "turned": np.asfortranarray(rng.normal(size=(5, 3))), "band_names": np.array(["B02", "é"]), "one": np.array("text"), "none": np.zeros((0, 7), np.int16)}
    with np.load(io.BytesIO(files.npz_bytes(arrays))) as f:
        assert f.files == list(arrays) and all(np.array_equal(f[k], v) and f[k].dtype == v.dtype for k, v in arrays.items())
    for save in (np.savez, np.savez_compressed):
        save(tmp_path / "x.npz", **arrays)
        with files.Npz((tmp_path / "x.npz").read_bytes()) as f:
            assert f.files == list(arrays) and all(np.array_equal(f[k], v) and f[k].dtype == v.dtype and f[k].shape == v.shape for k, v in arrays.items())
    np.savez(tmp_path / "o.npz", pixels=np.array([{}], object))
    with pytest.raises(ValueError), files.Npz((tmp_path / "o.npz").read_bytes()) as f:
        f["pixels"]


def test_small_files_share_tasks(spark, tmp_path):
    """800 files are 25 partitions of Spark's; four tasks a core read all of them."""
    x = np.arange(64, dtype=np.float32).reshape(4, 8, 2)
    for k in range(800):
        (tmp_path / f"t{k}.npz").write_bytes(files.npz_bytes({"pixels": x + k}))
    rows = files.read_tiles(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r["low"] for r in rows.select(F.array_min("pixels").alias("low")).collect()) == list(range(800))


def test_sequences_read_tiles_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            reads.add(len(pdf))
            yield pdf

    rows = [(f"county_00001_year_2020_x{p}_y1_t{t}_2020-05-01.npz", {"yield_bu_per_acre": str(p)}) for p in range(3) for t in range(7)]
    found = spark.createDataFrame(rows, "path string, meta map<string,string>").mapInPandas(counted, "path string, meta map<string,string>")
    assert sorted(r["target"] for r in files.patch_sequences(found, None, 7).collect()) == [0, 1, 2] and reads.value == 21
