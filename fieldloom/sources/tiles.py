"""Raster tiles in NPZ files: indexed by name, decoded by batches of files, audited."""

from __future__ import annotations

import io
import json
import math
import zipfile
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import ids, places
from ..operators.audit import duplicate_check, require, row_checks
from .tables import scratch_dir

#: Names under which tiles hold their pixels and embeddings, in the order they are tried.
PIXEL_KEYS = ("pixels", "image", "data", "arr_0")
EMBEDDING_KEYS = ("embedding", "embeddings", "features", "arr_0")
TILE = "path string, c int, h int, w int, pixels array<float>, bands array<string>, meta map<string,string>"


def list_files(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    """(path, length) of all files below a folder; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")


def identity(path: Column) -> dict[str, Column]:
    """Region, year, patch and timestep from a file name. The region is followed by the year, with or without the word; the patch is an
    explicit name, a row and column, x and y (other parts may stand between them), or the stem without its time and what follows."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.npz)?$", 1)
    part = lambda pattern, group=1: F.nullif(F.regexp_extract(F.lower(stem), pattern, group), F.lit(""))
    whole = F.regexp_replace(F.lower(stem), r"(?:_stack_cog)?(?:^|_)(?:timestep|interval|t)[_-]?\d+(?=_|$).*$", "")
    # How names write places, regions and years.
    row_column, x_y = r"(?:^|_)r(-?\d+)_c(-?\d+)(?=_|$)", r"(?:^|_)x[_-]?(-?\d+)(?:_.*?)?_y[_-]?(-?\d+)(?=_|$)"
    spot = lambda a, b, pattern: F.when(part(pattern).isNotNull(), F.concat(F.lit(a), part(pattern), F.lit(f"_{b}"), part(pattern, 2)))
    named = part(r"(?:^|_)patch[_-]?([a-z0-9]+)(?=_|$)")
    return {
        "county_id": ids.zfill(part(r"county[_-]?(\d{1,5})(?!\d)"), 5), "year": F.coalesce(part(r"year[_-]?(\d{4})(?!\d)"), part(r"county[_-]?\d{1,5}[_-](\d{4})(?!\d)")).cast("int"),
        "patch_id": F.coalesce(named, spot("r", "c", row_column), spot("x", "y", x_y), whole), "timestep": ids.interval_of(stem), "named_date": places.date_of(part(r"(?:^|_)(\d{4}-\d{2}-\d{2}|\d{8})(?=_|$)")),
    }


def unnamed(rows: DataFrame) -> DataFrame:
    """The check that region, year and timestep of each path are known."""
    return row_checks(rows, {f"no_{c}": F.col(c).isNull() for c in ("county_id", "year", "timestep")}, F.col("path"))


def tile_index(files: DataFrame, *, strict: bool = False) -> DataFrame:
    """Files with what their names say; with ``strict`` a name without region, year or timestep is an error."""
    rows = files.withColumns(identity(F.col("path")))
    if strict:
        require(unnamed(rows))
    return rows


@lru_cache(maxsize=1024)
def _header(dtype: str, shape: tuple[int, ...]) -> bytes:
    """The header of an array in C order, which is the same for all arrays of a kind and shape."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": dtype, "fortran_order": False, "shape": shape})
    return out.getvalue()


def npz_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """The NPZ file of arrays."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, x in arrays.items():
            z.writestr(zipfile.ZipInfo(f"{name}.npy"), _header(x.dtype.str, x.shape) + x.tobytes())
    return out.getvalue()


def _write(batches, folder: str):
    import os
    import uuid

    os.makedirs(folder, exist_ok=True)
    for b in batches:
        rows = b.column("members")
        members, ends = rows.flatten(), np.cumsum(rows.value_lengths().to_numpy()).tolist()
        names, shapes, texts = (members.field(k).to_pylist() for k in ("name", "shape", "texts"))
        values = members.field("values")
        sizes = values.value_lengths().fill_null(0).to_numpy()
        flat, stops = values.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes).tolist()
        start = 0
        for name, end in zip(b.column("file").to_pylist(), ends):
            arrays = {names[k]: (flat[stops[k] - sizes[k] : stops[k]] if texts[k] is None else np.array(texts[k])).reshape(shapes[k]) for k in range(start, end)}
            start, place = end, os.path.join(folder, name)
            with open(f"{place}.{uuid.uuid4().hex}", "wb") as f:
                f.write(npz_bytes(arrays))
            os.replace(f.name, place)  # a task that runs again writes the same file
        yield b.select(["file"])


def write_npz(df: DataFrame, folder: str) -> int:
    """Writes an NPZ file per row (file; members: name, shape, and values or texts) to a folder that all executors see as a local path; their number."""
    return df.select("file", "members").mapInArrow(partial(_write, folder=folder.removeprefix("file://").removeprefix("file:")), "file string").agg(F.count_distinct("file")).first()[0]


def member(name: str, shape: list, values: Column | None = None, texts: Column | None = None) -> Column:
    """One array of an NPZ file, for ``write_npz``; no shape: a single value."""
    sizes = F.array(*[F.lit(n) for n in shape]).cast("array<int>")
    return F.struct(F.lit(name).alias("name"), sizes.alias("shape"), (F.lit(None) if values is None else values).cast("array<float>").alias("values"), (F.lit(None) if texts is None else texts).cast("array<string>").alias("texts"))


@lru_cache(maxsize=1024)
def _parsed(version: tuple[int, int], header: bytes) -> tuple:
    """Shape, order and kind of an array by its header."""
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(io.BytesIO(header))


class Npz:
    """The arrays of an NPZ file's bytes, each unpacked when it is asked for. Tiles have few headers, so that these are parsed once."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.files = [n.removesuffix(".npy") for n in self.zip.namelist()]

    def __enter__(self) -> Npz:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()

    def __getitem__(self, name: str) -> np.ndarray:
        data = self.zip.read(f"{name}.npy")
        version = np.lib.format.read_magic(io.BytesIO(data[:8]))
        if version not in ((1, 0), (2, 0)):
            return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)
        start = 10 if version == (1, 0) else 12
        end = start + int.from_bytes(data[8:start], "little")
        shape, fortran, dtype = _parsed(version, data[8:end])
        if dtype.hasobject:
            raise ValueError(f"{name} holds objects, which are not read")
        return np.frombuffer(data, dtype, count=math.prod(shape), offset=end).reshape(shape, order="F" if fortran else "C")


def pixels_of(file: Npz) -> np.ndarray:
    """The pixel array as (bands, rows, columns) of 32-bit floats; an array with its smallest axis last has its bands there."""
    name = next((k for k in PIXEL_KEYS if k in file.files), None)
    if name is None:
        raise KeyError(f"no pixel array among {file.files}")
    x = np.asarray(file[name], np.float32)
    if x.ndim == 2:
        x = x[None]
    if x.ndim == 3 and x.shape[2] < min(x.shape[0], x.shape[1]):
        x = np.moveaxis(x, 2, 0)
    return x


def metadata_of(file: Npz) -> dict[str, str]:
    if "metadata" not in file.files:
        return {}
    raw = file["metadata"]
    raw = raw.item() if raw.shape == () else raw.tolist()
    raw = json.loads(raw) if isinstance(raw, (str, bytes)) else raw
    return {str(k): str(v) for k, v in dict(raw).items()}


def _open(content: bytes) -> Npz:
    return Npz(content)


def _decode(batches):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            with _open(content) as f:
                x = pixels_of(f)
                bands = [str(b) for b in f["band_names"]] if "band_names" in f.files else []
                rows.append((path, *x.shape, x.ravel(), bands, metadata_of(f)))
        yield pd.DataFrame(rows, columns=["path", "c", "h", "w", "pixels", "bands", "meta"])


#: Partitions of files that one task reads, where there are many. Spark counts a file as 4 MB at least, so that small ones make
#: partitions of 32, which cost a task more than their contents do.
TOGETHER = 32


def _binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")
    parts = files.rdd.getNumPartitions()
    return files.coalesce(max(parts // TOGETHER, min(parts, 4 * spark.sparkContext.defaultParallelism), 1))


def read_tiles(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    """One row per tile file: shape, flattened pixels, bands, metadata."""
    return _binary(spark, path, glob).mapInPandas(_decode, TILE)


def _metadata(batches):
    for pdf in batches:
        meta = []
        for content in pdf["content"]:
            with _open(content) as f:
                if not any(k in f.files for k in PIXEL_KEYS):
                    raise KeyError(f"no pixel array among {f.files}")
                meta.append(metadata_of(f))
        yield pd.DataFrame({"path": pdf["path"], "meta": meta})


def read_metadata(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    """Path and metadata of each tile file, whose pixels must be there and are not unpacked."""
    return _binary(spark, path, glob).mapInPandas(_metadata, "path string, meta map<string,string>")


def _bundles(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            with _open(content) as f:
                x = np.asarray(f["patches"], np.float32)
                bands = [str(b) for b in f["band_names"]] if "band_names" in f.files else []
                own = {k: str(f[k].item()) if k in f.files else None for k in ("county_fips", "year", "crop", "yield_bu_per_acre")}
            rows = [(path, own["county_fips"], own["year"], own["crop"], own["yield_bu_per_acre"], p, t, *x.shape[2:], x[p, t].ravel(), bands) for p in range(x.shape[0]) for t in range(x.shape[1])]
            yield pd.DataFrame(rows, columns=["path", "county_id", "year", "crop", "target", "patch", "timestep", "c", "h", "w", "pixels", "bands"])


def read_bundles(spark: SparkSession, path: str, *, crops: tuple[str, ...] = ("corn", "maize"), glob: str = "*.npz") -> DataFrame:
    """Files with all patches of a region and year: one row per patch and timestep, of the wanted crops."""
    rows = _binary(spark, path, glob).mapInPandas(_bundles, "path string, county_id string, year string, crop string, target string, patch int, timestep int, c int, h int, w int, pixels array<float>, bands array<string>")
    rows = rows.withColumns({"county_id": ids.region_id(F.col("county_id")), "year": F.col("year").cast("int"), "target": ids.safe_double(F.col("target"))})
    return rows.where(F.coalesce(F.lower("crop"), F.lit(crops[0])).isin(*crops))


def _shapes(batches, key: str):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(f"{key}.npy") as f:  # only the header is unpacked
                version = np.lib.format.read_magic(f)
                shape = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]
            bands_last = len(shape) == 3 and shape[2] < min(shape[:2])
            rows.append((path, *(shape[:2] if bands_last else shape[-2:])))
        yield pd.DataFrame(rows, columns=["path", "h", "w"])


def read_shapes(spark: SparkSession, path: str, key: str = "pixels", glob: str = "*.npz") -> DataFrame:
    return _binary(spark, path, glob).mapInPandas(partial(_shapes, key=key), "path string, h int, w int")


def _inspect(batches, member: str):
    for pdf in batches:
        out = []
        for content in pdf["content"]:
            try:
                if not content:
                    out.append("empty file")
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    bad = z.testzip()
                out.append(f"damaged member {bad}" if bad else None if f"{member}.npy" in names else f"missing {member}")
            except (zipfile.BadZipFile, OSError, EOFError) as e:
                out.append(f"unreadable: {type(e).__name__}")
        yield pd.DataFrame({"path": pdf["path"], "failure": out})


def integrity(spark: SparkSession, path: str, member: str = "pixels", glob: str = "*.npz", expected: DataFrame | None = None) -> DataFrame:
    """(path, failure): null where the file is whole and has the member. Spark's file sources pass over files without a byte; such
    files show as "empty or absent" when the ``expected`` paths are given."""
    found = _binary(spark, path, glob).mapInPandas(partial(_inspect, member=member), "path string, failure string")
    if expected is None:
        return found
    found = found.withColumn("_seen", F.lit(True))
    return found.join(expected.select("path").withColumn("_e", F.lit(True)), "path", "full").select("path", F.when(F.col("_e") & ~F.coalesce(F.col("_seen"), F.lit(False)), "empty or absent").otherwise(F.col("failure")).alias("failure"))


def integrity_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("failure").agg(F.count("*").alias("files"), F.min("path").alias("example"))


def _embeddings(batches):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            with _open(content) as f:
                name = next((k for k in EMBEDDING_KEYS if k in f.files), None)
                if name is None:
                    raise KeyError(f"{path}: no embedding among {f.files}")
                x = np.atleast_2d(np.asarray(f[name], np.float32))
            rows += [(path, t, len(x), v) for t, v in enumerate(x)]
        yield pd.DataFrame(rows, columns=["path", "row", "rows", "embedding"])


@udtf(returnType="row: int, rows: int, embedding: array<float>")
class EmbeddingRows:
    """The vectors of one NPZ file's bytes, as a table function: ``SELECT f.path, e.* FROM files f, LATERAL embedding_rows(f.content) e``. A null
    has no rows; a file without a known member is an error."""

    def eval(self, content: bytes):
        if content is None:
            return
        with _open(bytes(content)) as f:
            x = np.atleast_2d(np.asarray(f[next(k for k in EMBEDDING_KEYS if k in f.files)], np.float32))
        for t, v in enumerate(x):
            yield t, len(x), v.tolist()


def register_functions(spark: SparkSession) -> None:
    """Table functions for SQL: embedding_rows."""
    spark.udtf.register("embedding_rows", EmbeddingRows)


def read_embedding_files(spark: SparkSession, path: str, *, backbone: str) -> DataFrame:
    """NPZ files with one vector, or one per timestep, as canonical embedding rows; the name's interval counts for single vectors."""
    rows = _binary(spark, path, "*.npz").mapInPandas(_embeddings, "path string, row int, rows int, embedding array<float>")
    rows = tile_index(rows)
    step = F.when(F.col("rows") == 1, F.coalesce("timestep", "row")).otherwise(F.col("row"))
    return rows.select("county_id", "year", "patch_id", step.alias("timestep"), F.lit(backbone).alias("backbone"), "embedding")


def patch_sequences(tiles: DataFrame, labels: DataFrame | None, steps: int, *, authoritative: bool = True) -> DataFrame:
    """Patches with the files of their timesteps: metadata first, file name as fallback; schedule and label attached, complete ones only."""
    meta = lambda k: F.try_element_at("meta", F.lit(k))
    named = identity(F.col("path"))
    rows = tiles.select("path", F.coalesce(F.nullif(ids.region_id(meta("county_fips")), F.lit("")), named["county_id"]).alias("county_id"), F.coalesce(meta("year").try_cast("int"), named["year"]).alias("year"), named["patch_id"].alias("patch_id"), F.coalesce(meta("timestep").try_cast("int"), named["timestep"]).alias("timestep"), ids.safe_double(meta("yield_bu_per_acre")).alias("own_target"))
    place = scratch_dir(tiles.sparkSession)
    rows.write.parquet(place)  # the check and the groups read it, and the files are read once
    rows = tiles.sparkSession.read.schema(rows.schema).parquet(place)
    require(unnamed(rows))
    groups = rows.groupBy("county_id", "year", "patch_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("timestep", "path")))).alias("files"), F.array_sort(F.collect_set("timestep")).alias("steps"), F.max("own_target").alias("own_target"))
    groups = groups.withColumn("schedule", expected_schedule(F.col("steps"), steps)).where(F.size(F.array_except("schedule", "steps")) == 0)
    if labels is None:
        return groups.withColumnRenamed("own_target", "target")
    both = groups.join(labels.select("county_id", "year", F.col("target").alias("_label")), ["county_id", "year"], "left")
    target = F.col("_label") if authoritative else F.coalesce("_label", "own_target")
    return both.withColumn("target", target).where("target is not null").drop("_label", "own_target")


def expected_schedule(present: Column, steps: int) -> Column:
    """1..T where the timesteps that are there begin at one and end by T, else 0..T-1."""
    from_one = (F.size(present) > 0) & (F.array_min(present) >= 1) & (F.array_max(present) <= steps)
    return F.when(from_one, F.sequence(F.lit(1), F.lit(steps))).otherwise(F.sequence(F.lit(0), F.lit(steps - 1)))


def timestep_base(df: DataFrame, steps: int, requested: str = "auto") -> int:
    """0 or 1: as requested, else 0 if timestep 0 occurs, 1 if both 1 and T do; anything else is an error."""
    if requested in ("0", "1"):
        return int(requested)
    seen = df.agg(F.max(F.col("timestep") == 0).alias("zero"), F.max(F.col("timestep") == 1).alias("one"), F.max(F.col("timestep") == steps).alias("last")).first()
    if seen["zero"]:
        return 0
    if seen["one"] and seen["last"]:
        return 1
    raise ValueError("timestep base is ambiguous; pass 0 or 1")


def interval_origin(df: DataFrame, steps: int) -> int:
    """The origin, 0 or 1, with more complete sequences; 0 if they tie."""
    per = df.groupBy("county_id", "year", "patch_id").agg(F.collect_set("timestep").alias("s"))
    whole = lambda a: F.count_if(F.size(F.array_except(F.sequence(F.lit(a), F.lit(a + steps - 1)), "s")) == 0)
    n = per.agg(whole(0).alias("zero"), whole(1).alias("one")).first()
    return int(n["one"] > n["zero"])


def identity_checks(tiles: DataFrame) -> DataFrame:
    """Names and metadata agree on region, year and date; no two files are one tile."""
    meta = lambda k: F.try_element_at("meta", F.lit(k))
    rows = tiles.withColumns(identity(F.col("path")))
    differs = lambda a, b: F.coalesce(a != b, F.lit(False))
    checks = row_checks(rows, {"county_differs": differs(F.nullif(ids.region_id(meta("county_fips")), F.lit("")), F.col("county_id")), "year_differs": differs(meta("year").try_cast("int"), F.col("year")), "date_differs": differs(places.date_of(meta("date")), F.col("named_date"))}, F.col("path"))
    return checks.unionByName(duplicate_check(rows, ["county_id", "year", "patch_id", "timestep"], "duplicate_tile"))


def file_count_check(files: DataFrame, expected: int) -> DataFrame:
    return files.agg(F.lit("file_count").alias("check_name"), F.abs(F.count("*") - expected).alias("n_bad"), F.count("*").cast("string").alias("sample"))


def file_count(files: DataFrame, expected: int) -> None:
    require(file_count_check(files, expected))


def matched_files(index: DataFrame, cohort: DataFrame, steps: int, *, origin: int = 0) -> DataFrame:
    """(path, length) of the tiles of complete patches whose region and year are wanted; extra timesteps don't disqualify a patch."""
    want = F.sequence(F.lit(origin), F.lit(origin + steps - 1))
    whole = index.groupBy("county_id", "year", "patch_id").agg(F.collect_set("timestep").alias("s")).where(F.size(F.array_except(want, "s")) == 0)
    rows = index.join(whole, ["county_id", "year", "patch_id"], "left_semi").join(cohort, ["county_id", "year"], "left_semi")
    return rows.where(F.col("timestep").between(origin, origin + steps - 1)).select("path", "length")


def volume(files: DataFrame) -> DataFrame:
    """Number and exact size of the files of a list."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def write_file_list(files: DataFrame, path: str) -> None:
    files.select("path").orderBy("path").write.text(path)


def boundary_segments(spark: SparkSession, path: str) -> DataFrame:
    """(fips, ring, lon, lat, place) of the polygons and lines of a GeoJSON file; the region code is under one of several names."""
    text = spark.read.text(path, wholetext=True)
    features = text.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>")).alias("f"))
    names = ["GEOID", "geoid", "FIPS", "fips", "county_fips"]
    props = F.col("f.properties")
    code = F.coalesce(*[F.try_element_at(props, F.lit(n)) for n in names], F.concat(F.try_element_at(props, F.lit("STATEFP")), F.try_element_at(props, F.lit("COUNTYFP"))))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = (
        F.when(kind == "MultiPolygon", F.flatten(F.from_json(raw, "array<array<array<array<double>>>>")))
        .when(kind.isin("Polygon", "MultiLineString"), F.from_json(raw, "array<array<array<double>>>"))
        .when(kind == "LineString", F.array(F.from_json(raw, "array<array<double>>")))
    )
    out = features.select(ids.digits_region_id(code).alias("fips"), F.posexplode(rings).alias("ring", "points"))
    return out.select("fips", "ring", F.posexplode("points").alias("place", "p")).select("fips", "ring", "place", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def write_points(points: DataFrame, path: str) -> None:
    points.withColumn("intervals", F.array_join(F.col("intervals").cast("array<string>"), ";")).orderBy("county_id", "year", "patch_id").write.csv(path, header=True)
