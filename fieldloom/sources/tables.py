"""Reading and writing panel tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, vectors
from ..operators.audit import CheckFailed, duplicate_check, embedding_checks, require, row_checks

EMBEDDING = "county_id string, year int, patch_id string, timestep int, backbone string, embedding array<float>"
EMBEDDING_KEY = ["county_id", "year", "patch_id", "timestep", "backbone"]


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name in ``spark.checkpoint.dir``, which all executors share; in local mode a temporary folder where it is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix; CSV columns stay texts."""
    if path.lower().rstrip("/").endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, header=True, inferSchema=False)
    if path.lower().rstrip("/").endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    raise ValueError(f"unknown table type: {path}")


def resolve(columns: list[str], aliases: list[str], *, exact_first: bool = False) -> str | None:
    """The column that the first matching alias names, ignoring case and blanks around; with ``exact_first``, exact names win."""
    if exact_first:
        for a in aliases:
            if a in columns:
                return a
    lower = {c.strip().lower(): c for c in reversed(columns)}
    return next((lower[a.strip().lower()] for a in aliases if a.strip().lower() in lower), None)


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]], **options) -> DataFrame:
    """Selects the wanted columns under their own names; an absent one is an error."""
    found = {name: resolve(df.columns, aliases, **options) for name, aliases in wanted.items()}
    if lost := [n for n, c in found.items() if c is None]:
        raise CheckFailed(f"no column for {lost} among {df.columns}")
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in found.items()])


def typed_embeddings(df: DataFrame) -> DataFrame:
    """The canonical column types; a vector that a writer left as text is read from it."""
    kind = dict(df.dtypes)["embedding"]
    vector = vectors.from_text(F.col("embedding")) if kind == "string" else vectors.from_bytes(F.col("embedding")) if kind == "binary" else F.col("embedding")
    return df.withColumns({"county_id": ids.region_id(F.col("county_id")), "year": F.col("year").cast("int"), "timestep": F.col("timestep").cast("int"), "patch_id": F.col("patch_id").cast("string"), "embedding": vector.cast("array<float>")})


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    df = typed_embeddings(spark.read.parquet(path))
    require(embedding_checks(df))
    return df


def write_embeddings(df: DataFrame, path: str) -> None:
    """Checked, one region and year in one file, rows in key order, a folder per backbone so that readers can prune."""
    require(embedding_checks(df))
    df.repartition("backbone", "county_id", "year").sortWithinPartitions(*EMBEDDING_KEY).write.partitionBy("backbone").parquet(path)


def adapt_embeddings(df: DataFrame, *, backbone: str, embedding: list[str] = ("embedding", "features", "vector")) -> DataFrame:
    """A foreign embedding table by column aliases; vectors are lists, texts or bytes."""
    out = resolve_columns(df, {"county_id": ["county_id", "fips", "geoid"], "year": ["year"], "patch_id": ["patch_id", "patch", "tile"], "timestep": ["timestep", "interval", "t"], "embedding": list(embedding)}, exact_first=True)
    return typed_embeddings(out.withColumn("backbone", F.lit(backbone))).select(*EMBEDDING_KEY, "embedding")


def adapt_pairs(vectors_df: DataFrame, metadata: DataFrame, *, backbone: str, row: str = "row_id") -> DataFrame:
    """Vectors and their metadata (``location`` such as "17001_2020_p3") held as two tables with a common row number."""
    both = vectors_df.join(metadata, row)
    region, year = F.regexp_extract("location", r"(?<!\d)(\d{5})(?!\d)", 1), F.regexp_extract("location", r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    return typed_embeddings(both.select(region.alias("county_id"), year.alias("year"), F.coalesce(F.nullif(F.regexp_extract("location", r"_([^_]+)$", 1), F.lit("")), F.col("location")).alias("patch_id"), F.lit(0).alias("timestep"), F.lit(backbone).alias("backbone"), "embedding"))


def adapt_wide(df: DataFrame, *, backbone: str, pattern: str = r"(mean_A)(\d+)", width: int | None = None) -> DataFrame:
    """A row per region and year with columns mean_A00, mean_A01, ... as one vector; a numeric GEOID is preferred to a display name."""
    groups = vectors.wide_columns(df.columns, pattern)
    if len(groups) != 1:
        raise CheckFailed(f"no columns match {pattern}")
    columns = next(iter(groups.values()))
    if width is not None and len(columns) != width:
        raise CheckFailed(f"{len(columns)} embedding columns; expected {width}")
    region = resolve(df.columns, ["GEOID", "fips", "county_id", "county"])
    out = df.select(ids.region_id(F.col(region)).alias("county_id"), F.col(resolve(df.columns, ["year"])).cast("int").alias("year"), F.lit("county").alias("patch_id"), F.lit(0).alias("timestep"), F.lit(backbone).alias("backbone"), F.array(*[F.col(c).cast("float") for c in columns]).alias("embedding"), F.lit("sequence").alias("representation_scope"))
    return out


def convert_wide(df: DataFrame, *, backbone: str, width: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows, one provenance row); a repeated region and year is an error."""
    rows = adapt_wide(df, backbone=backbone, width=width)
    require(duplicate_check(rows, ["county_id", "year"]), row_checks(rows, {"not_finite": ~vectors.is_finite(F.col("embedding"))}, F.concat_ws("-", "county_id", "year")))
    return rows, rows.agg(F.lit(backbone).alias("backbone"), F.lit(width).alias("width"), F.count("*").alias("rows"), F.count_distinct("county_id").alias("counties"), F.array_sort(F.collect_set("year")).alias("years"))


def label_lookup(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """One finite value a key: of repeated ones the last by ``order``."""
    number = ids.safe_double(F.col(value))
    return df.withColumn("_v", number).where("_v is not null").groupBy(*key).agg(F.max_by("_v", order).alias(value))


def strict_labels(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Numeric values, nulls dropped; a repeated key is an error."""
    rows = df.withColumn(value, F.col(value).try_cast("double")).dropna(subset=[*key, value])
    require(duplicate_check(rows, key, "duplicate_label"))
    return rows.select(*key, value)


def load_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys from a text file, one a line; blank lines and lines that begin with # are left out."""
    text = F.trim("value")
    return spark.read.text(path).select(text.alias("key")).where((F.col("key") != "") & ~F.col("key").startswith("#")).distinct()


def with_contract(df: DataFrame, constants: dict) -> DataFrame:
    """Adds constant columns that are not there yet."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items() if k not in df.columns})


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_results(df: DataFrame, path: str, order: list[str], digits: int = 4) -> None:
    rounded(df, digits).orderBy(*order).write.csv(path, header=True)


def write_contract(df: DataFrame, path: str) -> None:
    """One JSON line per row; NaN and infinite numbers become null."""
    clean = [F.when(vectors.finite(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path)


def _write_run(pdf, folder: str):
    import os

    place = os.path.join(folder, str(pdf["representation"].iloc[0]), str(pdf["state"].iloc[0]))
    os.makedirs(place, exist_ok=True)
    pdf.drop(columns=["representation", "state"]).to_csv(os.path.join(place, "predictions.csv"), index=False)
    return pdf.iloc[:1][["representation", "state"]]


def write_run_grid(df: DataFrame, folder: str) -> int:
    """Predictions as <representation>/<state>/predictions.csv below a folder that all executors see as a local path; the number of files.
    A run's predictions are one file, so they have to fit in a task."""
    write = partial(_write_run, folder=folder.removeprefix("file://").removeprefix("file:"))
    return df.groupBy("representation", "state").applyInPandas(write, "representation string, state string").count()


def read_run_grid(spark: SparkSession, path: str) -> DataFrame:
    """Predictions held as <representation>/<state>/predictions.csv, with both names as columns."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "predictions.csv").csv(path, header=True)
    file = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(file, r"([^/]+)/[^/]+/predictions\.csv$", 1).alias("representation"), F.regexp_extract(file, r"([^/]+)/predictions\.csv$", 1).alias("state"), *rows.columns)


def read_run_results(spark: SparkSession, path: str) -> DataFrame:
    """Results held as <representation>/<state>/result.json, a JSON object each, with both names as columns."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "result.json").json(path, multiLine=True)
    file = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(file, r"([^/]+)/[^/]+/result\.json$", 1).alias("representation"), F.regexp_extract(file, r"([^/]+)/result\.json$", 1).alias("state"), *rows.columns)

