"""Operators on tile arrays: bands, crops, missing pixels, statistics, encoders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .audit import require, row_checks
from .pooling import GROUP
from .sequences import carried_forward, deterministic_sample

PATCH = [*GROUP, "patch_id"]


def reindexed(df: DataFrame, target: list[str], *, pad: bool = False) -> DataFrame:
    """Pixels in the order of the target bands. An absent band is an error, or zeros with ``pad``."""
    if not pad:
        want = F.array(*[F.lit(b) for b in target])
        require(row_checks(df, {"missing_bands": F.size(F.array_except(want, "bands")) > 0}, F.col("path")))
    size = F.col("h") * F.col("w")
    place = lambda b: F.array_position("bands", b).cast("int")
    layers = [F.when(place(b) > 0, F.slice("pixels", (place(b) - 1) * size + 1, size)).otherwise(F.array_repeat(F.lit(0.0).cast("float"), size)) for b in target]
    return df.withColumns({"pixels": F.concat(*layers), "bands": F.array(*[F.lit(b) for b in target]), "c": F.lit(len(target))})


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _cut(pixels: pd.Series, c: pd.Series, h: pd.Series, w: pd.Series, size: pd.Series) -> pd.Series:
    def one(x, c, h, w, s):
        a, b = (h - s) // 2, (w - s) // 2
        return np.asarray(x, np.float32).reshape(c, h, w)[:, a : a + s, b : b + s].ravel()

    return pd.Series([one(*r) for r in zip(pixels, c, h, w, size)])


def cropped(df: DataFrame, *sizes: int) -> DataFrame:
    """Centre crop to a square, in one or more stages; a smaller tile is an error."""
    for size in sizes:
        require(row_checks(df, {"undersize": (F.col("h") < size) | (F.col("w") < size)}, F.col("path")))
        df = df.withColumns({"pixels": _cut("pixels", "c", "h", "w", F.lit(size)), "h": F.lit(size), "w": F.lit(size)})
    return df


def screen_undersized(tiles: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(tiles of patches all of whose tiles are large enough, dropped patches)."""
    small = tiles.groupBy(*PATCH).agg(F.bool_or((F.col("h") < size) | (F.col("w") < size)).alias("small")).where("small").select(*PATCH)
    return tiles.join(small, PATCH, "left_anti"), small


def _bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def without_nonfinite(df: DataFrame, policy: str = "error") -> DataFrame:
    """error, zero, or mask: with zeros and a column ``valid`` that is false where a pixel was missing."""
    if policy == "error":
        require(row_checks(df, {"not_finite": F.exists("pixels", _bad)}, F.col("path")))
        return df
    out = df.withColumn("valid", F.transform("pixels", lambda x: ~_bad(x))) if policy == "mask" else df
    return out.withColumn("pixels", F.transform("pixels", lambda x: F.when(_bad(x), F.lit(0.0).cast("float")).otherwise(x)))


def valid_fraction(df: DataFrame) -> DataFrame:
    return df.withColumn("valid_fraction", F.size(F.filter("valid", lambda v: v)) / F.size("valid"))


def sequence_masks(df: DataFrame) -> DataFrame:
    """Per patch, the places that are valid at every timestep."""
    long = df.select(*PATCH, F.posexplode("valid").alias("place", "v")).groupBy(*PATCH, "place").agg(F.bool_and("v").alias("v"))
    rows = F.array_sort(F.collect_list(F.struct("place", "v")))
    return long.groupBy(*PATCH).agg(rows.alias("r")).select(*PATCH, F.col("r.v").alias("mask"), F.size(F.filter(F.col("r.v"), lambda v: v)).alias("n_valid"))


def band_means(df: DataFrame) -> DataFrame:
    """Mean of the valid pixels of each band and timestep of a patch."""
    rows = df.select(*PATCH, "timestep", (F.col("h") * F.col("w")).alias("_size"), F.posexplode(F.arrays_zip("pixels", "valid")).alias("place", "p"))
    rows = rows.withColumn("band", F.floor(F.col("place") / F.col("_size")).cast("int"))
    return rows.groupBy(*PATCH, "timestep", "band").agg(F.avg(F.when(F.col("p.valid"), F.col("p.pixels").cast("double"))).alias("mean"), F.count_if("p.valid").alias("n"))


#: Primes above any number of pixels: steps through the places of a tile that come to each once.
STRIDES = [2147483647, 2147483629, 2147483587, 2147483579]


def pixel_sample(df: DataFrame, k: int, salt: str) -> DataFrame:
    """Always k pixel places per patch (column n_pixels), by a salted hash: the places from a hashed start on in steps of a hashed stride,
    all different; where a patch has fewer than k, k independent draws, with ``replacement``. A patch without pixels is an error."""
    require(row_checks(df, {"no_pixels": F.col("n_pixels") < 1}, F.concat_ws("-", *PATCH)))
    number = lambda *more: F.conv(F.substring(F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in PATCH], F.lit(salt), *more)), 1, 8), 16, 10).cast("long")
    rows = df.select(*PATCH, "n_pixels", (F.col("n_pixels") < k).alias("replacement"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("rank"))
    stride = F.element_at(F.array(*[F.lit(x).cast("long") for x in STRIDES]), (number(F.lit("stride")) % len(STRIDES) + 1).cast("int"))
    walked, drawn = number(F.lit("start")) + F.col("rank") * stride, number(F.col("rank").cast("string"))
    return rows.withColumn("pixel", (F.when(F.col("replacement"), drawn).otherwise(walked) % F.col("n_pixels")).cast("int")).drop("n_pixels")


def patch_sample(df: DataFrame, k: int, *, seed: int, epoch: int) -> DataFrame:
    """k patches per region and year in an epoch, the same for any order of the rows."""
    return deterministic_sample(df.select(*PATCH).distinct(), GROUP, "patch_id", k, f"{seed}:{epoch}")


def assembled(df: DataFrame, steps: int, value: str = "pixels") -> DataFrame:
    """All timesteps of a patch; an absent one repeats the one before, or the first that there is. Step numbers alone pass the window;
    each array is fetched once by its step."""
    named = df.select(*PATCH, "timestep", F.col("timestep").alias("_from"))
    plan = carried_forward(named, PATCH, steps, "_from")
    return plan.join(df.select(*PATCH, F.col("timestep").alias("_from"), value), [*PATCH, "_from"]).drop("_from")


def channel_statistics(df: DataFrame, *, patches: int, pixels: int, seed: int, train: str = "split = 'train'") -> DataFrame:
    """Mean and deviation of each band over training tiles, from at most so many patches a region and year and pixels a patch (by hash)."""
    rows = df.where(train)
    chosen = patch_sample(rows, patches, seed=seed, epoch=0).select(*PATCH)
    rows = rows.join(chosen, PATCH, "left_semi").withColumn("_size", F.col("h") * F.col("w"))
    long = rows.select(*PATCH, "_size", F.posexplode("pixels").alias("place", "x")).withColumns({"band": F.floor(F.col("place") / F.col("_size")).cast("int"), "pixel": (F.col("place") % F.col("_size")).cast("int")})
    n = F.xxhash64(*PATCH, "pixel", F.lit(seed))
    keep = F.pmod(n, F.col("_size").cast("long")) < pixels  # about ``pixels`` of each patch, the same in all bands
    s = long.where((F.col("_size") <= pixels) | keep).groupBy("band").agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))
    return s.withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))


def standardised(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Pixels less their band's mean, over its deviation. The statistics, one row a band, are broadcast."""
    one = stats.agg(F.array_sort(F.collect_list(F.struct("band", "mean", "std"))).alias("_s"))
    at = lambda i: F.element_at("_s", (F.floor(i / (F.col("h") * F.col("w"))) + 1).cast("int"))
    return df.join(F.broadcast(one)).withColumn("pixels", F.transform("pixels", lambda x, i: ((x - at(i)["mean"]) / at(i)["std"]).cast("float"))).drop("_s")


def target_scale(df: DataFrame, target: str, train: str = "split = 'train'") -> DataFrame:
    """One row: mean and population deviation of training targets, 1 if there is none."""
    out = df.where(train).agg(F.avg(target).alias("mean"), F.stddev_pop(target).alias("std"))
    return out.select("mean", F.when(F.coalesce("std", F.lit(0.0)) < 1e-8, 1.0).otherwise(F.col("std")).alias("std"))


def scaled_target(df: DataFrame, scale: DataFrame, target: str, *, inverse: bool = False) -> DataFrame:
    value = F.col(target) * F.col("std") + F.col("mean") if inverse else (F.col(target) - F.col("mean")) / F.col("std")
    return df.join(F.broadcast(scale)).withColumn(target, value).drop("mean", "std")


def encoded(df: DataFrame, encoder: Callable[[pd.DataFrame], list], *, batch: int = 64, keys: list[str] = (*PATCH, "timestep")) -> DataFrame:
    """Applies a batch encoder, a callable that gets rows as pandas and returns a vector for each; a wrong number of vectors is an error."""
    keys = list(keys)

    def run(batches):
        for pdf in batches:
            for low in range(0, len(pdf), batch):
                part = pdf.iloc[low : low + batch]
                made = list(encoder(part))
                if len(made) != len(part):
                    raise ValueError(f"the encoder returned {len(made)} vectors for {len(part)} rows")
                yield part[keys].assign(embedding=[np.asarray(v, np.float32) for v in made])

    fields = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    return df.mapInPandas(run, f"{fields}, embedding array<float>")


def pooled_tokens(df: DataFrame, pooling: str, tokens: str = "tokens") -> DataFrame:
    """cls: the first token; spatial_mean: the mean of the others; mean: of all."""
    if pooling == "cls":
        return df.withColumn("embedding", F.element_at(tokens, 1))
    own = F.slice(tokens, 2, F.size(tokens) - 1) if pooling == "spatial_mean" else F.col(tokens)
    zero = F.transform(F.element_at(tokens, 1), lambda _: F.lit(0.0))
    total = F.aggregate(own, zero, lambda s, t: F.zip_with(s, t, lambda a, b: a + b))
    return df.withColumn("embedding", F.transform(total, lambda x: (x / F.size(own)).cast("float")))


def sampled_mean(df: DataFrame, width: int) -> DataFrame:
    """The mean of the embeddings of a patch's sampled pixels."""
    return df.groupBy(*PATCH).agg(F.count("*").alias("n"), F.array(*[F.avg(F.element_at("embedding", k + 1).cast("double")) for k in range(width)]).alias("embedding"))


def chronology_checks(df: DataFrame) -> DataFrame:
    """Dates of a patch increase with the timestep; its position stays the same to 1e-5 degrees."""
    order = W.Window.partitionBy(*PATCH).orderBy("timestep")
    rows = df.withColumn("_before", F.lag("date").over(order))
    per = df.groupBy(*PATCH).agg(F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")).alias("moved"))
    key = F.concat_ws("-", *PATCH)
    return row_checks(rows, {"dates_not_increasing": F.coalesce(F.col("date") <= F.col("_before"), F.lit(False))}, key).unionByName(row_checks(per, {"position_moves": F.col("moved") > 1e-5}, key))


def termination(df: DataFrame) -> DataFrame:
    """Adds the label that epoch counts imply, and whether it differs from a recorded one."""
    early = F.col("epochs_trained") == F.col("epoch") + F.col("patience") + 1
    known = F.col("epoch").isNotNull() & F.col("epochs_trained").isNotNull() & F.col("patience").isNotNull() & F.col("max_epochs_configured").isNotNull()
    return df.withColumn("termination", F.when(known & early, "early_stopping").when(known & (F.col("epochs_trained") >= F.col("max_epochs_configured")), "epoch_cap_reached"))
