"""Region identifiers, keys, labels and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing number.
NA_TOKENS = ("", "NA", "N/A", "NONE", "NULL", "NAN", "UNKNOWN")
#: The alias of a role in a fold manifest.
ROLE_ALIASES = {"validation": "val", "valid": "val", "dev": "val", "training": "train", "testing": "test"}


def zfill(text: Column, width: int) -> Column:
    """Zeros on the left up to ``width``; longer texts stay as they are."""
    text = text.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def region_id(value: Column) -> Column:
    """Null becomes "", "17001.0" loses its fraction, digits are filled to five places, other texts are only trimmed."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    text = F.when(text.rlike(r"^\d+\.0$"), F.regexp_replace(text, r"\.0$", "")).otherwise(text)
    return F.when(text.rlike(r"^\d+$"), zfill(text, 5)).otherwise(text)


def region_id_of_float(value: Column) -> Column:
    """The same for a floating-point column: integral values lose their fraction."""
    return F.when(value == F.floor(value), region_id(value.cast("long"))).otherwise(region_id(value))


def label_region_id(value: Column) -> Column:
    """As label tables have it: a trailing ".0" goes, and whatever is left is filled to five places."""
    return zfill(F.regexp_replace(F.trim(value.cast("string")), r"\.0$", ""), 5)


def digits_region_id(value: Column) -> Column:
    """The first run of digits, filled to five places."""
    return zfill(F.regexp_extract(value.cast("string"), r"(\d+)", 1), 5)


def region_name(value: Column) -> Column:
    """Lower case, without a trailing "county", with single blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"\s+county$", ""), r"\s+", " ")


def fips(state: Column, area: Column) -> Column:
    return F.concat(zfill(state.cast("int"), 2), zfill(area.cast("int"), 3))


def panel_key(region: Column, year: Column) -> Column:
    return F.concat_ws("-", region, year.cast("string"))


def key_region(key: Column) -> Column:
    return F.split_part(key, F.lit("-"), F.lit(1))


def key_year(key: Column) -> Column:
    """The year of a key; null where the key is malformed."""
    return F.try_to_number(F.regexp_extract(key, r"^.+-(\d{4})$", 1), F.lit("9999")).cast("int")


def state_of(region: Column) -> Column:
    return F.substring(region, 1, 2)


def role_name(value: Column) -> Column:
    text = F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-"))
    out = text
    for alias, role in ROLE_ALIASES.items():
        out = F.when(text == alias, role).otherwise(out)
    return out


def safe_double(value: Column, default: float | None = None) -> Column:
    """A number from text; missing-value tokens, other texts and non-finite numbers give ``default``."""
    text = F.trim(value.cast("string"))
    number = F.when(F.upper(text).isin(*NA_TOKENS), None).otherwise(text).try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return F.coalesce(finite, F.lit(default).cast("double"))


def band_name(value: Column) -> Column:
    """"b2" and "B2" are "B02"."""
    return F.regexp_replace(F.upper(F.trim(value)), r"^B(\d)$", "B0$1")


def interval_of(stem: Column) -> Column:
    """The number after t, interval or timestep in a file stem."""
    return F.regexp_extract(F.lower(stem), r"(?:^|_)(?:timestep|interval|t)[_-]?(\d{1,5})(?=_|$)", 1).try_cast("int")


def experiment_family(modalities: Column, fusion_stage: Column) -> Column:
    """unfused, input_fusion (the encoder read climate), late_fusion, or both."""
    climate = F.coalesce(F.lower(modalities).rlike("era5|daymet|climate"), F.lit(False))
    late = F.coalesce(F.lower(fusion_stage) == "late", F.lit(False))
    return F.when(climate & late, "both").when(climate, "input_fusion").when(late, "late_fusion").otherwise("unfused")
