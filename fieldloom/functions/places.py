"""Dates, positions and units as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Climate band aliases and plausible ranges.
CLIMATE_ALIASES = {"temperature_2m": "temperature", "t2m": "temperature", "tmean": "temperature", "total_precipitation": "precipitation", "tp": "precipitation", "prcp": "precipitation"}
CLIMATE_RANGES = {"temperature": (180.0, 340.0), "precipitation": (0.0, 5.0)}


def date_of(text: Column) -> Column:
    """A date from "2020-04-15", "20200415" or an ISO time stamp; null otherwise."""
    text = F.trim(text)
    return F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))


def month_index(date: Column) -> Column:
    return F.month(date) - 1


def year_day(date: Column) -> Column:
    """[year, day of the year from 0]."""
    return F.array(F.year(date).cast("double"), (F.dayofyear(date) - 1).cast("double"))


def _circle(angle: Column) -> list[Column]:
    return [F.sin(angle), F.cos(angle)]


def week_hour(ts: Column) -> Column:
    """[sin, cos] of the ISO week, then of the hour with its fraction."""
    hour = F.hour(ts) + F.minute(ts) / 60.0 + F.floor(F.second(ts)) / 3600.0
    return F.array(*_circle(F.weekofyear(ts) * (2 * math.pi / 52)), *_circle(hour * (2 * math.pi / 24)))


def lat_lon_circle(lat: Column, lon: Column) -> Column:
    """[sin, cos] of latitude, then of longitude; null out of range."""
    return F.when(in_range(lat, lon), F.array(*_circle(F.radians(lat)), *_circle(F.radians(lon))))


def in_range(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def reflectance(pixels: Column, *, scale: float = 10_000.0, limit: float = 2.0) -> Column:
    """Pixels as reflectance in 0..1: digital numbers, known by a value beyond ``limit``, are divided by ``scale``."""
    top = F.array_max(F.transform(pixels, lambda x: F.abs(x.cast("double"))))
    divide = F.when(top > limit, F.lit(scale)).otherwise(F.lit(1.0))
    return F.transform(pixels, lambda x: F.least(F.greatest(x.cast("double") / divide, F.lit(0.0)), F.lit(1.0)))


def unit_of(pixels: Column, limit: float = 2.0) -> Column:
    return F.when(F.array_max(F.transform(pixels, lambda x: F.abs(x.cast("double")))) > limit, "dn").otherwise("reflectance")


def climate_band(name: Column) -> Column:
    text = F.lower(F.trim(name))
    aliases = F.create_map(*[F.lit(x) for pair in CLIMATE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, text), text)


def plausible(band: Column, low: Column, high: Column) -> Column:
    """Whether a band's smallest and largest value lie in its range; bands without a range pass."""
    ok = F.lit(True)
    for name, (a, b) in CLIMATE_RANGES.items():
        ok = F.when(band == name, (low >= a) & (high <= b)).otherwise(ok)
    return ok
