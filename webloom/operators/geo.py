"""Locale profiles by country, with a city's time zone on top."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import geo_data

PROFILES = "country string, locale string, timezone string, accept_language string"
CITIES = "country string, city string, city_timezone string"

BROADCAST_ROWS = 100_000


def profiles(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The profile dimension: a table of the caller's, or the shipped countries."""
    if path:
        return spark.read.schema(PROFILES).option("header", True).csv(path)
    return spark.createDataFrame(list(geo_data.COUNTRIES), PROFILES)


def cities(spark: SparkSession, path: str | None = None) -> DataFrame:
    return spark.read.schema(CITIES).option("header", True).csv(path) if path else spark.createDataFrame(list(geo_data.CITIES), CITIES)


def with_profile(df: DataFrame, country: str, city: str, profile: DataFrame, city_zones: DataFrame) -> DataFrame:
    """Two lookups; only the time zone follows the city, and only in a known country.

    The shipped dimensions are a few hundred rows; a caller's own table is broadcast up to BROADCAST_ROWS rows, else shuffled."""
    small = lambda d: F.broadcast(d) if d.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else d
    p = profile.withColumnRenamed("country", "_cc")
    c = city_zones.select(F.col("country").alias("_cc2"), F.col("city").alias("_city"), "city_timezone")
    df = df.withColumn("_k", F.upper(F.trim(F.col(country))))
    df = df.join(small(p), F.col("_k") == F.col("_cc"), "left")
    df = df.join(small(c), (F.col("_k") == F.col("_cc2")) & (F.lower(F.trim(F.col(city))) == F.col("_city")), "left")
    zone = F.when(F.col("_cc").isNotNull(), F.coalesce("city_timezone", "timezone"))
    return df.withColumn("timezone", zone).drop("_k", "_cc", "_cc2", "_city", "city_timezone")
