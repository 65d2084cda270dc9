"""Inventory and request ingest from JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "id string, url string, connection_login string, connection_password string, system_status string, expired boolean, change_ip_links array<string>, connection_host string, connection_port int, access_type string"
RULE = "type string, fields map<string, struct<selector:string,attr:string,all:boolean,required:boolean>>"
REQUEST = f"url string, render boolean, wait_until string, wait_for_selector string, timeout_ms bigint, device string, headers map<string,string>, proxy_type string, proxy_pool_id string, raw_html boolean, screenshot boolean, stealth boolean, extract struct<type:string,fields:map<string,struct<selector:string,attr:string,all:boolean,required:boolean>>>"
DEFAULTS = {"render": True, "wait_until": "domcontentloaded", "device": "desktop", "proxy_type": "none", "raw_html": False, "screenshot": False, "stealth": True}


def inventory(df: DataFrame, body: str) -> DataFrame:
    """Items of a bare list or of {"results": [...]}; anything else is an error."""
    bare = F.from_json(F.col(body), f"array<struct<{_inner(ITEM)}>>")
    wrapped = F.from_json(F.col(body), f"results array<struct<{_inner(ITEM)}>>")["results"]
    start = F.left(F.ltrim(F.col(body)), F.lit(1))
    items = F.when(start == "[", bare).otherwise(wrapped)
    items = F.coalesce(items, F.raise_error(F.lit("neither a list nor an object with results")).cast(f"array<struct<{_inner(ITEM)}>>"))
    out = df.select(F.posexplode(items).alias("seq", "i")).select("seq", "i.*")
    return out.withColumn("status", F.lower("system_status")).withColumn("expired", F.coalesce("expired", F.lit(False)))


def _inner(schema: str) -> str:
    return ", ".join(p.replace(" ", ":", 1) for p in schema.split(", "))


def requests(df: DataFrame, body: str) -> DataFrame:
    """Scrape requests from JSON, with defaults for what is missing."""
    r = df.select(F.from_json(F.col(body), REQUEST).alias("r")).select("r.*")
    return r.fillna({k: v for k, v in DEFAULTS.items()})


#: The two device presets.
DEVICES = (
    ("desktop", "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36", 1280, 800, False),
    ("mobile", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_4 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.4 Mobile/15E148 Safari/604.1", 390, 844, True),
)
LOCALE, TIMEZONE = "en-US", "America/New_York"


def devices(spark) -> DataFrame:
    """device, user_agent, width, height, touch, locale, timezone, color_scheme of the presets."""
    rows = spark.createDataFrame(list(DEVICES), "device string, user_agent string, width int, height int, touch boolean")
    return rows.select("*", F.lit(LOCALE).alias("locale"), F.lit(TIMEZONE).alias("timezone"), F.lit("light").alias("color_scheme"))
