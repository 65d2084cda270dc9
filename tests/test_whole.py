"""The whole job: cases in which an operator once did a part of it."""

from webloom import api
from webloom.operators import geo, sitemap


def test_geo_has_all_countries_and_cities(spark):
    assert api.list_countries(spark).count() == 250 and geo.cities(spark).count() == 44
    rows = [("AT", None), (" pl", "x"), ("KE", None), ("ca", "Toronto"), ("IN", None), ("MA", ""), ("US", " Boston "), ("AU", "perth"), ("AQ", None), ("XX", "boston"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, country string, city string")
    out = geo.with_profile(df, "country", "city", geo.profiles(spark), geo.cities(spark)).orderBy("i").collect()
    assert [(r.locale, r.timezone, r.accept_language) for r in out] == [
        ("de-AT", "Europe/Vienna", "de-AT,de;q=0.9,en;q=0.8"), ("pl-PL", "Europe/Warsaw", "pl-PL,pl;q=0.9,en;q=0.8"),
        ("sw-KE", "Africa/Nairobi", "sw-KE,sw;q=0.9,en;q=0.8"), ("en-CA", "America/Toronto", "en-CA,en;q=0.9,fr-CA;q=0.8,fr;q=0.7"),
        ("en-IN", "Asia/Kolkata", "en-IN,en;q=0.9,hi;q=0.8"), ("ar-MA", "Africa/Casablanca", "ar-MA,ar;q=0.9,fr;q=0.8,en;q=0.7"),
        ("en-US", "America/New_York", "en-US,en;q=0.9"), ("en-AU", "Australia/Perth", "en-AU,en;q=0.9"), ("en-AQ", "Antarctica/McMurdo", "en-AQ,en;q=0.9"),
        (None, None, None), (None, None, None),
    ]


def test_site_map_has_every_level(spark):
    rows = [(f"u{k}", f"u{k - 1}" if k else None, k, k, 200, None, 0) for k in range(24)]
    df = spark.createDataFrame(rows, "url string, parent_url string, ord bigint, depth int, status_code int, error string, took_ms int")
    lines = [r.line.strip("│├└─ ").split(" ")[0] for r in sitemap.text_lines(df).orderBy("path").collect()]
    assert lines == [f"u{k}" for k in range(24)]
    assert sitemap.text_lines(df, 3).count() == 4
