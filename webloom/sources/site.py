"""A closed catalogue site made from the star-schema tables: pages, links, duplicates, off-site links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import table

ROOT = "https://shop.example.com/"


def _page(url, title, links, price=None):
    head = F.concat(F.lit('<html><head><title>'), title, F.lit('</title></head><body><h1 class="name">'), title, F.lit("</h1>"))
    if price is not None:
        head = F.concat(head, F.lit('<p class="price">£'), price, F.lit("</p>"))
    return F.struct(url.alias("url"), F.concat(head, links, F.lit("</body></html>")).alias("html"))


def _anchor(href, text):
    return F.concat(F.lit('<a href="'), href, F.lit('">'), text, F.lit("</a>"))


def _child_list(df: DataFrame, parent: str, kind: str, key: str, name: str) -> DataFrame:
    links = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(name).alias("n"))))
    anchors = F.transform(links, lambda x: _anchor(F.concat(F.lit(f"/{kind}/"), x["k"].cast("string")), x["n"]))
    return df.groupBy(F.col(parent).alias("key")).agg(F.array_join(anchors, "").alias("links"))


def catalogue(spark: SparkSession, sf_dir: str, with_orders: bool = False) -> DataFrame:
    """url, html, status_code: / -> /region/r -> /nation/n -> /customer/c (-> /order/o); every page links home."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    home = _anchor(F.lit("/#top"), F.lit("home"))
    url = lambda kind, key: F.concat(F.lit(f"{ROOT}{kind}/"), F.col(key).cast("string"))
    regions = F.array_sort(F.collect_list(F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n"))))
    top = F.array_join(F.transform(regions, lambda x: _anchor(F.concat(F.lit("/region/"), x["k"].cast("string")), x["n"])), "")
    first = region.agg(top.alias("links")).select(_page(F.lit(ROOT), F.lit("Catalogue"), F.concat(home, F.col("links"))).alias("p"))
    extra = F.concat(_anchor(F.lit("mailto:shop@example.com"), F.lit("mail")), _anchor(F.lit("https://partner.example.net/"), F.lit("partner")))
    blog = _anchor(F.concat(F.lit("https://blog.example.com/region/"), F.col("r_regionkey").cast("string")), F.lit("blog"))
    second = region.join(_child_list(nation, "n_regionkey", "nation", "n_nationkey", "n_name"), region["r_regionkey"] == F.col("key"), "left")
    second = second.select(_page(url("region", "r_regionkey"), F.col("r_name"), F.concat(home, F.coalesce("links", F.lit("")), extra, blog)).alias("p"))
    third = nation.join(_child_list(customer, "c_nationkey", "customer", "c_custkey", "c_name"), nation["n_nationkey"] == F.col("key"), "left")
    third = third.select(_page(url("nation", "n_nationkey"), F.col("n_name"), F.concat(home, F.coalesce("links", F.lit("")))).alias("p"))
    back = _anchor(F.concat(F.lit("/nation/"), F.col("c_nationkey").cast("string"), F.lit("?")), F.lit("nation"))
    price = F.format_string("%.2f", F.abs("c_acctbal"))
    fourth = customer
    more = F.lit("")
    if with_orders:
        orders = table(spark, sf_dir, "orders").withColumn("o_name", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")))
        fourth = customer.join(_child_list(orders, "o_custkey", "order", "o_orderkey", "o_name"), customer["c_custkey"] == F.col("key"), "left")
        more = F.coalesce("links", F.lit(""))
    fourth = fourth.select(_page(url("customer", "c_custkey"), F.col("c_name"), F.concat(home, back, more), price).alias("p"))
    pages = first.unionByName(second).unionByName(third).unionByName(fourth)
    if with_orders:
        pages = pages.unionByName(orders.select(_page(url("order", "o_orderkey"), F.col("o_name"), home, F.format_string("%.2f", "o_totalprice")).alias("p")))
    return pages.select("p.url", "p.html", F.lit(200).alias("status_code"))
