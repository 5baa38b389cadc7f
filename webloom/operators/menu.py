"""Menus: items of navigation areas, the site-wide forest, and each page's differences from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import analytics as A

KEEP = {"header": 0.5, "footer": 0.5, "sidebar": 0.2}


def forest(entries: DataFrame, keep: dict[str, float] = KEEP) -> DataFrame:
    """entries (page_id, lang, area, key, anchor, parent, ordinal) -> lang, area, key, anchor, parent, place, pages, area_pages.

    An item stays if enough of the pages that carry its area have it. Its parent is the one most pages give it (ties:
    the larger), none if that isn't kept or is the item itself; items go by their mean place, then key.
    """
    area_pages = entries.groupBy("lang", "area").agg(F.countDistinct("page_id").alias("area_pages"))
    items = entries.groupBy("lang", "area", "key").agg(F.countDistinct("page_id").alias("pages"), F.avg("ordinal").alias("mean"))
    least = F.coalesce(*(F.when(F.col("area") == a, s) for a, s in keep.items()), F.lit(0.5))
    kept = items.join(area_pages, ["lang", "area"]).filter(F.col("pages") >= least * F.col("area_pages"))
    anchor = A.most_frequent(entries, ["lang", "area", "key"], "anchor").drop("n")
    parent = A.most_frequent(entries, ["lang", "area", "key"], "parent").drop("n")
    rows = kept.join(anchor, ["lang", "area", "key"]).join(parent, ["lang", "area", "key"])
    known = kept.select("lang", "area", F.col("key").alias("parent"), F.lit(True).alias("known"))
    rows = rows.join(known, ["lang", "area", "parent"], "left").withColumn("parent", F.when(F.col("known") & (F.col("parent") != F.col("key")), F.col("parent")))
    place = F.row_number().over(Window.partitionBy("lang", "area").orderBy("mean", "key")).cast("long")
    return rows.select("lang", "area", "key", "anchor", "parent", place.alias("place"), "pages", "area_pages")


def differences(entries: DataFrame, items: DataFrame, support: float = 0.5) -> DataFrame:
    """Per page: extra (an entry that isn't kept) and missing (an item most pages have) -> page_id, lang, area, kind, key."""
    keys = ["lang", "area", "key"]
    extra = entries.select("page_id", *keys).distinct().join(items.select(*keys), keys, "left_anti").withColumn("kind", F.lit("extra"))
    common = items.filter(F.col("pages") >= support * F.col("area_pages")).select(*keys)
    due = entries.select("page_id", "lang", "area").distinct().join(common, ["lang", "area"])
    missing = due.join(entries.select("page_id", *keys).distinct(), ["page_id", *keys], "left_anti").withColumn("kind", F.lit("missing"))
    return extra.unionByName(missing).select("page_id", "lang", "area", "kind", "key")
