"""Link operators: counted links, targets, parents by path, robots decisions, sitemap comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import url as U


def resolved(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links with to_page_id: the page with the target's key, the smallest id if several have it."""
    keys = pages.groupBy(U.page_url(F.col("url")).alias("key")).agg(F.min("page_id").alias("to_page_id"))
    return links.withColumn("key", U.page_url(F.col("to_url"))).join(keys, "key", "left").drop("key")


def counted(links: DataFrame) -> DataFrame:
    """Outside the body, of links with equal source, target, position and anchor only the first counts."""
    target = F.coalesce(F.col("to_page_id").cast("string"), F.col("to_url"))
    order = Window.partitionBy("from_page_id", target, "position", "anchor").orderBy("ordinal")
    return links.withColumn("copy", F.row_number().over(order)).filter("position = 'body' OR copy = 1").drop("copy")


def dangling_nulled(links: DataFrame, pages: DataFrame) -> DataFrame:
    """to_page_id kept only where pages has it."""
    known = pages.select(F.col("page_id").alias("known_id")).distinct()
    return links.join(known, links.to_page_id == known.known_id, "left").withColumn("to_page_id", F.col("known_id")).drop("known_id")


def page_facts(pages: DataFrame, links: DataFrame) -> DataFrame:
    """pages with outbound, self_links, inbound and referrers (distinct other pages), from counted links."""
    out = links.groupBy(F.col("from_page_id").alias("page_id")).agg(F.count(F.lit(1)).alias("outbound"), F.count_if(F.col("to_page_id") == F.col("from_page_id")).alias("self_links"))
    others = links.filter("to_page_id IS NOT NULL AND to_page_id <> from_page_id")
    into = others.groupBy(F.col("to_page_id").alias("page_id")).agg(F.count(F.lit(1)).alias("inbound"), F.countDistinct("from_page_id").alias("referrers"))
    counts = ("outbound", "self_links", "inbound", "referrers")
    return pages.join(out, "page_id", "left").join(into, "page_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def path_parents(pages: DataFrame) -> DataFrame:
    """pages (page_id, url) with parent_id: the page at the longest folder above, same host; by equality with each folder, no range join."""
    stands = pages.groupBy(U.host(F.col("url")).alias("h"), U.path(U.page_url(F.col("url"))).alias("p")).agg(F.min("page_id").alias("parent_id"))
    stands = stands.withColumn("p", F.when(F.col("p") == "", "/").otherwise(F.col("p")))
    above = pages.select("page_id", U.host(F.col("url")).alias("h"), F.explode(U.folders(F.col("url"))).alias("p"))
    best = above.join(stands, ["h", "p"]).filter("page_id <> parent_id").groupBy("page_id").agg(F.max_by("parent_id", F.length("p")).alias("parent_id"))
    return pages.join(best, "page_id", "left")


def unique_suffix_targets(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Of unresolved links /a/b/slug: the page /slug of the host, if only one path ends so."""
    last = lambda u: F.regexp_extract(U.page_url(u), "([^/]+)$", 1)
    roots = pages.filter(F.regexp_like(U.path(U.page_url(F.col("url"))), F.lit("^/[^/]+$"))).groupBy(U.host(F.col("url")).alias("h"), last(F.col("url")).alias("slug")).agg(F.min("page_id").alias("inferred_id"), F.count(F.lit(1)).alias("many")).filter("many = 1")
    return links.withColumn("h", U.host(F.col("to_url"))).withColumn("slug", last(F.col("to_url"))).join(roots.drop("many"), ["h", "slug"], "left").withColumn("to_page_id", F.coalesce("to_page_id", "inferred_id")).drop("h", "slug", "inferred_id")


def robots_decision(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """urls (host, path) with allowed: the longest pattern of the agent's group, else of *, decides; on ties Allow; without a match allowed.

    rules: host, agent, allow, pattern. Joined by host, so a URL meets its own host's rules alone.
    """
    own = rules.filter(F.col("agent").isin(agent, "*")).withColumn("own", F.max(F.col("agent") == agent).over(Window.partitionBy("host"))).filter((F.col("agent") == agent) == F.col("own"))
    hit = urls.join(own.select("host", "allow", "pattern"), "host").filter(F.regexp_like(F.col("path"), U.robots_pattern(F.col("pattern"))))
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length("pattern").alias("length"), "allow", "pattern")).alias("rule"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, F.coalesce("rule.allow", F.lit(True)).alias("allowed"), F.col("rule.pattern").alias("pattern"))


def sitemap_comparison(sitemap: DataFrame, pages: DataFrame, linked: DataFrame) -> DataFrame:
    """A row for each key on any side: in_sitemap, in_pages, in_links."""
    side = lambda df, name: df.select("key").distinct().withColumn(name, F.lit(True))
    out = side(sitemap, "in_sitemap").join(side(pages, "in_pages"), "key", "full_outer").join(side(linked, "in_links"), "key", "full_outer")
    return out.select("key", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_sitemap", "in_pages", "in_links")))


def weak_pages(facts: DataFrame, most: int = 0) -> DataFrame:
    """Pages with at most so many referrers."""
    return facts.filter(F.col("referrers") <= most)


def position_of(kind: Column) -> Column:
    return F.when(kind.isin("nav", "footer", "aside"), kind).otherwise("body")


def admitted(urls: DataFrame, seed_host: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """urls (url) with admitted: internal addresses that match a pattern of include, if there are any, and none of exclude."""
    url = F.col("url")
    any_of = lambda patterns, none: F.regexp_like(url, F.lit("|".join(f"(?:{p})" for p in patterns))) if patterns else F.lit(none)
    return urls.withColumn("admitted", U.is_internal(U.host(url), U.path(url), F.lit(seed_host)) & any_of(include, True) & ~any_of(exclude, False))


def language_pairs(pages: DataFrame) -> DataFrame:
    """pages (page_id, group, lang) -> group, a, b, a_lang, b_lang: each two pages of a group in different languages. Groups are as large as a site has languages."""
    a, b = (pages.select("group", F.col("page_id").alias(n), F.col("lang").alias(f"{n}_lang")) for n in "ab")
    return a.join(b, "group").filter("a_lang < b_lang")


def inbound_to_originals(links: DataFrame, duplicates: DataFrame, groups: DataFrame) -> DataFrame:
    """links (from_id, to_id, position), duplicates (page_id, original_id), groups (page_id, group) -> to_id, group, body: links to originals, those to their duplicates too, from pages of other groups."""
    moved = links.join(duplicates.toDF("to_id", "original_id"), "to_id", "left").withColumn("to_id", F.coalesce("original_id", "to_id")).drop("original_id")
    rows = moved.join(groups.select(F.col("page_id").alias("from_id"), "group"), "from_id").join(groups.select(F.col("page_id").alias("to_id"), F.col("group").alias("own")), "to_id")
    return rows.filter("group <> own").select("to_id", "group", (F.col("position") == "body").alias("body"))


def cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (request_id, text), cache (text, answer) -> request_id, answer: of a cached request that is equal but for case and blanks, the same text first, then the smallest."""
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    kept = cache.select(key.alias("key"), F.col("text").alias("cached"), "answer")
    rows = requests.withColumn("key", key).join(kept, "key")
    return rows.groupBy("request_id").agg(F.min_by("answer", F.struct(F.col("cached") != F.col("text"), "cached", "answer")).alias("answer"))
