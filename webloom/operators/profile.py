"""Site profile: target country, languages, trailing slash, technology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import url as U

# Fixed values of the rules.
WEIGHTS = {"tld": 3.0, "hreflang": 1.0, "path_prefix": 1.5, "phone": 2.0, "schema": 2.0, "og_locale": 2.0, "currency": 1.0}
ISOLATED_OG_LOCALE = 1.0
STRONG = ("tld", "hreflang", "phone", "schema", "og_locale")
CORROBORATING = ("tld", "schema", "phone", "hreflang")
TLD = {
    "hu": "HU", "de": "DE", "at": "AT", "ch": "CH", "uk": "GB", "us": "US", "ca": "CA", "au": "AU", "ie": "IE", "it": "IT", "fr": "FR", "es": "ES", "nl": "NL", "be": "BE", "cz": "CZ", "pl": "PL",
    "ro": "RO", "hr": "HR",
}
PHONE = {
    "+36": "HU", "+49": "DE", "+43": "AT", "+41": "CH", "+44": "GB", "+1": "US", "+61": "AU", "+353": "IE", "+39": "IT", "+33": "FR", "+34": "ES", "+31": "NL", "+32": "BE", "+420": "CZ", "+48": "PL",
    "+40": "RO", "+385": "HR",
}
CURRENCY = {"HUF": "HU", "GBP": "GB", "CHF": "CH", "CZK": "CZ", "PLN": "PL", "RON": "RO", "HRK": "HR"}
SYMBOLS = {"€": "EUR", "£": "GBP", "Kč": "CZK", "zł": "PLN", "Ft": "HUF"}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in values.items()))


def tld_country(host: Column) -> Column:
    return _lookup(TLD, F.regexp_extract(host, r"([^.]+)$", 1))


def phone_countries(text: Column) -> Column:
    """Countries of the international numbers in a text, the longest prefix deciding."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(?:\+|00)\s?(\d{1,3})(?:[\s.\-/()]?\d){5,}"), 1), lambda n: F.concat(F.lit("+"), n))
    of = lambda n: F.coalesce(*(F.when(n.startswith(p), F.lit(c)) for p, c in sorted(PHONE.items(), key=lambda x: -len(x[0]))))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(digits, of))))


def currency_countries(text: Column) -> Column:
    codes = F.regexp_extract_all(text, F.lit(rf"\b({'|'.join([*CURRENCY, 'EUR', 'USD'])})\b"), 1)
    signs = F.array_compact(F.array(*(F.when(text.contains(s), F.lit(c)) for s, c in SYMBOLS.items())))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.concat(codes, signs), lambda c: _lookup(CURRENCY, c)))))


def country_votes(signals: DataFrame) -> DataFrame:
    """signals (site, kind, country; a row for each page) -> site, country, score, kinds, rank: the three best, scores as shares rounded to hundredths."""
    counts = signals.groupBy("site", "kind", "country").agg(F.count(F.lit(1)).alias("n"))
    backed = counts.filter(F.col("kind").isin(*CORROBORATING)).select("site", "country").distinct().withColumn("backed", F.lit(True))
    rows = counts.join(backed, ["site", "country"], "left")
    weight = F.when((F.col("kind") == "og_locale") & F.col("backed").isNull(), ISOLATED_OG_LOCALE).otherwise(F.coalesce(*(F.when(F.col("kind") == k, w) for k, w in WEIGHTS.items())))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("site", "kind"))
    score = rows.withColumn("part", weight * share).groupBy("site", "country").agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    site = Window.partitionBy("site")
    ranked = score.withColumn("rank", F.row_number().over(site.orderBy(F.desc(F.round("score", 9)), "country"))).withColumn("share", F.round(F.col("score") / F.sum("score").over(site), 2))
    return ranked.filter("rank <= 3")


def target_countries(signals: DataFrame) -> DataFrame:
    """signals as for country_votes -> site, country (null on a tie at the top), confidence."""
    votes = country_votes(signals)
    top = votes.groupBy("site").agg(F.min_by("country", "rank").alias("country"), F.max("score").alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    counts = signals.filter(F.col("kind").isin(*STRONG)).groupBy("site", "kind", "country").agg(F.count(F.lit(1)).alias("n"))
    backed = signals.filter(F.col("kind").isin(*CORROBORATING)).select("site", "country").distinct().withColumn("backed", F.lit(True))
    leaders = counts.withColumn("place", F.rank().over(Window.partitionBy("site", "kind").orderBy(F.desc("n")))).filter("place = 1").groupBy("site", "kind").agg(F.count(F.lit(1)).alias("many"), F.max("country").alias("leader")).filter("many = 1")
    leaders = leaders.join(backed.withColumnRenamed("country", "leader"), ["site", "leader"], "left").filter("kind <> 'og_locale' OR backed")
    against = leaders.join(top.select("site", "country"), "site").groupBy("site").agg(F.count_if(F.col("leader") == F.col("country")).alias("agree"), F.count_if(F.col("leader") != F.col("country")).alias("differ"))
    tie = F.coalesce(F.abs(F.col("first") - F.col("second")) <= 1e-9 * F.col("first"), F.lit(False))
    rows = top.join(against, "site", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("agree", "differ")})
    sure = F.when(F.col("agree") >= 3, "high").when(F.col("differ") > 0, "low").when(F.col("agree") > 0, "medium").otherwise("low")
    return rows.select("site", F.when(~tie, F.col("country")).alias("country"), F.when(~tie, sure).alias("confidence"))


def languages(pages: DataFrame) -> DataFrame:
    """pages (site, lang, hreflang langs) -> site, languages: by number of pages, then name; then those that only hreflang names."""
    own = pages.filter("lang IS NOT NULL").groupBy("site", "lang").agg(F.count(F.lit(1)).alias("n"))
    other = pages.select("site", F.explode("hreflang.lang").alias("lang")).select("site", F.lower(F.regexp_extract("lang", "^([a-zA-Z]+)", 1)).alias("lang")).filter("lang <> 'x' AND lang <> ''").distinct().join(own, ["site", "lang"], "left_anti").withColumn("n", F.lit(0))
    rows = own.unionByName(other).groupBy("site").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "lang"))).alias("l"))
    return rows.select("site", F.transform("l", lambda x: x["lang"]).alias("languages"))


def trailing_slash(pages: DataFrame, first: int = 50) -> DataFrame:
    """pages (site, page_id, url) -> site, trailing_slash: what most of a site's first pages have, those with a path and no file; null on a tie or without any."""
    path = U.path(F.col("url"))
    rows = pages.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("page_id"))).filter(F.col("place") <= first)
    votes = ~path.isin("", "/") & ~F.lower(F.regexp_extract(path, r"\.([^./]*)/*$", 1)).isin(*U.FILE_EXTENSIONS)
    with_, without = F.count_if(votes & path.endswith("/")), F.count_if(votes & ~path.endswith("/"))
    return rows.groupBy("site").agg(with_.alias("with_"), without.alias("without")).select("site", F.when(F.col("with_") != F.col("without"), F.col("with_") > F.col("without")).alias("trailing_slash"))


TECH = {"wordpress": r"(?i)wordpress|/wp-(content|includes)/", "shopify": r"(?i)cdn\.shopify\.com|shopify", "drupal": r"(?i)drupal", "joomla": r"(?i)joomla", "wix": r"(?i)wix\.com", "next.js": r"/_next/static/"}


def technologies(signals: DataFrame) -> DataFrame:
    """signals (site, page_id, signal) -> site, tech, pages."""
    found = F.array_compact(F.array(*(F.when(F.regexp_like("signal", F.lit(p)), F.lit(t)) for t, p in TECH.items())))
    return signals.select("site", "page_id", F.explode(found).alias("tech")).groupBy("site", "tech").agg(F.countDistinct("page_id").alias("pages"))
