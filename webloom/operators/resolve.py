"""Entity resolution: names to candidates, merges with keep order, votes, flags, relations, knowledge status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import analytics as A

SOURCE_ORDER = ("schema", "rule", "llm")
TIER_ORDER = ("core", "package", "work_mode", None, "step")


def source_rank(source: Column) -> Column:
    return F.coalesce(*(F.when(source == s, i) for i, s in enumerate(SOURCE_ORDER)), F.lit(len(SOURCE_ORDER)))


def keep_order() -> list[Column]:
    """Which of several equal entities stays: anchored, by tier, by source, by mentions, by id."""
    tier = F.when(F.col("tier") == "core", 0).when(F.col("tier").isin("package", "work_mode"), 1).when(F.col("tier").isNull(), 2).otherwise(3)
    return [F.when(F.col("anchor_page_id").isNotNull(), 0).otherwise(1), tier, source_rank(F.col("source")), F.desc("mentions"), F.asc("entity_id")]


def merges(entities: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """entities (entity_id, keys, type, subtype, tier, anchor_page_id, source, mentions) -> kept_id, removed_id, rule.

    Of equal keys the first by keep order stays; another is merged unless both are anchored to different pages or
    have two tiers or two subtypes. Decided against the one that stays, so each entity is removed once at most.
    """
    group = Window.partitionBy(*keys)
    rows = entities.withColumn("place", F.row_number().over(group.orderBy(*keep_order())))
    first = rows.filter("place = 1").select(*keys, *(F.col(c).alias(f"k_{c}") for c in ("entity_id", "anchor_page_id", "tier", "subtype")))
    pairs = rows.filter("place > 1").join(first, list(keys))
    clash = lambda c: F.col(c).isNotNull() & F.col(f"k_{c}").isNotNull() & (F.col(c) != F.col(f"k_{c}"))
    apart = clash("anchor_page_id") | clash("tier") | clash("subtype")
    return pairs.filter(~apart).select(F.col("k_entity_id").alias("kept_id"), F.col("entity_id").alias("removed_id"), F.lit(rule).alias("rule"))


def remapped(table: DataFrame, merge: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """table with removed ids replaced by those kept; rows that become equal by keys (of which one may be column) once."""
    to = merge.select(F.col("removed_id").alias(column), "kept_id")
    out = table.join(to, column, "left").withColumn(column, F.coalesce("kept_id", column)).drop("kept_id").select(*table.columns)
    return out.dropDuplicates(list(keys)) if keys else out


def canonical_names(mentions: DataFrame) -> DataFrame:
    """mentions (entity_id, name, source, n) -> entity_id, name: by source, then accents kept, then frequency, then the larger string."""
    each = mentions.groupBy("entity_id", "name").agg(F.min(source_rank(F.col("source"))).alias("rank"), F.sum("n").alias("n"))
    accents = F.length(F.regexp_replace("name", r"[\x00-\x7F]", ""))
    return each.groupBy("entity_id").agg(F.max_by("name", F.struct((-F.col("rank")).alias("a"), (accents > 0).alias("b"), F.col("n").alias("c"), F.col("name").alias("d"))).alias("name"))


def majority_types(votes: DataFrame, protected: Sequence[str] = ("schema", "rule")) -> DataFrame:
    """votes (entity_id, type, source) -> entity_id, type, share: most votes, ties the first by name; a protected source's type stands."""
    fixed = votes.filter(F.col("source").isin(*protected)).groupBy("entity_id").agg(F.min("type").alias("fixed"))
    counts = votes.groupBy("entity_id", "type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("entity_id"))
    best = counts.withColumn("share", F.col("n") / total).withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("n"), "type"))).filter("place = 1")
    return best.join(fixed, "entity_id", "left").select("entity_id", F.coalesce("fixed", "type").alias("type"), F.round("share", 6).alias("share"))


def template_entities(mentions: DataFrame) -> DataFrame:
    """Entities all of whose mentions are template text."""
    return mentions.groupBy("entity_id").agg(F.bool_and("template").alias("all")).filter("all").select("entity_id")


def repeated_anchors(links: DataFrame, reason: Column, pages: int = 3) -> DataFrame:
    """links (from_page_id, anchor) whose anchor names something and stands on so many pages: anchor, in_pages."""
    return links.filter(reason.isNull() & (F.col("anchor") != "")).groupBy("anchor").agg(F.countDistinct("from_page_id").alias("in_pages")).filter(F.col("in_pages") >= pages)


def unique_anchor_targets(links: DataFrame) -> DataFrame:
    """Anchors that lead to one page of the site only: anchor, page_id."""
    rows = links.filter("to_page_id IS NOT NULL AND anchor <> ''").groupBy(F.lower("anchor").alias("anchor")).agg(F.countDistinct("to_page_id").alias("many"), F.min("to_page_id").alias("page_id"))
    return rows.filter("many = 1").drop("many")


def families(products: DataFrame, brand: str, name: str, least: int = 2) -> DataFrame:
    """products (product_id, brand, name) -> product_id, family: the longest word prefix that so many of the brand's products share and that isn't the whole name's first word of one alone."""
    words = F.split(F.lower(name), r"\s+")
    prefixes = products.select("product_id", brand, F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("family"))
    counts = prefixes.groupBy(brand, "family").agg(F.countDistinct("product_id").alias("members")).filter(F.col("members") >= least)
    best = prefixes.join(counts, [brand, "family"]).groupBy("product_id").agg(F.max_by("family", F.length("family")).alias("family"))
    return best


def person_merges(people: DataFrame, count: int | None = None) -> DataFrame:
    """people (entity_id, name) -> kept_id, removed_id: those whose names have the same words in any order, cases and accents aside; the smallest id stays. With a count only names of so many words: for persons two."""
    words = F.array_sort(F.filter(F.split(X.alias_key(F.col("name")), " "), lambda w: w != ""))
    rows = people.withColumn("words", words).filter(F.size("words") == count if count else F.size("words") > 0).withColumn("key", F.array_join("words", " ")).drop("words").withColumn("kept_id", F.min("entity_id").over(Window.partitionBy("key")))
    return rows.filter("entity_id <> kept_id").select("kept_id", F.col("entity_id").alias("removed_id"))


def within_blocks(mentions: DataFrame, blocks: DataFrame) -> DataFrame:
    """mentions (entity_id, page_id, ordinal), blocks (page_id, ordinal) -> entity_id: entities all of whose mentions stand in these blocks."""
    known = blocks.select("page_id", "ordinal").distinct().withColumn("inside", F.lit(True))
    return mentions.join(known, ["page_id", "ordinal"], "left").groupBy("entity_id").agg(F.bool_and(F.coalesce("inside", F.lit(False))).alias("all")).filter("all").select("entity_id")


def knowledge_status(candidates: DataFrame) -> DataFrame:
    """candidates (entity_id, kb_id, name_equal, type_equal, corroborated) -> entity_id, kb_id, status.

    confident: the only candidate of equal name and type, or the only corroborated one; probable: an equal name; else none.
    """
    each = candidates.groupBy("entity_id").agg(
        F.count_if(F.col("name_equal") & F.col("type_equal")).alias("exact"), F.min(F.when(F.col("name_equal") & F.col("type_equal"), F.col("kb_id"))).alias("exact_id"),
        F.count_if("corroborated").alias("backed"), F.min(F.when(F.col("corroborated"), F.col("kb_id"))).alias("backed_id"), F.min(F.when(F.col("name_equal"), F.col("kb_id"))).alias("named_id"),
    )
    sure = F.when(F.col("backed") == 1, F.col("backed_id")).when(F.col("exact") == 1, F.col("exact_id"))
    return each.select("entity_id", F.coalesce(sure, "named_id").alias("kb_id"), F.when(sure.isNotNull(), "confident").when(F.col("named_id").isNotNull(), "probable").otherwise("none").alias("status"))


def display_names(names: DataFrame, pages: DataFrame) -> DataFrame:
    """names (entity_id, lang, name), pages (page_id, entity_id, lang) -> page_id, entity_id, name in the page's language, else the first by language."""
    own = names.groupBy("entity_id", "lang").agg(F.min("name").alias("own"))
    first = names.groupBy("entity_id").agg(F.min_by("name", F.struct("lang", "name")).alias("first"))
    return pages.join(own, ["entity_id", "lang"], "left").join(first, "entity_id", "left").select("page_id", "entity_id", F.coalesce("own", "first").alias("name"))


def chunks(blocks: DataFrame, most: int = 80) -> DataFrame:
    """blocks (page_id, ordinal) -> with chunk: a page's blocks in as few equal parts as hold at most so many each."""
    page = Window.partitionBy("page_id")
    n, place = F.count(F.lit(1)).over(page), F.row_number().over(page.orderBy("ordinal")) - 1
    parts = F.ceil(n / most)
    return blocks.withColumn("chunk", F.floor(place * parts / n).cast("long"))


def restored(old: DataFrame, new: DataFrame, keys: Sequence[str], most_lost: float = 0.1) -> DataFrame:
    """new, unless more of old's rows are missing in it than allowed: then an error, and old stands."""
    total, lost = old.count(), old.join(new, list(keys), "left_anti").count()
    if total and lost > most_lost * total:
        raise ValueError(f"{lost} of {total} rows would be lost")
    return new


def latest_records(records: DataFrame) -> DataFrame:
    """records (page_id, run_id, finished_at, status): each page's newest done record."""
    return A.latest(records.filter("status = 'done'"), ["page_id"], ["run_id", "finished_at"])
