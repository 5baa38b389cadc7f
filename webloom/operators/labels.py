"""What names, headings and markup say: expansions of acronyms, headings against main entities, markup against roles, items above items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import url as U
from .pages import ARTICLE_TYPES

# Fixed values of the rules.
ACRONYM = r"[A-Z0-9][A-Z0-9&.+-]{1,5}"
PLAIN_ACRONYM = r"[A-ZÁÉÍÓÖŐÚÜŰ0-9]{2,6}"
WORD = r"\p{L}[\p{L}\p{N}_'’-]*"
INTERNATIONAL = r"(?i)\b(worldwide|international|internationally|globally|global|online|remotely|remote)\b"
THING_TYPES = ("Service", "Product")
THING_ROLES = ("offer", "product", "category")


def expansions(text: Column) -> Column:
    """The two parts of "long (short)" or "short (long)" if one is an acronym, else an empty array."""
    pattern = r"^(.+?)\s*\(([^()]+)\)$"
    part = lambda n: F.trim(F.regexp_extract(F.trim(text), pattern, n))
    short = lambda c: F.regexp_like(c, F.lit(f"^{ACRONYM}$"))
    return F.when(short(part(1)) | short(part(2)), F.array(part(1), part(2))).otherwise(F.array().cast("array<string>"))


def long_form(text: Column) -> Column:
    """The long part of such a text, else null."""
    parts = expansions(text)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(F.regexp_like(first, F.lit(f"^{ACRONYM}$")), second).otherwise(first)


def acronym_meanings(texts: DataFrame) -> DataFrame:
    """texts (text) -> name, form, n: what stands in brackets with an acronym, or before it in brackets, where the words' initials spell it.

    Read once for all acronyms: each place yields its acronym and words, so names join by equality. form is the smallest spelling.
    """
    run = rf"{WORD}(?:[ \u00a0]+{WORD}){{1,5}}"
    before = rf"(?<![\p{{L}}\p{{N}}_'’-])({run})[ \u00a0]*\([ \u00a0]*({PLAIN_ACRONYM})[ \u00a0]*\)"
    after = rf"(?<![\p{{L}}\p{{N}}_])({PLAIN_ACRONYM})[ \u00a0]*\([ \u00a0]*({run})[ \u00a0]*\)"
    both = lambda p, name, words: F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, p, name).alias("name"), F.split(F.regexp_extract(m, p, words), r"[ \u00a0]+").alias("words"), F.lit(words == 1).alias("last")))
    rows = texts.filter("text LIKE '%(%)%'").select(F.explode(F.concat(both(before, 2, 1), both(after, 1, 2))).alias("m")).select("m.*").filter("size(words) >= length(name)")
    # Words before a bracket may belong to the sentence: the last so many count. In brackets all do.
    rows = rows.withColumn("form", F.when(F.col("last"), F.slice("words", -F.length("name"), F.length("name"))).when(F.size("words") == F.length("name"), F.col("words"))).filter("form IS NOT NULL")
    initials = F.upper(F.array_join(F.transform("form", lambda w: F.left(w, F.lit(1))), ""))
    kept = rows.filter(initials == F.upper("name")).withColumn("form", F.array_join("form", " "))
    return kept.groupBy("name", X.alias_key(F.col("form")).alias("key")).agg(F.min("form").alias("form"), F.count(F.lit(1)).alias("n")).drop("key")


def international(text: Column) -> Column:
    """A text says that a site serves the world."""
    return F.coalesce(F.regexp_like(text, F.lit(INTERNATIONAL)), F.lit(False))


def request_key(request: Column) -> Column:
    """A request's address with its parameters' values decoded, in lower case, blanks one; titles as a sorted set."""
    clean = lambda v: F.trim(F.regexp_replace(F.lower(F.coalesce(F.try_url_decode(v), v)), r"\s+", " "))
    value = lambda p: clean(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit("")))
    name = lambda p: F.regexp_replace(p, "=.*$", "")
    titles = lambda p: F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(value(p), r"\|"), lambda t: F.trim(t)))), "|")
    query = F.regexp_extract(request, r"\?(.*)$", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.concat(name(p), F.lit("="), F.url_encode(F.when(name(p) == "titles", titles(p)).otherwise(value(p)))))
    return F.concat(F.regexp_replace(request, r"\?.*$", ""), F.lit("?"), F.array_join(pairs, "&"))


def markup_contradictions(pages: DataFrame) -> DataFrame:
    """pages (page_id, role, types) -> page_id, says, types: roles of things marked up as articles alone, articles marked up as things alone."""
    pick = lambda kinds: F.array_sort(F.array_intersect("types", F.array(*map(F.lit, kinds))))
    rows = pages.select("page_id", "role", pick(ARTICLE_TYPES).alias("article"), pick(THING_TYPES).alias("thing"))
    says = F.when(F.col("role").isin(*THING_ROLES) & (F.size("article") > 0) & (F.size("thing") == 0), "article").when((F.col("role") == "article") & (F.size("thing") > 0) & (F.size("article") == 0), "thing")
    return rows.withColumn("says", says).filter("says IS NOT NULL").select("page_id", "says", F.array_join(F.when(F.col("says") == "article", F.col("article")).otherwise(F.col("thing")), ", ").alias("types"))


def heading_relations(headings: DataFrame, mains: DataFrame, relations: DataFrame) -> DataFrame:
    """headings (page_id, ordinal, entity_id), mains (page_id, entity_id, role), relations (from_id, to_id) -> page_id, ordinal, entity_id, relation.

    no_main, main, related (a relation either way, or a common target) or unrelated. A heading meets the targets of its own
    entity alone: pairs of all entities under a target aren't made.
    """
    main = mains.filter("role = 'main'").select("page_id", F.col("entity_id").alias("main_id"))
    rows = headings.select("page_id", "ordinal", "entity_id").join(main, "page_id", "left")
    pairs = rows.filter("main_id <> entity_id").select("entity_id", "main_id").distinct()
    up = relations.select("from_id", "to_id").distinct()
    either = up.union(up.select("to_id", "from_id")).toDF("entity_id", "main_id")
    shared = pairs.join(up.toDF("entity_id", "target"), "entity_id").join(up.toDF("main_id", "target"), ["main_id", "target"], "left_semi").select("entity_id", "main_id")
    near = pairs.join(either, ["entity_id", "main_id"], "left_semi").unionByName(shared).distinct().withColumn("near", F.lit(True))
    kind = F.when(F.col("main_id").isNull(), "no_main").when(F.col("main_id") == F.col("entity_id"), "main").when(F.col("near"), "related").otherwise("unrelated")
    return rows.join(near, ["entity_id", "main_id"], "left").select("page_id", "ordinal", "entity_id", kind.alias("relation"))


def steps_retyped(entities: DataFrame) -> DataFrame:
    """entities (type, subtype, tier, source, ...): services that only a model named and that have no tier are steps of a method."""
    hit = (F.col("type") == "service") & (F.col("source") == "llm") & F.col("tier").isNull()
    now = {"type": "concept", "subtype": "method", "tier": "step"}
    was = F.when(hit, F.col("type"))
    return entities.withColumns({"type_changed_from": was, **{c: F.when(hit, v).otherwise(F.col(c)) for c, v in now.items()}})


def items_above(items: DataFrame) -> DataFrame:
    """items (level, url) -> level, url, above: the item of the same level at the longest folder above, same host, the root aside; by equality with each folder."""
    folder = lambda u: F.regexp_replace(U.path(u), "/+$", "")
    rows = items.select("level", "url").distinct().withColumn("h", U.host(F.col("url")))
    stands = rows.select("level", "h", folder(F.col("url")).alias("folder"), F.col("url").alias("above")).filter("folder <> ''")
    below = rows.select("level", "h", "url", F.explode(U.folders(U.page_url(F.col("url")))).alias("folder"))
    best = below.join(stands, ["level", "h", "folder"]).groupBy("level", "url").agg(F.max(F.struct(F.length("folder"), "above")).alias("m"))
    return rows.select("level", "url").join(best, ["level", "url"], "left").select("level", "url", "m.above")


def structured_in_order(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """blocks (page_id, ordinal, type, json) of JSON-LD, then items (page_id, ordinal, syntax, type, json) of other markup: one list for each page, places from 0."""
    both = blocks.select("page_id", F.lit("jsonld").alias("syntax"), "type", "json", F.lit(0).alias("source"), "ordinal").unionByName(items.select("page_id", "syntax", "type", "json", F.lit(1).alias("source"), "ordinal"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("source", "ordinal", "syntax", "type", "json")) - 1
    return both.select("page_id", place.cast("long").alias("place"), "syntax", "type", "json")


def link_rows(links: DataFrame, inferred: DataFrame) -> DataFrame:
    """links (from_page_id, ordinal, to_url, to_page_id), inferred (the same rows with more targets) -> with resolution: stored, inferred or none."""
    more = inferred.select("from_page_id", "ordinal", F.col("to_page_id").alias("found")).distinct()
    how = F.when(F.col("to_page_id").isNotNull(), "stored").when(F.col("found").isNotNull(), "inferred").otherwise("none")
    return links.join(more, ["from_page_id", "ordinal"], "left").select("from_page_id", "ordinal", "to_url", F.coalesce("to_page_id", "found").alias("to_page_id"), how.alias("resolution"))


def aligned_headings(pairs: DataFrame, headings: DataFrame) -> DataFrame:
    """pairs (left_id, right_id) of pages, headings (page_id, block_id, ordinal, level) -> left_id, right_id, left_block, right_block.

    A section is a heading of level 2 with those of level 3 below it. From the front, then from the back, sections are
    paired as long as they have as many headings below; theirs are paired in order. Pages without sections have none.
    """
    page = Window.partitionBy("page_id").orderBy("ordinal")
    rows = headings.filter("level IN (2, 3)").withColumn("section", F.last(F.when(F.col("level") == 2, F.col("ordinal")), ignorenulls=True).over(page)).filter("section IS NOT NULL")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "block_id"))), lambda b: b["block_id"])
    parts = rows.groupBy("page_id", "section").agg(blocks.alias("blocks")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("section", "blocks"))).alias("parts"))
    parts = parts.select("page_id", F.transform("parts", lambda p: p["blocks"]).alias("parts"))  # the first block of each is its level 2
    both = pairs.join(parts.toDF("left_id", "l"), "left_id").join(parts.toDF("right_id", "r"), "right_id")

    def alike(a: Column, b: Column, most: Column) -> Column:
        same = F.zip_with(F.transform(a, F.size), F.transform(b, F.size), lambda x, y: F.coalesce(x == y, F.lit(False)))
        end = F.array_position(same, F.lit(False)).cast("int")
        return F.least(most, F.when(end > 0, end - 1).otherwise(F.size(same)))

    short = F.least(F.size("l"), F.size("r"))
    both = both.withColumn("front", alike(F.col("l"), F.col("r"), short)).withColumn("back", alike(F.reverse("l"), F.reverse("r"), short - F.col("front")))
    ends = lambda c: F.concat(F.slice(c, F.lit(1), F.col("front")), F.reverse(F.slice(F.reverse(c), F.lit(1), F.col("back"))))
    found = F.arrays_zip(F.flatten(ends("l")).alias("left_block"), F.flatten(ends("r")).alias("right_block"))
    return both.select("left_id", "right_id", F.inline(found))
