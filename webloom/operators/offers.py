"""Offers and names: price rows, product attributes, relations by labels and knowledge classes, names of sites, roles of pages."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import url as U

# Fixed values of the rules.
PRICE = r"(?i)\d[\d\s.,–-]*\s*(?:Ft|HUF|€|EUR|\$|USD|£)|(?:€|\$|£)\s*\d"
RATE = r"(?i)óradíj|hourly rate|\brate\s*:|\bdíj\s*:|munkadíj|billed at|/\s*(?:óra|hour)\b"
PRICE_ROWS = 4
NAME_WORDS = 6
NAME_CHARS = 80
NAMING_KINDS = ("heading", "paragraph", "card", "other", "list_item")
UNITS = ("kw", "w", "m3/h", "m³/h")
PHASE_WORDS = ("fázis", "f", "fázisú")
MODEL_CHARS = 6
GENERIC_CLASSES = ("Q35120", "Q151885", "Q1799072", "Q3249551", "Q1914636", "Q11016", "Q2267705")
INSTANCE_TYPES = ("tech", "org", "product", "place", "person")
SAME_TYPE_CLASSES = ("tech", "concept")
EVIDENCE_RANK = {"anchored": 1, "home": 1, "schema_about": 2, "profile": 2, "primary": 3, "group_primary": 3, "h1": 4, "title": 4, "heading": 4, "top_mentions": 5, "inbound_anchor": 6, "url": 6}
CONTACT_WORDS = ("contact", "kapcsolat", "kontakt", "contatti")
PROFILE_WORDS = ("about", "rolam", "rolunk", "author", "szerzo")
PROFILE_TYPES = ("AboutPage", "ProfilePage")
SUPPORT_SCHEMA = {"ContactPage": "contact", "CollectionPage": "list", "SearchResultsPage": "list", "CheckoutPage": "checkout"}
CATEGORY_FOLDERS = ("category", "kategoria")
LIST_SHARE = 0.5
TITLE_PAGES, TITLE_SHARE = 3, 0.25


def name_like(text: Column) -> Column:
    """A short text without digits: 1 to 6 words, at most 80 characters."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return words.between(1, NAME_WORDS) & ~F.regexp_like(text, F.lit(r"\d")) & (F.length(text) <= NAME_CHARS)


def pricing_rows(blocks: DataFrame) -> DataFrame:
    """blocks (page_id, ordinal, kind, text, first_cell) -> page_id, ordinal, name for each price that has a name.

    A table row's price is named by its first cell up to a separator; other prices by the nearest of the four blocks
    before that reads like a name, back to the previous price. Rates by the hour are no prices. Null texts are empty.
    """
    rows = blocks.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"priced": F.regexp_like("text", F.lit(PRICE)), "rate": F.regexp_like("text", F.lit(RATE))})
    before = Window.partitionBy("page_id").orderBy("ordinal").rowsBetween(-PRICE_ROWS, -1)
    rows = rows.withColumn("back", F.reverse(F.collect_list(F.struct("ordinal", "kind", "text", "priced")).over(before))).filter("priced AND NOT rate")
    stop = F.array_position(F.transform("back", lambda b: b["priced"]), True)
    near = F.when(stop > 0, F.slice("back", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("back"))
    best = F.get(F.filter(near, lambda b: b["kind"].isin(*NAMING_KINDS) & name_like(b["text"])), F.lit(0))
    cell = F.trim(F.get(F.split(F.coalesce("first_cell", "text"), r" · | \| ", 2), F.lit(0)))
    table = F.col("kind") == "table_row"
    out = rows.select("page_id", F.when(table, F.col("ordinal")).otherwise(best["ordinal"]).alias("ordinal"), F.when(table, F.when(name_like(cell), cell)).otherwise(F.trim(best["text"])).alias("name"))
    return out.filter("name IS NOT NULL")


def product_attributes(name: Column) -> Column:
    """capacity (number and unit), phase (1 to 3), energy_class and model of a product's name; the first of each, else null."""
    words = F.transform(F.split(F.trim(name), r"\s+"), lambda w: F.regexp_replace(w, r"^[,;:()]+|[,;:()]+$", ""))
    pairs = F.arrays_zip(words.alias("w"), F.concat(F.slice(words, 2, 100_000), F.array(F.lit(""))).alias("n"))
    units, phases, number = "|".join(UNITS), "|".join(PHASE_WORDS), r"\d+(?:[.,]\d+)?"
    like = lambda c, p: F.regexp_like(c, F.lit(f"(?iu)^(?:{p})$"))
    whole = lambda p: like(p["w"], rf"{number}(?:{units})")
    capacity = lambda p: whole(p) | (like(p["w"], number) & F.lower(p["n"]).isin(*UNITS))
    phase = lambda p: like(p["w"], f"[1-3](?:{phases})") | (p["w"].isin("1", "2", "3") & F.lower(p["n"]).isin(*PHASE_WORDS))
    energy = lambda p: F.regexp_like(p["w"], F.lit(r"^A\+{1,4}$"))
    model = lambda p: ~capacity(p) & ~phase(p) & ~energy(p) & (F.length(p["w"]) >= MODEL_CHARS) & F.regexp_like(p["w"], F.lit(r"\d")) & F.regexp_like(p["w"], F.lit("[A-Za-z]"))
    spaced = lambda p: F.when(whole(p), F.regexp_replace(p["w"], rf"^({number})", "$1 ")).otherwise(F.concat(p["w"], F.lit(" "), p["n"]))
    first = lambda test: F.get(F.filter(pairs, test), F.lit(0))
    return F.struct(spaced(first(capacity)).alias("capacity"), F.left(first(lambda p: phase(p) & ~capacity(p))["w"], F.lit(1)).cast("int").alias("phase"), first(energy)["w"].alias("energy_class"), first(model)["w"].alias("model"))


def surface_spans(text: Column, surface: Column) -> Column:
    """Starts and ends of a name in a text, cases aside, any blanks between its words, no letter before or after it."""
    words = F.filter(F.split(surface, r"\s+"), lambda w: w != "")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})"), F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), r"\s+"), F.lit(r"(?!\p{L})"))
    hits, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    total = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    spans = F.transform(hits, lambda h, i: F.struct((total(between, i + 1) + total(hits, i)).alias("start"), (total(between, i + 1) + total(hits, i + 1)).alias("end")))
    return F.when(F.size(words) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def offer_relations(offers: DataFrame, concepts: DataFrame) -> DataFrame:
    """offers (entity_id, names), concepts (concept_id, name) -> from_id, to_id, part: a concept that a label's part names; the first part and the smallest concept of a name."""
    known = concepts.groupBy(X.normal_key(F.col("name")).alias("key")).agg(F.min("concept_id").alias("to_id")).filter("key <> ''")
    parts = offers.select(F.col("entity_id").alias("from_id"), F.explode("names").alias("label")).select("from_id", F.explode(X.label_parts(F.col("label"))).alias("part")).distinct()
    return parts.withColumn("key", X.normal_key(F.col("part"))).join(known, "key").groupBy("from_id", "to_id").agg(F.min("part").alias("part"))


def class_relations(entities: DataFrame, classes: DataFrame) -> DataFrame:
    """entities (entity_id, type, kb_id), classes (kb_id, property, class_id) -> from_id, to_id, property, reason.

    An entity is one of another whose knowledge id is its class. reason: null where the relation holds, else generic_class,
    instance_of_type or other_type. A pair related in several ways has one row, one that holds before others.
    """
    own = entities.filter("kb_id IS NOT NULL").select(F.col("entity_id").alias("from_id"), F.col("type").alias("kind"), "kb_id")
    target = entities.filter("kb_id IS NOT NULL").select(F.col("entity_id").alias("to_id"), F.col("type").alias("target_kind"), F.col("kb_id").alias("class_id"))
    rows = own.join(classes.filter("class_id <> kb_id"), "kb_id").join(target, "class_id").filter("from_id <> to_id")
    reason = (
        F.when(F.col("class_id").isin(*GENERIC_CLASSES), "generic_class")
        .when((F.col("property") == "P31") & ~F.col("kind").isin(*INSTANCE_TYPES), "instance_of_type")
        .when(F.col("kind").isin(*SAME_TYPE_CLASSES) & (F.col("target_kind") != F.col("kind")), "other_type")
    )
    best = F.min(F.struct(reason.isNotNull().alias("rejected"), "property", reason.alias("reason"))).alias("b")
    return rows.groupBy("from_id", "to_id").agg(best).select("from_id", "to_id", "b.property", "b.reason")


def evidence_text(evidence: Column) -> Column:
    """array of (kind, detail) as text, the strongest kind first: places with #, counts with a colon, other kinds by name alone."""
    rank = F.create_map(*(F.lit(x) for kv in EVIDENCE_RANK.items() for x in kv))
    said = lambda e: F.when(e["kind"].isin("primary", "group_primary"), F.concat_ws("#", e["kind"], e["detail"])).when(e["kind"].isin("top_mentions", "inbound_anchor"), F.concat_ws(":", e["kind"], e["detail"])).otherwise(e["kind"])
    rows = F.array_sort(F.transform(evidence, lambda e: F.struct(rank[e["kind"]].alias("rank"), e["kind"].alias("kind"), said(e).alias("text"))))
    return F.array_join(F.transform(rows, lambda r: r["text"]), "; ")


def site_names(pages: DataFrame, least: int = TITLE_PAGES, share: float = TITLE_SHARE) -> DataFrame:
    """pages (site, page_id, title) -> site, name, pages: endings that many of a site's titles share.

    Endings that end an accepted name, or that end with one, are left out. Each title counts once for each of its endings,
    so a site has few candidates (endings of a title / share), which one task takes in order. Sites without titles have none.
    """
    rows = pages.filter("title IS NOT NULL AND trim(title) <> ''").withColumn("title", F.trim("title"))
    ends = rows.select("site", "page_id", F.explode(F.array_distinct(F.concat(F.array("title"), X.title_endings(F.col("title"))))).alias("name"))
    # Counts by spelling first: a key that every page shares is summed from partial counts, no page list is built.
    forms = ends.withColumn("key", X.alias_key(F.col("name"))).filter("key <> ''").dropDuplicates(["site", "page_id", "key"]).groupBy("site", "key", "name").agg(F.count(F.lit(1)).alias("n"))
    keys = forms.groupBy("site", "key").agg(F.sum("n").alias("pages"), F.max_by("name", F.struct("n", "name")).alias("name"))
    total = rows.groupBy("site").agg(F.count(F.lit(1)).alias("titles"))
    some = keys.join(total, "site").filter(F.col("pages") >= F.greatest(F.lit(float(least)), F.lit(share) * F.col("titles")))
    some = some.withColumn("tails", X.alias_keys(F.concat(F.array("name"), X.title_endings(F.col("name")))))

    def accepted(group: pd.DataFrame) -> pd.DataFrame:
        taken: list[int] = []
        known: set[str] = set()
        covered: set[str] = set()
        group = group.assign(long=group["key"].str.len()).sort_values(["pages", "long", "key"], ascending=[False, False, True])
        for place, (key, tails) in enumerate(zip(group["key"], group["tails"], strict=True)):
            if key not in covered and known.isdisjoint(tails):
                taken.append(place)
                known.add(key)
                covered.update(tails)
        return group.iloc[taken][["site", "name", "pages"]]

    return some.select("site", "key", "name", "pages", "tails").groupBy("site").applyInPandas(accepted, "site string, name string, pages bigint")


def has_word(url: Column, stems: Sequence[str]) -> Column:
    """A word of an address's path or query begins with one of these."""
    said = F.regexp_replace(F.lower(F.concat(U.path(url), F.lit("-"), F.regexp_extract(url, r"\?([^#]*)", 1))), r"[/\-_.?=&]+", "-")
    return F.regexp_like(said, F.lit(f"(^|-)({'|'.join(stems)})"))


def node_roles(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, role, page_type, types, is_home, placeholder, legal, has_anchor, list_share) -> page_id, role, support_kind by the first rule that holds."""
    c, types = F.col, F.coalesce("types", F.array().cast("array<string>"))
    plain, own = c("role").isin("support", "article"), c("role")
    schema = F.coalesce(*(F.when(F.array_contains(types, t), F.lit(k)) for t, k in SUPPORT_SCHEMA.items()))
    profile = F.arrays_overlap(types, F.array(*map(F.lit, PROFILE_TYPES))) | has_word(c("url"), PROFILE_WORDS)
    listing = plain & F.arrays_overlap(F.split(F.lower(U.path(c("url"))), "/"), F.array(*map(F.lit, CATEGORY_FOLDERS)))
    rules = [
        (c("is_home"), F.lit("home"), None),
        (c("placeholder"), own, "placeholder"),
        (c("legal"), F.lit("support"), "legal"),
        (plain & has_word(c("url"), CONTACT_WORDS), F.lit("support"), "contact"),
        (c("page_type") == "list", F.lit("listing"), "list"),
        (c("page_type") == "not_found", own, "placeholder"),
        (listing, F.lit("listing"), "list"),
        ((c("role") == "support") & profile, F.lit("profile"), None),
        (schema.isNotNull(), own, schema),
        (c("page_type") == "brand_category", F.lit("listing"), "list"),
        ((c("page_type") == "category") & c("has_anchor"), F.lit("category"), None),
        (c("page_type") == "category", F.lit("listing"), "list"),
        (plain & (c("list_share") > LIST_SHARE), F.lit("listing"), "list"),
    ]
    got = F.coalesce(*(F.when(test, F.struct(role.alias("role"), (kind if isinstance(kind, Column) else F.lit(kind)).cast("string").alias("support_kind"))) for test, role, kind in rules), F.struct(own.alias("role"), F.lit(None).cast("string").alias("support_kind")))
    return pages.select("page_id", got.alias("r")).select("page_id", "r.*")


def verified(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items (page_id, name, type, ...) without those that the latest decision (page_id, name, type, run_id, keep) on them drops; items without an answer stay."""
    last = decisions.groupBy("page_id", "name", "type").agg(F.max_by("keep", "run_id").alias("keep")).filter("NOT keep")
    return items.join(last.drop("keep"), ["page_id", "name", "type"], "left_anti")


def filler_share(text: Column) -> Column:
    """Share of filler words among the words of three letters or more; 0 without words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)
    hits = F.filter(words, lambda w: w.isin(*X.FILLER, *X.WEAK_FILLER))
    return F.when(F.size(words) > 0, F.size(hits) / F.size(words)).otherwise(0.0)


def filler_pages(blocks: DataFrame, least: int = 20, share: float = 0.5) -> DataFrame:
    """blocks (page_id, kind, region, text) -> page_id whose content, the title aside, is so many words and mostly filler."""
    n = F.size(F.filter(F.split("text", r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    rows = blocks.filter("region = 'content' AND kind <> 'title' AND text IS NOT NULL").select("page_id", n.alias("n"), (filler_share(F.col("text")) * n).alias("hits"))
    return rows.groupBy("page_id").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).filter((F.col("n") >= least) & (F.round("hits") >= share * F.col("n"))).select("page_id")
