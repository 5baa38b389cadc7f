"""Page roles, types and kinds by address, markup and links, as ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..sources.structured import is_own

# Fixed values of the rules.
ARTICLE_TYPES = ("Article", "BlogPosting", "NewsArticle", "TechArticle")
BLOG_TYPES = ("BlogPosting", "NewsArticle")
SUPPORT_TYPES = ("ContactPage", "AboutPage", "ProfilePage", "CollectionPage", "SearchResultsPage", "CheckoutPage")
SUPPORT_SLUGS = (
    "privacy", "privacy-policy", "privacy-notice", "privacy-centre", "privacy-center", "cookie-policy", "cookies", "terms", "terms-of-service", "terms-of-use", "terms-and-conditions", "impressum",
    "impresszum", "adatvedelem", "adatvedelmi-tajekoztato", "adatkezelesi-tajekoztato", "adatkezeles", "jogi-nyilatkozat", "sutik", "suti-tajekoztato", "aszf", "felhasznalasi-feltetelek", "thank-you",
    "thanks", "koszonjuk", "grazie", "404", "et-code-snippet", "et-code-snippet-type",
)
#: Kind -> whole slugs, starts of the first word, starts of any word.
LEGAL = {
    "terms": (("aszf", "altalanos-szerzodesi-feltetelek", "vasarlasi-feltetelek", "felhasznalasi-feltetelek", "jogi-nyilatkozat", "terms", "terms-of-service", "terms-of-use", "terms-and-conditions"), (), ()),
    "privacy": (("privacy", "privacy-policy", "privacy-notice", "privacy-centre", "privacy-center", "cookie-policy", "cookies", "sutik", "suti-tajekoztato", "information/personaldata"), ("adatved", "adatkezel"), ()),
    "withdrawal": (("withdrawal", "returns", "return-policy"), ("elallas",), ()),
    "shipping_payment": (("shipping", "shipping-policy", "delivery", "payment"), ("szallitas", "fizetes"), ("csomagkuld",)),
    "warranty": (("warranty",), ("garancia", "jotallas", "szavatossag"), ()),
    "contact": (("impresszum", "impressum", "imprint", "information/contact"), ("kapcsolat", "contact"), ()),
}
LEGAL_TAILS = ("es", "nyilatkozat", "tajekoztato", "feltetelek", "jog", "szabalyzat", "informaciok", "modok", "fizetes", "fizetesi", "szallitas", "szallitasi", "iranyelvek", "policy", "us")
HELPER_WORDS = ("kifuto", "akcio", "ujdonsag", "outlet", "ajandek")
HELPER_SLUGS = ("sitemap", "oldalterkep", "information/sitemap", "hibabejelentes", "special=1")
BODY_CLASSES = {"not_found_body": "not_found", "category-list-body": "category", "special-list-body": "list", "latest-list-body": "list"}
NOT_FOUND = r"(?i)nem található|not found|\b404\b"


def slugs(url: Column) -> Column:
    """Folder names, query values and key=value pairs in lower case, _ as -, a number at the end gone."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.contains("="))
    values = F.transform(pairs, lambda p: F.regexp_replace(p, "^[^=]*=", ""))
    pieces = F.filter(F.concat(F.split(U.path(url), "/"), values), lambda p: p != "")
    return F.concat(F.transform(pieces, lambda p: F.regexp_replace(F.replace(F.lower(p), F.lit("_"), F.lit("-")), r"-\d+$", "")), F.transform(pairs, F.lower))


def legal_kind(url: Column) -> Column:
    """The kind of legal page that an address names, else null; kinds in their fixed order."""
    found = slugs(url)

    def names(slug: Column, whole, starts, inner) -> Column:
        words = F.split(slug, "-")
        out = slug.isin(*whole)
        if starts:
            out |= F.regexp_like(slug, F.lit(f"^({'|'.join(starts)})")) & F.forall(F.slice(words, 2, 100), lambda w: w.isin(*LEGAL_TAILS))
        if inner:
            out |= F.regexp_like(slug, F.lit(f"(^|-)({'|'.join(inner)})"))
        return out

    test = lambda rule: lambda slug: names(slug, *rule)
    return F.coalesce(*(F.when(F.exists(found, test(rule)), F.lit(kind)) for kind, rule in LEGAL.items()))


def support_address(url: Column) -> Column:
    return F.arrays_overlap(slugs(url), F.array(*map(F.lit, SUPPORT_SLUGS)))


def helper_list(url: Column) -> Column:
    return F.arrays_overlap(slugs(url), F.array(*map(F.lit, HELPER_SLUGS)))


def helper_name(url: Column) -> Column:
    last = F.lower(F.regexp_extract(U.page_url(url), "([^/]+)$", 1))
    return F.regexp_like(last, F.lit(f"(^|[-_])({'|'.join(HELPER_WORDS)})"))


def node_types(nodes: DataFrame) -> DataFrame:
    """nodes (structured.nodes_of) -> page_id, types, own_types: all types of a page, and those of nodes about it."""
    own = is_own(F.col("url"), F.col("id"), F.col("page"))
    return nodes.groupBy("page_id").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set(F.when(own, F.col("type")))).alias("own_types"))


def page_types(pages: DataFrame, types: DataFrame) -> DataFrame:
    """pages (page_id, url, title, h1, body_class), types (node_types) -> page_id, page_type."""
    none = F.array().cast("array<string>")
    rows = pages.join(types, "page_id", "left").withColumns({"types": F.coalesce("types", none), "own_types": F.coalesce("own_types", none)})
    classes = F.split(F.coalesce("body_class", F.lit("")), r"\s+")
    platform = F.coalesce(*(F.when(F.array_contains(classes, c), F.lit(k)) for c, k in BODY_CLASSES.items()))
    has = lambda column, *kinds: F.arrays_overlap(column, F.array(*map(F.lit, kinds)))
    lost = F.regexp_like(F.concat_ws("\n", "title", "h1"), F.lit(NOT_FOUND))
    kind = (
        F.when(lost, "not_found")
        .when(helper_list(F.col("url")), "list")
        .when(platform.isNotNull(), F.when((platform == "category") & helper_name(F.col("url")), "list").otherwise(platform))
        .when(has("own_types", "Product"), "product")
        .when(has("own_types", "Service"), "service")
        .when(has("types", *BLOG_TYPES), "blog")
        .otherwise("other")
    )
    return rows.select("page_id", kind.alias("page_type"))


def own_roles(pages: DataFrame, types: DataFrame, h1_words: int = 4, linkers: int = 2) -> DataFrame:
    """pages (page_id, url, h1, is_home, has_code, nav_groups, service_named), types -> page_id, role, why."""
    none = F.array().cast("array<string>")
    rows = pages.join(types, "page_id", "left").withColumns({"types": F.coalesce("types", none), "own_types": F.coalesce("own_types", none)})
    has = lambda column, *kinds: F.arrays_overlap(column, F.array(*map(F.lit, kinds)))
    rule = lambda role, why: F.struct(F.lit(role).alias("role"), F.lit(why).alias("why"))
    plain_article = has("types", "Article") & ~has("types", *(t for t in ARTICLE_TYPES if t != "Article"))
    got = (
        F.when(F.col("is_home"), rule("support", "home"))
        .when(support_address(F.col("url")), rule("support", "support_url"))
        .when(has("own_types", "Service"), rule("offer", "schema_service"))
        .when(has("own_types", "Product"), rule("product", "schema_product"))
        .when(plain_article & F.col("service_named"), rule("offer", "article_service"))
        .when(has("types", *ARTICLE_TYPES), rule("article", "schema_article"))
        .when(has("types", *SUPPORT_TYPES), rule("support", "schema_support"))
        .when(F.col("has_code") & (F.size(F.split("h1", r"\s+")) <= h1_words) & (F.col("nav_groups") >= linkers), rule("component", "docs_component"))
        .otherwise(rule("support", "no_entity_evidence"))
    )
    return rows.select("page_id", got.alias("r")).select("page_id", "r.*")


ROLE_ORDER = ("offer", "product", "component", "article", "support")


def group_roles(roles: DataFrame, groups: DataFrame) -> DataFrame:
    """roles (page_id, role, why), groups (page_id, group_key) -> page_id, role: a group has its strongest role unless a member is home or a support address."""
    place = F.coalesce(*(F.when(F.col("role") == r, i) for i, r in enumerate(ROLE_ORDER)))
    rows = roles.join(groups, "page_id")
    best = rows.groupBy("group_key").agg(F.min_by("role", place).alias("best"), F.bool_or(F.col("why").isin("home", "support_url")).alias("fixed"))
    return rows.join(best, "group_key").select("page_id", "group_key", F.when(F.col("fixed"), F.col("role")).otherwise(F.col("best")).alias("role"))


def missing_legal_pages(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """pages (site, page_id, url), sites (site) -> site, kind for each kind without a page. Six kinds a site: small."""
    kinds = sites.select("site", F.explode(F.array(*map(F.lit, LEGAL))).alias("kind"))
    have = pages.select("site", legal_kind(F.col("url")).alias("kind")).filter("kind IS NOT NULL").distinct()
    return kinds.join(have, ["site", "kind"], "left_anti")
