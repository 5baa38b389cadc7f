"""Findings: each a query over pages, headings, links and main entities, with type, severity, page and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import url as U
from . import analytics as A

TYPES = (
    "h1_title_mismatch", "cannibalization", "shared_topic", "missing_page", "uncovered_topic", "unclear_topic", "missing_h1", "h1_outside_content", "multiple_h1", "empty_section", "skipped_level",
    "missing_h2", "paragraph_heading", "canonical_issue", "legal_page", "soft_404", "schema_id_names", "title_without_main_entity", "article_markup_on_other_pages", "breadcrumb_foreign_home",
    "menu_home_target", "menu_broken_target", "orphan_pages", "breadcrumb_ignores_menu", "link_not_final_url", "robots_blocked_link", "robots_bot_blocked", "template_placeholder",
)
SEVERITIES = ("high", "medium", "low")


def finding(df: DataFrame, kind: str, severity: str | Column, page: Column | None, entity: Column | None, evidence: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    none = F.lit(None).cast("long")
    return df.select(F.lit(kind).alias("type"), severity.alias("severity"), (none if page is None else page).cast("long").alias("page_id"), (none if entity is None else entity).cast("long").alias("entity_id"), evidence.alias("evidence"))


def heading_findings(pages: DataFrame, sections: DataFrame, headings: DataFrame) -> DataFrame:
    """pages (page_id, words), sections (as analytics.sections), headings (page_id, level, text, ordinal)."""
    by = headings.groupBy("page_id").agg(F.count_if(F.col("level") == 1).alias("h1"), F.count_if(F.col("level") == 2).alias("h2"))
    rows = pages.join(by, "page_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("h1", "h2")})
    named = sections.join(headings.select("page_id", "ordinal", "text"), ["page_id", "ordinal"], "left")
    long = F.size(F.split("text", r"\s+")) > 12
    parts = [
        finding(rows.filter("h1 = 0"), "missing_h1", "high", F.col("page_id"), None, F.lit("")),
        finding(rows.filter("h1 > 1"), "multiple_h1", "low", F.col("page_id"), None, F.col("h1").cast("string")),
        finding(rows.filter("h2 = 0 AND words > 600"), "missing_h2", "low", F.col("page_id"), None, F.col("words").cast("string")),
        finding(named.filter("skipped"), "skipped_level", "low", F.col("page_id"), None, F.col("text")),
        finding(named.filter(F.col("empty") & ~long), "empty_section", "low", F.col("page_id"), None, F.col("text")),
        finding(named.filter(F.col("empty") & long), "paragraph_heading", "low", F.col("page_id"), None, F.col("text")),
    ]
    return reduce(DataFrame.unionByName, parts)


def cannibalization(mains: DataFrame, pages: DataFrame, least: float = 0.6) -> DataFrame:
    """mains (page_id, entity_id, confidence, role), pages (page_id, lang, url, title): strong main entities of several pages of a language; similar titles cannibalize, others share a topic."""
    strong = mains.filter("role = 'main' AND confidence = 'strong'").join(pages, "page_id").filter(~U.is_pagination(F.col("url")))
    groups = strong.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("entity_id", "lang"))).filter("many > 1").withColumn("tokens", X.tokens(F.col("title")))
    pairs = A.similar_pairs(groups.select("page_id", "entity_id", "lang", "tokens"), ["entity_id", "lang"], "tokens", least)
    in_pair = pairs.select(F.explode(F.array("a", "b")).alias("page_id")).distinct().withColumn("similar", F.lit(True))
    each = groups.join(in_pair, "page_id", "left").groupBy("entity_id", "lang").agg(F.count_if("similar").alias("similar"), F.count(F.lit(1)).alias("many"))
    kind = F.when(F.col("similar") > 0, "cannibalization").otherwise("shared_topic")
    severity = F.when(F.col("similar") >= 3, "high").when(F.col("similar") > 0, "medium").otherwise("low")
    out = finding(each.withColumn("kind", kind), "", severity, None, F.col("entity_id"), F.concat_ws(":", "lang", "many", "kind"))
    return out.withColumn("type", F.element_at(F.split("evidence", ":"), -1)).withColumn("evidence", F.regexp_replace("evidence", ":[^:]*$", ""))


def unclear_topic(pages: DataFrame, mains: DataFrame) -> DataFrame:
    """Pages without a main entity (high) or with a weak one (medium)."""
    main = mains.filter("role = 'main'").select("page_id", "confidence", "entity_id")
    rows = pages.select("page_id").join(main, "page_id", "left").filter("confidence IS NULL OR confidence = 'weak'")
    return finding(rows, "unclear_topic", F.when(F.col("confidence").isNull(), "high").otherwise("medium"), F.col("page_id"), F.col("entity_id"), F.coalesce("confidence", F.lit("none")))


def canonical_issues(targets: DataFrame) -> DataFrame:
    return finding(targets.filter("issue = 'loop'"), "canonical_issue", "medium", F.col("page_id"), None, F.col("issue"))


def orphan_pages(pages: DataFrame, depths: DataFrame, key_role: Column) -> DataFrame:
    """Pages no click reaches; medium for key roles."""
    rows = pages.join(depths.select(F.col("node").alias("page_id"), "depth"), "page_id", "left").filter("depth IS NULL")
    return finding(rows, "orphan_pages", F.when(key_role, "medium").otherwise("low"), F.col("page_id"), None, F.lit("unreachable"))


def link_forms(links: DataFrame, broken: Column, many: int = 10) -> DataFrame:
    """links (from_page_id, to_page_id, raw_url, stored_url, position) whose address isn't the stored one, by target; broken: high, menu or many sources: medium."""
    rows = links.withColumn("differences", U.form_differences(F.col("raw_url"), F.col("stored_url"))).withColumn("broken", broken).filter(F.col("broken") | (F.size("differences") > 0))
    each = rows.groupBy("to_page_id").agg(F.bool_or("broken").alias("broken"), F.bool_or(F.col("position") == "nav").alias("menu"), F.countDistinct("from_page_id").alias("sources"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("differences")))), ",").alias("how"))
    severity = F.when(F.col("broken"), "high").when(F.col("menu") | (F.col("sources") >= many), "medium").otherwise("low")
    return finding(each, "link_not_final_url", severity, F.col("to_page_id"), None, F.concat_ws(":", "how", "sources"))


def title_mismatch(pages: DataFrame) -> DataFrame:
    """pages (page_id, title, h1, entity_id, name): a main entity's name that the title lacks (high) or the h1 (medium)."""
    key = X.alias_key(F.col("name"))
    rows = pages.withColumns({"in_title": X.occurs(key, X.alias_key(F.col("title"))), "in_h1": X.occurs(key, X.alias_key(F.col("h1")))})
    missing = F.array_join(F.array_compact(F.array(F.when(~F.col("in_title"), "title"), F.when(~F.col("in_h1"), "h1"))), ",")
    return finding(rows.filter("NOT in_title OR NOT in_h1"), "h1_title_mismatch", F.when(~F.col("in_title"), "high").otherwise("medium"), F.col("page_id"), F.col("entity_id"), missing)


def placeholders(pages: DataFrame) -> DataFrame:
    """pages (page_id, title, h1, text, noindex): slots and filler text; medium in title or h1 of an indexable page."""
    said = {c: X.text_slots(F.coalesce(c, F.lit("")), short=c != "text") for c in ("title", "h1", "text")}
    rows = pages.withColumns(said)
    hit = lambda c: (F.size(f"{c}.brackets") > 0) | F.col(f"{c}.lorem") | F.col(f"{c}.cms_default") | F.col(f"{c}.slot")
    severity = F.when((hit("title") | hit("h1")) & ~F.coalesce("noindex", F.lit(False)), "medium").otherwise("low")
    return finding(rows.filter(hit("title") | hit("h1") | hit("text")), "template_placeholder", severity, F.col("page_id"), None, F.array_join(F.concat("title.brackets", "h1.brackets", "text.brackets"), ","))


def uncovered_topics(weights: DataFrame, names: DataFrame, groups: int = 3, often: int = 10) -> DataFrame:
    """weights (as graph.entity_weights) of which the top tenth have no main page though several pages name them."""
    top = A.top_share(weights, [F.desc("weight"), F.asc("entity_id")], 0.1)
    rows = top.filter((F.col("main_pages") == 0) & (F.col("pages") >= groups)).join(names, "entity_id")
    return finding(rows, "uncovered_topic", F.when(F.col("pages") >= often, "medium").otherwise("low"), None, F.col("entity_id"), F.col("name"))


def missing_pages(weights: DataFrame, families: DataFrame, often: int = 10) -> DataFrame:
    """families (entity_id, name) of the top tenth without a main page of their own: high if many pages name them."""
    top = A.top_share(weights, [F.desc("weight"), F.asc("entity_id")], 0.1)
    rows = top.filter((F.col("main_pages") == 0) & (F.col("pages") >= 3)).join(families, "entity_id")
    return finding(rows, "missing_page", F.when(F.col("pages") >= often, "high").otherwise("medium"), None, F.col("entity_id"), F.col("name"))


def h1_outside_content(blocks: DataFrame) -> DataFrame:
    """blocks (page_id, level, region, text): pages whose h1 all stand in the page's frame."""
    heads = blocks.filter("level = 1").groupBy("page_id").agg(F.bool_and(F.col("region") == "chrome").alias("outside"), F.min("text").alias("text"))
    return finding(heads.filter("outside"), "h1_outside_content", "medium", F.col("page_id"), None, F.col("text"))


def legal_pages(missing: DataFrame, linked: DataFrame, partial: bool = False) -> DataFrame:
    """missing (site, kind) and linked (page_id, kind, in_footer): a kind without a page, medium, low after a partial crawl; one the footer doesn't link, low."""
    none = F.lit(None).cast("long")
    gone = finding(missing, "legal_page", "low" if partial else "medium", none, None, F.concat_ws(":", F.lit("missing"), "site", "kind"))
    hidden = finding(linked.filter(~F.col("in_footer")), "legal_page", "low", F.col("page_id"), None, F.concat_ws(":", F.lit("not in footer"), "kind"))
    return gone.unionByName(hidden)


def soft_404(types: DataFrame) -> DataFrame:
    return finding(types.filter("page_type = 'not_found'"), "soft_404", "medium", F.col("page_id"), None, F.lit("not_found"))


def schema_id_names(ids: DataFrame) -> DataFrame:
    """ids (id, names): one node id with several names."""
    return finding(ids, "schema_id_names", "low", None, None, F.concat_ws(" | ", "id", "names"))


def title_without_main_entity(pages: DataFrame) -> DataFrame:
    """pages (page_id, title, text, entity_id, name): a main entity that the visible text names and the title doesn't, or neither does."""
    key = X.alias_key(F.col("name"))
    rows = pages.withColumns({"in_title": X.occurs(key, X.alias_key(F.col("title"))), "in_text": X.occurs(key, X.alias_key(F.col("text")))})
    case = F.when(F.col("title").isNull() | (F.col("title") == ""), "no title").when(F.col("in_text"), "visible only").otherwise("nowhere")
    return finding(rows.filter("in_title IS NULL OR NOT in_title"), "title_without_main_entity", "low", F.col("page_id"), F.col("entity_id"), case)


def article_markup(pages: DataFrame, share: float = 0.6) -> DataFrame:
    """pages (site, page_id, role, has_article): where most of a site's pages carry article markup, those that are no articles."""
    marked = F.avg(F.col("has_article").cast("double")).over(Window.partitionBy("site"))
    rows = pages.withColumn("share", marked).filter((F.col("share") >= share) & F.col("has_article") & (F.col("role") != "article"))
    return finding(rows, "article_markup_on_other_pages", "medium", F.col("page_id"), None, F.round("share", 4).cast("string"))


def breadcrumb_foreign_home(crumbs: DataFrame, homes: DataFrame) -> DataFrame:
    """crumbs (page_id, lang, first_url), homes (lang, url): a trail that starts at another language's home."""
    key = lambda c: U.page_url(F.col(c))
    other = homes.select(F.col("lang").alias("home_lang"), key("url").alias("k"))
    rows = crumbs.withColumn("k", key("first_url")).join(other, "k").filter("home_lang <> lang")
    own = homes.select("lang", key("url").alias("k"))
    return finding(rows.join(own, ["lang", "k"], "left_anti"), "breadcrumb_foreign_home", "low", F.col("page_id"), None, F.col("first_url"))


def menu_targets(items: DataFrame, pages: DataFrame, homes: DataFrame) -> DataFrame:
    """items (lang, area, anchor, url), pages (url, status, final_url), homes (lang, url): menu items called home that lead elsewhere, and items whose target fails or redirects."""
    called = F.lower(F.trim("anchor")).isin("home", "homepage", "start", "startseite", "accueil", "inicio", "főoldal", "kezdőlap")
    own = homes.select("lang", U.page_url(F.col("url")).alias("home"))
    lost = items.filter((F.col("area") == "header") & called).join(own, "lang").filter(U.page_url(F.col("url")) != F.col("home"))
    state = pages.select(U.page_url(F.col("url")).alias("k"), "status", "final_url")
    broken = items.withColumn("k", U.page_url(F.col("url"))).join(state, "k").filter((F.col("status") >= 400) | (U.page_url(F.col("final_url")) != F.col("k")))
    a = finding(lost, "menu_home_target", "medium", None, None, F.concat_ws(" ", "lang", "url"))
    b = finding(broken, "menu_broken_target", "medium", None, None, F.concat_ws(" ", "lang", "url", F.col("status").cast("string")))
    return a.unionByName(b)


def breadcrumb_ignores_menu(items: DataFrame, crumbs: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """items (key, parent) of submenus, crumbs (page_id, key, steps: keys of the trail): a parent that most of its items' trails leave out."""
    rows = items.filter("parent IS NOT NULL").join(crumbs, "key").groupBy("parent").agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.array_contains("steps", F.col("parent"))).alias("without"))
    hit = rows.filter((F.col("without") >= least) & (F.col("without") >= share * F.col("all")))
    return finding(hit, "breadcrumb_ignores_menu", "low", None, None, F.concat_ws(":", "parent", "without", "all"))


# Fixed values of the rules: words of folders and parameters (those with _ at the end: starts) that sites block on purpose.
INTENDED = {
    "cart": (("cart", "kosar", "checkout", "penztar", "basket"), ()),
    "account": (("account", "login", "logout", "register", "regisztracio", "fiok", "belepes", "wishlist", "kivansaglista", "signin", "signup"), ()),
    "search": (("search", "kereses", "kereso"), ("s", "q", "search", "keres", "kereses")),
    "filter": (("filter", "szuro", "page"), ("sort", "order", "orderby", "limit", "page", "paged", "filter", "szuro", "filter_", "sort_")),
    "admin": (("admin", "wp-login", "wp-json", "cgi-bin", "ajax", "api", "xmlrpc", "feed"), ()),
}
SEARCH_BOTS = ("googlebot", "bingbot")


def intended_block(url: Column) -> Column:
    """What a site means to keep robots from by an address: a folder (its ending aside) or a part of one between - and _, or a parameter's name; else null."""
    names = F.transform(F.split(F.regexp_extract(F.lower(url), r"\?([^#]*)", 1), "&"), lambda p: F.regexp_replace(p, "=.*$", ""))
    folders = F.transform(F.split(F.lower(U.path(url)), "/"), lambda f: F.regexp_replace(f, r"\.[^.]*$", ""))
    said = F.concat(folders, F.flatten(F.transform(folders, lambda f: F.split(f, "[-_]"))))

    def meant(words, parameters) -> Column:
        out = F.exists(said, lambda w: w.isin(*words))
        if parameters:
            starts = [p for p in parameters if p.endswith("_")]
            out |= F.exists(names, lambda n: reduce(Column.__or__, (n.startswith(p) for p in starts), n.isin(*parameters)))
        return out

    return F.coalesce(*(F.when(meant(*rule), F.lit(kind)) for kind, rule in INTENDED.items()))


def robots_blocked_links(links: DataFrame) -> DataFrame:
    """links (to_page_id, to_url, pattern, allowed, indexable, position) by rule: blocked targets that search results should hold, high; in menus, medium; blocked on purpose, low."""
    meant = intended_block(F.col("to_url")).isNotNull()
    rows = links.filter(~F.col("allowed")).withColumn("meant", meant).groupBy("pattern", "meant").agg(F.bool_or("indexable").alias("indexable"), F.bool_or(F.col("position") == "nav").alias("menu"), F.countDistinct("to_url").alias("targets"))
    severity = F.when(F.col("meant"), "low").when(F.col("indexable"), "high").when(F.col("menu"), "medium").otherwise("low")
    return finding(rows, "robots_blocked_link", severity, None, None, F.concat_ws(":", "pattern", "targets"))


def robots_blocked_bots(rules: DataFrame) -> DataFrame:
    """rules (host, agent, allow, pattern): bots shut out of a whole site; search engines high, others low."""
    shut = rules.groupBy("host", "agent").agg(F.bool_or(~F.col("allow") & (F.col("pattern") == "/")).alias("shut"), F.bool_or(F.col("allow") & (F.col("pattern") == "/")).alias("open")).filter("shut AND NOT open")
    return finding(shut, "robots_bot_blocked", F.when(F.col("agent").isin("*", *SEARCH_BOTS), "high").otherwise("low"), None, None, F.concat_ws(":", "host", "agent"))


def numbered(parts: list[DataFrame]) -> DataFrame:
    """All findings in order of type, severity and what they are about, with ids from 1."""
    place = lambda values, c: F.coalesce(*(F.when(F.col(c) == v, i) for i, v in enumerate(values)))
    rows = reduce(DataFrame.unionByName, parts).withColumns({"t": place(TYPES, "type"), "v": place(SEVERITIES, "severity")})
    return A.identified(rows, "finding_id", [F.asc("t"), F.asc("v"), F.asc_nulls_last("page_id"), F.asc_nulls_last("entity_id"), F.asc("evidence")]).drop("t", "v")
