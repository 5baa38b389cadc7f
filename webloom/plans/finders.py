"""Queries of the finding operators over the star-schema tables: parts and orders are pages, nations sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as D
from ..operators import links as L
from ..operators import pages as P
from ..sources import html as H
from .projections import query, table

NONE = "NULL::BIGINT"


def parts(s, d):
    c = F.col
    return table(s, d, "part").select(c("p_partkey").alias("page_id"), c("p_name").alias("name"), c("p_type").alias("lang"), c("p_size").alias("size"), c("p_retailprice").alias("price"))


def choose(*cases, default=None):
    out = F
    for test, value in cases:
        out = out.when(F.expr(test), value)
    return out if default is None else out.otherwise(default)


#: A part's title lacks the name of every fifth, its h1 that of every fifth after; every eleventh has no title.
NAMED = """r AS (SELECT p_partkey AS page_id, p_size AS entity_id, p_size % 5 = 0 AS t, p_size % 5 = 1 OR p_size % 10 = 0 AS h, p_size % 11 = 0 AS bare FROM part)"""


def named_pages(s, d):
    other = F.lit("something else")
    title = choose(("size % 11 = 0", F.lit("")), ("size % 5 = 0", other), default=F.concat(F.lit("The "), F.initcap("name"), F.lit("s | Shop")))
    h1 = choose(("size % 5 = 1 OR size % 10 = 0", other), default=F.upper("name"))
    return parts(s, d).select("page_id", F.col("size").alias("entity_id"), "name", title.alias("title"), h1.alias("h1"), F.concat_ws(" ", F.lit("about"), h1).alias("text"))


@query("h1_title_mismatch", f"WITH {NAMED} SELECT 'h1_title_mismatch' AS type, CASE WHEN t OR bare THEN 'high' ELSE 'medium' END AS severity, page_id, entity_id, array_to_string(list_filter([CASE WHEN t OR bare THEN 'title' END, CASE WHEN h THEN 'h1' END], lambda x: x IS NOT NULL), ',') AS evidence FROM r WHERE t OR bare OR h")
def _(s, d):
    return D.title_mismatch(named_pages(s, d))


@query("title_without_main_entity", f"WITH {NAMED} SELECT 'title_without_main_entity' AS type, 'low' AS severity, page_id, entity_id, CASE WHEN bare THEN 'no title' WHEN NOT h THEN 'visible only' ELSE 'nowhere' END AS evidence FROM r WHERE t OR bare")
def _(s, d):
    return D.title_without_main_entity(named_pages(s, d))


@query(
    "cannibalization",
    f"""WITH p AS (SELECT p_size AS e, p_type AS lang, count(*) OVER (PARTITION BY p_size, p_type, p_name) AS same FROM part), g AS (SELECT e, lang, count(*) FILTER (WHERE same > 1) AS alike, count(*) AS many FROM p GROUP BY ALL HAVING count(*) > 1)
    SELECT CASE WHEN alike > 0 THEN 'cannibalization' ELSE 'shared_topic' END AS type, CASE WHEN alike >= 3 THEN 'high' WHEN alike > 0 THEN 'medium' ELSE 'low' END AS severity, {NONE} AS page_id, e AS entity_id, lang || ':' || many AS evidence FROM g""",
)
def _(s, d):
    rows = parts(s, d)
    mains = rows.select("page_id", F.col("size").alias("entity_id"), F.lit("strong").alias("confidence"), F.lit("main").alias("role"))
    return D.cannibalization(mains, rows.select("page_id", "lang", F.concat(F.lit("https://s.example/p/"), F.col("page_id").cast("string")).alias("url"), F.col("name").alias("title")))


#: Parts as entities: dear ones weigh most, a quarter has no main page, size says how many pages name them.
TOP = "t AS (SELECT *, p_size % 4 AS mains FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT (SELECT ceil(count(*) * 0.1)::BIGINT FROM part))"


def heavy(s, d):
    return parts(s, d).select(F.col("page_id").alias("entity_id"), F.col("price").alias("weight"), (F.col("size") % 4).alias("main_pages"), F.col("size").alias("pages"))


@query("missing_pages", f"WITH {TOP} SELECT 'missing_page' AS type, CASE WHEN p_size >= 10 THEN 'high' ELSE 'medium' END AS severity, {NONE} AS page_id, p_partkey AS entity_id, p_name AS evidence FROM t WHERE mains = 0 AND p_size >= 3 AND p_type <> 'SMALL'")
def _(s, d):
    return D.missing_pages(heavy(s, d), parts(s, d).filter("lang <> 'SMALL'").select(F.col("page_id").alias("entity_id"), "name"))


@query("uncovered_parts", f"WITH {TOP} SELECT 'uncovered_topic' AS type, CASE WHEN p_size >= 10 THEN 'medium' ELSE 'low' END AS severity, {NONE} AS page_id, p_partkey AS entity_id, p_name AS evidence FROM t WHERE mains = 0 AND p_size >= 3")
def _(s, d):
    return D.uncovered_topics(heavy(s, d), parts(s, d).select(F.col("page_id").alias("entity_id"), "name"))


@query("h1_outside_content", f"SELECT 'h1_outside_content' AS type, 'medium' AS severity, l_orderkey AS page_id, {NONE} AS entity_id, min(l_partkey::VARCHAR) AS evidence FROM lineitem WHERE l_quantity < 20 GROUP BY l_orderkey HAVING bool_and(l_linestatus = 'O')")
def _(s, d):
    c = F.col
    return D.h1_outside_content(table(s, d, "lineitem").select(c("l_orderkey").alias("page_id"), F.when(c("l_quantity") < 20, 1).otherwise(2).alias("level"), F.when(c("l_linestatus") == "O", "chrome").otherwise("content").alias("region"), c("l_partkey").cast("string").alias("text")))


#: A nation's site: its customers' segments say which legal page a customer's row is.
SLUG = {"AUTOMOBILE": "terms-of-use", "BUILDING": "Privacy_Policy", "FURNITURE": "szallitas-es-fizetes", "HOUSEHOLD": "about-us", "MACHINERY": "contact-us"}
KIND = {"AUTOMOBILE": "terms", "BUILDING": "privacy", "FURNITURE": "shipping_payment", "MACHINERY": "contact"}
KINDS = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND.items()) + " END"


def legal_rows(s, d):
    slug = F.create_map(*(F.lit(x) for kv in SLUG.items() for x in kv))[F.col("c_mktsegment")]
    rows = table(s, d, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("site"), slug.alias("slug"))
    return rows.withColumn("url", F.concat(F.lit("https://"), "site", F.lit(".example/"), "slug"))


@query(
    "legal_pages",
    f"""WITH p AS (SELECT c_custkey AS page_id, 'n' || c_nationkey AS site, {KINDS} AS kind FROM customer WHERE c_acctbal > 9000), k AS (SELECT DISTINCT 'n' || c_nationkey AS site, unnest(['terms', 'privacy', 'withdrawal', 'shipping_payment', 'warranty', 'contact']) AS kind FROM customer)
    SELECT 'legal_page' AS type, 'medium' AS severity, {NONE} AS page_id, {NONE} AS entity_id, 'missing:' || site || ':' || kind AS evidence FROM k ANTI JOIN p USING (site, kind) UNION ALL SELECT 'legal_page', 'low', page_id, NULL, 'not in footer:' || kind FROM p WHERE kind IS NOT NULL AND page_id % 3 = 0""",
)
def _(s, d):
    rows = legal_rows(s, d)
    sites = table(s, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("site")).distinct()
    linked = rows.select("page_id", P.legal_kind(F.col("url")).alias("kind"), (F.col("page_id") % 3 != 0).alias("in_footer")).filter("kind IS NOT NULL")
    return D.legal_pages(P.missing_legal_pages(rows, sites), linked)


def typed_pages(s, d):
    """Parts as pages of every kind that the rules tell."""
    title = choose(("size % 13 = 0", F.lit("404 - Page not found")), default=F.col("name"))
    url = F.concat(F.lit("https://s.example/"), choose(("size % 11 = 0", F.lit("sitemap")), ("size % 7 = 0", F.lit("c/outlet-bags")), default=F.lit("p/x")))
    body = choose(("size % 7 IN (0, 1)", F.lit("wide category-list-body")), ("size % 7 = 2", F.lit("latest-list-body")), default=F.lit("plain"))
    pages = parts(s, d).select("page_id", url.alias("url"), title.alias("title"), F.col("name").alias("h1"), body.alias("body_class"))
    kind = choose(("size % 7 = 3", F.lit("Product")), ("size % 7 = 4", F.lit("Service")), ("size % 7 = 5", F.lit("BlogPosting")))
    kinds = parts(s, d).select("page_id", F.array(kind).alias("types")).filter("types[0] IS NOT NULL")
    return P.page_types(pages, kinds.withColumn("own_types", F.col("types")))


TYPED = """y AS (SELECT p_partkey AS page_id, CASE WHEN p_size % 13 = 0 THEN 'not_found' WHEN p_size % 11 = 0 OR p_size % 7 IN (0, 2) THEN 'list' WHEN p_size % 7 = 1 THEN 'category' WHEN p_size % 7 = 3 THEN 'product' WHEN p_size % 7 = 4 THEN 'service' WHEN p_size % 7 = 5 THEN 'blog' ELSE 'other' END AS page_type FROM part)"""


@query("page_types_by_rule", f"WITH {TYPED} SELECT * FROM y")
def _(s, d):
    return typed_pages(s, d)


@query("soft_404", f"WITH {TYPED} SELECT 'soft_404' AS type, 'medium' AS severity, page_id, {NONE} AS entity_id, 'not_found' AS evidence FROM y WHERE page_type = 'not_found'")
def _(s, d):
    return D.soft_404(typed_pages(s, d))


@query("schema_id_names", f"SELECT 'schema_id_names' AS type, 'low' AS severity, {NONE} AS page_id, {NONE} AS entity_id, '#' || p_partkey // 3 || ' | ' || string_agg(DISTINCT p_name, ' / ' ORDER BY p_name) AS evidence FROM part GROUP BY p_partkey // 3 HAVING count(DISTINCT p_name) > 1")
def _(s, d):
    names = F.array_sort(F.collect_set("name"))
    ids = parts(s, d).groupBy(F.concat(F.lit("#"), F.floor(F.col("page_id") / 3).cast("string")).alias("id")).agg(names.alias("all")).filter(F.size("all") > 1)
    return D.schema_id_names(ids.select("id", F.array_join("all", " / ").alias("names")))


@query("article_markup", f"""WITH a AS (SELECT p_partkey AS page_id, p_size % 3 = 0 AS article, CASE p_type WHEN 'PROMO' THEN p_size % 2 = 0 ELSE p_size % 5 <> 0 END AS has, p_type FROM part), w AS (SELECT *, avg(has::INT) OVER (PARTITION BY p_type) AS share FROM a)
    SELECT 'article_markup_on_other_pages' AS type, 'medium' AS severity, page_id, {NONE} AS entity_id, round(share, 4)::VARCHAR AS evidence FROM w WHERE share >= 0.6 AND has AND NOT article""")
def _(s, d):
    has = choose(("lang = 'PROMO'", F.expr("size % 2 = 0")), default=F.expr("size % 5 <> 0"))
    return D.article_markup(parts(s, d).select(F.col("lang").alias("site"), "page_id", choose(("size % 3 = 0", F.lit("article")), default=F.lit("product")).alias("role"), has.alias("has_article")))


HOMES = {"AUTOMOBILE": "a", "BUILDING": "b", "FURNITURE": "f", "HOUSEHOLD": "h", "MACHINERY": "m"}
HOME = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HOMES.items()) + " END"
HOME_SQL = HOME.format("c_mktsegment")


def home_rows(s):
    return s.createDataFrame([(v, f"https://s.example/{v}/") for v in HOMES.values()], "lang string, url string")


def segment(c: str = "c_mktsegment"):
    return F.expr(HOME.format(c))


@query("breadcrumb_foreign_home", f"WITH c AS (SELECT c_custkey AS page_id, {HOME_SQL} AS lang, ['a', 'b', 'f', 'h', 'm', 'x'][1 + c_custkey % 6] AS start FROM customer) SELECT 'breadcrumb_foreign_home' AS type, 'low' AS severity, page_id, {NONE} AS entity_id, 'https://s.example/' || start AS evidence FROM c WHERE start <> lang AND start <> 'x'")
def _(s, d):
    start = F.element_at(F.array(*map(F.lit, "abfhmx")), (1 + F.col("c_custkey") % 6).cast("int"))
    crumbs = table(s, d, "customer").select(F.col("c_custkey").alias("page_id"), segment().alias("lang"), F.concat(F.lit("https://s.example/"), start).alias("first_url"))
    return D.breadcrumb_foreign_home(crumbs, home_rows(s))


@query(
    "menu_targets",
    f"""WITH i AS (SELECT {HOME_SQL} AS lang, c_custkey AS k, c_custkey % 4 = 0 AS home, c_custkey % 5 <> 0 AS header, c_custkey % 3 = 0 AS own, 200 + 204 * (c_custkey % 7 = 0)::INT AS status, c_custkey % 6 = 1 AS moved FROM customer),
    u AS (SELECT *, 'https://s.example/' || CASE WHEN own THEN lang || '/' ELSE 'p/' || k END AS url FROM i)
    SELECT 'menu_home_target' AS type, 'medium' AS severity, {NONE} AS page_id, {NONE} AS entity_id, lang || ' ' || url AS evidence FROM u WHERE home AND header AND NOT own
    UNION ALL SELECT 'menu_broken_target', 'medium', NULL, NULL, lang || ' ' || url || ' ' || status FROM u WHERE NOT own AND (status >= 400 OR moved)""",
)
def _(s, d):
    k = F.col("c_custkey")
    own, page = F.concat(F.lit("https://s.example/"), segment(), F.lit("/")), F.concat(F.lit("https://s.example/p/"), k.cast("string"))
    rows = table(s, d, "customer")
    items = rows.select(segment().alias("lang"), F.when(k % 5 != 0, "header").otherwise("footer").alias("area"), F.when(k % 4 == 0, " Home").otherwise("Goods").alias("anchor"), F.when(k % 3 == 0, own).otherwise(page).alias("url"))
    pages = rows.select(page.alias("url"), F.when(k % 7 == 0, 404).otherwise(200).alias("status"), F.when(k % 6 == 1, F.concat(page, F.lit("-new"))).otherwise(page).alias("final_url"))
    return D.menu_targets(items, pages, home_rows(s))


@query("breadcrumb_ignores_menu", f"WITH c AS (SELECT c_nationkey AS parent, count(*) AS n, count(*) FILTER (WHERE c_custkey % 7 < c_nationkey % 7) AS w FROM customer GROUP BY ALL) SELECT 'breadcrumb_ignores_menu' AS type, 'low' AS severity, {NONE} AS page_id, {NONE} AS entity_id, parent || ':' || w || ':' || n AS evidence FROM c WHERE w >= 3 AND w >= 0.5 * n")
def _(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").cast("string").alias("parent"), F.expr("c_custkey % 7 < c_nationkey % 7").alias("without"))
    crumbs = rows.select(F.col("key").alias("page_id"), "key", F.when(F.col("without"), F.array(F.lit("home"))).otherwise(F.array(F.lit("home"), "parent")).alias("steps"))
    return D.breadcrumb_ignores_menu(rows.select("key", "parent"), crumbs)


@query(
    "link_forms",
    f"""WITH l AS (SELECT l_orderkey AS f, l_partkey AS t, l_linenumber = 1 AS nav, [CASE WHEN l_quantity < 3 THEN 'protocol' END, CASE WHEN l_quantity BETWEEN 3 AND 4 THEN 'www' END, CASE WHEN l_discount > 0.09 THEN 'trailing_slash' END] AS how, l_tax > 0.07 AND l_quantity > 48 AS broken FROM lineitem),
    r AS (SELECT *, list_filter(how, lambda x: x IS NOT NULL) AS forms FROM l WHERE broken OR len(list_filter(how, lambda x: x IS NOT NULL)) > 0)
    SELECT 'link_not_final_url' AS type, CASE WHEN bool_or(broken) THEN 'high' WHEN bool_or(nav) OR count(DISTINCT f) >= 10 THEN 'medium' ELSE 'low' END AS severity, t AS page_id, {NONE} AS entity_id, concat_ws(':', array_to_string(list_sort(list_distinct(flatten(list(forms)))), ','), count(DISTINCT f)) AS evidence FROM r GROUP BY t""",
)
def _(s, d):
    c = F.col
    q, path = c("l_quantity"), F.concat(F.lit("s.example/p/"), c("l_partkey").cast("string"))
    raw = F.concat(F.when(q < 3, "http://").when(q <= 4, "https://www.").otherwise("https://"), path, F.when(c("l_discount") > 0.09, "/").otherwise(""))
    broken = (c("l_tax") > 0.07) & (q > 48)
    rows = table(s, d, "lineitem").select(c("l_orderkey").alias("from_page_id"), c("l_partkey").alias("to_page_id"), raw.alias("raw_url"), F.concat(F.lit("https://"), path).alias("stored_url"), F.when(c("l_linenumber") == 1, "nav").otherwise("body").alias("position"), broken.alias("b"))
    return D.link_forms(rows, F.col("b"))


#: Addresses that sites block, with or without a purpose; the rule that meets each, and the purpose.
BLOCKED = {"AUTOMOBILE": ("/my-account/", "/my-account", "account"), "BUILDING": ("/list?filter_size=", "/*?filter", "filter"), "FURNITURE": ("/accounting/", "/acc", None), "HOUSEHOLD": ("/open/", None, None), "MACHINERY": ("/basket.html?x=", "/basket", "cart")}


def _case(i: int) -> str:
    return "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in BLOCKED.items() if v[i]) + " END"


@query("intended_blocks", f"SELECT c_custkey, {_case(2)} AS purpose FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", D.intended_block(F.concat(F.lit("https://s.example"), F.expr(_case(0)), F.col("c_custkey").cast("string"))).alias("purpose"))


@query(
    "robots_blocked_links",
    f"""WITH l AS (SELECT c_custkey, {_case(1)} AS pattern, {_case(2)} IS NOT NULL AS meant, c_custkey % 2 = 0 AS indexable FROM customer) SELECT 'robots_blocked_link' AS type, CASE WHEN meant THEN 'low' WHEN bool_or(indexable) THEN 'high' ELSE 'medium' END AS severity,
    {NONE} AS page_id, {NONE} AS entity_id, pattern || ':' || count(DISTINCT c_custkey) AS evidence FROM l WHERE pattern IS NOT NULL GROUP BY pattern, meant""",
)
def _(s, d):
    k = F.col("c_custkey")
    rules = H.robots_rules(s.createDataFrame([("s.example", "User-agent: *\n" + "".join(f"Disallow: {v[1]}\n" for v in BLOCKED.values() if v[1]))], "host string, text string"))
    rows = table(s, d, "customer").select(k.alias("to_page_id"), F.lit("s.example").alias("host"), F.concat(F.expr(_case(0)), k.cast("string")).alias("path"), (k % 2 == 0).alias("indexable"), F.lit("nav").alias("position"))
    decided = L.robots_decision(rows.select("host", "path").distinct(), rules, "somebot")
    return D.robots_blocked_links(rows.join(decided, ["host", "path"]).withColumn("to_url", F.concat(F.lit("https://"), "host", "path")))


@query(
    "robots_blocked_bots",
    f"""SELECT 'robots_bot_blocked' AS type, CASE WHEN agent = 'trainbot' THEN 'low' ELSE 'high' END AS severity, {NONE} AS page_id, {NONE} AS entity_id, 'n' || n_nationkey || '.example:' || agent AS evidence
    FROM (SELECT n_nationkey, unnest(CASE n_regionkey WHEN 0 THEN ['*'] WHEN 1 THEN ['googlebot', 'trainbot'] WHEN 2 THEN ['trainbot'] ELSE []::VARCHAR[] END) AS agent FROM nation)""",
)
def _(s, d):
    files = {0: "User-agent: *\nDisallow: /\n", 1: "User-agent: GoogleBot\nUser-agent: trainbot\nDisallow: /\n", 2: "User-agent: trainbot\nDisallow: /\n\nUser-agent: *\nDisallow: /a\n", 3: "User-agent: *\nDisallow: /\nAllow: /\n", 4: "User-agent: *\nDisallow:\n"}
    text = F.create_map(*(F.lit(x) for kv in files.items() for x in kv))[F.col("n_regionkey").cast("int")]
    return D.robots_blocked_bots(H.robots_rules(table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".example")).alias("host"), text.alias("text"))))
