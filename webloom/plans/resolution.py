"""Queries of entity resolution, menus, profiles and views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import analytics as A
from ..operators import menu as M
from ..operators import pages as P
from ..operators import profile as S
from ..operators import resolve as R
from ..operators import views as V
from ..sources import html as H
from ..sources import structured as D
from .graphs import EVIDENCE, WEIGHTS, main_entities, weights
from .projections import MENTIONS, mentions, query, table
from .web import HOST, PATH, parsed

ENTITIES = """e AS (SELECT p_partkey AS entity_id, p_name AS name, p_type AS type, CASE WHEN p_size > 35 THEN p_brand END AS subtype, CASE p_size % 7 WHEN 0 THEN 'core' WHEN 1 THEN 'package' WHEN 2 THEN 'step' END AS tier,
  CASE WHEN p_partkey % 11 = 0 THEN p_partkey END AS anchor, CASE p_partkey % 3 WHEN 0 THEN 'schema' WHEN 1 THEN 'rule' ELSE 'llm' END AS source, coalesce(n, 0) AS mentions
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_partkey = p_partkey)"""


def entities(s, d):
    n = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    key = F.col("p_partkey")
    tier = F.when(F.col("p_size") % 7 == 0, "core").when(F.col("p_size") % 7 == 1, "package").when(F.col("p_size") % 7 == 2, "step")
    source = F.when(key % 3 == 0, "schema").when(key % 3 == 1, "rule").otherwise("llm")
    return table(s, d, "part").join(n, "p_partkey", "left").select(
        key.alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.when(F.col("p_size") > 35, F.col("p_brand")).alias("subtype"), tier.alias("tier"),
        F.when(key % 11 == 0, key).alias("anchor_page_id"), source.alias("source"), F.coalesce("n", F.lit(0)).alias("mentions"),
    )


MERGES = f"""{ENTITIES}, o AS (SELECT *, row_number() OVER (PARTITION BY name, type ORDER BY CASE WHEN anchor IS NULL THEN 1 ELSE 0 END,
  CASE WHEN tier = 'core' THEN 0 WHEN tier = 'package' THEN 1 WHEN tier IS NULL THEN 2 ELSE 3 END, CASE source WHEN 'schema' THEN 0 WHEN 'rule' THEN 1 ELSE 2 END, mentions DESC, entity_id) AS r FROM e),
  g AS (SELECT k.entity_id AS kept_id, o.entity_id AS removed_id FROM o JOIN o k ON k.r = 1 AND o.r > 1 AND o.name = k.name AND o.type = k.type
  WHERE NOT coalesce(o.anchor <> k.anchor, false) AND NOT coalesce(o.tier <> k.tier, false) AND NOT coalesce(o.subtype <> k.subtype, false))"""


@query("entity_merges", f"WITH {MERGES} SELECT kept_id, removed_id, 'normalized' AS rule FROM g")
def merges(s, d):
    return R.merges(entities(s, d), ["name", "type"], "normalized")


@query("mentions_after_merge", f"WITH {MERGES}, {MENTIONS} SELECT coalesce(kept_id, entity_id) AS entity_id, page_id FROM m LEFT JOIN g ON removed_id = entity_id GROUP BY ALL")
def _(s, d):
    return R.remapped(mentions(s, d).select("entity_id", "page_id"), merges(s, d), "entity_id", ["entity_id", "page_id"])


@query(
    "majority_types",
    """WITH v AS (SELECT user_id AS entity_id, event_type AS type, CASE WHEN event_id % 50 = 0 THEN 'schema' ELSE 'llm' END AS source FROM events), f AS (SELECT entity_id, min(type) AS fixed FROM v WHERE source = 'schema' GROUP BY ALL),
    c AS (SELECT entity_id, type, count(*) AS n FROM v GROUP BY ALL), b AS (SELECT *, n / sum(n) OVER (PARTITION BY entity_id) AS share, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, type) AS r FROM c)
    SELECT entity_id, coalesce(fixed, type) AS type, round(share, 6) AS share FROM b LEFT JOIN f USING (entity_id) WHERE r = 1""",
)
def _(s, d):
    return R.majority_types(table(s, d, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 50 == 0, "schema").otherwise("llm").alias("source")))


@query("template_entities", f"WITH {MENTIONS} SELECT entity_id FROM m GROUP BY entity_id HAVING bool_and(skip)")
def _(s, d):
    return R.template_entities(mentions(s, d).withColumnRenamed("skip", "template"))


@query(
    "canonical_names",
    f"WITH {ENTITIES}, c AS (SELECT type AS entity_id, name, min(CASE source WHEN 'schema' THEN 0 WHEN 'rule' THEN 1 ELSE 2 END) AS r, sum(mentions) AS n FROM e GROUP BY ALL) SELECT entity_id, name FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY r, n DESC, name DESC) AS k FROM c) WHERE k = 1",
)
def _(s, d):
    return R.canonical_names(entities(s, d).select(F.col("type").alias("entity_id"), "name", "source", F.col("mentions").alias("n")))


@query(
    "product_families",
    """WITH w AS (SELECT p_partkey, p_brand, string_split(lower(p_name), ' ') AS ws FROM part), p AS (SELECT p_partkey, p_brand, array_to_string(ws[1:n], ' ') AS family FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS n FROM w)),
    c AS (SELECT p_brand, family FROM p GROUP BY ALL HAVING count(DISTINCT p_partkey) >= 2) SELECT p_partkey AS product_id, max_by(family, length(family)) AS family FROM p JOIN c USING (p_brand, family) GROUP BY p_partkey""",
)
def _(s, d):
    return R.families(table(s, d, "part").withColumnRenamed("p_partkey", "product_id"), "p_brand", "p_name")


@query(
    "knowledge_status",
    """WITH c AS (SELECT o_custkey AS entity_id, o_orderkey AS kb_id, o_orderstatus = 'F' AS ne, o_orderpriority < '3' AS te, o_totalprice > 300000 AS co FROM orders),
    g AS (SELECT entity_id, count(*) FILTER (WHERE ne AND te) AS ex, min(kb_id) FILTER (WHERE ne AND te) AS exid, count(*) FILTER (WHERE co) AS b, min(kb_id) FILTER (WHERE co) AS bid, min(kb_id) FILTER (WHERE ne) AS nid FROM c GROUP BY ALL)
    SELECT entity_id, CASE WHEN b = 1 THEN bid WHEN ex = 1 THEN exid ELSE nid END AS kb_id, CASE WHEN b = 1 OR ex = 1 THEN 'confident' WHEN nid IS NOT NULL THEN 'probable' ELSE 'none' END AS status FROM g""",
)
def _(s, d):
    rows = table(s, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("kb_id"), (F.col("o_orderstatus") == "F").alias("name_equal"), (F.col("o_orderpriority") < "3").alias("type_equal"), (F.col("o_totalprice") > 300000).alias("corroborated"))
    return R.knowledge_status(rows)


@query(
    "block_chunks",
    """WITH b AS (SELECT o_custkey AS page_id, o_orderkey AS ordinal FROM orders) SELECT page_id, ordinal, ((row_number() OVER (PARTITION BY page_id ORDER BY ordinal) - 1) * ceil(count(*) OVER (PARTITION BY page_id) / 4.0)::BIGINT // count(*) OVER (PARTITION BY page_id))::BIGINT AS chunk FROM b""",
)
def _(s, d):
    return R.chunks(table(s, d, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("ordinal")), 4)


ENTRIES = """n AS (SELECT l_orderkey AS page_id, CASE WHEN l_linestatus = 'O' THEN 'header' ELSE 'footer' END AS area, l_returnflag AS lang, 'k' || (l_partkey % 5) AS key, 'a' || (l_suppkey % 3) AS anchor, 'k' || (l_suppkey % 6) AS parent, l_linenumber AS ordinal FROM lineitem)"""


def entries(s, d):
    num = lambda prefix, c, m: F.concat(F.lit(prefix), (F.col(c) % m).cast("string"))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.when(F.col("l_linestatus") == "O", "header").otherwise("footer").alias("area"), F.col("l_returnflag").alias("lang"), num("k", "l_partkey", 5).alias("key"), num("a", "l_suppkey", 3).alias("anchor"), num("k", "l_suppkey", 6).alias("parent"), F.col("l_linenumber").alias("ordinal"))


FOREST = f"""{ENTRIES}, ap AS (SELECT lang, area, count(DISTINCT page_id) AS area_pages FROM n GROUP BY ALL), it AS (SELECT lang, area, key, count(DISTINCT page_id) AS pages, avg(ordinal) AS mean FROM n GROUP BY ALL),
  kept AS (SELECT * FROM it JOIN ap USING (lang, area) WHERE pages >= 0.25 * area_pages),
  an AS (SELECT lang, area, key, anchor FROM (SELECT *, row_number() OVER (PARTITION BY lang, area, key ORDER BY n DESC, anchor DESC) AS r FROM (SELECT lang, area, key, anchor, count(*) AS n FROM n GROUP BY ALL)) WHERE r = 1),
  pa AS (SELECT lang, area, key, parent FROM (SELECT *, row_number() OVER (PARTITION BY lang, area, key ORDER BY n DESC, parent DESC) AS r FROM (SELECT lang, area, key, parent, count(*) AS n FROM n GROUP BY ALL)) WHERE r = 1),
  fo AS (SELECT k.lang, k.area, k.key, anchor, CASE WHEN parent <> k.key AND EXISTS (SELECT 1 FROM kept x WHERE x.lang = k.lang AND x.area = k.area AND x.key = parent) THEN parent END AS parent,
    row_number() OVER (PARTITION BY k.lang, k.area ORDER BY mean, k.key)::BIGINT AS place, pages::BIGINT AS pages, area_pages::BIGINT AS area_pages FROM kept k JOIN an USING (lang, area, key) JOIN pa USING (lang, area, key))"""


def forest(s, d):
    return M.forest(entries(s, d), {"header": 0.25, "footer": 0.25})


@query("menu_forest", f"WITH {FOREST} SELECT * FROM fo")
def _(s, d):
    return forest(s, d)


@query(
    "menu_differences",
    f"""WITH {FOREST}, ne AS (SELECT DISTINCT page_id, lang, area, key FROM n), co AS (SELECT lang, area, key FROM fo WHERE pages >= 0.3 * area_pages)
    SELECT page_id, lang, area, 'extra' AS kind, key FROM ne WHERE NOT EXISTS (SELECT 1 FROM fo WHERE fo.lang = ne.lang AND fo.area = ne.area AND fo.key = ne.key)
    UNION ALL SELECT page_id, lang, area, 'missing', key FROM (SELECT DISTINCT page_id, lang, area FROM ne) q JOIN co USING (lang, area) ANTI JOIN ne USING (page_id, lang, area, key)""",
)
def _(s, d):
    return M.differences(entries(s, d), forest(s, d), 0.3)


COUNTRY = f"""g AS (SELECT substr(url, -1) AS site, kind, country FROM (SELECT url, 'path_prefix' AS kind, CASE regexp_extract({PATH.format('url')}, '^/([a-z][a-z])/', 1) WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' WHEN 'es' THEN 'ES' END AS country FROM pages
  UNION ALL SELECT url, 'hreflang', CASE regexp_extract(html, '<html lang="([^"]*)"', 1) WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' WHEN 'en' THEN 'GB' END FROM pages) WHERE country IS NOT NULL),
  c AS (SELECT site, kind, country, count(*) AS n FROM g GROUP BY ALL), v AS (SELECT site, country, sum(CASE kind WHEN 'path_prefix' THEN 1.5 ELSE 1.0 END * share) AS score FROM (SELECT *, n / sum(n) OVER (PARTITION BY site, kind) AS share FROM c) GROUP BY ALL),
  t AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(score, 9) DESC, country) AS rank, round(score / sum(score) OVER (PARTITION BY site), 2) AS share FROM v)"""


def country_signals(s, d):
    code = lambda c, **m: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in m.items()))
    rows = parsed(s, d).select(F.substring("url", -1, 1).alias("site"), code(U.path_language(F.col("url")), de="DE", fr="FR", es="ES").alias("a"), code(F.col("lang"), de="DE", fr="FR", en="GB").alias("b"))
    both = F.array(F.struct(F.lit("path_prefix").alias("kind"), F.col("a").alias("country")), F.struct(F.lit("hreflang").alias("kind"), F.col("b").alias("country")))
    return rows.select("site", F.inline(both)).filter("country IS NOT NULL")


@query("country_votes", f"WITH {COUNTRY} SELECT site, country, share, rank::BIGINT AS rank FROM t WHERE rank <= 3")
def _(s, d):
    return S.country_votes(country_signals(s, d)).select("site", "country", "share", F.col("rank").cast("long").alias("rank"))


#: hreflang is the one strong kind among these signals: its leader agrees with the vote or differs from it.
@query("target_countries", f"""WITH {COUNTRY}, f AS (SELECT site, max(country) FILTER (WHERE rank = 1) AS country, max(score) FILTER (WHERE rank = 1) AS a, max(score) FILTER (WHERE rank = 2) AS b FROM t GROUP BY site),
    l AS (SELECT site, max(country) AS leader FROM (SELECT *, rank() OVER (PARTITION BY site ORDER BY n DESC) AS place FROM c WHERE kind = 'hreflang') WHERE place = 1 GROUP BY site HAVING count(*) = 1)
    SELECT f.site, CASE WHEN NOT coalesce(abs(a - b) <= 1e-9 * a, false) THEN country END AS country, CASE WHEN NOT coalesce(abs(a - b) <= 1e-9 * a, false) THEN CASE WHEN leader = country THEN 'medium' ELSE 'low' END END AS confidence FROM f LEFT JOIN l ON l.site = f.site""")
def _(s, d):
    return S.target_countries(country_signals(s, d))


@query("site_languages", f"""SELECT site, string_agg(lang, ',' ORDER BY n DESC, lang) AS languages FROM (SELECT {HOST.format('url')} AS site, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, count(*) AS n FROM pages GROUP BY ALL) GROUP BY site""")
def _(s, d):
    return S.languages(parsed(s, d).select(U.host(F.col("url")).alias("site"), "lang", "hreflang")).withColumn("languages", F.array_join("languages", ","))


@query("trailing_slashes", f"WITH p AS (SELECT {HOST.format('url')} AS site, page_id, {PATH.format('url')} AS p FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS k FROM p), v AS (SELECT *, p NOT IN ('', '/') AND lower(regexp_extract(p, '[.]([^./]*)/*$', 1)) NOT IN {U.FILE_EXTENSIONS} AS votes FROM r WHERE k <= 50), n AS (SELECT site, count(*) FILTER (WHERE votes AND p LIKE '%/') AS a, count(*) FILTER (WHERE votes AND p NOT LIKE '%/') AS b FROM v GROUP BY site) SELECT site, CASE WHEN a <> b THEN a > b END AS trailing_slash FROM n")
def _(s, d):
    return S.trailing_slash(table(s, d, "pages").select(U.host(F.col("url")).alias("site"), "page_id", "url"))


@query("page_types", "SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<title>[^<]*(not found|nem található|\\b404\\b)') OR regexp_matches(html, '(?i)<h1>[^<]*(not found|nem található|\\b404\\b)') THEN 'not_found' ELSE 'other' END AS page_type FROM pages")
def _(s, d):
    pages = parsed(s, d)
    return P.page_types(pages, P.node_types(D.nodes_of(pages)))


@query("missing_legal_pages", f"SELECT DISTINCT {HOST.format('url')} AS site, kind FROM pages CROSS JOIN (SELECT unnest(['terms', 'privacy', 'withdrawal', 'shipping_payment', 'warranty', 'contact']) AS kind)")
def _(s, d):
    pages = table(s, d, "pages").select(U.host(F.col("url")).alias("site"), "page_id", "url")
    return P.missing_legal_pages(pages, pages.select("site").distinct())


@query("page_spend", "SELECT event_type AS model, count(*)::BIGINT AS calls, round(sum(value), 6) AS usd, sum(value) > 20000 AS over_budget FROM events GROUP BY ALL")
def _(s, d):
    return V.spend(table(s, d, "events").select(F.col("event_type").alias("model"), F.col("value").alias("usd")), 20000)


@query("fact_rows", "SELECT n_nationkey, unnest(['n_name', 'n_regionkey']) AS fact, unnest([n_name, n_regionkey::VARCHAR]) AS value FROM nation")
def _(s, d):
    return V.fact_rows(table(s, d, "nation"), "n_nationkey")


@query("crawl_ids", "SELECT user_id AS site, event_id AS run_id, coalesce(last_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), event_id) AS crawl_id FROM events")
def _(s, d):
    runs = table(s, d, "events").select(F.col("user_id").alias("site"), F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "error", "resume").otherwise("crawl").alias("mode"))
    return V.with_crawl_ids(runs).drop("mode")


@query("entity_view", f"WITH {WEIGHTS}, k AS (SELECT entity_id, weight, main_pages, row_number() OVER (ORDER BY weight DESC, entity_id)::BIGINT AS rank FROM w), h2 AS (SELECT entity_id, page_id FROM main WHERE role = 'main'), o2 AS (SELECT DISTINCT entity_id, page_id FROM m ANTI JOIN h2 USING (entity_id, page_id)) SELECT entity_id, rank, weight, main_pages, p_name AS name, (SELECT count(*) FROM h2 x WHERE x.entity_id = k.entity_id)::BIGINT AS main_on_n, (SELECT count(*) FROM o2 x WHERE x.entity_id = k.entity_id)::BIGINT AS mentioned_on_n FROM k JOIN part ON p_partkey = entity_id")
def _(s, d):
    names = table(s, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    out = V.entity_view(weights(s, d), names, main_entities(s, d), mentions(s, d))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("main_on_n", "mentioned_on_n")}
    return out.withColumns(zero).drop("main_on", "mentioned_on")


@query("page_view", f"WITH {EVIDENCE} SELECT o_orderkey AS page_id, h.entity_id AS main_entity, confidence, (SELECT count(*) FROM main x WHERE x.page_id = o_orderkey AND role = 'secondary')::BIGINT AS secondaries FROM orders LEFT JOIN (SELECT * FROM main WHERE role = 'main') h ON h.page_id = o_orderkey")
def _(s, d):
    pages = table(s, d, "orders").select(F.col("o_orderkey").alias("page_id"))
    none = pages.limit(0)
    out = V.page_view(pages, main_entities(s, d), none, none)
    return out.select("page_id", "main_entity", "confidence", F.coalesce(F.size("secondaries").cast("long"), F.lit(0)).alias("secondaries"))


@query("blocks_by_kind", "SELECT 'heading' AS kind, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(html, '<h1>')) FROM pages)")
def _(s, d):
    return H.blocks_of(parsed(s, d)).filter("kind = 'heading'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("similar_products", """WITH w AS (SELECT p_partkey, p_brand, p_type, list_distinct(string_split(p_name || ' ' || p_size, ' ')) AS ws FROM part)
    SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) AS similarity FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey
    WHERE len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) >= 0.5""")
def _(s, d):
    words = F.split(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")), " ")
    return A.similar_pairs(table(s, d, "part").select(F.col("p_partkey").alias("page_id"), "p_brand", "p_type", words.alias("tokens")), ["p_brand", "p_type"], "tokens", 0.5)
