"""Queries of operators over sections, links, names, votes, spending and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import url as U
from ..operators import analytics as A
from ..operators import graph as G
from ..operators import links as L
from ..operators import resolve as R
from ..operators import views as V
from ..sources import html as H
from ..sources import structured as T
from .graphs import duplicates
from .projections import LINKS, MENTIONS, links, mentions, query, table
from .web import HOST, PATH


@query("in_parameter_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE list_contains(['1-URGENT', '3-MEDIUM'], o_orderpriority)")
def _(s, d):
    wanted = F.array(F.lit("1-URGENT"), F.lit("3-MEDIUM"))
    return table(s, d, "orders").filter(F.array_contains(wanted, F.col("o_orderpriority"))).select("o_orderkey", "o_orderpriority")


FLAGS = "list_filter([CASE WHEN l_linestatus = 'O' THEN 'template' END, CASE WHEN l_quantity < 10 THEN 'label' END, CASE WHEN l_discount > 0.05 THEN 'demo' END], lambda x: x IS NOT NULL)"


@query("flagged_everywhere", f"SELECT l_orderkey AS page_id, count(*)::BIGINT AS mentions FROM (SELECT l_orderkey, {FLAGS} AS flags FROM lineitem) GROUP BY l_orderkey HAVING bool_and(len(flags) > 0) OR NOT bool_or(list_contains(flags, 'demo'))")
def _(s, d):
    c = F.col
    flags = F.array_compact(F.array(F.when(c("l_linestatus") == "O", F.lit("template")), F.when(c("l_quantity") < 10, F.lit("label")), F.when(c("l_discount") > 0.05, F.lit("demo"))))
    rows = table(s, d, "lineitem").select(c("l_orderkey").alias("page_id"), flags.alias("flags")).groupBy("page_id")
    out = rows.agg(F.count(F.lit(1)).alias("mentions"), F.bool_and(F.size("flags") > 0).alias("all"), F.bool_or(F.array_contains("flags", "demo")).alias("demo"))
    return out.filter("all OR NOT demo").select("page_id", "mentions")


@query("admitted_addresses", f"SELECT page_id, regexp_matches({HOST.format('url')}, '(^|[.])(' || k.domain || ')$') AND NOT regexp_matches({HOST.format('url')}, '^(cdn|static|img)[.]') AND regexp_matches(url, '/(en|de)/') AND NOT regexp_matches(url, '[?]page=') AS admitted FROM pages, (SELECT array_to_string(list_slice(string_split({HOST.format('url')}, '.'), -2, -1), '[.]') AS domain FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)) k")
def _(s, d):
    pages = table(s, d, "pages")
    seed = pages.agg(F.min_by(U.host(F.col("url")), "page_id")).first()[0] or ""
    return L.admitted(pages.select("page_id", "url"), seed, ["/(en|de)/"], [r"[?]page="]).drop("url")


@query("language_pairs", "SELECT a.o_orderkey // 4 AS \"group\", a.o_orderkey AS a, b.o_orderkey AS b, a.o_orderpriority AS a_lang, b.o_orderpriority AS b_lang FROM orders a JOIN orders b ON a.o_orderkey // 4 = b.o_orderkey // 4 AND a.o_orderpriority < b.o_orderpriority")
def _(s, d):
    return L.language_pairs(table(s, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.floor(F.col("o_orderkey") / 4).alias("group"), F.col("o_orderpriority").alias("lang")))


@query("subsequences", """WITH c AS (SELECT o_custkey AS c, string_agg(o_orderstatus, '' ORDER BY o_orderdate, o_orderkey) AS t FROM orders GROUP BY o_custkey)
    SELECT a.c AS customer, regexp_matches(b.t, array_to_string(string_split(a.t, ''), '.*')) AS kept FROM c a JOIN c b ON b.c = a.c + 1""")
def _(s, d):
    rows = table(s, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("old"))
    new = rows.select((F.col("o_custkey") - 1).alias("o_custkey"), F.col("old").alias("new"))
    return rows.join(new, "o_custkey").select(F.col("o_custkey").alias("customer"), A.is_subsequence(F.col("old"), F.col("new")).alias("kept"))


@query("cache_hits", "WITH q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE '  ' || lower(c_mktsegment) || ' x' END AS t FROM customer), k AS (SELECT DISTINCT c_mktsegment AS t FROM customer) SELECT q.id AS request_id, length(k.t)::BIGINT AS answer FROM q JOIN k ON lower(trim(q.t)) = lower(k.t)")
def _(s, d):
    rows = table(s, d, "customer")
    text = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" x")))
    cache = rows.select(F.col("c_mktsegment").alias("text"), F.length("c_mktsegment").cast("long").alias("answer")).distinct()
    return L.cache_hits(rows.select(F.col("c_custkey").alias("request_id"), text.alias("text")), cache)


@query("title_suffixes", "WITH t AS (SELECT p_type AS lang, p_brand AS suffix, count(*) AS n FROM part GROUP BY ALL), a AS (SELECT p_type AS lang, count(*) AS titles FROM part GROUP BY ALL) SELECT t.lang, suffix, n AS pages FROM t JOIN a ON a.lang = t.lang WHERE n >= 0.04 * titles")
def _(s, d):
    rows = table(s, d, "part").select(F.col("p_type").alias("lang"), X.title_ending(F.concat_ws(" | ", "p_name", "p_brand")).alias("suffix"), F.lit(True).alias("titled"))
    return A.title_suffixes(rows, 0.04)


@query("table_share", "SELECT l_orderkey AS page_id, sum(CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END) / sum(l_linenumber) AS share FROM lineitem GROUP BY l_orderkey")
def _(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.when(F.col("l_returnflag") == "A", "table").otherwise("text").alias("kind"), F.col("l_linenumber").alias("words"))
    return A.kind_share(rows, "table")


@query("spend_by_purpose", "WITH e AS (SELECT substr(event_type, 1, 1) AS provider, event_type AS model, user_id % 3 AS purpose, event_id % 100 AS usd FROM events), g AS (SELECT provider, model, purpose, count(*)::BIGINT AS calls, sum(usd)::BIGINT AS usd FROM e GROUP BY ALL) SELECT *, (sum(usd) OVER (PARTITION BY provider))::BIGINT AS provider_usd, provider IN ('c', 'e') AND sum(usd) OVER (PARTITION BY provider) > 1000 AS over_budget FROM g")
def _(s, d):
    c = F.col
    calls = table(s, d, "events").select(F.substring("event_type", 1, 1).alias("provider"), c("event_type").alias("model"), (c("user_id") % 3).alias("purpose"), (c("event_id") % 100).cast("long").alias("usd"))
    return V.spend_by_purpose(calls, s.createDataFrame([("c", 1000), ("e", 1000)], "provider string, budget long"))


@query("concept_ranks", f"WITH {MENTIONS}, g AS (SELECT page_id, entity_id, bool_or(position <> 'body') AS top, count(*) AS n, min(ordinal) AS first FROM m GROUP BY ALL) SELECT page_id, entity_id, row_number() OVER (PARTITION BY page_id ORDER BY top DESC, n DESC, first, entity_id)::BIGINT AS rank FROM g")
def _(s, d):
    return A.concept_ranks(mentions(s, d))


HEADS = "h AS (SELECT l_orderkey AS page_id, l_linenumber AS ordinal, l_partkey % 3 + 1 AS level, l_partkey % 50 AS own_words FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)"


@query("subtree_words", f"""WITH {HEADS}, e AS (SELECT a.page_id, a.ordinal, a.level, a.own_words, coalesce(min(b.ordinal), 1000000) AS stop FROM h a LEFT JOIN h b ON b.page_id = a.page_id AND b.ordinal > a.ordinal AND b.level <= a.level GROUP BY ALL)
    SELECT e.page_id, e.ordinal, e.level, e.own_words, sum(h.own_words)::BIGINT AS total_words FROM e JOIN h ON h.page_id = e.page_id AND h.ordinal >= e.ordinal AND h.ordinal < e.stop GROUP BY ALL""")
def _(s, d):
    c = F.col
    rows = table(s, d, "lineitem").groupBy(c("l_orderkey").alias("page_id"), c("l_linenumber").alias("ordinal")).agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x"))
    return A.subtree_words(rows.select("page_id", "ordinal", (c("x.l_partkey") % 3 + 1).alias("level"), (c("x.l_partkey") % 50).alias("own_words")))


@query("menu_levels", "SELECT 'all' AS area, p_partkey::VARCHAR AS key, CASE WHEN p_partkey >= 10 THEN (p_partkey // 10)::VARCHAR END AS parent, (length(p_partkey::VARCHAR) - 1)::BIGINT AS level FROM part")
def _(s, d):
    key = F.col("p_partkey")
    items = table(s, d, "part").select(F.lit("all").alias("area"), key.cast("string").alias("key"), F.when(key >= 10, F.floor(key / 10).cast("string")).alias("parent"))
    return G.chain_levels(items, ["area"])


@query("inbound_to_originals", f"""WITH {LINKS}, du AS (SELECT o_orderkey AS page_id, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS original_id, o_orderpriority AS g FROM orders)
    SELECT t.original_id AS to_id, count(*)::BIGINT AS links, count(*) FILTER (WHERE position = 'body')::BIGINT AS in_body, count(DISTINCT f.g)::BIGINT AS groups FROM l JOIN du f ON f.page_id = from_id JOIN du t ON t.page_id = to_id WHERE f.g <> t.g GROUP BY ALL""")
def _(s, d):
    groups = table(s, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderpriority").alias("group"))
    rows = L.inbound_to_originals(links(s, d).select("from_id", "to_id", "position"), duplicates(s, d), groups)
    return rows.groupBy("to_id").agg(F.count(F.lit(1)).alias("links"), F.count_if("body").alias("in_body"), F.countDistinct("group").alias("groups"))


@query("person_merges", "WITH p AS (SELECT p_partkey AS id, array_to_string(list_sort(string_split(p_name || ' ' || lower(p_type), ' ')), ' ') AS key FROM part), k AS (SELECT id, min(id) OVER (PARTITION BY key) AS kept FROM p) SELECT kept AS kept_id, id AS removed_id FROM k WHERE id <> kept")
def _(s, d):
    key = F.col("p_partkey")
    name = F.when(key % 2 == 0, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.concat_ws(" ", "p_type", F.array_join(F.reverse(F.split("p_name", " ")), " ")))
    return R.person_merges(table(s, d, "part").select(key.alias("entity_id"), name.alias("name")))


@query("person_name_pairs", "WITH p AS (SELECT p_partkey AS id, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS key FROM part WHERE p_size % 3 > 0), k AS (SELECT id, min(id) OVER (PARTITION BY key) AS kept FROM p) SELECT kept AS kept_id, id AS removed_id FROM k WHERE id <> kept")
def _(s, d):
    size = F.col("p_size")
    name = F.when(size % 3 == 0, F.concat_ws(" ", "p_name", "p_type")).when(size % 3 == 1, F.initcap("p_name")).otherwise(F.array_join(F.reverse(F.split("p_name", " ")), "  "))
    return R.person_merges(table(s, d, "part").select(F.col("p_partkey").alias("entity_id"), name.alias("name")), 2)


@query("stop_reasons", "SELECT event_type AS stopped, count(*)::BIGINT AS runs FROM events WHERE event_type <> 'click' GROUP BY ALL UNION ALL SELECT NULL, count(*)::BIGINT FROM events WHERE event_type = 'click' HAVING count(*) > 0")
def _(s, d):
    notes = F.concat(F.lit("started; "), F.when(F.col("event_type") == "click", "done").otherwise(F.concat(F.lit("stopped: "), "event_type")), F.lit("; kept"))
    return V.stop_reasons(table(s, d, "events").select(notes.alias("notes"))).groupBy("stopped").agg(F.count(F.lit(1)).alias("runs"))


@query("unique_anchor_targets", "SELECT lower(o_orderpriority) || '/' || o_custkey AS anchor, min(o_orderkey) AS page_id FROM orders GROUP BY 1 HAVING count(*) = 1")
def _(s, d):
    return R.unique_anchor_targets(table(s, d, "orders").select(F.col("o_orderkey").alias("to_page_id"), F.concat_ws("/", "o_orderpriority", F.col("o_custkey").cast("string")).alias("anchor")))


@query("status_counts", "SELECT o_orderpriority AS site, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 4 END AS class, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def _(s, d):
    status = F.when(F.col("o_orderstatus") == "F", 200 + F.col("o_orderkey") % 7).when(F.col("o_orderstatus") == "O", 404)
    return V.status_counts(table(s, d, "orders").select(F.col("o_orderpriority").alias("site"), status.alias("status"))).withColumn("class", F.col("class").cast("int"))


@query("name_functions", """SELECT p_partkey, replace(p_name, ' ', '') || '&' || lower(replace(p_brand, '#', '')) AS normal, p_name AS bare, [p_name, p_brand, p_type] AS parts, true AS starts, true AS short, p_brand AS ending, [strpos(lower(p_name || ' ' || p_type), lower(p_type)) - 1, strpos(lower(p_name || ' ' || p_type), lower(p_type)) - 1 + length(p_type)] AS place FROM part""")
def _(s, d):
    c, part = F.col, table(s, d, "part")
    both = F.concat(c("p_name"), F.lit(" and "), F.regexp_replace("p_brand", "#", ""))
    title = F.concat_ws(" ", "p_name", "p_type")
    return part.select(
        "p_partkey", X.normal_key(both).alias("normal"), X.without_legal_form(F.concat(c("p_name"), F.lit(", Kft."))).alias("bare"), X.label_parts(F.concat(c("p_name"), F.lit(" & "), c("p_brand"), F.lit(" / "), c("p_type"))).alias("parts"),
        X.occurs(X.alias_key(F.substring("p_name", 1, 5)), X.alias_key(c("p_name"))).alias("starts"), X.is_abbreviation(F.concat(F.substring("p_name", 1, 1), F.substring("p_name", 3, 1)), c("p_name")).alias("short"),
        F.element_at(X.title_endings(F.concat_ws(" | ", "p_name", "p_brand")), 1).alias("ending"), X.find_name(title, X.alias_key(c("p_type"))).alias("place"),
    )


@query("address_functions", f"""SELECT page_id, 'url:' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS grouped, CASE WHEN {PATH.format('url')} NOT IN ('', '/') THEN CASE WHEN {PATH.format('url')} LIKE '%/' THEN regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '') ELSE regexp_extract(url, '^([^?#]*)', 1) || '/' END || regexp_extract(url, '^[^?#]*(.*)$', 1) END AS other,
    CASE WHEN {PATH.format('url')} IN ('', '/') THEN 'other' ELSE 'parent_child' END AS to_home FROM pages""")
def _(s, d):
    u = F.col("url")
    none = F.array().cast("array<struct<lang:string,url:string>>")
    home = F.concat(F.regexp_extract(u, "^([a-zA-Z]+://[^/?#]+)", 1), F.lit("/"))
    related = F.when(U.path(u).isin("", "/"), "other").otherwise(U.relation(u, home))
    return table(s, d, "pages").select("page_id", U.group_key(u, none).alias("grouped"), U.slash_alternate(u).alias("other"), related.alias("to_home"))


@query("breadcrumb_trails", "SELECT p_partkey AS page_id, 'Home > ' || p_type || ' > ' || p_name AS trail FROM part")
def _(s, d):
    c = F.col
    block = F.concat(F.lit('{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"'), c("p_type"), F.lit('"},{"position":"1","item":{"@id":"https://s.example/","name":"Home"}},{"position":3,"name":"'), c("p_name"), F.lit('"}]}'))
    return table(s, d, "part").select(c("p_partkey").alias("page_id"), block.alias("b")).select("page_id", F.array_join(F.transform(T.breadcrumb_trail("b"), lambda x: x["name"]), " > ").alias("trail"))


@query("vote_counters", """WITH n AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, '{' || string_agg('"' || o_orderstatus || '":' || n, ',' ORDER BY o_orderstatus) || '}' AS counters FROM n GROUP BY o_custkey""")
def _(s, d):
    return A.vote_counters(table(s, d, "orders"), ["o_custkey"], "o_orderstatus")


@query("sitemap_rows", "SELECT p_type AS sitemap, count(*)::BIGINT AS urls, count(*) FILTER (WHERE p_size % 2 = 0)::BIGINT AS dated, min('https://s.example/?a&b=' || p_partkey) AS first FROM part GROUP BY ALL")
def _(s, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    entry = F.concat(F.lit("<url><loc> https://s.example/?a&amp;b="), key.cast("string"), F.lit("\n</loc>"), F.when(size % 2 == 0, "<lastmod>2024-01-01</lastmod>").otherwise(""), F.lit("</url>"))
    files = table(s, d, "part").groupBy(F.col("p_type").alias("sitemap")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    rows = H.sitemap_urls(files)
    return rows.groupBy("sitemap").agg(F.count(F.lit(1)).alias("urls"), F.count("lastmod").alias("dated"), F.min("loc").alias("first"))


@query("changed_inputs", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = docs.select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "old").otherwise("")), 256).alias("hash"))
    return A.changed_inputs(old, docs, "doc_id", F.col("text")).select("doc_id")


@query("cascaded_deletes", "SELECT l_orderkey AS page_id, count(*)::BIGINT AS mentions FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY ALL")
def _(s, d):
    gone = table(s, d, "orders").filter("o_orderstatus = 'O'")
    return A.cascaded(mentions(s, d), "page_id", gone, "o_orderkey").groupBy("page_id").agg(F.count(F.lit(1)).alias("mentions"))


@query("entities_within_blocks", "SELECT l_partkey * 100 + l_orderkey % 100 AS entity_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING bool_and(o_orderstatus <> 'O')")
def _(s, d):
    rows = mentions(s, d).withColumn("entity_id", F.col("entity_id") * 100 + F.col("page_id") % 100)  # few mentions each
    blocks = rows.join(table(s, d, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("page_id")), "page_id")
    return R.within_blocks(rows, blocks)
