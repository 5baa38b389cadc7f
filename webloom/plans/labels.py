"""Queries over acronyms, headings' relations, markup, requests and items above items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as B
from ..operators import links as L
from .graphs import EVIDENCE, main_entities
from .projections import mentions, query, table


@query(
    "acronym_expansions",
    """WITH r AS (SELECT p_partkey, p_name AS long, CASE WHEN p_size % 2 = 0 THEN upper(left(p_name, 3)) ELSE 'R' || p_size END AS short, p_size % 3 = 0 AS turned, p_size % 5 = 0 AS plain FROM part)
    SELECT p_partkey, CASE WHEN plain THEN '' WHEN turned THEN short || '|' || long ELSE long || '|' || short END AS parts, CASE WHEN NOT plain THEN long END AS long FROM r""",
)
def _(s, d):
    c = F.col
    short = F.when(c("p_size") % 2 == 0, F.upper(F.left("p_name", F.lit(3)))).otherwise(F.concat(F.lit("R"), c("p_size").cast("string")))
    pair = lambda a, b: F.concat(F.lit(" "), a, F.lit(" ("), b, F.lit(")"))
    text = F.when(c("p_size") % 5 == 0, pair(c("p_name"), F.lit("not short"))).when(c("p_size") % 3 == 0, pair(short, c("p_name"))).otherwise(pair(c("p_name"), short))
    return table(s, d, "part").select("p_partkey", F.array_join(B.expansions(text), "|").alias("parts"), B.long_form(text).alias("long"))


@query(
    "acronym_meanings",
    """WITH w AS (SELECT p_name, string_split(p_name, ' ') AS ws, p_size FROM part), f AS (SELECT upper(left(ws[1], 1) || left(ws[2], 1)) AS name, p_name AS form, CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 4 = 1 THEN 1 WHEN p_size % 4 = 2 THEN 2 ELSE 0 END AS k FROM w)
    SELECT name, form, sum(k)::BIGINT AS n FROM f WHERE k > 0 GROUP BY ALL""",
)
def _(s, d):
    c = F.col
    words = F.split("p_name", " ")
    name = F.upper(F.concat(F.left(words[0], F.lit(1)), F.left(words[1], F.lit(1))))
    first, second = F.concat(F.lit("we sell a "), "p_name", F.lit(" ("), name, F.lit(").")), F.concat(F.lit("Our "), name, F.lit(" ( "), "p_name", F.lit(" ) too"))
    text = F.when(c("p_size") % 4 == 0, first).when(c("p_size") % 4 == 1, second).when(c("p_size") % 4 == 2, F.concat(first, F.lit(" "), second)).otherwise(F.concat("p_name", F.lit(" (XY) and "), name, F.lit(" (one more word)")))
    return B.acronym_meanings(table(s, d, "part").select(text.alias("text")))


@query("international_names", "SELECT p_partkey, p_size % 3 = 0 AS international FROM part")
def _(s, d):
    text = F.when(F.col("p_size") % 6 == 0, "Works Remotely, too").when(F.col("p_size") % 3 == 0, "sold world-wide and GLOBAL").when(F.col("p_size") % 3 == 1, "a globalist, onliner")
    return table(s, d, "part").select("p_partkey", B.international(text).alias("international"))


@query("request_keys", "SELECT p_name AS name, count(*)::BIGINT AS requests, 1::BIGINT AS keys FROM part GROUP BY ALL")
def _(s, d):
    c = F.col
    words = F.split("p_name", " ")
    spelled = F.when(c("p_size") % 3 == 0, F.initcap("p_name")).when(c("p_size") % 3 == 1, F.concat_ws("%20%20", F.upper(words[0]), words[1])).otherwise(F.concat_ws("+", words[0], words[1]))
    titles = F.when(c("p_size") % 2 == 0, "A%7Cb|a").otherwise("b|A")
    rows = table(s, d, "part").select(c("p_name").alias("name"), B.request_key(F.concat(F.lit("https://k.example/w?q="), spelled, F.lit("&titles="), titles)).alias("key"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("key").alias("keys"))


@query(
    "markup_contradictions",
    """WITH r AS (SELECT p_partkey AS page_id, ['offer', 'product', 'article', 'support'][1 + p_partkey % 4] AS role, p_size % 3 = 0 AS a, p_size % 2 = 0 AS t FROM part)
    SELECT page_id, CASE WHEN role = 'article' THEN 'thing' ELSE 'article' END AS says, CASE WHEN role = 'article' THEN 'Product' ELSE 'Article, BlogPosting' END AS types FROM r WHERE (role IN ('offer', 'product') AND a AND NOT t) OR (role = 'article' AND t AND NOT a)""",
)
def _(s, d):
    c = F.col
    role = F.element_at(F.array(*map(F.lit, ("offer", "product", "article", "support"))), (1 + c("p_partkey") % 4).cast("int"))
    article, thing = F.when(c("p_size") % 3 == 0, F.array(F.lit("BlogPosting"), F.lit("Article"))).otherwise(F.array(F.lit("WebPage"))), F.when(c("p_size") % 2 == 0, F.array(F.lit("Product"))).otherwise(F.array().cast("array<string>"))
    return B.markup_contradictions(table(s, d, "part").select(c("p_partkey").alias("page_id"), role.alias("role"), F.concat(article, thing).alias("types")))


@query(
    "heading_relations",
    f"""WITH {EVIDENCE}, u AS (SELECT p_partkey AS f, p_partkey // 20 AS t FROM part WHERE p_size > 10), h AS (SELECT DISTINCT page_id, ordinal, entity_id FROM m WHERE position = 'heading'),
    hm AS (SELECT h.*, main.entity_id AS main_id FROM h LEFT JOIN main ON main.page_id = h.page_id AND role = 'main')
    SELECT page_id, ordinal, entity_id, CASE WHEN main_id IS NULL THEN 'no_main' WHEN main_id = entity_id THEN 'main' WHEN (a.t = main_id) OR (b.t = entity_id) OR (a.t = b.t) THEN 'related' ELSE 'unrelated' END AS relation
    FROM hm LEFT JOIN u a ON a.f = entity_id LEFT JOIN u b ON b.f = main_id""",
)
def _(s, d):
    heads = mentions(s, d).filter("position = 'heading'").select("page_id", "ordinal", "entity_id").distinct()
    up = table(s, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("from_id"), F.floor(F.col("p_partkey") / 20).alias("to_id"))
    return B.heading_relations(heads, main_entities(s, d), up)


@query("steps_retyped", """WITH e AS (SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN 'service' ELSE 'org' END AS type, CASE p_size % 3 WHEN 0 THEN 'offer' END AS tier, CASE p_size % 5 WHEN 0 THEN 'rule' ELSE 'llm' END AS source FROM part), h AS (SELECT *, type = 'service' AND source = 'llm' AND tier IS NULL AS hit FROM e)
    SELECT p_partkey, CASE WHEN hit THEN 'concept' ELSE type END AS type, CASE WHEN hit THEN 'method' END AS subtype, CASE WHEN hit THEN 'step' ELSE tier END AS tier, source, CASE WHEN hit THEN 'service' END AS type_changed_from FROM h""")
def _(s, d):
    z = F.col("p_size")
    rows = table(s, d, "part").select("p_partkey", F.when(z % 2 == 0, "service").otherwise("org").alias("type"), F.lit(None).cast("string").alias("subtype"), F.when(z % 3 == 0, "offer").alias("tier"), F.when(z % 5 == 0, "rule").otherwise("llm").alias("source"))
    return B.steps_retyped(rows)


@query(
    "items_above",
    """WITH i AS (SELECT DISTINCT c_nationkey AS level, '/' || c_mktsegment || CASE WHEN c_custkey % 3 > 0 THEN '/' || c_custkey % 3 || CASE WHEN c_custkey % 7 < 3 THEN '/x' || c_custkey % 5 ELSE '' END ELSE '' END AS path FROM customer), p AS (SELECT a.level, a.path, max_by(b.path, len(b.path)) AS above FROM i a JOIN i b ON a.level = b.level AND starts_with(a.path, b.path || '/') GROUP BY ALL)
    SELECT level, 'https://s.example' || path AS url, 'https://s.example' || above AS above FROM i LEFT JOIN p USING (level, path)""",
)
def _(s, d):
    k = F.col("c_custkey")
    tail = F.when(k % 3 > 0, F.concat(F.lit("/"), (k % 3).cast("string"), F.when(k % 7 < 3, F.concat(F.lit("/x"), (k % 5).cast("string"))).otherwise(""))).otherwise("")
    return B.items_above(table(s, d, "customer").select(F.col("c_nationkey").alias("level"), F.concat(F.lit("https://s.example/"), "c_mktsegment", tail).alias("url")))


@query("structured_in_order", """WITH r AS (SELECT l_orderkey AS page_id, l_linenumber AS ordinal, l_returnflag = 'A' AS ld, l_partkey::VARCHAR AS json, CASE WHEN l_returnflag = 'A' THEN 'jsonld' ELSE 'microdata' END AS syntax, l_linestatus AS type FROM lineitem)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY NOT ld, ordinal, syntax, type, json) - 1 AS place, syntax, type, json FROM r""")
def _(s, d):
    c = F.col
    rows = table(s, d, "lineitem").select(c("l_orderkey").alias("page_id"), c("l_linenumber").alias("ordinal"), F.lit("microdata").alias("syntax"), c("l_linestatus").alias("type"), c("l_partkey").cast("string").alias("json"), "l_returnflag")
    return B.structured_in_order(rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag <> 'A'"))


@query(
    "link_rows",
    """WITH l AS (SELECT l_orderkey AS from_page_id, l_linenumber AS ordinal, min(l_partkey) AS t FROM lineitem GROUP BY ALL) SELECT from_page_id, ordinal, 'https://s.example/a/p' || t AS to_url, CASE WHEN t % 3 < 2 THEN t END AS to_page_id, CASE t % 3 WHEN 0 THEN 'stored' WHEN 1 THEN 'inferred' ELSE 'none' END AS resolution FROM l""",
)
def _(s, d):
    c = F.col
    rows = table(s, d, "lineitem").groupBy(c("l_orderkey").alias("from_page_id"), c("l_linenumber").alias("ordinal")).agg(F.min("l_partkey").alias("t"))
    links = rows.select("from_page_id", "ordinal", F.concat(F.lit("https://s.example/a/p"), c("t").cast("string")).alias("to_url"), F.when(c("t") % 3 == 0, c("t")).alias("to_page_id"))
    key = c("p_partkey")
    pages = table(s, d, "part").filter(key % 3 == 1).select(key.alias("page_id"), F.concat(F.lit("https://s.example/p"), key.cast("string")).alias("url"))
    return B.link_rows(links, L.unique_suffix_targets(links, pages))


@query(
    "aligned_headings",
    """WITH x AS (SELECT l_orderkey AS p, l_linenumber AS o, min(l_quantity) AS q FROM lineitem GROUP BY ALL), h AS (SELECT p, o, CASE WHEN q < 15 THEN 2 ELSE 3 END AS level FROM x WHERE q < 40),
    g AS (SELECT p, o, last_value(CASE WHEN level = 2 THEN o END IGNORE NULLS) OVER (PARTITION BY p ORDER BY o) AS s FROM h), b AS (SELECT p, s, o, row_number() OVER (PARTITION BY p, s ORDER BY o) AS k FROM g WHERE s IS NOT NULL),
    t AS (SELECT p, s, count(*) AS n, row_number() OVER (PARTITION BY p ORDER BY s) AS i, count(*) OVER (PARTITION BY p) AS c FROM b GROUP BY p, s),
    j AS (SELECT DISTINCT a.p AS lp, z.p AS rp, least(a.c, z.c) AS m FROM t a JOIN t z ON z.p = a.p + 1 WHERE a.p % 2 = 0),
    f AS (SELECT lp, rp, m, coalesce((SELECT min(a.i) - 1 FROM t a JOIN t z ON z.i = a.i WHERE a.p = lp AND z.p = rp AND a.n <> z.n), m) AS front FROM j),
    e AS (SELECT *, least(m - front, coalesce((SELECT min(a.c - a.i) FROM t a JOIN t z ON z.c - z.i = a.c - a.i WHERE a.p = lp AND z.p = rp AND a.n <> z.n), m)) AS back FROM f)
    SELECT lp AS left_id, rp AS right_id, u.o AS left_block, v.o AS right_block FROM e JOIN t a ON a.p = lp JOIN t z ON z.p = rp AND ((a.i = z.i AND a.i <= front) OR (a.c - a.i = z.c - z.i AND a.c - a.i < back))
    JOIN b u ON u.p = lp AND u.s = a.s JOIN b v ON v.p = rp AND v.s = z.s AND v.k = u.k""",
)
def _(s, d):
    c = F.col
    rows = table(s, d, "lineitem").groupBy(c("l_orderkey").alias("page_id"), c("l_linenumber").alias("ordinal")).agg(F.min("l_quantity").alias("q")).filter("q < 40")
    heads = rows.select("page_id", c("ordinal").alias("block_id"), "ordinal", F.when(c("q") < 15, 2).otherwise(3).alias("level"))
    return B.aligned_headings(table(s, d, "orders").filter("o_orderkey % 2 = 0").select(c("o_orderkey").alias("left_id"), (c("o_orderkey") + 1).alias("right_id")), heads)
