"""Queries over offers, names, roles and knowledge classes, made of the parts, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import analytics as A
from ..operators import findings as D
from ..operators import offers as O
from ..operators import resolve as R
from ..operators import views as V
from .projections import MENTIONS, QUERIES, mentions, query, table


def line_blocks(s, d):
    """An order's line items as its blocks: every kind, prices and rates among them."""
    c = F.col
    kind = F.element_at(F.array(*map(F.lit, ("heading", "table_row", "paragraph", "code"))), (1 + c("l_suppkey") % 4).cast("int"))
    price = F.when(c("l_quantity") <= 20, F.concat(F.lit(" from "), c("l_partkey").cast("string"), F.lit(" EUR"))).when(c("l_quantity") <= 22, F.lit(" 30 EUR / hour")).otherwise("")
    rows = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    rows = rows.join(table(s, d, "part").select(c("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return rows.select(c("l_orderkey").alias("page_id"), c("l_linenumber").alias("ordinal"), kind.alias("kind"), F.concat("p_name", price).alias("text"), F.concat("p_name", F.lit(" | x"), price).alias("first_cell"))


BLOCKS = """x AS (SELECT l_orderkey AS page_id, l_linenumber AS ordinal, l_suppkey, l_quantity, p_name FROM lineitem JOIN part ON p_partkey = l_partkey QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
b AS (SELECT page_id, ordinal, l_suppkey % 4 AS k, p_name AS name, l_quantity <= 22 AS priced, l_quantity > 20 AND l_quantity <= 22 AS rate, row_number() OVER (PARTITION BY page_id ORDER BY ordinal) AS i FROM x)"""


@query(
    "pricing_rows",
    f"""WITH {BLOCKS}, p AS (SELECT * FROM b WHERE priced AND NOT rate AND k <> 1), c AS (SELECT p.page_id, p.i, q.ordinal, q.name, row_number() OVER (PARTITION BY p.page_id, p.i ORDER BY q.i DESC) AS near
      FROM p JOIN b q ON q.page_id = p.page_id AND q.i < p.i AND q.i >= p.i - 4 WHERE NOT q.priced AND q.k IN (0, 2) AND NOT EXISTS (SELECT 1 FROM b z WHERE z.page_id = p.page_id AND z.i < p.i AND z.i > q.i AND z.priced))
    SELECT page_id, ordinal, name FROM b WHERE priced AND NOT rate AND k = 1 UNION ALL SELECT page_id, ordinal, name FROM c WHERE near = 1""",
)
def _(s, d):
    return O.pricing_rows(line_blocks(s, d))


@query(
    "product_attributes",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size || ' kW' WHEN p_size % 4 = 1 THEN p_size || ',5 M3/h' END AS capacity, CASE WHEN p_size % 3 = 0 THEN 3 WHEN p_size % 3 = 1 THEN 1 END::INT AS phase,
    CASE WHEN p_size % 5 < 2 THEN 'A++' END AS energy_class, CASE WHEN p_size % 7 = 0 THEN 'CW09-' || p_partkey END AS model FROM part""",
)
def _(s, d):
    c = F.col
    size = c("p_size").cast("string")
    name = F.concat_ws(
        " ", "p_name", F.when(c("p_size") % 4 == 0, F.concat(size, F.lit("kW,"))).when(c("p_size") % 4 == 1, F.concat(size, F.lit(",5 M3/h"))), F.when(c("p_size") % 3 == 0, F.lit("(3Fázis)")).when(c("p_size") % 3 == 1, F.lit("1 fázis")),
        F.when(c("p_size") % 5 < 2, F.lit("A++")), F.when(c("p_size") % 7 == 0, F.concat(F.lit("CW09-"), c("p_partkey").cast("string"))),
    )
    return table(s, d, "part").select("p_partkey", O.product_attributes(name).alias("a")).select("p_partkey", "a.*")


@query("surface_spans", """WITH w AS (SELECT page_id, 12 + len(p_name) AS a, len(p_name) AS n FROM (SELECT p_partkey AS page_id, p_name FROM part)) SELECT page_id, unnest([0, a]) AS start, unnest([n, a + n + 1]) AS "end" FROM w""")
def _(s, d):
    name = F.col("p_name")
    text = F.concat(F.upper(name), F.lit(", xé"), name, F.lit(" "), name, F.lit("es; my "), F.replace(name, F.lit(" "), F.lit(" \n")), F.lit("."))
    # Of the four places the second follows a letter, the third is followed by one.
    rows = table(s, d, "part").select(F.col("p_partkey").alias("page_id"), F.length(name).alias("n"), O.surface_spans(text, name).alias("spans"))
    return rows.select("page_id", "n", F.posexplode("spans").alias("i", "x")).select("page_id", (F.col("x.start") - F.when(F.col("i") == 1, 2 * F.col("n")).otherwise(0)).alias("start"), (F.col("x.end") - F.when(F.col("i") == 1, 2 * F.col("n")).otherwise(0)).alias("end"))


@query("offer_relations", """WITH k AS (SELECT p_name AS name, min(p_partkey) AS to_id FROM part WHERE p_size <= 3 GROUP BY p_name), o AS (SELECT a.p_partkey AS from_id, unnest([a.p_name, b.p_name]) AS part FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size > 3)
    SELECT from_id, to_id, min(part) AS part FROM o JOIN k ON k.name = o.part GROUP BY ALL""")
def _(s, d):
    c = F.col
    rows = table(s, d, "part")
    other = rows.select((c("p_partkey") - 1).alias("p_partkey"), c("p_name").alias("next"))
    offers = rows.filter("p_size > 3").join(other, "p_partkey").select(c("p_partkey").alias("entity_id"), F.array(F.concat_ws(" & ", "p_name", "next"), c("p_name")).alias("names"))
    return O.offer_relations(offers, rows.filter("p_size <= 3").select(c("p_partkey").alias("concept_id"), F.initcap("p_name").alias("name")))


TYPES = "['tech', 'concept', 'org', 'service']"


@query(
    "class_relations",
    f"""WITH e AS (SELECT s_suppkey AS id, {TYPES}[1 + s_suppkey % 4] AS type, CASE WHEN s_suppkey = 7 THEN 'Q35120' WHEN s_suppkey % 5 > 0 THEN 'Q' || s_suppkey // 2 END AS kb FROM supplier), c AS (SELECT DISTINCT 'Q' || l_suppkey // 2 AS kb, CASE l_returnflag WHEN 'A' THEN 'P31' ELSE 'P279' END AS property, CASE WHEN l_partkey % 40 = 3 THEN 'Q35120' ELSE 'Q' || l_partkey % 40 END AS class FROM lineitem),
    r AS (SELECT a.id AS from_id, b.id AS to_id, property, CASE WHEN class = 'Q35120' THEN 'generic_class' WHEN property = 'P31' AND a.type NOT IN ('tech', 'org') THEN 'instance_of_type' WHEN a.type IN ('tech', 'concept') AND b.type <> a.type THEN 'other_type' END AS reason
      FROM e a JOIN c ON c.kb = a.kb JOIN e b ON b.kb = c.class WHERE c.class <> c.kb AND a.id <> b.id)
    SELECT from_id, to_id, property, reason FROM r QUALIFY row_number() OVER (PARTITION BY from_id, to_id ORDER BY reason IS NOT NULL, property, reason NULLS FIRST) = 1""",
)
def _(s, d):
    c = F.col
    q = lambda x: F.concat(F.lit("Q"), x.cast("string"))
    key = c("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("tech", "concept", "org", "service"))), (1 + key % 4).cast("int"))
    kb = F.when(key == 7, "Q35120").when(key % 5 > 0, q(F.floor(key / 2)))
    entities = table(s, d, "supplier").select(key.alias("entity_id"), kind.alias("type"), kb.alias("kb_id"))
    n = c("l_partkey") % 40
    classes = table(s, d, "lineitem").select(q(F.floor(c("l_suppkey") / 2)).alias("kb_id"), F.when(c("l_returnflag") == "A", "P31").otherwise("P279").alias("property"), F.when(n == 3, "Q35120").otherwise(q(n)).alias("class_id")).distinct()
    return O.class_relations(entities, classes)


@query("evidence_texts", """WITH e AS (SELECT l_orderkey AS page_id, CASE l_returnflag WHEN 'A' THEN 'h1' WHEN 'R' THEN 'primary#' || min(l_linenumber) ELSE 'top_mentions:' || min(l_linenumber) END AS text, CASE l_returnflag WHEN 'A' THEN 4 WHEN 'R' THEN 3 ELSE 5 END AS rank FROM lineitem GROUP BY l_orderkey, l_returnflag)
    SELECT page_id, string_agg(text, '; ' ORDER BY rank) AS evidence FROM e GROUP BY page_id""")
def _(s, d):
    kind = F.create_map(F.lit("A"), F.lit("h1"), F.lit("R"), F.lit("primary"), F.lit("N"), F.lit("top_mentions"))[F.col("l_returnflag")]
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), kind.alias("kind")).agg(F.min("l_linenumber").cast("string").alias("detail"))
    return rows.groupBy("page_id").agg(O.evidence_text(F.collect_list(F.struct("kind", "detail"))).alias("evidence"))


@query("site_names", """WITH n AS (SELECT p_type AS site, 'Shop of ' || p_type AS name, count(*) FILTER (WHERE p_size <= 20)::BIGINT AS pages, count(*) FILTER (WHERE p_size > 20 AND p_size <= 40)::BIGINT AS other FROM part GROUP BY ALL)
    SELECT site, name, pages FROM n UNION ALL SELECT site, 'Outlet', other FROM n""")
def _(s, d):
    c = F.col
    shop = F.concat(F.lit("Shop of "), c("p_type"))
    # Titles end with the shop's name, after its section for many; those of the dearer parts with another name.
    end = F.when(c("p_size") <= 12, F.concat(F.lit(" - Tools | "), shop)).when(c("p_size") <= 20, F.concat(F.lit(" | "), shop)).when(c("p_size") <= 40, F.lit(" – Outlet")).otherwise("")
    return O.site_names(table(s, d, "part").select(c("p_type").alias("site"), c("p_partkey").alias("page_id"), F.concat(F.lit("n"), c("p_partkey").cast("string"), end).alias("title")))


@query(
    "node_roles",
    """WITH r AS (SELECT p_partkey AS page_id, p_size AS z, ['support', 'article', 'product'][1 + p_partkey % 3] AS role FROM part)
    SELECT page_id, CASE WHEN z = 1 THEN 'home' WHEN z = 2 THEN role WHEN z = 3 THEN 'support' WHEN z = 4 AND role <> 'product' THEN 'support' WHEN z = 5 THEN 'listing' WHEN z = 6 THEN role WHEN z = 7 AND role <> 'product' THEN 'listing' WHEN z IN (8, 9) AND role = 'support' THEN 'profile'
        WHEN z = 10 THEN role WHEN z = 11 THEN role WHEN z = 12 THEN 'listing' WHEN z = 13 THEN 'category' WHEN z = 14 THEN 'listing' WHEN z >= 40 AND role <> 'product' THEN 'listing' ELSE role END AS role,
      CASE WHEN z IN (2, 6) THEN 'placeholder' WHEN z = 3 THEN 'legal' WHEN z = 4 AND role <> 'product' THEN 'contact' WHEN z IN (5, 12, 14) THEN 'list' WHEN z = 7 AND role <> 'product' THEN 'list' WHEN z = 10 THEN 'contact' WHEN z = 11 THEN 'checkout' WHEN z >= 40 AND role <> 'product' THEN 'list' END AS support_kind FROM r""",
)
def _(s, d):
    z, c = F.col("p_size"), F.col
    path = F.when(z == 4, "en/Kapcsolat_felvetel").when(z == 7, "shop/Category/x").when(z == 8, "x?tab=about-us").when(z == 15, "not-a-recontact").otherwise("p")
    kind = F.when(z == 5, "list").when(z == 6, "not_found").when(z == 12, "brand_category").when(z.isin(13, 14), "category").otherwise("other")
    types = F.when(z == 9, F.array(F.lit("ProfilePage"))).when(z == 10, F.array(F.lit("ContactPage"))).when(z == 11, F.array(F.lit("CheckoutPage")))
    role = F.element_at(F.array(*map(F.lit, ("support", "article", "product"))), (1 + c("p_partkey") % 3).cast("int"))
    return O.node_roles(table(s, d, "part").select(c("p_partkey").alias("page_id"), F.concat(F.lit("https://s.example/"), path).alias("url"), role.alias("role"), kind.alias("page_type"), types.alias("types"), (z == 1).alias("is_home"), (z == 2).alias("placeholder"), (z == 3).alias("legal"), (z == 13).alias("has_anchor"), F.when(z >= 40, 0.6).otherwise(0.5).alias("list_share")))


@query("verified_items", """WITH i AS (SELECT DISTINCT l_orderkey AS page_id, p_name AS name, p_type AS type FROM lineitem JOIN part ON p_partkey = l_partkey), v AS (SELECT l_orderkey AS page_id, p_name AS name, p_type AS type, arg_max(l_linestatus = 'O', (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS keep FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'A' GROUP BY ALL)
    SELECT * FROM i ANTI JOIN (SELECT * FROM v WHERE NOT keep) USING (page_id, name, type)""")
def _(s, d):
    c = F.col
    rows = table(s, d, "lineitem").join(table(s, d, "part").select(c("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")
    each = rows.select(c("l_orderkey").alias("page_id"), c("p_name").alias("name"), c("p_type").alias("type"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("run_id"), (c("l_linestatus") == "O").alias("keep"), "l_returnflag")
    return O.verified(each.select("page_id", "name", "type").distinct(), each.filter("l_returnflag <> 'A'"))


@query("filler_pages", "SELECT page_id FROM (SELECT l_orderkey AS page_id, count(*) AS n, count(*) FILTER (WHERE l_quantity < 25) AS f FROM lineitem WHERE l_returnflag <> 'A' AND l_linestatus = 'F' GROUP BY ALL) WHERE n * 4 >= 20 AND 2 * f >= n")
def _(s, d):
    c = F.col
    text = F.when(c("l_quantity") < 25, "Lorem ipsum, DOLOR amet; a 12").otherwise("four plain words here 7 x")
    rows = table(s, d, "lineitem").select(c("l_orderkey").alias("page_id"), F.when(c("l_returnflag") == "A", "title").otherwise("paragraph").alias("kind"), F.when(c("l_linestatus") == "F", "content").otherwise("chrome").alias("region"), text.alias("text"))
    return O.filler_pages(rows)


@query("duplicate_mentions", """WITH m AS (SELECT l_orderkey AS page_id, CASE WHEN l_tax > 0.01 THEN l_linenumber END AS block, l_partkey AS entity_id, l_suppkey AS surface, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax) AS id FROM lineitem)
    SELECT b.page_id, b.block, b.entity_id, b.surface, count(*)::BIGINT AS rows FROM m a JOIN m b ON a.page_id = b.page_id AND a.block IS NOT DISTINCT FROM b.block AND (a.entity_id = b.entity_id OR a.surface = b.surface) AND a.id <> b.id GROUP BY ALL""")
def _(s, d):
    c = F.col
    order = [F.asc(x) for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")]
    rows = A.identified(table(s, d, "lineitem"), "id", order).select(c("l_orderkey").alias("page_id"), F.when(c("l_tax") > 0.01, c("l_linenumber")).alias("block"), c("l_partkey").alias("entity_id"), c("l_suppkey").alias("surface"), "id")
    a, b = rows.alias("a"), rows.alias("b")
    same = (c("a.page_id") == c("b.page_id")) & c("a.block").eqNullSafe(c("b.block")) & ((c("a.entity_id") == c("b.entity_id")) | (c("a.surface") == c("b.surface"))) & (c("a.id") != c("b.id"))
    return a.join(b, same).groupBy("b.page_id", "b.block", "b.entity_id", "b.surface").agg(F.count(F.lit(1)).alias("rows"))


@query("calls_within_budget", "SELECT event_id, coalesce(sum(event_id % 100) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent, spent + 50 <= 40000 AS allowed FROM events")
def _(s, d):
    calls = table(s, d, "events").select("event_id", "event_type", (F.col("event_id") % 100).alias("cost"))
    return V.within_budget(calls, ["event_type"], ["event_id"], "cost", 50, 40000).select("event_id", "spent", "allowed")


@query("overruns", """WITH p AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, epoch_us(ts) // 1000000 - min(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id) AS seconds FROM events),
    t AS (SELECT *, max(CASE WHEN page = 10 THEN seconds END) OVER (PARTITION BY run_id) / 10.0 AS pace FROM p) SELECT run_id, min(page) FILTER (WHERE page > 10 AND seconds > 1.5 * pace * 30)::INT AS stop FROM t GROUP BY run_id""")
def _(s, d):
    user = Window.partitionBy("user_id")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(s, d, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(user.orderBy("ts", "event_id")).alias("page"), (at - F.min(at).over(user)).alias("seconds"), F.lit(30).alias("expected"))
    return V.overrun(rows, 1.5)


@query("template_mentions", f"WITH {MENTIONS} SELECT entity_id FROM m GROUP BY entity_id HAVING bool_and(skip OR ordinal < 6)")
def _(s, d):
    return R.template_entities(mentions(s, d).withColumn("template", F.expr("skip OR ordinal < 6")))


@query("volatile_hashes", "SELECT p_partkey, sha256('<p>' || p_name || '</p>') AS stable FROM part")
def _(s, d):
    key = F.col("p_partkey").cast("string")
    changing = (
        F.concat(F.lit(' data-cfemail="'), F.hex("p_partkey"), F.lit('"')), F.concat(F.lit(' nonce="n'), key, F.lit('"')), F.concat(F.lit("<!-- W3 Total Cache "), key, F.lit(" -->")), F.concat(F.lit("<!-- page generated in 0."), key, F.lit(" seconds -->")),
        F.concat(F.lit('<meta name="csrf-token" content="'), key, F.lit('">')), F.concat(F.lit("<!-- 2024-01-01 10:00 "), key, F.lit("-->")), F.concat(F.lit("<!--x 1712345678 "), key, F.lit("-->")), F.concat(F.lit("<!--"), key, F.lit(" ms-->")),
    )
    token = F.element_at(F.array(*changing), (1 + F.col("p_size") % len(changing)).cast("int"))
    inside = F.col("p_size") % len(changing) <= 1  # attributes stand in the tag, the rest after it
    page = F.concat(F.lit("<p"), F.when(inside, token).otherwise(""), F.lit(">"), "p_name", F.when(inside, "").otherwise(token), F.lit("</p>"))
    return table(s, d, "part").select("p_partkey", X.stable_hash(page).alias("stable"))


@query(
    "heading_rules",
    f"""WITH s AS ({QUERIES["heading_sections"][1]}), t AS (SELECT *, CASE WHEN ordinal % 3 = 0 THEN repeat('word ', 12) || ordinal ELSE 'h' || ordinal END AS text FROM s), p AS (SELECT l_orderkey AS page_id, sum(l_partkey) AS words FROM lineitem GROUP BY ALL),
    h AS (SELECT page_id, words, count(*) FILTER (WHERE level = 1) AS h1, count(*) FILTER (WHERE level = 2) AS h2 FROM p LEFT JOIN s USING (page_id) GROUP BY ALL),
    f AS (SELECT 'missing_h1' AS type, 'high' AS severity, page_id, '' AS evidence FROM h WHERE h1 = 0 UNION ALL SELECT 'multiple_h1', 'low', page_id, h1::VARCHAR FROM h WHERE h1 > 1 UNION ALL SELECT 'missing_h2', 'low', page_id, words::VARCHAR FROM h WHERE h2 = 0 AND words > 600
      UNION ALL SELECT 'skipped_level', 'low', page_id, text FROM t WHERE skipped UNION ALL SELECT CASE WHEN ordinal % 3 = 0 THEN 'paragraph_heading' ELSE 'empty_section' END, 'low', page_id, text FROM t WHERE empty)
    SELECT *, NULL::BIGINT AS entity_id FROM f""",
)
def _(s, d):
    heads = QUERIES["heading_sections"][0](s, d)
    text = F.when(F.col("ordinal") % 3 == 0, F.concat(F.repeat(F.lit("word "), F.lit(12)), F.col("ordinal").cast("string"))).otherwise(F.concat(F.lit("h"), F.col("ordinal").cast("string")))
    pages = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.sum("l_partkey").alias("words"))
    return D.heading_findings(pages, heads, heads.select("page_id", "ordinal", "level", text.alias("text")))
