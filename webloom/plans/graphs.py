"""Graph queries: weights, main entities, depths, chains, components, sections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import analytics as A
from ..operators import findings as D
from ..operators import graph as G
from .projections import LINKS, MENTIONS, QUERIES, links, mentions, query, table

#: Evidence from mentions: title lines speak for the h1, heading lines for the list of primary entities, the rest are
#: mentions. Orders next to each other are one page in two languages.
EVIDENCE = f"""{MENTIONS}, e AS (
  SELECT page_id, entity_id, CASE position WHEN 'title' THEN 'h1' WHEN 'heading' THEN 'primary' ELSE 'top_mentions' END AS kind, ordinal, count(*) OVER (PARTITION BY page_id, entity_id) AS n FROM m WHERE NOT skip
), g AS (
  SELECT page_id, page_id // 2 AS pair, entity_id, min(CASE kind WHEN 'h1' THEN 4 WHEN 'primary' THEN 3 ELSE 5 END) AS best, count(DISTINCT kind) AS kinds, max(n) AS n, min(ordinal - 1) FILTER (WHERE kind = 'primary') AS ix,
    bool_or(kind = 'primary') AS p, bool_or(kind = 'h1') AS h, bool_or(kind = 'top_mentions') AS t, list(DISTINCT kind) AS ks FROM e GROUP BY ALL
), pr AS (
  SELECT o_orderkey // 2 AS pair, count(*) > 1 AS paired FROM orders GROUP BY ALL
), q AS (
  SELECT pair, entity_id, min(ix) AS pix, count(*) FILTER (WHERE p) AS lists, len(list_distinct(flatten(list(ks)))) AS pk, sum(n) AS pn, bool_or(p AND page_id % 2 = 0) AS pf FROM g GROUP BY ALL
), r AS (
  SELECT g.*, pix, row_number() OVER (PARTITION BY page_id ORDER BY best, coalesce(pix, 99), CASE WHEN paired THEN lists ELSE 0 END DESC, pk DESC, pn DESC, paired AND pf DESC, CASE WHEN paired THEN g.entity_id ELSE 0 END, kinds DESC, n DESC, g.entity_id) AS place
  FROM g JOIN pr ON pr.pair = g.pair JOIN q ON q.pair = g.pair AND q.entity_id = g.entity_id
), chosen AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place)::BIGINT AS rank FROM r WHERE place = 1 OR (h AND p)
), main AS (
  SELECT page_id, entity_id, CASE WHEN rank = 1 THEN 'main' ELSE 'secondary' END AS role, rank,
    CASE WHEN rank > 1 THEN NULL WHEN p AND h THEN 'strong' WHEN coalesce(pix, 99) = 0 OR (p AND t) OR (h AND (p OR t)) THEN 'medium' ELSE 'weak' END AS confidence FROM chosen WHERE rank <= 3
)"""


def evidence(s, d):
    rows = mentions(s, d).filter("NOT skip")
    n = rows.groupBy("page_id", "entity_id").agg(F.count(F.lit(1)).alias("mentions"))
    kind = F.create_map(F.lit("title"), F.lit("h1"), F.lit("heading"), F.lit("primary"), F.lit("body"), F.lit("top_mentions"))[F.col("position")]
    index = F.min(F.when(F.col("kind") == "primary", F.col("ordinal") - 1)).alias("primary_index")
    return rows.withColumn("kind", kind).groupBy("page_id", "entity_id", "kind").agg(index).join(n, ["page_id", "entity_id"])


def language_pairs(s, d):
    key = F.col("o_orderkey")
    return table(s, d, "orders").select(key.alias("page_id"), F.floor(key / 2).alias("pair_id"), (key % 2 == 0).alias("first_lang"))


@query("main_entities", f"WITH {EVIDENCE} SELECT * FROM main")
def main_entities(s, d):
    return G.main_entities(evidence(s, d), language_pairs(s, d))


@query("mention_edges", f"WITH {MENTIONS} SELECT page_id, entity_id, sum(CASE position WHEN 'title' THEN 3.0 WHEN 'heading' THEN 2.0 ELSE 1.0 END * n)::DOUBLE AS weight FROM m WHERE NOT skip GROUP BY ALL")
def _(s, d):
    return G.mention_edges(mentions(s, d))


WEIGHTS = f"""{EVIDENCE}, {LINKS}, c AS (
  SELECT entity_id, count(DISTINCT page_id) AS pages, sum(n) AS mentions, count(DISTINCT page_id) FILTER (WHERE position <> 'body') AS structural FROM m WHERE NOT skip GROUP BY entity_id
), hm AS (SELECT entity_id, count(DISTINCT page_id) FILTER (WHERE role = 'main') AS main_pages, count(DISTINCT page_id) FILTER (WHERE role <> 'main') AS secondary_pages FROM main GROUP BY entity_id
), an AS (SELECT entity_id, count(*) FILTER (WHERE position = 'body') AS content_anchors, count(DISTINCT o_custkey) FILTER (WHERE position <> 'body') AS nav_anchors FROM main JOIN l ON to_id = page_id WHERE role = 'main' GROUP BY entity_id
), x AS (
  SELECT entity_id, pages::BIGINT AS pages, mentions::BIGINT AS mentions, structural::BIGINT AS structural, coalesce(main_pages, 0)::BIGINT AS main_pages, coalesce(secondary_pages, 0)::BIGINT AS secondary_pages,
    coalesce(content_anchors, 0)::BIGINT AS content_anchors, coalesce(nav_anchors, 0)::BIGINT AS nav_anchors FROM c LEFT JOIN hm USING (entity_id) LEFT JOIN an USING (entity_id)
), w AS (
  SELECT *, round((log2(1 + pages::DOUBLE) + 0.5 * log2(1 + mentions::DOUBLE) + log2(1 + structural::DOUBLE) + 2 * log2(1 + main_pages::DOUBLE) + 0.5 * log2(1 + content_anchors::DOUBLE) + 0.1 * log2(1 + nav_anchors::DOUBLE)) * CASE WHEN mentions = 1 THEN 0.25 ELSE 1.0 END, 4) AS weight FROM x
)"""


def weights(s, d):
    inbound = links(s, d).select(F.col("to_id").alias("to_page_id"), F.col("o_custkey").alias("group"), (F.col("position") == "body").alias("body"))
    return G.entity_weights(mentions(s, d), main_entities(s, d), inbound)


@query("entity_weights", f"WITH {WEIGHTS} SELECT * FROM w")
def _(s, d):
    return weights(s, d)


@query("unclear_topic", f"WITH {EVIDENCE} SELECT 'unclear_topic' AS type, CASE WHEN confidence IS NULL THEN 'high' ELSE 'medium' END AS severity, o_orderkey AS page_id, entity_id, coalesce(confidence, 'none') AS evidence FROM orders LEFT JOIN (SELECT * FROM main WHERE role = 'main') ON o_orderkey = page_id WHERE confidence IS NULL OR confidence = 'weak'")
def unclear(s, d):
    return D.unclear_topic(table(s, d, "orders").select(F.col("o_orderkey").alias("page_id")), main_entities(s, d))


@query("uncovered_topic", f"WITH {WEIGHTS}, t AS (SELECT * FROM w ORDER BY weight DESC, entity_id LIMIT (SELECT ceil(count(*) * 0.1)::BIGINT FROM w)) SELECT 'uncovered_topic' AS type, CASE WHEN pages >= 10 THEN 'medium' ELSE 'low' END AS severity, NULL::BIGINT AS page_id, entity_id, p_name AS evidence FROM t JOIN part ON p_partkey = entity_id WHERE main_pages = 0 AND pages >= 3")
def uncovered(s, d):
    return D.uncovered_topics(weights(s, d), table(s, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")))


#: All links: a chain's pages are as deep as their place in it. Customers in debt have no home, so their chains are unreachable.
WHOLE = """o AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
b AS (SELECT o_orderkey AS node, r - 1 AS depth FROM o JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0)"""


def click_depths(s, d):
    first = table(s, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("node"))
    homes = first.join(table(s, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("node")
    return G.depths(links(s, d).select("from_id", "to_id"), homes)


@query("click_depths", f"WITH {WHOLE} SELECT node, depth::BIGINT AS depth FROM b")
def _(s, d):
    return click_depths(s, d).withColumn("depth", F.col("depth").cast("long"))


@query(
    "depth_histogram",
    f"""WITH {WHOLE} SELECT o_orderpriority, (count(*) FILTER (WHERE depth = 0))::BIGINT AS d_0, (count(*) FILTER (WHERE depth = 1))::BIGINT AS d_1, (count(*) FILTER (WHERE depth = 2))::BIGINT AS d_2,
    (count(*) FILTER (WHERE depth = 3))::BIGINT AS d_3, (count(*) FILTER (WHERE depth >= 4))::BIGINT AS d_4_plus, (count(*) FILTER (WHERE depth IS NULL))::BIGINT AS d_unreachable FROM o LEFT JOIN b ON node = o_orderkey GROUP BY ALL""",
)
def _(s, d):
    return A.depth_histogram(click_depths(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("node"), "o_orderpriority"), ["o_orderpriority"])


@query("orphan_pages", f"WITH {WHOLE} SELECT 'orphan_pages' AS type, CASE WHEN o_orderpriority = '1-URGENT' THEN 'medium' ELSE 'low' END AS severity, o_orderkey AS page_id, NULL::BIGINT AS entity_id, 'unreachable' AS evidence FROM o LEFT JOIN b ON node = o_orderkey WHERE depth IS NULL")
def orphans(s, d):
    pages = table(s, d, "orders").select(F.col("o_orderkey").alias("page_id"), "o_orderpriority")
    return D.orphan_pages(pages, click_depths(s, d), F.col("o_orderpriority") == "1-URGENT")


#: Canonical pointers: urgent pages point to the customer's next page, the last page of some customers back to the first.
CHAIN = """o AS (SELECT o_orderkey AS id, o_custkey AS c, row_number() OVER w AS r, lead(o_orderkey) OVER w AS nxt, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
k AS (SELECT id AS page_id, CASE WHEN c % 5 = 0 THEN coalesce(nxt, first) WHEN id % 3 = 0 THEN nxt END AS canonical_id FROM o)"""


def canonical_rows(s, d):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", F.lead("o_orderkey").over(order).alias("next"), F.first("o_orderkey").over(order).alias("first"))
    to = F.when(F.col("o_custkey") % 5 == 0, F.coalesce("next", "first")).when(F.col("o_orderkey") % 3 == 0, F.col("next"))
    return rows.select(F.col("o_orderkey").alias("page_id"), to.alias("canonical_id"))


@query(
    "canonical_targets",
    f"""WITH RECURSIVE {CHAIN}, x AS (SELECT page_id, page_id AS target, 0 AS n FROM k UNION ALL SELECT x.page_id, k.canonical_id, n + 1 FROM x JOIN k ON k.page_id = x.target
    WHERE k.canonical_id IS NOT NULL AND k.canonical_id <> k.page_id AND n < 100), z AS (SELECT page_id, max_by(target, n) AS target, max(n) AS n FROM x GROUP BY page_id)
    SELECT page_id, CASE WHEN n < 100 THEN target END AS target, CASE WHEN n = 100 THEN 'loop' WHEN n > 0 THEN 'duplicate' END AS issue FROM z""",
)
def canonical(s, d):
    return G.canonical_targets(canonical_rows(s, d))


@query("merge_components", f"WITH {WHOLE} SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM o QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def _(s, d):
    return G.components(links(s, d).select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))


@query("ancestor_closure", f"WITH {WHOLE} SELECT x.o_orderkey AS node, y.o_orderkey AS ancestor, (x.r - y.r)::BIGINT AS level FROM o x JOIN o y ON y.o_custkey = x.o_custkey AND y.r < x.r")
def _(s, d):
    return G.ancestors(links(s, d).select(F.col("to_id").alias("node"), F.col("from_id").alias("parent"))).withColumn("level", F.col("level").cast("long"))


@query("hubs", f"WITH g AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 97 AS b FROM lineitem WHERE l_suppkey <> l_partkey % 97) SELECT x.a AS hub, count(*)::BIGINT AS members, count(y.a)::BIGINT AS reciprocal FROM g x LEFT JOIN g y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) >= 2")
def _(s, d):
    return G.hubs(table(s, d, "lineitem").select(F.col("l_suppkey").alias("from_id"), (F.col("l_partkey") % 97).alias("to_id")))


@query(  # blocks of a page: its line items, of which those of small quantities are headings
    "heading_sections",
    """WITH b AS (SELECT l_orderkey AS page_id, l_linenumber AS ordinal, CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 20 THEN 2 WHEN l_quantity < 30 THEN 4 END AS level, l_partkey % 50 AS words FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1),
    i AS (SELECT *, last_value(CASE WHEN level IS NOT NULL THEN ordinal END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ordinal) AS section FROM b),
    w AS (SELECT page_id, section, sum(words)::BIGINT AS own_words FROM i WHERE level IS NULL AND section IS NOT NULL GROUP BY ALL),
    h AS (SELECT page_id, ordinal, level, lead(level) OVER (PARTITION BY page_id ORDER BY ordinal) AS nxt, (SELECT max(p.ordinal) FROM b p WHERE p.page_id = b.page_id AND p.ordinal < b.ordinal AND p.level < b.level) AS parent FROM b WHERE level IS NOT NULL)
    SELECT h.page_id, h.ordinal, h.level, h.parent, coalesce(own_words, 0) AS own_words, coalesce(h.level > p.level + 1, false) AS skipped, coalesce(own_words, 0) = 0 AND coalesce(h.nxt <= h.level, true) AS empty
    FROM h LEFT JOIN b p ON p.page_id = h.page_id AND p.ordinal = h.parent LEFT JOIN w ON w.page_id = h.page_id AND w.section = h.ordinal""",
)
def _(s, d):
    q = F.col("l_quantity")
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("ordinal")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("x")).select("page_id", "ordinal", "x.*")
    return A.sections(rows.select("page_id", "ordinal", F.when(q < 10, 1).when(q < 20, 2).when(q < 30, 4).alias("level"), (F.col("l_partkey") % 50).alias("words")))


@query("inherited_mains", f"""WITH {EVIDENCE}, du AS (SELECT o_orderkey AS page_id, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS original_id FROM orders), v AS (SELECT page_id, original_id FROM du WHERE page_id <> original_id)
    SELECT * FROM main WHERE page_id NOT IN (SELECT page_id FROM v) UNION ALL SELECT v.page_id, entity_id, role, rank, confidence FROM v JOIN main ON main.page_id = v.original_id""")
def _(s, d):
    return G.inherited(main_entities(s, d), duplicates(s, d))


def duplicates(s, d):
    """Orders of a customer of one priority are copies of the first."""
    same = Window.partitionBy("o_custkey", "o_orderpriority")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.min("o_orderkey").over(same).alias("original_id")).filter("page_id <> original_id")


@query("pair_signals", f"""WITH {EVIDENCE}, a AS (SELECT o_orderkey AS page_id, o_orderkey // 2 AS pair, entity_id FROM orders LEFT JOIN main ON main.page_id = o_orderkey AND role = 'main'), z AS (SELECT pair FROM a GROUP BY pair HAVING count(DISTINCT coalesce(entity_id, -1)) > 1)
    SELECT page_id, 'pair_differs' AS signal FROM a WHERE pair IN (SELECT pair FROM z) UNION ALL SELECT page_id, 'primary_empty' FROM a WHERE page_id NOT IN (SELECT page_id FROM e WHERE kind = 'primary')""")
def _(s, d):
    lists = evidence(s, d).filter("kind = 'primary'").select("page_id").distinct().withColumn("has_list", F.lit(True))
    pages = language_pairs(s, d).join(lists, "page_id", "left").withColumn("has_list", F.coalesce("has_list", F.lit(False)))
    return G.pair_signals(main_entities(s, d), pages)


@query("graph_edges", f"""WITH {EVIDENCE}, du AS (SELECT o_orderkey AS page_id, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS original_id FROM orders)
    SELECT type, from_kind, to_kind, count(*)::BIGINT AS edges, count(DISTINCT to_id)::BIGINT AS targets, sum(weight) AS weight FROM (
      SELECT 'mentions' AS type, 'page' AS from_kind, 'entity' AS to_kind, entity_id AS to_id, sum(CASE position WHEN 'title' THEN 3.0 WHEN 'heading' THEN 2.0 ELSE 1.0 END * n)::DOUBLE AS weight FROM m WHERE NOT skip GROUP BY page_id, entity_id
      UNION ALL SELECT 'main_entity', 'page', 'entity', entity_id, CASE role WHEN 'main' THEN 1.0 ELSE 0.5 END FROM main UNION ALL SELECT 'duplicate_of', 'page', 'page', original_id, 1.0 FROM du WHERE page_id <> original_id
      UNION ALL SELECT 'variant_of', 'entity', 'entity', first, 1.0 FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS first FROM part) WHERE p_partkey <> first) GROUP BY ALL""")
def _(s, d):
    first = F.min("p_partkey").over(Window.partitionBy("p_name", "p_brand"))
    variants = table(s, d, "part").select(F.col("p_partkey").alias("from_id"), first.alias("to_id"), F.lit("variant_of").alias("type")).filter("from_id <> to_id")
    rows = G.edges(mentions(s, d), main_entities(s, d), duplicates(s, d), variants)
    return rows.groupBy("type", "from_kind", "to_kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("to_id").alias("targets"), F.sum("weight").alias("weight"))


def _findings_sql() -> str:
    sql = {n: QUERIES[n][1] for n in ("unclear_topic", "uncovered_topic", "orphan_pages", "canonical_targets")}
    columns = "type, severity, page_id, entity_id, evidence"
    sql["canonical_targets"] = f"SELECT 'canonical_issue' AS type, 'medium' AS severity, page_id, NULL::BIGINT AS entity_id, issue AS evidence FROM ({sql['canonical_targets']}) WHERE issue = 'loop'"
    rows = " UNION ALL ".join(f"SELECT {columns} FROM ({x})" for x in sql.values())
    return f"SELECT row_number() OVER (ORDER BY list_position({list(D.TYPES)}, type), list_position({list(D.SEVERITIES)}, severity), page_id NULLS LAST, entity_id NULLS LAST, evidence) AS finding_id, {columns} FROM ({rows})"


@query("all_findings", _findings_sql())
def _(s, d):
    return D.numbered([unclear(s, d), uncovered(s, d), orphans(s, d), D.canonical_issues(canonical(s, d))])
