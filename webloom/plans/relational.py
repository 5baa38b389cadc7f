"""Selections, joins, aggregates, ranks and set operations of the engine over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import analytics as A
from ..operators import links as L
from .projections import LINKS, MENTIONS, links, mentions, query, table


@query("select_except_with_flag", "SELECT * EXCLUDE (o_totalprice, o_orderdate), o_totalprice > 200000 AS large FROM orders")
def _(s, d):
    return table(s, d, "orders").withColumn("large", F.col("o_totalprice") > 200000).drop("o_totalprice", "o_orderdate")


@query(
    "null_dangling_targets",
    f"WITH {LINKS} SELECT from_id AS from_page_id, CASE WHEN to_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') THEN to_id END AS to_page_id, position FROM l",
)
def _(s, d):
    pages = table(s, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("page_id"))
    rows = links(s, d).select(F.col("from_id").alias("from_page_id"), F.col("to_id").alias("to_page_id"), "position")
    return L.dangling_nulled(rows, pages)


@query("label_override", "SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN 'LARGE' END, p_type) AS shown_type, CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS shown_subtype FROM part")
def _(s, d):
    label = F.when(F.col("p_size") > 40, "LARGE")
    return table(s, d, "part").select("p_partkey", F.coalesce(label, "p_type").alias("shown_type"), F.when(label.isNull(), F.col("p_brand")).alias("shown_subtype"))


@query("union_by_name", "SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL BY NAME SELECT c_mktsegment AS segment, c_name AS name, c_custkey AS id FROM customer")
def _(s, d):
    a = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = table(s, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


@query("successful_pages", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice BETWEEN 100000 AND 299999 AND o_orderstatus IS DISTINCT FROM 'P'")
def _(s, d):
    return table(s, d, "orders").filter(F.col("o_totalprice").between(100000, 299999) & ~F.col("o_orderstatus").eqNullSafe("P")).select("o_orderkey", "o_orderstatus")


@query("entities_with_mentions", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def _(s, d):
    return table(s, d, "part").join(table(s, d, "lineitem").filter("l_returnflag = 'A'"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query("orphan_entities", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25)")
def _(s, d):
    used = table(s, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 25")
    return table(s, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("only_in_titles", f"WITH {MENTIONS} SELECT entity_id FROM m WHERE NOT skip GROUP BY ALL HAVING bool_and(position = 'title')")
def _(s, d):
    return mentions(s, d).filter("NOT skip").groupBy("entity_id").agg(F.bool_and(F.col("position") == "title").alias("all")).filter("all").select("entity_id")


@query(
    "mentions_by_brand",
    "SELECT p_brand, count(*)::BIGINT AS mentions, count(DISTINCT l_orderkey)::BIGINT AS pages, count(DISTINCT l_partkey)::BIGINT AS entities FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
)
def _(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("l_orderkey").alias("pages"), F.countDistinct("l_partkey").alias("entities"))


@query(
    "mentions_multiway",
    """SELECT r_name, p_type, count(*)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' GROUP BY r_name, p_type""",
)
def _(s, d):
    t = lambda n: table(s, d, n)
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("mentions_with_pages", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON l_orderkey = o_orderkey")
def _(s, d):
    pages = table(s, d, "orders").filter("o_orderstatus = 'O'")
    return table(s, d, "lineitem").join(pages, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "o_orderpriority")


@query(
    "repeated_mentions",
    "SELECT a.l_orderkey, a.l_partkey, a.l_linenumber AS first, b.l_linenumber AS second FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey IS NOT DISTINCT FROM b.l_partkey WHERE a.l_linenumber < b.l_linenumber",
)
def _(s, d):
    a = table(s, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("first"))
    b = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("second"))
    return a.join(b, (a.l_orderkey == b.k) & a.l_partkey.eqNullSafe(b.p) & (F.col("first") < F.col("second"))).select("l_orderkey", "l_partkey", "first", "second")


@query("mention_counts", "SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey)::BIGINT AS mentions FROM part")
def _(s, d):
    n = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("mentions"))
    return table(s, d, "part").select("p_partkey").join(n, "p_partkey", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))


@query(
    "best_candidate",
    """SELECT p_name, p_partkey AS entity_id, n AS mentions FROM (SELECT p_name, p_partkey, n, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, p_partkey) AS r
    FROM (SELECT p_name, p_partkey, count(l_orderkey)::BIGINT AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)) WHERE r = 1""",
)
def _(s, d):
    n = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("mentions"))
    rows = table(s, d, "part").join(n, "p_partkey", "left").select("p_name", F.col("p_partkey").alias("entity_id"), F.coalesce("mentions", F.lit(0)).alias("mentions"))
    return rows.groupBy("p_name").agg(F.max_by("entity_id", F.struct("mentions", -F.col("entity_id"))).alias("entity_id"), F.max("mentions").alias("mentions"))


@query("latest_version", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(s, d):
    return A.latest(table(s, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    "queue_join",
    """WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'),
    b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O')
    SELECT a.o_orderkey AS anchor_id, b.o_orderkey AS link_id, n::BIGINT AS place FROM a JOIN b USING (o_custkey, n)""",
)
def _(s, d):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("place")
    side = lambda status, name: table(s, d, "orders").filter(F.col("o_orderstatus") == status).select("o_custkey", F.col("o_orderkey").alias(name), place)
    return side("F", "anchor_id").join(side("O", "link_id"), ["o_custkey", "place"]).select("anchor_id", "link_id", "place")


@query(
    "key_union",
    """SELECT key, bool_or(side = 1) AS in_sitemap, bool_or(side = 2) AS in_pages, bool_or(side = 3) AS in_links FROM (SELECT c_custkey AS key, 1 AS side FROM customer WHERE c_nationkey < 12
    UNION ALL SELECT o_custkey, 2 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 3 FROM orders WHERE o_totalprice > 400000) GROUP BY key""",
)
def _(s, d):
    orders = table(s, d, "orders").withColumnRenamed("o_custkey", "key")
    return L.sitemap_comparison(table(s, d, "customer").filter("c_nationkey < 12").withColumnRenamed("c_custkey", "key"), orders.filter("o_orderstatus = 'F'"), orders.filter("o_totalprice > 400000"))


@query(
    "filtered_counts",
    f"WITH {MENTIONS} SELECT entity_id, count(*)::BIGINT AS all_mentions, (count(*) FILTER (WHERE skip))::BIGINT AS template, (count(DISTINCT page_id) FILTER (WHERE position = 'title'))::BIGINT AS title_pages FROM m GROUP BY entity_id",
)
def _(s, d):
    return mentions(s, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("all_mentions"), F.count_if("skip").alias("template"), F.countDistinct(F.when(F.col("position") == "title", F.col("page_id"))).alias("title_pages"))


@query("ordered_concat", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _(s, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(parts, " ").alias("text"))


@query("sorted_distinct_list", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments, count(DISTINCT c_mktsegment)::BIGINT AS n FROM customer GROUP BY c_nationkey")
def _(s, d):
    return table(s, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"), F.countDistinct("c_mktsegment").alias("n"))


@query("exploded_words", "SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def _(s, d):
    return table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "most_frequent_status",
    "SELECT o_custkey, o_orderstatus, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus DESC) AS r FROM (SELECT o_custkey, o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY ALL)) WHERE r = 1",
)
def _(s, d):
    return A.most_frequent(table(s, d, "orders"), ["o_custkey"], "o_orderstatus")


@query(
    "most_frequent_or_null",
    """SELECT o_custkey, CASE WHEN count(*) = 1 THEN max(o_orderstatus) END AS o_orderstatus, max(n)::BIGINT AS n FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY n DESC) AS r
    FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)) WHERE r = 1 GROUP BY o_custkey""",
)
def _(s, d):
    return A.most_frequent(table(s, d, "orders"), ["o_custkey"], "o_orderstatus", ties="null")


@query(
    "weighted_vote",
    """WITH c AS (SELECT user_id, event_type AS kind, event_id % 7 AS choice, count(*) AS n FROM events GROUP BY ALL),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, kind) AS share FROM c),
    w AS (SELECT * FROM (VALUES ('purchase', 3.0::DOUBLE), ('signup', 2.0), ('click', 1.5), ('view', 1.0)) AS t(kind, weight)),
    v AS (SELECT user_id, choice, sum(share * weight) AS score FROM s JOIN w USING (kind) GROUP BY ALL),
    r AS (SELECT user_id, choice, round(score / sum(score) OVER (PARTITION BY user_id), 4) AS score FROM v),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, choice) AS rank FROM r) SELECT * FROM k WHERE rank <= 3""",
)
def _(s, d):
    signals = table(s, d, "events").select("user_id", F.col("event_type").alias("kind"), (F.col("event_id") % 7).alias("choice"))
    weights = s.createDataFrame([("purchase", 3.0), ("signup", 2.0), ("click", 1.5), ("view", 1.0)], "kind string, weight double")
    return A.weighted_vote(signals, weights, ["user_id"])


@query(
    "template_units",
    """SELECT text, level, in_groups FROM (SELECT p_name AS text, p_type AS level, count(DISTINCT p_brand)::BIGINT AS in_groups FROM part GROUP BY ALL)
    WHERE in_groups >= greatest(3, 0.15 * (SELECT count(DISTINCT p_brand) FROM part))""",
)
def _(s, d):
    return A.repeated_units(table(s, d, "part").select(F.col("p_name").alias("text"), F.col("p_type").alias("level"), "p_brand"), ["text", "level"], "p_brand")


@query("share_per_entity", f"WITH {MENTIONS} SELECT entity_id, round(avg(CASE WHEN skip THEN 1.0 ELSE 0.0 END), 6) AS share FROM m GROUP BY entity_id HAVING avg(CASE WHEN skip THEN 1.0 ELSE 0.0 END) >= 0.5")
def _(s, d):
    share = F.avg(F.col("skip").cast("double"))
    return mentions(s, d).groupBy("entity_id").agg(F.round(share, 6).alias("share"), share.alias("exact")).filter("exact >= 0.5").drop("exact")


@query("status_by_price_class", "SELECT floor(o_totalprice / 100000)::BIGINT AS class, o_orderstatus, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def _(s, d):
    return table(s, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 100000).alias("class"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("status_pivot", "SELECT o_orderpriority, (count(*) FILTER (WHERE o_orderstatus = 'F'))::BIGINT AS f, (count(*) FILTER (WHERE o_orderstatus = 'O'))::BIGINT AS o, (count(*) FILTER (WHERE o_orderstatus = 'P'))::BIGINT AS p FROM orders GROUP BY o_orderpriority")
def _(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(*(F.count_if(F.col("o_orderstatus") == x).alias(x.lower()) for x in "FOP"))


@query("spend_by_type", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS units, round(coalesce(sum(value), 0), 2) AS usd, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def _(s, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("units"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("usd"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("look_back_value", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before FROM events")
def _(s, d):
    rows = table(s, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return rows.select("event_id", A.look_back(rows, ["user_id"], "at", F.when(F.col("event_type") == "purchase", F.col("event_id")), 4).alias("before"))


@query("rank_entities", f"WITH {MENTIONS}, c AS (SELECT entity_id, count(*) AS n FROM m WHERE NOT skip GROUP BY entity_id) SELECT entity_id, n::BIGINT AS n, row_number() OVER (ORDER BY n DESC, entity_id)::BIGINT AS rank FROM c")
def _(s, d):
    n = mentions(s, d).filter("NOT skip").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return A.identified(n, "rank", [F.desc("n"), F.asc("entity_id")])


@query("top_tenth", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT (SELECT ceil(count(*) * 0.1)::BIGINT FROM part)")
def _(s, d):
    return A.top_share(table(s, d, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 0.1)


@query("frontier_batch", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100")
def _(s, d):
    return table(s, d, "orders").filter("o_orderstatus = 'O'").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority")


@query("mean_place", f"WITH {MENTIONS} SELECT entity_id, round(avg(ordinal), 6) AS place, count(DISTINCT page_id)::BIGINT AS pages FROM m GROUP BY entity_id")
def _(s, d):
    return mentions(s, d).groupBy("entity_id").agg(F.round(F.avg("ordinal"), 6).alias("place"), F.countDistinct("page_id").alias("pages"))


@query("keep_first", "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("distinct_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT lower(r_name) FROM region")
def _(s, d):
    names = table(s, d, "region").select(F.col("r_name").alias("name"))
    return table(s, d, "nation").select(F.col("n_name").alias("name")).union(names).union(names.select(F.lower("name"))).distinct()


@query("key_differences", "SELECT key, 'extra' AS kind FROM (SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT key, 'missing' FROM (SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(s, d):
    side = lambda x: table(s, d, "orders").filter(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("key")).distinct()
    one = lambda a, b, kind: side(a).join(side(b), "key", "left_anti").withColumn("kind", F.lit(kind))
    return one("P", "O", "extra").unionByName(one("O", "P", "missing"))


@query("unchanged_within_week", "SELECT event_id FROM (SELECT event_id, ts, event_type, lag(ts) OVER w AS before, lag(event_type) OVER w AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before > ts - INTERVAL 7 DAY AND kind = event_type")
def _(s, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(s, d, "events").withColumn("before", F.lag("ts").over(order)).withColumn("kind", F.lag("event_type").over(order))
    return rows.filter((F.col("before") > F.col("ts") - F.expr("INTERVAL 7 DAYS")) & (F.col("kind") == F.col("event_type"))).select("event_id")


@query("upserted", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) UNION ALL SELECT o_custkey, 'NEW' FROM orders WHERE o_totalprice > 450000 GROUP BY o_custkey")
def _(s, d):
    new = table(s, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"), F.lit("NEW").alias("c_mktsegment")).distinct()
    return A.upsert(table(s, d, "customer").select("c_custkey", "c_mktsegment"), new, ["c_custkey"])


@query("menu_copies_once", f"WITH {LINKS} SELECT from_id, to_id, position FROM l WHERE position = 'body' UNION ALL SELECT from_id, to_id, position FROM l WHERE position <> 'body' GROUP BY ALL")
def _(s, d):
    rows = links(s, d)
    twice = rows.select(F.col("from_id").alias("from_page_id"), F.col("to_id").alias("to_page_id"), F.lit(None).cast("string").alias("to_url"), "position", F.lit("a").alias("anchor"), "ordinal")
    doubled = twice.unionByName(twice.filter("position <> 'body'").withColumn("ordinal", F.col("ordinal") + 1))
    return L.counted(doubled).select(F.col("from_page_id").alias("from_id"), F.col("to_page_id").alias("to_id"), "position")


@query("today_filter", "SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' GROUP BY ALL")
def _(s, d):
    return table(s, d, "events").filter(F.to_date("ts") >= F.lit("2024-01-10").cast("date")).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
