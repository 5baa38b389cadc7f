"""Graph operators: chains, depths, closures, components, main entities, edges and weights.

Loops end each round in a table in the shared folder, so that plans stay short and a lost executor costs a round
at most.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import saved


def canonical_targets(pages: DataFrame, most: int = 64) -> DataFrame:
    """pages (page_id, canonical_id) -> page_id, target, issue: where each chain ends; a chain that comes back has issue loop and no target.

    Pointers double each round; most bounds the rounds, 2 ** most steps.
    """
    step = saved(pages.select("page_id", F.coalesce("canonical_id", "page_id").alias("target")), "canonical")
    n = step.count()
    for done in range(most):
        hop = step.select(F.col("page_id").alias("target"), F.col("target").alias("next"))
        step = saved(step.join(hop, "target", "left").select("page_id", F.coalesce("next", "target").alias("target"), (F.coalesce("next", "target") != F.col("target")).alias("moved")), "canonical")
        # Chains are no longer than the pages are many: what moves after that many steps is in a loop.
        if step.filter("moved").isEmpty() or 1 << done > n:
            break
        step = step.drop("moved")
    ends = step.drop("moved").join(pages.select(F.col("page_id").alias("target"), F.col("canonical_id").alias("own")), "target", "left")
    final = F.col("own").isNull() | (F.col("own") == F.col("target"))
    return ends.select("page_id", F.when(final, F.col("target")).alias("target"), F.when(~final, "loop").when(F.col("target") != F.col("page_id"), "duplicate").alias("issue"))


#: Clicks that are followed before what was reached is written.
STEPS = 6


def depths(edges: DataFrame, homes: DataFrame, steps: int = STEPS) -> DataFrame:
    """edges (from_id, to_id), homes (node) -> node, depth: clicks from the nearest home. Each round goes some clicks on from the last front, whose joins share one exchange of the edges, and keeps the nodes not seen before."""
    edges = saved(edges.filter("from_id <> to_id").select("from_id", "to_id").distinct(), "edges")
    seen = saved(homes.select("node").distinct().withColumn("depth", F.lit(0)), "depths")
    front = seen
    for done in count(0, steps):
        reached, now = [], front.select("node")
        for step in range(1, steps + 1):
            now = now.join(edges, now.node == edges.from_id).select(F.col("to_id").alias("node")).distinct()
            reached.append(now.withColumn("depth", F.lit(done + step)))
        nearest = reduce(DataFrame.unionByName, reached).groupBy("node").agg(F.min("depth").alias("depth"))
        new = saved(nearest.join(seen, "node", "left_anti"), "depths")
        front = new.filter(F.col("depth") == done + steps)
        seen = seen.unionByName(new)
        if front.isEmpty():
            break
        if done // steps % 8 == 7:
            seen = saved(seen, "depths")
    return seen


def ancestors(parents: DataFrame) -> DataFrame:
    """parents (node, parent) -> node, ancestor, level, along single parents; a loop ends where it comes back."""
    known = parents.filter("parent IS NOT NULL AND parent <> node").groupBy("node").agg(F.max("parent").alias("parent"))
    paths = saved(known.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("level"), F.array("node", "parent").alias("path")), "ancestors")
    out, front = [paths], paths
    for level in count(2):
        up = known.toDF("ancestor", "above")
        front = front.join(up, "ancestor").filter(~F.array_contains("path", F.col("above"))).select("node", F.col("above").alias("ancestor"), F.lit(level).alias("level"), F.concat("path", F.array("above")).alias("path"))
        front = saved(front, "ancestors")
        if front.isEmpty():
            break
        out.append(front)
        if level % 64 == 0:
            out = [saved(reduce(DataFrame.unionByName, out), "ancestors")]
    return reduce(DataFrame.unionByName, out).drop("path")


def components(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) -> node, root: the smallest node each reaches. Labels fall along edges, then to their label's label."""
    both = saved(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "pairs")
    label = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "label")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("m"))
        low = label.join(near, label.node == near.a, "left").select("node", "root", F.least("root", "m").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("root").alias("deep"))
        new = saved(low.join(jump, "low", "left").select("node", F.least("low", "deep").alias("now"), "root"), "label")
        changed = not new.filter("now <> root").isEmpty()
        label = new.select("node", F.col("now").alias("root"))
        if not changed:
            break
    return label


#: How strong a kind of evidence is: the smaller the stronger. Fixed values of the rules.
STRENGTH = {"anchored": 1, "home": 1, "schema_about": 2, "profile": 2, "primary": 3, "group_primary": 3, "h1": 4, "title": 4, "heading": 4, "top_mentions": 5, "inbound_anchor": 6, "url": 6}


def main_entities(evidence: DataFrame, pages: DataFrame | None = None, secondaries: int = 2) -> DataFrame:
    """evidence (page_id, entity_id, kind, mentions, and primary_index: place in the page's list of primary entities) -> page_id, entity_id, role, rank, confidence.

    pages (page_id, pair_id, first_lang) says which pages are one page in several languages, and which of them is in
    the site's first language: their evidence counts together. Candidates go by strongest kind, first place in a
    list of the pair, lists of the pair that have it, kinds and mentions of the pair, whether the first language's list
    has it, id within a pair, own kinds and mentions, id. The first is main; secondary are those after it that have a
    kind of strength 1 or 2, or h1 and primary both. Confidence: strong with a kind of strength 1 or 2, or named and a
    headline; medium as the first in a list, or named with heading or top_mentions, or a headline and another kind.
    """
    if "primary_index" not in evidence.columns:
        evidence = evidence.withColumn("primary_index", F.lit(None).cast("int"))
    strength = F.coalesce(*(F.when(F.col("kind") == k, s) for k, s in STRENGTH.items()))
    has = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    each = evidence.groupBy("page_id", "entity_id").agg(
        F.min(strength).alias("best"), F.collect_set("kind").alias("kinds"), F.max("mentions").alias("mentions"), F.min("primary_index").alias("index"), has("primary").alias("primary"), has("primary", "group_primary").alias("named"),
        has("h1").alias("h1"), has("h1", "title").alias("headline"), has("heading", "top_mentions").alias("further"), F.count_if(~F.col("kind").isin("h1", "title")).alias("others"),
    )
    if pages is None:
        each = each.withColumns({"pair_index": F.col("index"), "votes": F.lit(0), "pair_kinds": F.size("kinds"), "pair_mentions": F.col("mentions"), "first": F.lit(False), "tie": F.lit(0).cast("long")})
    else:
        pairs = pages.join(pages.groupBy("pair_id").agg((F.count(F.lit(1)) > 1).alias("paired")), "pair_id")
        each = each.join(pairs, "page_id")
        both = each.groupBy("pair_id", "entity_id").agg(
            F.min("index").alias("pair_index"), F.count_if("primary").alias("n_lists"), F.size(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("pair_kinds"), F.sum("mentions").alias("pair_mentions"),
            F.bool_or(F.col("primary") & F.col("first_lang")).alias("in_first"),
        )
        each = each.join(both, ["pair_id", "entity_id"]).withColumns({"votes": F.when(F.col("paired"), F.col("n_lists")).otherwise(0), "first": F.col("paired") & F.col("in_first"), "tie": F.when(F.col("paired"), F.col("entity_id")).otherwise(0)})
    order = [F.asc("best"), F.coalesce("pair_index", F.lit(99)).asc(), F.desc("votes"), F.desc("pair_kinds"), F.desc("pair_mentions"), F.desc("first"), F.asc("tie"), F.size("kinds").desc(), F.desc("mentions"), F.asc("entity_id")]
    page = Window.partitionBy("page_id")
    fits = (F.col("best") <= 2) | F.col("h1") & F.col("primary")
    ranked = each.withColumn("place", F.row_number().over(page.orderBy(*order))).filter((F.col("place") == 1) | fits)
    ranked = ranked.withColumn("rank", F.row_number().over(page.orderBy("place"))).filter(F.col("rank") <= 1 + secondaries)
    medium = (F.coalesce("pair_index", F.lit(99)) == 0) | F.col("named") & F.col("further") | F.col("headline") & (F.col("others") >= 1)
    confidence = F.when((F.col("best") <= 2) | F.col("named") & F.col("headline"), "strong").when(medium, "medium").otherwise("weak")
    return ranked.select("page_id", "entity_id", F.when(F.col("rank") == 1, "main").otherwise("secondary").alias("role"), F.col("rank").cast("long").alias("rank"), F.when(F.col("rank") == 1, confidence).alias("confidence"))


def inherited(mains: DataFrame, duplicates: DataFrame) -> DataFrame:
    """mains with the decisions of originals for their duplicates (page_id, original_id), in place of the duplicates' own."""
    own = mains.join(duplicates.select("page_id"), "page_id", "left_anti")
    taken = duplicates.select("page_id", "original_id").join(mains.withColumnRenamed("page_id", "original_id"), "original_id").select(*mains.columns)
    return own.unionByName(taken)


def pair_signals(mains: DataFrame, pages: DataFrame) -> DataFrame:
    """pages (page_id, pair_id, has_list) -> page_id, signal: primary_empty (the page's list is empty), pair_differs (a page of the pair has another main entity)."""
    main = pages.join(mains.filter("role = 'main'").select("page_id", "entity_id"), "page_id", "left")
    differ = main.groupBy("pair_id").agg((F.countDistinct(F.coalesce("entity_id", F.lit(-1))) > 1).alias("differs"))
    rows = main.join(differ, "pair_id")
    signals = F.array_compact(F.array(F.when(~F.col("has_list"), "primary_empty"), F.when(F.col("differs"), "pair_differs")))
    return rows.select("page_id", F.explode(signals).alias("signal"))


POSITION_WEIGHT = {"title": 3.0, "h1": 3.0, "heading": 2.0}


def mention_edges(mentions: DataFrame) -> DataFrame:
    """mentions (page_id, entity_id, position, skip, n) -> an edge for each pair with the sum of position weights, skipped ones out."""
    weight = F.coalesce(*(F.when(F.col("position") == p, w) for p, w in POSITION_WEIGHT.items()), F.lit(1.0))
    return mentions.filter(~F.col("skip")).groupBy("page_id", "entity_id").agg(F.sum(weight * F.col("n")).alias("weight"))


#: Weights of an entity's counts, and the factor of one mentioned once. Fixed values of the rules.
COUNT_WEIGHT, SINGLE = {"pages": 1.0, "mentions": 0.5, "structural": 1.0, "main_pages": 2.0, "content_anchors": 0.5, "nav_anchors": 0.1}, 0.25


def entity_weights(mentions: DataFrame, mains: DataFrame, inbound: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """The counts of each entity and the weight that joins them: pages, mentions, structural, main_pages, secondary_pages, content_anchors, nav_anchors, weight.

    mentions as for mention_edges, with region where known: only those at title, h1, heading and body count, structural
    are the first three and the page's frame. mains (page_id, entity_id, role). inbound (to_page_id, group, body): links
    to its main pages, counted in the body, by group of source elsewhere. Pages of duplicates (page_id) are left out.
    """
    if duplicates is not None:
        mentions, mains = (df.join(duplicates.select("page_id"), "page_id", "left_anti") for df in (mentions, mains))
    head = F.col("position").isin("title", "h1", "heading")
    head = head | (F.col("region") == "chrome") if "region" in mentions.columns else head
    counted = mentions.filter(~F.col("skip") & F.col("position").isin("title", "h1", "heading", "body"))
    parts = counted.groupBy("entity_id").agg(F.countDistinct("page_id").alias("pages"), F.sum("n").alias("mentions"), F.countDistinct(F.when(head, F.col("page_id"))).alias("structural"))
    heads = mains.groupBy("entity_id").agg(F.countDistinct(F.when(F.col("role") == "main", F.col("page_id"))).alias("main_pages"), F.countDistinct(F.when(F.col("role") != "main", F.col("page_id"))).alias("secondary_pages"))
    rows = parts.join(heads, "entity_id", "full_outer")
    if inbound is not None:
        led = mains.filter("role = 'main'").select(F.col("page_id").alias("to_page_id"), "entity_id").join(inbound, "to_page_id")
        led = led.groupBy("entity_id").agg(F.count_if("body").alias("content_anchors"), F.countDistinct(F.when(~F.col("body"), F.col("group"))).alias("nav_anchors"))
        rows = rows.join(led, "entity_id", "left")
    else:
        rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("content_anchors", "nav_anchors")})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in (*COUNT_WEIGHT, "secondary_pages")})
    weight = reduce(lambda a, b: a + b, (w * F.log2(1 + F.col(c).cast("double")) for c, w in COUNT_WEIGHT.items()))
    return rows.select("entity_id", *COUNT_WEIGHT, "secondary_pages", F.round(weight * F.when(F.col("mentions") == 1, SINGLE).otherwise(1.0), 4).alias("weight"))


def edges(mentions: DataFrame, mains: DataFrame, duplicates: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges of the page-entity graph: from_kind, from_id, to_kind, to_id, type, weight.

    Of mentions (mention_edges), main entities (main 1, secondary 0.5), duplicates (page_id, original_id) and
    relations between entities (from_id, to_id, type).
    """
    said = lambda df, a, x, b, y, kind, w: df.select(F.lit(a).alias("from_kind"), F.col(x).alias("from_id"), F.lit(b).alias("to_kind"), F.col(y).alias("to_id"), kind.alias("type"), w.cast("double").alias("weight"))
    role = F.when(F.col("role") == "main", 1.0).otherwise(0.5)
    parts = [
        said(mention_edges(mentions), "page", "page_id", "entity", "entity_id", F.lit("mentions"), F.col("weight")), said(mains, "page", "page_id", "entity", "entity_id", F.lit("main_entity"), role),
        said(duplicates, "page", "page_id", "page", "original_id", F.lit("duplicate_of"), F.lit(1)), said(relations, "entity", "from_id", "entity", "to_id", F.col("type"), F.lit(1)),
    ]
    return reduce(DataFrame.unionByName, parts)


def chain_levels(items: DataFrame, keys: list[str]) -> DataFrame:
    """items (keys, key, parent) -> with level: how many items stand above, 0 without a parent; an item of a loop, or below one, counts each once."""
    names = [*keys, "key"]
    node = items.select(F.struct(*names).alias("node"), F.when(F.col("parent").isNotNull(), F.struct(*keys, F.col("parent").alias("key"))).alias("parent"))
    levels = ancestors(node).groupBy("node").agg(F.max("level").alias("level"))
    return items.withColumn("node", F.struct(*names)).join(levels, "node", "left").withColumn("level", F.coalesce("level", F.lit(0)).cast("long")).drop("node")


def hubs(links: DataFrame, least: int = 2) -> DataFrame:
    """links (from_id, to_id) -> hub, members, reciprocal: pages that link to at least so many others, and how many of them link back."""
    pairs = links.filter("from_id <> to_id").select("from_id", "to_id").distinct()
    back = pairs.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit(1).alias("back"))
    return pairs.join(back, ["from_id", "to_id"], "left").groupBy(F.col("from_id").alias("hub")).agg(F.count(F.lit(1)).alias("members"), F.count("back").alias("reciprocal")).filter(F.col("members") >= least)
