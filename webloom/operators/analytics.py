"""Votes, shares, ranks, sections and other analytics over pages, blocks and mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import saved


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, ties: str = "largest") -> DataFrame:
    """Each key's most frequent value and its count; ties: the largest value, or null."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    if ties == "largest":
        return counts.groupBy(*keys).agg(F.max(F.struct("n", value)).alias("top")).select(*keys, F.col(f"top.{value}").alias(value), F.col("top.n").alias("n"))
    top = counts.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("n")))).filter("place = 1")
    return top.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 1, F.max(value)).alias(value), F.max("n").alias("n"))


def weighted_vote(signals: DataFrame, weights: DataFrame, keys: Sequence[str], top: int = 3) -> DataFrame:
    """signals (keys, kind, choice), weights (kind, weight): a kind's weight is split by its choices' shares; the top choices, their scores shares of all."""
    counts = signals.groupBy(*keys, "kind", "choice").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "kind"))
    score = counts.withColumn("share", share).join(weights, "kind").groupBy(*keys, "choice").agg(F.sum(F.col("share") * F.col("weight")).alias("score"))
    whole = Window.partitionBy(*keys)
    score = score.withColumn("score", F.round(F.col("score") / F.sum("score").over(whole), 4))
    return score.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("score"), "choice")).cast("long")).filter(F.col("rank") <= top)


def repeated_units(blocks: DataFrame, keys: Sequence[str], group: str, least: int = 3, share: float = 0.15) -> DataFrame:
    """Keys that stand in max(least, share of all groups) groups or more: template text."""
    groups = blocks.agg(F.countDistinct(group).alias("groups"))
    units = blocks.groupBy(*keys).agg(F.countDistinct(group).alias("in_groups"))
    return units.crossJoin(F.broadcast(groups)).filter(F.col("in_groups") >= F.greatest(F.lit(float(least)), share * F.col("groups"))).drop("groups")


def sections(blocks: DataFrame) -> DataFrame:
    """blocks (page_id, ordinal, level null for text, words) -> headings with own words, their parent heading's ordinal, skipped and empty."""
    order = Window.partitionBy("page_id").orderBy("ordinal")
    inside = F.last(F.when(F.col("level").isNotNull(), F.col("ordinal")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = blocks.withColumn("section", inside)
    words = placed.filter("level IS NULL AND section IS NOT NULL").groupBy("page_id", "section").agg(F.sum("words").alias("own_words"))
    heads = blocks.filter("level IS NOT NULL").select("page_id", "ordinal", "level")
    # The parent is the last heading before with a smaller level: for each level the last ordinal so far.
    last = {k: F.max(F.when(F.col("level") == k, F.col("ordinal"))).over(order.rowsBetween(Window.unboundedPreceding, -1)) for k in range(1, 6)}
    parent = F.greatest(*(F.when(F.col("level") > k, c) for k, c in last.items()), F.lit(None).cast("int"))
    heads = heads.withColumn("parent", parent).withColumn("next_level", F.lead("level").over(order))
    level = heads.select("page_id", F.col("ordinal").alias("parent"), F.col("level").alias("parent_level"))
    out = heads.join(level, ["page_id", "parent"], "left").join(words.withColumnRenamed("section", "ordinal"), ["page_id", "ordinal"], "left").withColumn("own_words", F.coalesce("own_words", F.lit(0)))
    skipped = F.coalesce(F.col("level") > F.col("parent_level") + 1, F.lit(False))
    empty = (F.col("own_words") == 0) & F.coalesce(F.col("next_level") <= F.col("level"), F.lit(True))
    return out.select("page_id", "ordinal", "level", "parent", "own_words", skipped.alias("skipped"), empty.alias("empty"))


def subtree_words(heads: DataFrame) -> DataFrame:
    """heads (page_id, ordinal, level, own_words) with total_words: own words and those of the sections below, up to the next heading of this level or above."""
    order = Window.partitionBy("page_id").orderBy("ordinal")
    so_far = F.coalesce(F.sum("own_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = heads.withColumn("so_far", so_far).withColumn("all_words", F.sum("own_words").over(Window.partitionBy("page_id")))
    after = order.rowsBetween(1, Window.unboundedFollowing)
    ends = {k: F.min(F.when(F.col("level") <= k, F.struct("ordinal", "so_far"))).over(after) for k in range(1, 7)}
    end = F.coalesce(*(F.when(F.col("level") == k, e["so_far"]) for k, e in ends.items()), F.col("all_words"))
    return rows.withColumn("total_words", (end - F.col("so_far")).cast("long")).drop("so_far", "all_words")


def concept_ranks(mentions: DataFrame) -> DataFrame:
    """mentions (page_id, entity_id, position, n, ordinal) -> page_id, entity_id, rank: those in title, h1 or heading first, then by mentions, first place, id."""
    each = mentions.groupBy("page_id", "entity_id").agg(F.bool_or(F.col("position").isin("title", "h1", "heading")).alias("prominent"), F.sum("n").alias("n"), F.min("ordinal").alias("first"))
    order = Window.partitionBy("page_id").orderBy(F.desc("prominent"), F.desc("n"), "first", "entity_id")
    return each.select("page_id", "entity_id", F.row_number().over(order).cast("long").alias("rank"))


def kind_share(blocks: DataFrame, kind: str) -> DataFrame:
    """blocks (page_id, kind, words) -> page_id, share: the part of a page's words that stands in blocks of a kind; null without words."""
    return blocks.groupBy("page_id").agg((F.sum(F.when(F.col("kind") == kind, F.col("words")).otherwise(0)) / F.nullif(F.sum("words"), F.lit(0))).alias("share"))


def title_suffixes(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """pages (lang, suffix: a title's last piece, null without one; titled) -> lang, suffix, pages: those that such a share of the language's titled pages end in."""
    titled = pages.filter("titled")
    all_ = titled.groupBy("lang").agg(F.count(F.lit(1)).alias("titles"))
    each = titled.filter("suffix IS NOT NULL").groupBy("lang", "suffix").agg(F.count(F.lit(1)).alias("pages"))
    return each.join(all_, "lang").filter(F.col("pages") >= share * F.col("titles")).drop("titles")


def is_subsequence(part: Column, whole: Column) -> Column:
    """Whether the items of an array stand in another in the same order, others between them or not."""
    found = F.aggregate(whole, F.lit(0), lambda n, x: F.when(x.eqNullSafe(F.get(part, n)) & (n < F.size(part)), n + 1).otherwise(n))
    return found == F.size(part)


def vote_counters(votes: DataFrame, keys: Sequence[str], choice: str) -> DataFrame:
    """Each key's choices and how often they were made, as JSON sorted by choice."""
    counts = votes.groupBy(*keys, choice).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(choice), "n"))))).alias("counters"))


def changed_inputs(old: DataFrame, new: DataFrame, key: str, content: Column) -> DataFrame:
    """old (key, hash), new rows -> those of new whose content's hash isn't the one kept for their key: what must be done again."""
    fresh = new.withColumn("hash", F.sha2(content, 256))
    return fresh.join(old.select(key, "hash"), [key, "hash"], "left_anti")


def cascaded(children: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """children without the rows that belong to rows that are gone."""
    return children.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(*children.columns)


def look_back(df: DataFrame, keys: Sequence[str], order: str, value: Column, rows: int) -> Column:
    """The nearest non-null value in so many rows before."""
    return F.last(value, True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, -1))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's row that is largest by order: the newest version."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order)))
    return df.withColumn("version", rank).filter("version = 1").drop("version")


def similar_pairs(pages: DataFrame, group: Sequence[str], tokens: str, least: float) -> DataFrame:
    """pages (page_id, group columns, tokens) -> a, b, similarity: pairs of a group whose tokens' Jaccard is large enough.

    Pairs come from the tokens that a similar page can't lack: of each set sorted by rarity in the group only the
    first (1 - least) * size + 1 are joined, so a frequent token makes no pairs unless nothing rarer can.
    """
    rows = pages.select("page_id", *group, F.array_distinct(tokens).alias("tokens")).withColumn("size", F.size("tokens")).filter("size > 0")
    each = rows.select("page_id", *group, "size", F.explode("tokens").alias("token"))
    counts = each.groupBy(*group, "token").agg(F.count(F.lit(1)).alias("many"))
    rank = F.row_number().over(Window.partitionBy("page_id", *group).orderBy("many", "token"))
    first = each.join(counts, [*group, "token"]).withColumn("rank", rank).filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * least) + 1)
    a, b = (first.select(*group, "token", F.col("page_id").alias(n), F.col("size").alias(f"{n}_size")) for n in "ab")
    pairs = a.join(b, [*group, "token"]).filter((F.col("a") < F.col("b")) & (F.col("b_size") >= least * F.col("a_size")) & (F.col("a_size") >= least * F.col("b_size"))).select("a", "b").distinct()
    sets = rows.select("page_id", "tokens")
    out = pairs.join(sets.toDF("a", "a_tokens"), "a").join(sets.toDF("b", "b_tokens"), "b")
    similarity = F.size(F.array_intersect("a_tokens", "b_tokens")) / F.size(F.array_union("a_tokens", "b_tokens"))
    return out.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= least)


def top_share(df: DataFrame, order: Sequence[Column], share: float) -> DataFrame:
    """The first ceil(share of rows) in a total order, by ids of range partitions: no task sorts all rows."""
    placed = identified(df, "_place", order)
    n = placed.agg(F.ceil(F.count(F.lit(1)) * F.lit(share).cast("decimal(18,6)")).alias("_most"))
    return placed.crossJoin(F.broadcast(n)).filter(F.col("_place") <= F.col("_most")).drop("_place", "_most")


def depth_histogram(depths: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """nodes (node, keys), depths (node, depth) -> counts at depth 0 to 3, 4 and more, unreachable."""
    rows = nodes.join(depths, "node", "left")
    bucket = F.when(F.col("depth").isNull(), "unreachable").when(F.col("depth") >= 4, "4+").otherwise(F.col("depth").cast("string"))
    names = ("0", "1", "2", "3", "4+", "unreachable")
    return rows.withColumn("bucket", bucket).groupBy(*keys).agg(*(F.count_if(F.col("bucket") == b).alias(f"d_{b.replace('+', '_plus')}") for b in names))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with rows of new in place of those with equal keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def identified(df: DataFrame, name: str, order: Sequence[Column]) -> DataFrame:
    """df with ids from 1 on in a total order: ranges sorted in parallel, each starting after the rows before it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = saved(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "identified")
    counts = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))  # as many rows as partitions
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = at.join(F.broadcast(counts.withColumn("_before", before)), "_part")
    return placed.withColumn(name, F.col("_row") - F.col("_first") + F.col("_before") + 1).drop("_part", "_row", "_first", "_before", "_n")
