"""Views and sinks: entity and page views, status and spend, CSV and JSON files with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import analytics as A


def entity_view(weights: DataFrame, names: DataFrame, mains: DataFrame, mentions: DataFrame, shown: int = 5) -> DataFrame:
    """entity_id, rank, name, weight, main_pages and the first ids of pages where it is main, and where it is only mentioned."""
    ranked = A.identified(weights.select("entity_id", "weight", "main_pages"), "rank", [F.desc("weight"), F.asc("entity_id")])
    main = mains.filter("role = 'main'").select("entity_id", "page_id").distinct()
    only = mentions.select("entity_id", "page_id").distinct().join(main, ["entity_id", "page_id"], "left_anti")
    some = lambda df, name: df.groupBy("entity_id").agg(F.slice(F.array_sort(F.collect_list("page_id")), 1, shown).alias(name), F.count(F.lit(1)).alias(f"{name}_n"))
    return ranked.join(names, "entity_id", "left").join(some(main, "main_on"), "entity_id", "left").join(some(only, "mentioned_on"), "entity_id", "left")


def page_view(pages: DataFrame, mains: DataFrame, facts: DataFrame, depths: DataFrame) -> DataFrame:
    """pages with main entity, confidence, secondaries, link counts and depth."""
    main = mains.filter("role = 'main'").select("page_id", F.col("entity_id").alias("main_entity"), "confidence")
    others = mains.filter("role = 'secondary'").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))), lambda x: x["entity_id"]).alias("secondaries"))
    return pages.join(main, "page_id", "left").join(others, "page_id", "left").join(facts, "page_id", "left").join(depths, "page_id", "left")


def status_counts(pages: DataFrame) -> DataFrame:
    """pages (site, status) -> site, class (2 for 2xx; null when never answered), n."""
    return pages.groupBy("site", F.floor(F.col("status") / 100).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def spend(calls: DataFrame, budget: float) -> DataFrame:
    """calls (model, purpose, usd) -> model, calls, usd, over_budget."""
    rows = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 6).alias("usd"))
    return rows.withColumn("over_budget", F.col("usd") > budget)


def spend_by_purpose(calls: DataFrame, budgets: DataFrame) -> DataFrame:
    """calls (provider, model, purpose, usd), budgets (provider, budget) -> provider, model, purpose, calls, usd, provider_usd, over_budget."""
    each = calls.groupBy("provider", "model", "purpose").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))
    total = each.groupBy("provider").agg(F.sum("usd").alias("provider_usd"))
    return each.join(total, "provider").join(budgets, "provider", "left").withColumn("over_budget", F.coalesce(F.col("provider_usd") > F.col("budget"), F.lit(False))).drop("budget")


def fact_rows(df: DataFrame, key: str) -> DataFrame:
    """A wide row as key-value rows: key, fact, value as text."""
    facts = [c for c in df.columns if c != key]
    return df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("fact"), F.col(c).cast("string").alias("value")) for c in facts))).alias("f")).select(key, "f.*")


def without_binary(df: DataFrame) -> DataFrame:
    return df.select(*(f.name for f in df.schema if not isinstance(f.dataType, T.BinaryType)))


def as_json(df: DataFrame) -> DataFrame:
    """A json column: each row with its fields in alphabetical order, nulls kept."""
    return df.select(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}).alias("json"))


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A folder of CSV parts, sorted from the first to the last; nested columns as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in without_binary(df).schema]
    df.select(*flat).orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, order: Sequence[str]) -> None:
    as_json(df.orderBy(*order)).write.mode("overwrite").text(path)


def with_crawl_ids(runs: DataFrame) -> DataFrame:
    """runs (site, run_id, mode) with crawl_id: a resumed run belongs to the last run before it that wasn't one."""
    order = Window.partitionBy("site").orderBy("run_id")
    return runs.withColumn("crawl_id", F.coalesce(F.last(F.when(F.col("mode") != "resume", F.col("run_id")), True).over(order), "run_id"))


def stop_reasons(runs: DataFrame) -> DataFrame:
    """runs (notes) with stopped: what the notes say after stopped:, else null."""
    return runs.withColumn("stopped", F.nullif(F.regexp_extract("notes", r"stopped: ([^;]*)", 1), F.lit("")))


def within_budget(calls: DataFrame, keys: Sequence[str], order: Sequence[str], cost: str, reserve: float, cap: float) -> DataFrame:
    """calls with spent, what was spent under the keys before each, and allowed: whether that and a reserve for one call stay within the cap. Calls are paid for, so a key's ledger is what one task sorts."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("spent", F.coalesce(F.sum(cost).over(before), F.lit(0))).withColumn("allowed", F.col("spent") + reserve <= cap)


def overrun(progress: DataFrame, factor: float, calibration: int = 10) -> DataFrame:
    """progress (run_id, page, seconds: since the run's start, expected: pages) -> run_id, stop: the first page after the calibration ones at which a run took factor times what they foretold, null if none."""
    pace = F.max(F.when(F.col("page") == calibration, F.col("seconds") / calibration)).over(Window.partitionBy("run_id"))
    late = (F.col("page") > calibration) & (F.col("seconds") > factor * F.col("pace") * F.col("expected"))
    return progress.withColumn("pace", pace).groupBy("run_id").agg(F.min(F.when(late, F.col("page"))).alias("stop"))
