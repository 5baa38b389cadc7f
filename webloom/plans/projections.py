"""The engine's inputs as views of the star-schema tables: pages, links, mentions, entities, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame and the SQL that says the same."""

    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark, d) -> DataFrame:
    """Line items: orders are pages, parts are entities."""
    position = F.create_map(F.lit("A"), F.lit("title"), F.lit("R"), F.lit("heading"), F.lit("N"), F.lit("body"))[F.col("l_returnflag")]
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("entity_id"), position.alias("position"), (F.col("l_linestatus") == "O").alias("skip"), F.lit(1).cast("long").alias("n"), F.col("l_linenumber").alias("ordinal"))


MENTIONS = """m AS (
  SELECT l_orderkey AS page_id, l_partkey AS entity_id, CASE l_returnflag WHEN 'A' THEN 'title' WHEN 'R' THEN 'heading' ELSE 'body' END AS position,
    l_linestatus = 'O' AS skip, 1 AS n, l_linenumber AS ordinal FROM lineitem
)"""


def links(spark, d) -> DataFrame:
    """An order links to the customer's next one."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    position = F.create_map(F.lit("F"), F.lit("nav"), F.lit("P"), F.lit("footer"), F.lit("O"), F.lit("body"))[F.col("o_orderstatus")]
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("from_id"), F.lead("o_orderkey").over(order).alias("to_id"), position.alias("position"), F.row_number().over(order).alias("ordinal"), F.col("o_orderpriority").alias("lang"))
    return rows.filter("to_id IS NOT NULL")


LINKS = """l AS (
  SELECT * FROM (SELECT o_custkey, o_orderkey AS from_id, lead(o_orderkey) OVER w AS to_id, CASE o_orderstatus WHEN 'F' THEN 'nav' WHEN 'P' THEN 'footer' ELSE 'body' END AS position,
    row_number() OVER w AS ordinal, o_orderpriority AS lang FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE to_id IS NOT NULL
)"""
