"""A site, or many, as named tables in a folder: versions written whole and swapped by one small file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import links as L
from .operators import views as V
from .sources import html as H


class Site:
    """Tables below a folder of any store that Spark reads.

    A table is a folder of versions; CURRENT, a one-line text table, names the version that readers see. A version
    is written first and named after, so a failed write leaves the old one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, name: str, df: DataFrame) -> None:
        version = uuid.uuid4().hex
        if name in schemas.TABLES:
            df = schemas.checked(df, name)
        df.write.parquet(f"{self.path}/{name}/{version}")
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}.CURRENT")

    def read(self, name: str) -> DataFrame:
        version = self.spark.read.text(f"{self.path}/{name}.CURRENT").first()[0]
        return self.spark.read.parquet(f"{self.path}/{name}/{version}")

    def load_pages(self, raw: DataFrame) -> None:
        """raw (page_id, url, html) parsed to pages_parsed, links, headings, blocks and schema_blocks."""
        self.write("pages_parsed", H.parse_pages(raw))
        parsed = self.read("pages_parsed")
        links = L.resolved(H.links_of(parsed), parsed.select("page_id", "url"))
        self.write("links", links.withColumn("raw_url", F.col("to_url")).drop("from_url"))
        self.write("headings", H.headings_of(parsed))
        self.write("page_blocks", H.blocks_of(parsed))
        self.write("schema_blocks", parsed.select("page_id", F.posexplode("schema").alias("ordinal", "b")).select("page_id", "b.type", "b.json", "ordinal"))

    def links(self, counted: bool = True) -> DataFrame:
        return L.counted(self.read("links")) if counted else self.read("links")

    def page_facts(self) -> DataFrame:
        return L.page_facts(self.read("pages_parsed").select("page_id", "url", "title", "h1"), self.links())

    def current_pages(self) -> DataFrame:
        """Pages of the latest crawl, and those never stamped."""
        pages = self.read("pages")
        last = pages.agg(F.max("seen_crawl_id").alias("last"))
        return pages.join(F.broadcast(last), F.col("seen_crawl_id").isNull() | (F.col("seen_crawl_id") == F.col("last"))).drop("last")

    def table_rows(self, name: str) -> DataFrame:
        """A table as exported: no binary columns, in a total order."""
        rows = V.without_binary(self.read(name))
        return rows.orderBy(*rows.columns)
