"""Incremental operators on Structured Streaming: expiry of unchanged pages, latest versions, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import work_dir


def changed_pages(stream: DataFrame, key: str, content: str, time: str, ttl: str = "7 days") -> DataFrame:
    """Rows whose key and content weren't seen within ttl; state older than that goes."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key, content])


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows by window and keys; rows later than late are left out once their window is closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def frontier(stream: DataFrame, path: str, key: str = "url", depth: str = "depth"):
    """Writes each batch's smallest depths beside those before it: a batch costs what it holds, and one that is lost is written again over itself."""

    def put(batch: DataFrame, version: int) -> None:
        batch.groupBy(key).agg(F.min(depth).alias(depth)).write.mode("overwrite").parquet(f"{path}/batch={version}")

    return stream.writeStream.foreachBatch(put)


def frontier_table(spark: SparkSession, path: str, key: str = "url", depth: str = "depth") -> DataFrame:
    """Each key's smallest depth over all batches written so far."""
    return spark.read.parquet(path).groupBy(key).agg(F.min(depth).alias(depth))


def leased(queue: DataFrame, most: int) -> DataFrame:
    """queue (url, depth, priority, status) of which the next so many queued rows are leased: the smallest depth first, then priority, then address."""
    batch = queue.filter("status = 'queued'").orderBy("depth", "priority", "url").limit(most).select("url", F.lit("leased").alias("now"))
    return queue.join(batch, "url", "left").withColumn("status", F.coalesce("now", "status")).drop("now")


def reissued(queue: DataFrame) -> DataFrame:
    """queue after a restart: what was leased and never finished is queued again."""
    return queue.withColumn("status", F.when(F.col("status") == "leased", "queued").otherwise(F.col("status")))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a bounded stream yields, as a table in the shared folder. In complete mode every batch writes the whole result anew, windows still open included."""
    spark = stream.sparkSession
    out = work_dir(spark, "stream")
    if mode == "complete":
        spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(out)
        writer = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    else:
        writer = stream.writeStream.format("parquet").option("path", out)
    writer.outputMode(mode).option("checkpointLocation", work_dir(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
