"""Streaming queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..storage import work_dir
from ..streaming import incremental as I
from .projections import query, table


def events(s, d):
    return s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("changed_events", "SELECT user_id, event_type, count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL")
def _(s, d):
    rows = events(s, d).withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return I.drained(I.changed_pages(rows, "key", "props", "ts", "60 days")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("daily_event_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def _(s, d):
    return I.drained(I.windowed_counts(events(s, d), "ts", ["event_type"]), "complete")


@query("frontier_depths", "SELECT user_id, min(event_id % 1000)::BIGINT AS depth FROM events GROUP BY user_id")
def _(s, d):
    path = work_dir(s, "frontier")
    rows = events(s, d).select("user_id", (F.col("event_id") % 1000).alias("depth"))
    I.frontier(rows, path, "user_id").option("checkpointLocation", work_dir(s, "progress")).trigger(availableNow=True).start().awaitTermination()
    return I.frontier_table(s, path, "user_id")


@query("leased_frontier", """WITH q AS (SELECT o_orderkey AS url, o_custkey % 9 AS depth, o_orderpriority AS priority, CASE o_orderstatus WHEN 'F' THEN 'queued' WHEN 'O' THEN 'leased' ELSE 'done' END AS status FROM orders), n AS (SELECT url FROM q WHERE status <> 'done' ORDER BY depth, priority, url LIMIT 500)
    SELECT url, depth, priority, CASE WHEN status = 'done' THEN 'done' WHEN url IN (SELECT url FROM n) THEN 'leased' ELSE 'queued' END AS status FROM q""")
def _(s, d):
    c = F.col
    status = F.when(c("o_orderstatus") == "F", "queued").when(c("o_orderstatus") == "O", "leased").otherwise("done")
    queue = table(s, d, "orders").select(c("o_orderkey").alias("url"), (c("o_custkey") % 9).alias("depth"), c("o_orderpriority").alias("priority"), status.alias("status"))
    return I.leased(I.reissued(queue), 500)
