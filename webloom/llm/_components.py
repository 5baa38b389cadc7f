"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved, splitting_join

#: Edges of one file of a round, about.
FILE_EDGES = 250_000


def gathered(edges: DataFrame, n: int) -> DataFrame:
    """edges, of which there are about n, in as many files as they fill or as cores can write at once, not one for each shuffle partition."""
    return edges.coalesce(max(edges.sparkSession.sparkContext.defaultParallelism, -(-n // FILE_EDGES)))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), of longs or binaries -> (node, root): the smallest node that each node reaches; roots too.

    Each round is two joins on a node, which Spark can split where one node has many edges, and ends in a
    table in the shared folder. Rounds are as many as the logarithm of the longest path, about; none has more edges
    than were given.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before, most = None, edges.count()
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = splitting_join(both, low, ["u"]).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = splitting_join(large, least, ["a"])
        edges = saved(gathered(small.select("a", F.col("m").alias("b")).union(small.filter("b <> m").select("b", "m")).distinct(), most), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select("b").distinct()
    return gathered(edges.toDF("node", "root").union(roots.select("b", "b")), now[0])
