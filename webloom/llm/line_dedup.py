"""Line deduplication with levelled sorted runs of line hashes, in DataFrame operations alone.

Documents come in batches, those with the largest ids first. A batch's line hashes are merge-joined with the
runs before it: hashes in no run are new, and the batch's largest document that holds them keeps them; for
the others the run only adds to their number of documents. Runs are bucketed and sorted by hash, so that a join
reads them without a shuffle; as many runs of a level as the fan-out are compacted into one of the next level.

Defined cases: a null or empty text is one empty line. Each row counts as a document, also where ids repeat; a
null id is the smallest. A line is never dropped from the largest id that holds it, where it may stand several
times. An empty table gives an empty table. Other columns pass through; a new column whose name is taken gets
an underscore.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import documents, free_name, shuffle_files_end, splitting_join, work_dir

BLANK = " \t\n\x0b\f\r"
MIN_DOCS, MIN_CHARS = 3, 20
BATCHES, FANOUT = 4, 2


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line):
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


class LineRuns:
    """Runs of (h, n, keeper): n documents with the line; keeper only in the run that saw the hash first."""

    def __init__(self, spark, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _written(self, rows: DataFrame) -> str:
        name = f"webloom_lines_{uuid.uuid4().hex}"
        with shuffle_files_end(self.spark):
            rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        return name

    def rows(self) -> DataFrame | None:
        runs = [self.spark.table(name) for level in self.levels for name in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def new(self, own: DataFrame) -> DataFrame:
        """own with keeper left only where no run has the hash: an anti-join with each run in turn."""
        for level in self.levels:
            for name in level:
                seen = self.spark.table(name).filter("keeper_known").select("h", F.lit(True).alias("seen"))
                own = own.join(seen, "h", "left").select("h", "n", F.expr("if(seen, null, keeper)").alias("keeper"), F.expr("keeper_known and seen is null").alias("keeper_known"))
        return own

    def add(self, lines: DataFrame) -> None:
        """lines: a row (doc_id, h) for each line hash of each document of the batch."""
        own = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).withColumn("keeper_known", F.lit(True))
        self._push(self._written(self.new(own)), 0)

    def _push(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            runs = self.levels[level]
            rows = reduce(DataFrame.unionByName, [self.spark.table(r) for r in runs])
            merged = self._written(self._summed(rows))
            self.levels[level] = []
            for r in runs:
                self.spark.sql(f"DROP TABLE {r}")
            self._push(merged, level + 1)

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"), F.bool_or("keeper_known").alias("keeper_known"))

    def repeated(self, min_docs: int) -> DataFrame:
        return self._summed(self.rows()).filter(F.col("n") >= min_docs).select("h", "keeper")


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs (id, text) with hs: each line's hash, null for short lines."""
    keys = F.transform(lines_of(F.col("text")), key_of)
    return docs.withColumn("hs", F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.unhex(F.md5(k.cast("binary"))))))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with text cut down, n_lines (before) and n_dropped.

    Lines whose key (stripped, in lower case) has min_chars or more and stands in min_docs documents stay only
    in the largest id that holds them. Batches hold about as many rows each.
    """
    spark = docs.sparkSession
    bounds = docs.agg(F.percentile_approx(F.col(doc_id).cast("long"), [1 - (i + 1) / batches for i in range(batches - 1)])).first()[0] or []
    batch = reduce(lambda later, i: F.when(F.col("doc_id") > bounds[i], i).otherwise(later), reversed(range(len(bounds))), F.lit(batches - 1)).cast("int").alias("batch")
    path = work_dir(spark, "lines")
    # Lines are hashed once: the hashes of a row's lines in order, null for short ones.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("fp", F.xxhash64("text"))
    line_hashes(rows, min_chars).select("doc_id", "fp", "hs", batch).write.partitionBy("batch").parquet(path)
    hashed = spark.read.schema(T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("fp", T.LongType()), T.StructField("hs", T.ArrayType(T.BinaryType())), T.StructField("batch", T.IntegerType())])).parquet(path)
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        own = hashed.filter(F.col("batch") == b)
        runs.add(own.select("doc_id", F.explode(F.array_distinct(F.array_compact("hs"))).alias("h")))
    lines = hashed.select("doc_id", "fp", F.posexplode("hs").alias("pos", "h")).filter(F.col("h").isNotNull())
    gone = (
        splitting_join(lines, runs.repeated(min_docs), ["h"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("gone_id"), "fp")  # rows that share an id but not a text stay apart
        .agg(F.collect_set("pos").alias("gone_pos"))
    )
    n_lines, n_dropped = free_name(docs.columns, "n_lines"), free_name(docs.columns, "n_dropped")
    row = docs.select(F.struct(*docs.columns).alias("row")).join(gone, F.col(f"row.{doc_id}").eqNullSafe(F.col("gone_id")) & (F.xxhash64(f"row.{text}") == F.col("fp")), "left")
    row = row.withColumn("lines", lines_of(F.col(f"row.{text}"))).withColumn("gone_pos", F.coalesce("gone_pos", F.array().cast("array<int>")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone_pos")), lambda i: F.get("lines", i))
    cut = F.when(F.size("gone_pos") == 0, F.col(f"row.{text}")).otherwise(F.array_join(kept, "\n"))
    return row.select(*(cut.alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in docs.columns), F.size("lines").cast("long").alias(n_lines), F.size("gone_pos").cast("long").alias(n_dropped))


def op6_line_dedup(spark, sf_dir):
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def keep_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go, every document stays."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
