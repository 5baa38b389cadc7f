"""What the operators share: the shared work folder, Arrow helpers, word and window hashes."""

from __future__ import annotations

import contextlib
import gc
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import work_dir

#: Rows that one call of an Arrow function works on, and bytes of text: bounds a Python worker's memory.
SLICE_ROWS, SLICE_BYTES = 2000, 2_000_000


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, a lost executor costs nothing."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """saved(), and the table's folder."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    with shuffle_files_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    forget(spark)
    return spark.read.schema(df.schema).parquet(path), path


def cleared(spark: SparkSession, path: str) -> None:
    """Empties a stored table that nothing reads any more."""
    spark.range(0).write.mode("overwrite").parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of the actions inside hold so many rows: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches hold two slices' bytes at most, from now on in this session: 10,000 rows of text would be tens of MB in the executor and once more in its Python worker."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(min(now, 2 * SLICE_BYTES)))


#: Functions whose values a Python worker keeps from task to task.
KEPT: list = []


def kept(f: Callable) -> Callable:
    """functools.cache for what a Python worker keeps for its next tasks, until it turns to another operator."""
    KEPT.append(cache(f))
    return KEPT[-1]


def let_go() -> None:
    """Drops what this Python worker keeps for another operator: it would count beside what the worker needs now."""
    for f in KEPT:
        f.cache_clear()


def splitting_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by on whose hot keys Spark can split.

    Where a side is an aggregate by the same key, both would share its partitioning, and Spark splits only
    what is dealt for the join: one more key, made of the others, has both sides dealt anew.
    """
    deal = free_name([*left.columns, *right.columns], "deal")
    return left.withColumn(deal, F.hash(*on)).join(right.withColumn(deal, F.hash(*on)), [*on, deal], how).drop(deal)


def forget(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what is already written: it does so once the driver's garbage is collected, which may be long after the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def shuffle_files_end(spark: SparkSession):
    """Shuffle files of the actions inside go when each action ends, not when the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(taken: Iterable[str], name: str) -> str:
    """name, with underscores added until no column has it (Spark's names don't tell case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def crc_fold(col, mod: int):
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE_ROWS rows and about SLICE_BYTES of text; one row may be longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        size = np.concatenate([[0], np.cumsum(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(size, size[at] + SLICE_BYTES, "right")) - 1
            to = max(at + 1, min(to, at + SLICE_ROWS, batch.num_rows))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in (col.cast(pa.binary()) if col.type != pa.binary() else col).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash; emptied when it grows over a bound, so memory stays bounded."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of n consecutive values, order told apart; empty with fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for j in range(n):
        out = (out ^ words[j : j + m]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mixed(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def crc_bytes(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
