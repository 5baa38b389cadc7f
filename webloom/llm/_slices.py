"""Slices of the texts and shards of a key space: what slices count meets in shards, and each slice gets its answer back.

Nothing is broadcast, and a task holds one slice or one shard. A key that many texts have comes once from each slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

#: Bytes of text of a slice, and of all texts for each shard; bits of a 64-bit hash that a key leaves out.
SLICE_TEXT, SHARD_TEXT, KEY = 8_000_000, 64_000_000, np.uint64(16)


def shards_of(docs: DataFrame) -> int:
    """As many shards as hold SHARD_TEXT bytes of text (column text) each, one for each shuffle partition at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_TEXT + 1)


def gathered(batches) -> Iterator[list[pa.RecordBatch]]:
    """Batches (with a column text) that make up a slice."""
    held, size = [], 0
    for batch in slices(batches):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= SLICE_TEXT:
            yield held
            held, size = [], 0
    if held:
        yield held


def by_shard(keys: np.ndarray, count: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """Sorted keys and their counts by shard, packed."""
    shard = ((keys >> np.uint64(16)) * np.uint64(shards)) >> np.uint64(32)
    at = np.searchsorted(shard, np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(at)).tolist():
        yield k, packed(keys[at[k] : at[k + 1]], count[at[k] : at[k + 1]])


def packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys of 48 bits and their counts: differences and counts by byte place, compressed."""
    delta = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T[:6]
    count = np.minimum(n, 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(delta.tobytes() + count.tobytes(), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(10, -1)
    delta = np.zeros((planes.shape[1], 8), np.uint8)
    delta[:, :6] = planes[:6].T
    return np.cumsum(delta.view("<u8").ravel(), dtype=np.uint64), np.ascontiguousarray(planes[6:].T).view("<u4").ravel()


def record(names: list[str], schema: str, row: list) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[x.split()[1]]) for v, x in zip(row, schema.split(", "), strict=True)], names=names)
