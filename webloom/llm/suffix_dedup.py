"""Removal of byte strings that occur more than once, found with suffix arrays.

Equal strings of LENGTH bytes hold the same anchor, the GRAM bytes with the smallest hash in them. The strings
with one anchor make up its context. Contexts meet by anchor: an anchor seen once has no repeated string, and
equal contexts are repeated whole. Where contexts of an anchor differ, each distinct one is sent once; their
suffixes are sorted in two stages (suffix_array) and neighbours with a common prefix of LENGTH bytes are repeated.
An anchor with more contexts than a task takes is dealt to several; strings that stay single in theirs are
then matched between tasks by a 128-bit hash, so none is lost and no group is capped.

Defined cases: null and empty texts have no bytes; shorter texts stay. Each row is a document of its own, also
where ids and texts repeat. What is left may break UTF-8 characters, so it is binary. Other columns aren't kept.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import as_bytes, documents, mixed, saved, signed, slices, splitting_join
from .suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 200, 32
#: Bytes hashed at once, bytes sorted at once, contexts of one anchor that go to one task.
PIECE, BATCH, MOST = 1_000_000, 700_000, 2_000
NO_ID = -(1 << 63)
_RANDOM = np.random.default_rng(20)
BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(2)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64, for i below n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, np.uint64(b))
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of each GRAM bytes, by doubling."""
    h, n = BYTE[data], 1
    while n < GRAM:
        h = h[:-n] * np.uint64(2 * n + 0x9E3779B97F4A7C15 % (1 << 63)) ^ (h[n:] + np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        n *= 2
    return h


def contexts(data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pieces of texts, end to end: anchor hash, two context hashes, piece, first string's start in it, how many strings.

    The strings of a context start one after the other, and all have its anchor.
    """
    owner_start = np.cumsum(length) - length
    h = gram_hashes(data)
    wide = LENGTH - GRAM + 1
    # The hash's upper bits, then the place: the least is the leftmost of the smallest.
    m, n = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * n <= wide:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    m = np.minimum(m[: len(m) - (wide - n)], m[wide - n :])
    owner = np.repeat(np.arange(len(length)), length)
    start = np.flatnonzero(owner[LENGTH - 1 :] == owner[: len(data) - LENGTH + 1])
    place = (m[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    first, many, anchor = start[new], np.diff(np.append(new, len(start))), place[new]
    out = [mixed(h[anchor])]
    size = 1 << max(int(len(data)) - 1, 1).bit_length()
    for base in BASES:
        power, inverse = powers(base, size)
        total = np.append(np.uint64(0), np.cumsum(BYTE[data] * power[: len(data)], dtype=np.uint64))
        content = (total[first + many + LENGTH - 1] - total[first]) * inverse[first]
        out.append(mixed(content ^ mixed((anchor - first).astype(np.uint64) << np.uint64(20) | many.astype(np.uint64))))
    return *out, owner[first], first - owner_start[owner[first]], many


def pieces(batch: pa.RecordBatch):
    """Groups of (row, offset, bytes): each string of LENGTH bytes of a text starts in one piece of it."""
    group, size = [], 0
    for row, text in enumerate(as_bytes(batch.column("text"))):
        for offset in range(0, len(text) - LENGTH + 1, PIECE):
            group.append((row, offset, text[offset : offset + PIECE + LENGTH - 1]))
            size += len(group[-1][2])
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


CONTEXT = ["anchor", "c1", "c2", "id", "fp", "start", "n"]


def found_contexts(batches):
    for batch in slices(batches):
        ids, fps = batch.column("id").to_numpy(), batch.column("fp").to_numpy()
        for group in pieces(batch):
            anchor, c1, c2, piece, start, n = contexts(np.frombuffer(b"".join(g[2] for g in group), np.uint8), np.array([len(g[2]) for g in group]))
            row = np.array([g[0] for g in group])[piece]
            yield pa.RecordBatch.from_arrays([pa.array(signed(x)) for x in (anchor, c1, c2)] + [pa.array(x) for x in (ids[row], fps[row], start + np.array([g[1] for g in group])[piece], n)], names=CONTEXT)


def cut_contexts(batches):
    """The bytes of the contexts that a text stands for."""
    for batch in batches:
        for text, wanted in zip(as_bytes(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
            for at in range(0, len(wanted), 5000):
                part = wanted[at : at + 5000]
                yield pa.RecordBatch.from_pylist([{k: w[k] for k in ("anchor", "c1", "c2", "n", "several", "salt", "split")} | {"bytes": text[w["start"] : w["start"] + w["n"] + LENGTH - 1]} for w in part], schema=CUT)


CUT = pa.schema([("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), ("several", pa.bool_()), ("salt", pa.int32()), ("split", pa.bool_()), ("bytes", pa.binary())])
FLAGS = ["w1", "w2", "open", "anchor", "c1", "c2", "first", "n"]


def sorted_contexts(batches):
    """Rows come by anchor. Runs of repeated strings of each context; of split anchors also each distinct string that is single here."""
    held, size, key = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "salt", "c1", "c2", "n", "several", "split", "bytes")), strict=True):
            if row[:2] != key and size >= BATCH:
                yield from repeated_strings(held)
                held, size = [], 0
            key = row[:2]
            held.append(row)
            size += len(row[-1])
    if held:
        yield from repeated_strings(held)


def repeated_strings(rows: list[tuple]):
    n = np.array([r[4] for r in rows])
    size = np.array([len(r[7]) for r in rows])
    begin = np.cumsum(size) - size
    text = np.frombuffer(b"".join(r[7] for r in rows) + bytes(LENGTH), np.uint8)
    owner = np.repeat(np.arange(len(rows)), n)
    string = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())  # places where a string starts
    number = np.full(len(text), -1, np.int64)
    number[string] = np.arange(len(string))
    order, words = suffix_array(text, LENGTH)
    order = order[number[order] >= 0]
    like = common_prefixes(order, words, LENGTH) >= LENGTH
    twice = like | np.append(like[1:], False)
    repeated = np.zeros(len(string), bool)
    repeated[number[order[twice]]] = True
    repeated |= np.array([r[5] for r in rows])[owner]
    split = np.array([r[6] for r in rows])[owner]
    names = [np.array([r[c] for r in rows]) for c in (0, 2, 3)]
    offset = string - begin[owner]
    # One of each distinct string of the split anchors speaks for its equals here.
    head = np.zeros(len(string), bool)
    head[number[order[~like]]] = True
    for mark, which in ((False, repeated), (True, split & head)):
        at = np.flatnonzero(which)
        if mark:
            h1, h2 = string_hashes(text, string[at]) if len(at) else (np.zeros(0, np.int64),) * 2
            many = np.ones(len(at), np.int64)
        else:
            new = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))) if len(at) else at
            many = np.diff(np.append(new, len(at)))
            at = at[new]
            h1 = h2 = np.zeros(len(at), np.int64)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, np.full(len(at), mark), *(x[owner[at]] for x in names), offset[at], many)], names=FLAGS)


def string_hashes(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each string of LENGTH bytes."""
    size = 1 << (len(text) - 1).bit_length()
    out = []
    for base in BASES:
        power, inverse = powers(base, size)
        total = np.append(np.uint64(0), np.cumsum(BYTE[text] * power[: len(text)], dtype=np.uint64))
        out.append(signed(mixed((total[at + LENGTH] - total[at]) * inverse[at])))
    return out[0], out[1]


def repeated_runs(docs: DataFrame) -> DataFrame:
    """docs (id, fp, text) -> id, fp, start, n: n strings from start on that occur elsewhere too."""
    rows = docs.mapInArrow(found_contexts, "anchor long, c1 long, c2 long, id long, fp long, start long, n long")
    rows = saved(rows, "contexts")
    # Counted in each task first; the join back deals both sides anew, so Spark can split an anchor with very many contexts.
    counts = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("seen"), (F.min("c1") < F.max("c1")).alias("mixed")).filter("seen > 1")
    known = saved(splitting_join(rows, counts, ["anchor"]), "repeated")
    one = known.filter("mixed").groupBy("anchor", "c1", "c2").agg(F.min(F.struct("id", "fp", "start", "n")).alias("at"), (F.count(F.lit(1)) > 1).alias("several"), F.max("seen").alias("seen"))
    deals = F.ceil(F.col("seen") / MOST).cast("int")
    one = one.select("anchor", "c1", "c2", "at.*", "several", F.pmod(F.xxhash64("c1", "c2"), deals).cast("int").alias("salt"), (deals > 1).alias("split"))
    wanted = one.groupBy("id", "fp").agg(F.collect_list(F.struct("anchor", "c1", "c2", "start", "n", "several", "salt", "split")).alias("wanted"))
    texts = docs.join(wanted, ["id", "fp"]).dropDuplicates(["id", "fp"]).select("text", "wanted")
    cut = texts.mapInArrow(cut_contexts, "anchor long, c1 long, c2 long, n long, several boolean, salt int, split boolean, bytes binary")
    flags = cut.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "c1", "c2").mapInArrow(sorted_contexts, "w1 long, w2 long, open boolean, anchor long, c1 long, c2 long, first long, n long")
    flags = saved(flags, "strings")
    several = F.count(F.lit(1)).over(Window.partitionBy("w1", "w2"))
    # Strings of split anchors: those that other tasks have too. Equal ones in the task of one are repeated there already.
    across = flags.filter("open").withColumn("tasks", several).filter("tasks > 1")
    marked = flags.filter("NOT open").select("anchor", "c1", "c2", "first", F.col("n").alias("run")).unionByName(across.select("anchor", "c1", "c2", "first", F.col("n").alias("run")))
    partly = known.filter("mixed").select("anchor", "c1", "c2", "id", "fp", "start")
    partly = splitting_join(partly, marked, ["anchor", "c1", "c2"])
    return known.filter("NOT mixed").select("id", "fp", "start", "n").unionByName(partly.select("id", "fp", (F.col("start") + F.col("first")).alias("start"), F.col("run").alias("n")))


def dedup_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each row of docs: its id, n_bytes, n_removed, spans (removed runs of bytes), kept (bytes)."""
    plain = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("fp"), F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    gone = repeated_runs(plain.select("id", "fp", "text")).groupBy("id", "fp").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    joined = plain.join(gone, ["id", "fp"], "left").select("doc", "text", "gone")

    def cut(batches):
        for batch in slices(batches):
            kept, n_bytes, n_removed, spans = [], [], [], []
            for data, gone in zip(as_bytes(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
                change = np.zeros(len(data) + 1, np.int32)
                for g in gone or ():
                    change[g["start"]] += 1
                    change[g["start"] + g["n"] + LENGTH - 1] -= 1
                removed = np.cumsum(change)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], removed.view(np.int8), [0]])))
                kept.append(np.frombuffer(data, np.uint8)[~removed].tobytes())
                n_bytes.append(len(data))
                n_removed.append(int(removed.sum()))
                spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")


def op10_suffix_array_dedup(spark, sf_dir):
    out = dedup_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
