"""Removal of word windows that start earlier elsewhere, behind a count-min prefilter.

First pass: each slice of the texts counts the anchors of its windows (the run of ANCHOR words with the smallest hash
in a window, which equal windows share) and sends the counts to the shards of the key space; a shard merges them into
a count-min sketch and answers each slice with a bit for each of its anchors. A cell counts at least what it stands
for, so a window whose cells say one occurrence has only one. Second pass: windows estimated repeated are grouped
exactly by a 128-bit hash. Of a window's occurrences in one slice all but the first go at once, so a key gets at most
a row from each slice, however often it occurs.

A shard's sketch has DEPTH rows of at least four cells for each anchor, MOST_CELLS at most. Shards grow in number with
the texts, so cells stay as empty at any size, and no sketch is sent around. A full sketch lets more windows reach the
exact pass; none is lost.

Defined cases: null and empty texts have no words. Texts shorter than a window stay. Rows that share an id and a
text have equal places, so neither is earlier; a null id is the smallest. Other columns pass through; a new
column whose name is taken gets an underscore.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import WordHashes, as_bytes, batches_of, cleared, documents, free_name, grams, mixed, saved, signed, stored
from ._slices import KEY, by_shard, gathered, record, shards_of, unpacked

WINDOW, ANCHOR = 20, 8
DEPTH, MOST_CELLS = 2, 1 << 24
#: Bytes of text worked on at once within a slice.
PORTION = 2_000_000
NO_ID = -(1 << 63)


def anchored(words: list[np.ndarray], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of texts' word hashes, end to end: all words, each text's first, each window's start, its text, its anchor's place, the anchors' hashes."""
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size) - size
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    hashes = grams(flat, anchor)
    if len(flat) < window:
        none = np.zeros(0, np.int64)
        return flat, first, none, none, none, hashes
    owner = np.repeat(np.arange(len(words)), size)
    place = np.lib.stride_tricks.sliding_window_view(hashes, window - anchor + 1).argmin(axis=1)
    start = np.flatnonzero(owner[window - 1 :] == owner[: len(flat) - window + 1])
    return flat, first, start, owner[start], place[start] + start, hashes


PARTS = "slice string, shard int, ids array<long>, fps array<long>, lengths array<int>, blob binary"


def sliced(docs: DataFrame, window: int, anchor: int, shards: int) -> DataFrame:
    """docs (id, fp, text) in slices, a row of PARTS for each: its rows and texts; and a row for each shard of its anchors' keys, with how often it has them."""
    names = [x.split()[0] for x in PARTS.split(", ")]

    def run(batches):
        cache = WordHashes()
        for held in gathered(batches):
            name = uuid.uuid4().hex
            texts = [x for b in held for x in as_bytes(b.column("text"))]
            ids, fps = ([x for b in held for x in b.column(c).to_pylist()] for c in ("id", "fp"))
            yield record(names, PARTS, [name, -1, ids, fps, [len(t) for t in texts], zstandard.compress(b"".join(texts), 3)])
            keys = [hashes[np.unique(place)] >> KEY for *_, place, hashes in (anchored(words, window, anchor) for words in some(texts, cache))]
            for k, blob in by_shard(*np.unique(np.concatenate(keys), return_counts=True), shards):
                yield record(names, PARTS, [name, k, None, None, None, blob])

    return docs.mapInArrow(run, PARTS)


def some(texts: list[bytes], cache: WordHashes):
    """Words of some texts at a time, so that what is worked on stays small."""
    held, size = [], 0
    for text in texts:
        held.append(cache.array(text.split()))
        size += len(text)
        if size >= PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


class Sketch:
    """A shard's count-min sketch: DEPTH rows of cells, each at least as large as the counts of the keys it stands for."""

    def __init__(self, keys: int, most_cells: int):
        self.cells = 1 << 10
        while self.cells < min(most_cells, 4 * keys):
            self.cells *= 2
        self.count = np.zeros((DEPTH, self.cells), np.uint32)

    def cell(self, keys: np.ndarray, row: int) -> np.ndarray:
        return (mixed(keys + np.uint64(row * 0x9E3779B1 + 1)) & np.uint64(self.cells - 1)).astype(np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        for row in range(DEPTH):  # two are as good as more, so sums stay small
            np.add.at(self.count[row], self.cell(keys, row), np.minimum(n, 2).astype(np.uint32))

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Keys that may occur twice."""
        return np.logical_and.reduce([self.count[row][self.cell(keys, row)] >= 2 for row in range(DEPTH)])


def estimated(parts: DataFrame, shards: int, most_cells: int) -> DataFrame:
    """parts (slice, shard, blob) -> the same with a bit for each key: whether all slices together may have it twice. A shard's slices are merged into one sketch."""

    def answered(rows):
        keys = [unpacked(blob) for _, _, blob in rows]
        sketch = Sketch(sum(len(k) for k, _ in keys), most_cells)
        for k, n in keys:
            sketch.add(k, n)
        for (name, shard, _), (k, _) in zip(rows, keys, strict=True):
            yield record(["slice", "shard", "blob"], "slice string, shard int, blob binary", [name, shard, len(k).to_bytes(8, "little") + np.packbits(sketch.repeated(k)).tobytes()])

    def run(batches):
        """Rows come by shard."""
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("slice", "shard", "blob")), strict=True):
                if held and held[-1][1] != row[1]:
                    yield from answered(held)
                    held = []
                held.append(row)
        if held:
            yield from answered(held)

    return parts.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "slice string, shard int, blob binary")


def judged(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each occurrence: has its key one with a smaller (doc, start) among these?"""
    order = np.lexsort((start, doc, h2, h1))
    a, b, d, s = h1[order], h2[order], doc[order], start[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    later = np.empty(len(a), bool)
    later[order] = (d != d[head]) | (s != s[head])
    return later


def repeated_windows(docs: DataFrame, window: int, anchor: int, most_cells: int) -> DataFrame:
    """docs (id, fp, text) -> id, fp, gone: runs (start, n) of n windows that also start earlier; stored."""
    spark, shards = docs.sparkSession, shards_of(docs)
    cut, path = stored(sliced(docs, window, anchor, shards), "slices")
    bits = saved(estimated(cut.filter("shard >= 0").select("slice", "shard", "blob"), shards, most_cells), "estimates")
    names = ["h1", "h2", "later", "id", "fp", "start", "n"]

    def rows(parts):
        h1, h2, ids, fps, start = parts
        later = judged(h1, h2, ids, start)
        one = np.ones(int((~later).sum()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[~later]) for x in (h1, h2, later, ids, fps, start)] + [pa.array(one)], names=names)
        ids, fps, start = ids[later], fps[later], start[later]
        if len(ids):  # runs of windows that are settled; texts are end to end, so their windows are in order
            new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (fps[1:] != fps[:-1]) | (start[1:] != start[:-1] + 1)))
            ids, fps, start, n = ids[new], fps[new], start[new], np.diff(np.append(new, len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, start, np.ones(len(ids), bool), ids, fps, start, n)], names=names)

    def windows(header, found, cache):
        """The slice's windows whose anchor may be repeated."""
        ids, fps, lengths, blob = header
        data, at = zstandard.decompress(blob), np.cumsum([0, *lengths]).tolist()
        ids, fps, done, parts = np.array(ids), np.array(fps), 0, []
        for words in some([data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], cache):
            parts.append((done, *anchored(words, window, anchor)))
            done += len(words)
        keys = np.unique(np.concatenate([hashes[np.unique(place)] >> KEY for *_, place, hashes in parts]))
        twice = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int.from_bytes(x[:8], "little")) for x in found)]).astype(bool)
        if len(twice) != len(keys):
            raise ValueError("the slice's anchors aren't those that were counted")
        hits = []
        for row, flat, first, start, owner, place, hashes in parts:
            if not len(start):
                continue
            own, back = np.unique(place, return_inverse=True)  # windows share anchors, so each is looked up once
            hit = twice[np.searchsorted(keys, hashes[own] >> KEY)][back]
            at_, of = start[hit], owner[hit]
            hits.append((signed(grams(flat, window, 3)[at_]), signed(grams(flat, window, 5)[at_]), ids[row + of], fps[row + of], at_ - first[of]))
        if any(len(h[0]) for h in hits):
            yield from rows([np.concatenate(x) for x in zip(*hits, strict=True)])

    def run(batches):
        """Rows come by slice: its texts, then its anchors' bits by shard."""
        cache, header, found = WordHashes(), None, []
        for batch in batches:
            for shard, *head, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "ids", "fps", "lengths", "blob")), strict=True):
                if shard < 0:
                    if header:
                        yield from windows(header, found, cache)
                    header, found = (*head, blob), []
                else:
                    found.append(blob)
        if header:
            yield from windows(header, found, cache)

    both = cut.filter("shard < 0").unionByName(bits, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "shard")
    order = Window.partitionBy("h1", "h2", "later").orderBy("id", "start")
    with batches_of(spark, 64):
        found_rows = both.mapInArrow(run, "h1 long, h2 long, later boolean, id long, fp long, start long, n long")
        again = found_rows.withColumn("rank", F.rank().over(order)).filter("later OR rank > 1")
        out = saved(again.groupBy("id", "fp").agg(F.collect_list(F.struct("start", "n")).alias("gone")), "repeated")
    cleared(spark, path)
    return out


def dedup_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text", doc_id: str = "doc_id", most_cells: int = MOST_CELLS) -> DataFrame:
    """docs with text cut to the words that are left, joined by a space, n_words (before) and n_removed."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("fp"), F.col(text).alias("text"))
    plain = row.select("id", "fp", "text")
    gone = repeated_windows(plain, window, anchor, most_cells)
    joined = row.select("row", "id", "fp").join(gone, ["id", "fp"], "left").select("row", "gone")
    names = []
    for name in ("n_words", "n_removed"):
        names.append(free_name([*docs.columns, *names], name))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = part.column("row")
                columns = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
                kept, n_words, n_removed = [], [], []
                for words, gone in zip((t.split() for t in as_bytes(columns[text])), part.column("gone").to_pylist(), strict=True):
                    change = np.zeros(len(words) + 1, np.int64)
                    for g in gone or ():
                        change[g["start"]] += 1
                        change[g["start"] + g["n"] + window - 1] -= 1
                    removed = np.cumsum(change)[:-1] > 0
                    kept.append(b" ".join([w for w, r in zip(words, removed.tolist(), strict=True) if not r]).decode())
                    n_words.append(len(words))
                    n_removed.append(int(removed.sum()))
                columns[text] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=schema.names)

    return joined.mapInArrow(cut, schema)


def op5_substring_dedup(spark, sf_dir):
    out = dedup_windows(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Words of ASCII white space only, windows by their words; ids are taken to be distinct.
ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS start, ws FROM w WHERE len(ws) >= 20
), k AS (
  SELECT doc_id, start, array_to_string(ws[start:start + 19], ' ') AS win FROM s
), g AS (
  SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS n FROM k
), c AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM g WHERE n > 1
), a AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w
), m AS (
  SELECT a.doc_id, a.pos, a.word, c.pos IS NOT NULL AS gone FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.pos = c.pos
), r AS (
  SELECT doc_id, (count(*) FILTER (WHERE gone))::BIGINT AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
