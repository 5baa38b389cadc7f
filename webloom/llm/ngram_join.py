"""Similarity self-join of documents by the Jaccard coefficient of their word n-grams, exact.

Equal sets collapse first. N-grams are ordered by how many sets have them, counted over all: each slice of the
texts sends its n-grams' keys to the shards of the key space and gets a class of rarity back for each. Two sets
similar enough share one of the rarest n-grams of both (a prefix bound that loses nothing); n-grams of one set
only can't be it. Sets that share one, and what those reach, form a cell. Inside a cell a T-occurrence search
finds the links: an inverted list for each n-gram, the short lists of a document heap-merged, the long ones
probed by binary search (DivideSkip), and documents kept that reach the overlap which the coefficient needs. A
cell too large for a task is dealt into blocks, and each pair of blocks is searched: no list, partner or
candidate is capped.

Defined cases: a text with fewer words than n has its whole word sequence as one n-gram; a null text, an empty
one and one of blanks have none and link with nothing. Equal sets link. Each row is judged by its own text,
also where ids repeat. A row with a null id gets its counts and no component. Other columns aren't looked at.
"""

from __future__ import annotations

import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, as_bytes, batches_of, cleared, documents, grams, saved, signed, slices, splitting_join, stored
from ._components import components
from ._slices import KEY, by_shard, gathered, record, shards_of, unpacked

N, PERCENT = 3, 90
#: N-grams of one block; a task holds two blocks.
BLOCK = 1_000_000
#: DivideSkip's weight of a probe's cost against a merge's, as published.
MU = 0.0085
LAST_ID = (1 << 63) - 1


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-grams of a word-hash sequence, sorted."""
    if len(words) < n:
        return grams(words, len(words), 2) if len(words) else np.zeros(0, np.uint64)
    return np.unique(grams(words, n))


def sets_of(texts: list[bytes], n: int, cache: WordHashes) -> list[np.ndarray]:
    return [shingle_set(cache.array(t.lower().split()), n) for t in texts]


def overlap(a: int, b: int, percent: int) -> int:
    """The n-grams that sets of these sizes must share."""
    return -(-percent * (a + b) // (100 + percent))


def t_occurrence(sets: list[np.ndarray], percent: int, cross: np.ndarray | None = None):
    """Pairs (q, c) of indices whose sets are similar; with cross (a side for each set) only pairs of both sides."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    side = None if cross is None else cross[order]
    flat = np.concatenate([sets[i] for i in order]) if len(order) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(order)), size)
    # Inverted lists in one array: by n-gram, then by document in order of size.
    by = np.argsort(flat, kind="stable")
    lists = owner[by]
    at = np.empty(len(flat), np.int64)
    at[by] = np.arange(len(flat))
    new = np.flatnonzero(np.append(True, flat[by][1:] != flat[by][:-1])) if len(flat) else np.zeros(0, np.int64)
    ends = np.append(new[1:], len(flat))
    end = np.empty(len(flat), np.int64)
    end[by] = np.repeat(ends, ends - new) if len(flat) else 0
    starts = np.append(0, np.cumsum(size))
    for q in range(len(order)):
        s, e = at[starts[q] : starts[q + 1]] + 1, end[starts[q] : starts[q + 1]]
        some = e > s
        s, e = s[some], e[some]
        t = overlap(int(size[q]), int(size[q]), percent)
        if len(s) < t or not len(s):
            continue
        longest = np.argsort(s - e, kind="stable")
        s, e = s[longest], e[longest]
        n_long = min(t - 1, int(t / (MU * math.log2(max(2, e[0] - s[0])) + 1)))
        short = [lists[i:j] for i, j in zip(s[n_long:], e[n_long:], strict=True)]
        found, count = merged(short, t - n_long)
        fits = size[found] * percent <= size[q] * 100
        if side is not None:
            fits &= side[found] != side[q]
        found, count = found[fits], count[fits]
        found, count = probed(lists, s[:n_long], e[:n_long], found, count, t)
        both = size[found] + size[q]
        hit = 100 * count >= percent * (both - count)
        for c in found[hit]:
            yield int(order[q]), int(order[c])


def merged(short: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents in at least so many of the lists, and in how many: a heap over few entries, a sort of the runs over many."""
    if sum(map(len, short)) > 500:
        found, count = np.unique(np.concatenate(short), return_counts=True)
    else:
        found, count = [], []
        for d in heapq.merge(*(x.tolist() for x in short)):
            if found and found[-1] == d:
                count[-1] += 1
            else:
                found.append(d)
                count.append(1)
        found, count = np.array(found, np.int64), np.array(count, np.int64)
    keep = count >= least
    return found[keep], count[keep]


def probed(lists: np.ndarray, s: np.ndarray, e: np.ndarray, found: np.ndarray, count: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Adds to count in how many of the long lists each document is, by binary search; drops those that can't reach t."""
    if len(found) <= 12:  # all lists at once for each document
        for x in range(len(found)):
            low, high = s.copy(), e.copy()
            while (open_ := low < high).any():
                mid = (low + high) >> 1
                less = open_ & (lists[np.minimum(mid, len(lists) - 1)] < found[x])
                low = np.where(less, mid + 1, low)
                high = np.where(open_ & ~less, mid, high)
            count[x] += int(((low < e) & (lists[np.minimum(low, len(lists) - 1)] == found[x])).sum())
        return found, count
    for n in range(len(s)):  # all documents at once in each list
        run = lists[s[n] : e[n]]
        i = np.searchsorted(run, found)
        count = count + (run[np.minimum(i, len(run) - 1)] == found)
        if n % 16 == 15:
            can = count + (len(s) - n - 1) >= t
            found, count = found[can], count[can]
            if not len(found):
                break
    return found, count


SETS = "slice string, shard int, doc_ids array<long>, marks array<long>, sizes array<long>, prints array<binary>, sets array<binary>, lengths array<int>, blob binary"


def sliced(docs: DataFrame, n: int, shards: int) -> DataFrame:
    """docs (doc_id, mark, text) in slices, a row of SETS for each: its rows, its distinct sets and a text of each; and a row for each shard of its n-grams' keys."""
    names = [x.split()[0] for x in SETS.split(", ")]

    def one(held, cache):
        ids, marks = ([x for b in held for x in b.column(c).to_pylist()] for c in ("doc_id", "mark"))
        texts = [x for b in held for x in as_bytes(b.column("text"))]
        sets = sets_of(texts, n, cache)
        prints = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
        first: dict[bytes, int] = {}
        for row, (i, p) in enumerate(zip(ids, prints, strict=True)):
            if p is not None and i is not None:
                first.setdefault(p, row)
        own, name = list(first.values()), uuid.uuid4().hex
        blob = zstandard.compress(b"".join(texts[r] for r in own), 3)
        yield record(names, SETS, [name, -1, ids, marks, [len(x) for x in sets], prints, list(first), [len(texts[r]) for r in own], blob])
        if not own:
            return
        keys, count = np.unique(np.concatenate([sets[r] for r in own]) >> KEY, return_counts=True)
        for k, blob in by_shard(keys, count, shards):
            yield record(names, SETS, [name, k, None, None, None, None, None, None, blob])

    def run(batches):
        cache = WordHashes()
        for held in gathered(batches):
            yield from one(held, cache)

    return docs.mapInArrow(run, SETS)


def rarities(keys: DataFrame, shards: int) -> DataFrame:
    """keys (slice, shard, blob) -> the same with a class for each key: 0 where one set of all has it, else the more the more sets have it."""

    def answered(rows):
        parts = [unpacked(blob) for _, _, blob in rows]
        _, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        total = np.bincount(back, np.concatenate([n for _, n in parts]))
        rank = np.where(total < 2, 0, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(total, 1))))).astype(np.uint8)[back]
        at = 0
        for (name, shard, _), (k, _) in zip(rows, parts, strict=True):
            yield record(["slice", "shard", "blob"], "slice string, shard int, blob binary", [name, shard, zstandard.compress(rank[at : at + len(k)].tobytes(), 1)])
            at += len(k)

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

    return keys.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "slice string, shard int, blob binary")


def prefixes(sets: DataFrame, ranks: DataFrame, n: int, percent: int) -> DataFrame:
    """Of each set that may have a partner: fp, n, grams (of its prefix, without those that no other set has) and a text.

    Similar sets share at least percent of either one's n-grams, so they share one of those that come first in
    both, by rarity, when the last of so many but one are left out.
    """

    def chosen(header, found, cache):
        prints, lengths, blob = header
        data, texts, at = zstandard.decompress(blob), [], 0
        for size in lengths:
            texts.append(data[at : at + size])
            at += size
        own = sets_of(texts, n, cache)
        flat = np.concatenate(own) >> KEY
        order = np.argsort(flat, kind="stable")
        new = np.append(True, flat[order[1:]] != flat[order[:-1]])
        rank = np.frombuffer(b"".join(found), np.uint8)
        if len(rank) != new.sum():
            raise ValueError("the slice's n-grams aren't those that were counted")
        each = np.empty(len(flat), np.uint8)
        each[order] = rank[np.cumsum(new) - 1]
        out = []
        for fp, text, x, r in zip(prints, texts, own, np.split(each, np.cumsum([len(x) for x in own])[:-1]), strict=True):
            most = len(x) - -(-percent * len(x) // 100) + 1 - int((r == 0).sum())
            if most > 0:
                shared = x[r > 0]
                out.append((fp, len(x), signed(shared[np.lexsort((shared, r[r > 0]))[:most]]), text))
        for k in range(0, len(out), 500):
            part = out[k : k + 500]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.binary()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.list_(pa.int64())), pa.array([x[3] for x in part], pa.binary())], names=["fp", "n", "grams", "text"])

    def run(batches):
        """Rows come by slice: its sets, then its n-grams' classes by shard."""
        cache, header, found = WordHashes(), None, []
        for batch in batches:
            for shard, prints, lengths, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "sets", "lengths", "blob")), strict=True):
                if shard < 0:
                    if header and header[0]:
                        yield from chosen(header, found, cache)
                    header, found = (prints, lengths, blob), []
                else:
                    found.append(zstandard.decompress(blob))
        if header and header[0]:
            yield from chosen(header, found, cache)

    both = sets.select("slice", "shard", "sets", "lengths", "blob").unionByName(ranks, allowMissingColumns=True)
    return both.repartition("slice").sortWithinPartitions("slice", "shard").mapInArrow(run, "fp binary, n long, grams array<long>, text binary")


def linked(docs: DataFrame, n: int = N, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, mark, text) -> doc_id, mark, n, fp (a set's print, null without words), root (of the set's links, a print), least (smallest id that they reach), n_links."""
    spark = docs.sparkSession
    shards = shards_of(docs)
    cut, cut_path = stored(sliced(docs, n, shards), "slices")
    header = cut.filter("shard < 0")
    rows = saved(header.select(F.explode(F.arrays_zip("doc_ids", "marks", "sizes", "prints")).alias("x")).select(F.col("x.doc_ids").alias("doc_id"), F.col("x.marks").alias("mark"), F.col("x.sizes").alias("n"), F.col("x.prints").alias("fp")), "rows")
    known = rows.filter(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))

    ranks = saved(rarities(cut.filter("shard >= 0").select("slice", "shard", "blob"), shards), "ranks")
    with batches_of(spark, 64):
        alive = saved(prefixes(header, ranks, n, percent), "prefixes")
    cleared(spark, cut_path)
    # Equal sets of other slices have the same prefix: each says once which set is the first with an n-gram.
    postings = alive.select("fp", F.explode("grams").alias("gram"))
    first = postings.groupBy("gram").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).filter("first <> last").select("gram", "first")
    near = splitting_join(postings, first, ["gram"]).filter("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    cells = saved(components(near).toDF("fp", "cell"), "cells")

    members = splitting_join(cells, classes, ["fp"])
    texts = alive.groupBy("fp").agg(F.first("n").alias("n"), F.first("text").alias("text")).join(members, "fp")
    blocks = splitting_join(cells, alive.groupBy("fp").agg(F.first("n").alias("n")), ["fp"]).groupBy("cell").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    dealt = (
        splitting_join(texts, blocks, ["cell"])
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .select("cell", "i", "j", "own", "fp", "copies", "text")
        .repartition("cell", "i", "j")
        .sortWithinPartitions("cell", "i", "j", "fp")
    )

    def searched(batches):
        """Rows come by cell and pair of blocks."""
        cache, key, held = WordHashes(), None, []
        for batch in slices(batches):
            sets = sets_of(as_bytes(batch.column("text")), n, cache)
            for row, own in zip(zip(*(batch.column(c).to_pylist() for c in ("cell", "i", "j", "own", "fp", "copies")), strict=True), sets, strict=True):
                if row[:3] != key:
                    if held:
                        yield links(key, held, percent)
                    key, held = row[:3], []
                held.append((*row[3:], own))
        if held:
            yield links(key, held, percent)

    found = saved(dealt.mapInArrow(searched, "fp binary, root binary, links long"), "links")
    roots = saved(components(found.select(F.col("fp").alias("a"), F.col("root").alias("b"))).toDF("fp", "root"), "roots")
    least = splitting_join(roots, classes, ["fp"]).groupBy("root").agg(F.min("rep").alias("least"))
    degree = found.groupBy("fp").agg(F.sum("links").alias("links"))
    named = classes.join(splitting_join(roots, least, ["root"]), "fp", "left").join(degree, "fp", "left")
    named = named.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "rep").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return splitting_join(rows, named, ["fp"], "left").select("doc_id", "mark", "n", "fp", "root", "least", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_join(docs: DataFrame, n: int = N, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (smallest id reachable by links), n_links."""
    found = linked(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("mark"), F.col(text).alias("text")), n, percent, block)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"), "n_links")


def links(key: tuple, rows: list[tuple], percent: int):
    """A row for each set of the group (own block, fp, copies, n-grams) that has a link: a set that its links reach, and how many documents they lead to."""
    sets = [r[3] for r in rows]
    cross = np.array([r[0] for r in rows]) if key[1] != key[2] else None
    up, degree = list(range(len(rows))), [0] * len(rows)

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for q, c in t_occurrence(sets, percent, cross):
        degree[q] += rows[c][2]
        degree[c] += rows[q][2]
        a, b = sorted((top(q), top(c)))
        up[b] = a
    have = [x for x in range(len(rows)) if degree[x]]
    return pa.RecordBatch.from_arrays([pa.array([rows[x][1] for x in have], pa.binary()), pa.array([rows[top(x)][1] for x in have], pa.binary()), pa.array([degree[x] for x in have], pa.int64())], names=["fp", "root", "links"])


def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join(documents(spark, sf_dir))


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (five words, 0.8 or more) one row stays, that of the smallest id; rows without words stay.

    Each row is judged by its own text. A null id is the largest; rows of a group that share its smallest id go
    by a hash of their text, and of those equal in both any one stays.
    """
    mark = F.xxhash64("text")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    found = saved(linked(docs.select(key.alias("doc_id"), mark.alias("mark"), "text"), 5, 80), "found")
    row = F.struct("doc_id", "mark")
    kept = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(row).alias("kept"))
    # Rows of one id and mark are of one set, so they have one root.
    each = found.filter("root IS NOT NULL").groupBy("doc_id", "mark").agg(F.first("root").alias("root"), F.count(F.lit(1)).alias("rows"))
    judged = splitting_join(each, kept, ["root"]).select("doc_id", "mark", F.when(row == F.col("kept"), F.when(F.col("rows") > 1, "several").otherwise("one")).otherwise("gone").alias("fate"))
    judged = judged.filter("fate <> 'one'").toDF("key_", "mark_", "fate_")
    whole = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key_"), mark.alias("mark_"))
    whole = splitting_join(whole, judged, ["key_", "mark_"], "left")
    once = whole.filter("fate_ = 'several'").groupBy("key_", "mark_").agg(F.first("row").alias("row"))
    return whole.filter("fate_ IS NULL").select("row.*").unionByName(once.select("row.*"))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY doc_id
), e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 90 * (p.n + q.n - shared)
), l AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node
), c AS (
  SELECT node, min(root) AS component_id FROM r GROUP BY node
), k AS (
  SELECT a, count(*)::BIGINT AS n_links FROM l GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
