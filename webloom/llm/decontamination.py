"""Benchmark decontamination with a distributed positional inverted index.

The training texts become index segments, each of some whole documents: for every term the sorted positions of
its words. A test phrase is looked up in each segment from its rarest term on, as counted over all segments:
the lists, shifted by each term's place in the phrase, are intersected until none is left or all have met. What
remains are exact occurrences. A proximity match has all terms of a phrase near one of its rarest term.

Defined cases: null texts have no words and match nothing. An item of fewer words than a window is one window.
A repeated item counts once, a null item id is the empty string. Phrases never cross documents. Rows that share
a doc_id are documents of their own. Without items nothing is hit. Other columns aren't looked at.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, as_bytes, documents, saved, signed, slices

WINDOW = 13
#: Words on either side of a phrase's length within which all its terms make a proximity match.
SLOP = 2
#: Distinct test terms up to which the index leaves other terms out; with more it holds every term.
MOST_TERMS = 2_000_000
#: Windows that go to the executors at once; a larger benchmark is searched in several passes.
CHUNK = 200_000
#: Positions between two documents, more than any phrase with its slop.
GAP = 4096
#: A-Z in lower case; other ASCII than letters and digits is a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SEGMENT = "segment string, doc_ids array<long>, marks array<long>, lengths array<int>, terms binary, ends binary, positions binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def build_index(docs: DataFrame, terms: np.ndarray | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Segments of docs, stored; terms (sorted hashes) limits the lists to these."""

    def segments(batches):
        cache = WordHashes()
        for batch in slices(batches):
            words = [cache.array(words_of(t)) for t in as_bytes(batch.column("text"))]
            size = np.array([len(w) for w in words])
            start = np.cumsum(size + GAP) - size - GAP
            term = np.concatenate(words)
            at = (np.repeat(start - np.cumsum(size) + size, size) + np.arange(len(term))).astype(np.int32)
            if terms is not None:
                i = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
                known = terms[i] == term if len(terms) else np.zeros(len(term), bool)
                term, at = term[known], at[known]
            order = np.argsort(term, kind="stable")
            name, count = np.unique(term, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([batch.column("mark").to_pylist()], pa.list_(pa.int64())), pa.array([size], pa.list_(pa.int32())), pa.array([name.tobytes()]), pa.array([np.cumsum(count).astype(np.int32).tobytes()]), pa.array([at[order].tobytes()])],
                names=["segment", "doc_ids", "marks", "lengths", "terms", "ends", "positions"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return saved(rows.mapInArrow(segments, SEGMENT), "index")


class Phrases:
    """Distinct windows of some items: terms (0 beyond the end), how many, and the items that have each."""

    def __init__(self, windows: dict[tuple, set]):
        self.items = [sorted(x) for x in windows.values()]
        self.length = np.array([len(w) for w in windows], np.int64)
        width = max(self.length, default=0)
        self.terms = np.zeros((len(windows), width), np.uint64)
        for i, w in enumerate(windows):
            self.terms[i, : len(w)] = w
        self.inside = np.arange(width) < self.length[:, None]
        self.vocabulary = np.unique(self.terms[self.inside])

    def rank(self, frequency: dict[int, int]) -> None:
        """The order in which each phrase's terms are looked up: the rarest first."""
        many = np.array([frequency.get(int(v), 0) for v in signed(self.vocabulary)], np.int64)
        place = np.searchsorted(self.vocabulary, self.terms)
        cost = np.where(self.inside, many[np.minimum(place, len(many) - 1)] if len(many) else 0, 1 << 62)
        self.order = np.argsort(cost, axis=1, kind="stable")


def item_windows(texts, window: int, cache: WordHashes) -> Iterator[tuple[str, tuple]]:
    for item, text in texts:
        w = cache.array(words_of((text or "").encode())).tolist()
        for i in range(max(1, len(w) - window + 1) if w else 0):
            yield "" if item is None else str(item), tuple(w[i : i + window])


def chunks(items: DataFrame, window: int) -> Iterator[Phrases]:
    """The items' windows, CHUNK at a time on the driver."""
    cache, found = WordHashes(), defaultdict(set)
    for item, w in item_windows(((r[0], r[1]) for r in items.toLocalIterator()), window, cache):
        found[w].add(item)
        if len(found) >= CHUNK:
            yield Phrases(found)
            found = defaultdict(set)
    if found:
        yield Phrases(found)


def frequencies(index: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often the training texts have each term of a vocabulary (of one chunk, so bounded)."""

    def partial(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for t, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, count = np.frombuffer(t, np.uint64), np.diff(np.frombuffer(e, np.int32), prepend=0)
                i = np.searchsorted(vocabulary, name)
                i = np.minimum(i, max(len(vocabulary) - 1, 0))
                same = vocabulary[i] == name
                np.add.at(total, i[same], count[same])
        yield pa.RecordBatch.from_arrays([pa.array(signed(vocabulary)), pa.array(total)], names=["term", "n"])

    rows = index.select("terms", "ends").mapInArrow(partial, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r.term: r.n for r in rows}


def matches(segment: tuple, phrases: Phrases, slop: int | None) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(phrase, positions, exact) in one segment."""
    name, end, position = segment
    start = np.append(0, end[:-1])
    if not len(name) or not len(phrases.length):
        return
    where = np.minimum(np.searchsorted(name, phrases.terms), len(name) - 1)
    here = (name[where] == phrases.terms) | ~phrases.inside
    for p in np.flatnonzero(here.all(axis=1)):
        order = phrases.order[p, : phrases.length[p]]
        lists = [position[start[i] : end[i]] for i in where[p, order]]
        left = lists[0] - order[0]
        for shift, run in zip(order[1:], lists[1:], strict=True):
            i = np.minimum(np.searchsorted(run, left + shift), len(run) - 1)
            left = left[run[i] == left + shift]
            if not len(left):
                break
        if len(left):
            yield int(p), left, True
        if slop is not None:
            reach, near = int(phrases.length[p]) - 1 + slop, lists[0]
            for run in lists[1:]:
                i = np.searchsorted(run, near)
                gap = np.minimum(np.abs(run[np.minimum(i, len(run) - 1)] - near), np.abs(run[np.maximum(i - 1, 0)] - near))
                near = near[gap <= reach]
                if not len(near):
                    break
            if len(near):
                yield int(p), near, False


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = SLOP) -> DataFrame:
    """A row for each document: doc_id, mark (a hash of its text), n_words, hits (merged word ranges of exact matches), items, near_items.

    items: (item_id, text). Exact matches also count as near ones.
    """
    found = None
    for phrases in chunks(items, window):
        phrases.rank(frequencies(index, phrases.vocabulary))
        now = _searched(index, phrases, slop)
        if found is None:
            found, several = now, False
            continue
        # A pass that is written needs its windows no more, so the driver holds those of one or two passes.
        found, several = saved(found, "pass") if not several else found, True
        found = found.unionByName(saved(now, "pass"))
    if found is None:
        found, several = _searched(index, Phrases({}), slop), False
    if not several:
        return found.drop("segment", "row")
    # A document has a row from each pass, so groups are small.
    found = found.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"))
    return found.drop("segment", "row").withColumn("hits", _merge(F.col("hits")))


def _merge(ranges):
    """Sorted ranges, those that meet joined."""
    step = lambda out, r: F.when((F.size(out) > 0) & (F.element_at(out, -1)["stop"] >= r["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["stop"], r["stop"]).alias("stop"))))).otherwise(F.concat(out, F.array(r)))
    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<start:int,stop:int>>"), step)


FOUND = "segment string, row int, doc_id long, mark long, n_words long, hits array<struct<start:int,stop:int>>, items array<string>, near_items array<string>"


def _searched(index: DataFrame, phrases: Phrases, slop: int | None) -> DataFrame:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def found(batches):
        for batch in batches:
            for key, ids, marks, size, name, end, position in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = np.array(size)
                start = np.cumsum(size + GAP) - size - GAP
                change = np.zeros(int(start[-1] + size[-1]) + GAP, np.int32) if len(size) else np.zeros(0, np.int32)
                exact, near = defaultdict(set), defaultdict(set)
                segment = (np.frombuffer(name, np.uint64), np.frombuffer(end, np.int32), np.frombuffer(position, np.int32))
                for p, at, whole in matches(segment, phrases, slop):
                    if whole:
                        np.add.at(change, at, 1)
                        np.add.at(change, at + phrases.length[p], -1)
                    for d in np.unique(np.searchsorted(start, at, "right") - 1):
                        (exact if whole else near)[int(d)].update(phrases.items[p])
                covered = np.cumsum(change) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                begin, stop = edge[::2], edge[1::2]
                owner = np.searchsorted(start, begin, "right") - 1
                ranges = defaultdict(list)
                for d, b, s in zip(owner.tolist(), begin.tolist(), stop.tolist(), strict=True):
                    ranges[d].append({"start": b - int(start[d]), "stop": s - int(start[d])})
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n), pa.array(range(n), pa.int32()), pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(size, pa.int64()), pa.array([ranges[d] for d in range(n)], kind), pa.array([sorted(exact[d]) for d in range(n)], pa.list_(pa.string())), pa.array([sorted(exact[d] | near[d]) for d in range(n)], pa.list_(pa.string()))],
                    names=["segment", "row", "doc_id", "mark", "n_words", "hits", "items", "near_items"],
                )

    return index.select("segment", "doc_ids", "marks", "lengths", "terms", "ends", "positions").mapInArrow(found, FOUND)


def test_terms(items: DataFrame) -> np.ndarray | None:
    """Sorted hashes of all words of the items; None if they are more than MOST_TERMS."""

    def distinct(batches):
        cache = WordHashes()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.unique(np.concatenate([cache.array(words_of(t)) for t in as_bytes(batch.column("text"))]))))], names=["term"])

    terms = saved(items.toDF("item_id", "text").select("text").mapInArrow(distinct, "term long").distinct(), "terms")
    if terms.count() > MOST_TERMS:
        return None
    return np.sort(np.array([r.term for r in terms.collect()], np.int64).view(np.uint64))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = SLOP) -> DataFrame:
    """search() of items (item_id, text) over docs, with n_hit and contaminated: at least a twentieth of the words hit."""
    found = search(build_index(docs, test_terms(items)), items, window, slop)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def op3_decontamination(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate(documents(spark, sf_dir), items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near_items"))


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go. Each row is judged by its own text, also where ids are null or repeat."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    gone = decontaminate(docs, items, slop=None).filter("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("mark"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark"))
    return rows.join(gone, same, "left_anti").select("row.*")


#: Words of a window are joined by blanks, which no word has. Near: all terms within m + 1 places of one of the rarest.
ORACLE_SQL = """
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM t
), i AS (
  SELECT DISTINCT id AS item_id, array_to_string(ws[s:s + 12], ' ') AS win, least(13, len(ws)) AS m
  FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS s FROM w WHERE kind = 1 AND len(ws) > 0)
), g AS (
  SELECT id AS doc_id, m, s, array_to_string(ws[s:s + m - 1], ' ') AS win
  FROM (SELECT id, ws, m, unnest(range(1, len(ws) - m + 2)) AS s FROM w JOIN (SELECT DISTINCT m FROM i) ON len(ws) >= m WHERE kind = 0)
), h AS (
  SELECT g.doc_id, g.s, g.m, i.item_id FROM g JOIN i ON i.win = g.win AND i.m = g.m
), p AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS place FROM h) GROUP BY doc_id
), f AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
), v AS (
  SELECT win, unnest(string_split(win, ' ')) AS term, generate_subscripts(string_split(win, ' '), 1) AS k FROM (SELECT DISTINCT win FROM i)
), a AS (
  SELECT * FROM (SELECT id AS doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS place FROM w WHERE kind = 0) WHERE term IN (SELECT term FROM v)
), b AS (
  SELECT term, count(*) AS n FROM a GROUP BY term
), q AS (
  SELECT win, arg_min(term, n * 1000 + k) AS term, max(k) AS m, count(DISTINCT term) AS terms FROM v JOIN b USING (term) GROUP BY win
  HAVING count(*) = (SELECT count(*) FROM v AS u WHERE u.win = v.win)
), c AS (
  SELECT q.win, q.m, q.terms, a.doc_id, a.place FROM q JOIN a ON a.term = q.term
), z AS (
  SELECT DISTINCT doc_id, win FROM (
    SELECT c.doc_id, c.place, c.win FROM c JOIN (SELECT DISTINCT win, term FROM v) t ON t.win = c.win
    JOIN a ON a.doc_id = c.doc_id AND a.term = t.term AND abs(a.place - c.place) <= c.m + 1
    GROUP BY c.doc_id, c.place, c.win, c.terms HAVING count(DISTINCT t.term) = c.terms)
), y AS (
  SELECT z.doc_id, count(DISTINCT i.item_id) AS n_near FROM z JOIN i ON i.win = z.win GROUP BY z.doc_id
)
SELECT id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM w LEFT JOIN p ON p.doc_id = id LEFT JOIN f ON f.doc_id = id LEFT JOIN y ON y.doc_id = id WHERE kind = 0
"""
