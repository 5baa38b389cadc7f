"""Packing of documents into token sequences along a space-filling curve.

Each document's token counts, hashed to a fixed random vector each, are projected to a few dimensions. Less the
corpus' mean and scaled to length 1, so that only what a document is about counts, not how long it is, they are cut
by the corpus' quantiles in each dimension; the Hilbert index of these orders the documents, so that neighbours along
the curve are alike. The index, with a hash of the id below it, is range-partitioned into ranges of about as many
tokens each, sorted, and the tokens are cut into sequences along that order: a document's place is the sum of tokens
before it, from the totals of the ranges. Only the last sequence isn't full.

Defined cases: a null or empty text is the end token alone. Equal texts are neighbours; ties go by id, then
token count. Repeated rows are packed as often as they stand there. An empty table gives no piece. Other
columns aren't looked at.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, documents, kept, saved, slices

LENGTH = 1024
END = 0
TOKENIZER = "byte_bpe_50k.json"
#: Dimensions of the curve, and bits of each.
DIMS, BITS = 4, 8
#: Documents of one range, about, were all as long; ranges at most, as each is a bound and a total on the driver.
RANGE_ROWS, MOST_RANGES = 5_000, 100_000
#: Rows that a range's bounds are taken from: a document stands there once for each such share of a range that it has tokens for.
WEIGHTS = 20
#: Characters of which the tokenizer's own pattern is known to be SPLIT: others go through the tokenizer whole.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
SAFE = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ]*\Z")
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")


class Encoder(dict):
    """Token ids of texts as bytes of little-endian numbers; the ids of each piece between cuts are kept."""

    LIMIT = 1_000_000

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        #: Bytes as the model writes them: printable ones stand for themselves, the rest for what follows 255.
        keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in keep]
        self.written = str.maketrans({chr(b): chr(256 + rest.index(b)) for b in rest})
        self.model = self.tokenizer.model

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.written))]
        out = self[piece] = np.array(ids, self.kind).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        if SAFE.match(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, SPLIT.findall(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


@kept
def encoder(tokenizer: str) -> Encoder:
    return Encoder(tokenizer)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of rows of coordinates of so many bits (Skilling's transposition)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= swap | np.where(high, p, 0)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@cache
def token_vectors(size: int) -> np.ndarray:
    """A fixed random vector for each token id, with parts of mean 0 and deviation 1."""
    return np.random.default_rng(11).standard_normal((size, DIMS)).astype(np.float32)


def projected(ids: np.ndarray, size: int) -> np.ndarray:
    """The sum of the tokens' vectors."""
    return token_vectors(size)[ids].sum(axis=0, dtype=np.float64)


def encoded(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n, ids, v (the sum of the tokens' vectors); stored."""

    def run(batches):
        enc = encoder(tokenizer)
        size, end = enc.tokenizer.get_vocab_size(), np.array([END], enc.kind).tobytes()
        step = len(end)
        for batch in slices(batches):
            ids = [enc.encode(t.decode()) + end for t in as_bytes(batch.column("text"))]
            v = [projected(np.frombuffer(x, enc.kind), size) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // step for x in ids], pa.int64()), pa.array(ids), pa.array(v, pa.list_(pa.float64()))], names=["doc_id", "n", "ids", "v"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, ids binary, v array<double>")
    return saved(rows, "tokens")


def directed(tokens: DataFrame) -> DataFrame:
    """tokens with x: v for each token, less the corpus' mean, scaled to length 1."""
    mean = tokens.agg(F.sum("n"), *(F.sum(F.col("v")[i]) for i in range(DIMS))).first()
    x = [F.col("v")[i] / F.col("n") - (mean[1 + i] or 0.0) / (mean[0] or 1) for i in range(DIMS)]
    length = F.greatest(F.sqrt(sum((c * c for c in x[1:]), x[0] * x[0])), F.lit(1e-12))
    return tokens.withColumn("x", F.array(*(c / length for c in x))).drop("v")


def placed(tokens: DataFrame) -> np.ndarray:
    """The quantiles of x in each dimension, 2 ** BITS parts."""
    parts = 1 << BITS
    cuts = tokens.agg(*(F.percentile_approx(F.col("x")[i], [k / parts for k in range(1, parts)], 20 * parts) for i in range(DIMS))).first()
    return np.array([c or [0.0] * (parts - 1) for c in cuts])


def places(x: np.ndarray, doc_id: pa.Array, low: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """Hilbert index of each row's cell, above a hash of its id."""
    cell = np.stack([np.searchsorted(cuts[i], x[:, i], "right") for i in range(DIMS)], axis=1)
    return (hilbert(cell, BITS) << 30) + low.to_numpy()


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids on demand."""
    tokens = directed(encoded(docs, tokenizer, text, doc_id))
    cuts = placed(tokens)
    low = F.pmod(F.xxhash64("doc_id"), F.lit((1 << 30) - 1)).alias("low")
    rows, total = tokens.agg(F.count(F.lit(1)), F.sum("n")).first()
    ranges = min(MOST_RANGES, max(1, -(-rows // RANGE_ROWS)))

    def place(batches, bounds=None):
        for batch in batches:
            x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(-1, DIMS)
            at = places(x, batch.column("doc_id"), batch.column("low"), cuts)
            if bounds is None:
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("n")], names=["place", "n"])
            else:
                part = np.searchsorted(bounds, at, "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(at), *(batch.column(c) for c in ("doc_id", "n", "ids"))], names=["part", "place", "doc_id", "n", "ids"])

    bounds = []
    if ranges > 1:
        share = max(1, total // (ranges * WEIGHTS))
        weighed = tokens.select("doc_id", "x", "n", low).mapInArrow(place, "place long, n long").select("place", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / share))))
        bounds = sorted(set(weighed.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]))
    bounds = np.array(bounds, np.int64)

    def parts(batches):
        for batch in place(batches):
            part = np.searchsorted(bounds, batch.column("place").to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("n")], names=["part", "n"])

    short = tokens.select("doc_id", "x", "n", low).mapInArrow(parts, "part int, n long")
    tokens = tokens.select("doc_id", "x", "n", "ids", low).mapInArrow(lambda batches: place(batches, bounds), "part int, place long, doc_id long, n long, ids binary")
    # As many totals as ranges.
    totals = {r.part: r.n for r in short.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    first, at = {}, 0
    for p in sorted(totals):
        first[p], at = at, at + totals[p]
    kind = encoder(tokenizer).kind

    def pieces(batches):
        step, part, at = np.dtype(kind).itemsize, None, 0
        for batch in batches:
            out = []
            for p, doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "ids")), strict=True):
                if p != part:
                    part, at = p, first[p]
                start = 0
                while start < n:
                    take = min(n - start, length - at % length)
                    cut = np.frombuffer(ids, kind, take, start * step).astype("<u4")
                    out.append((doc, start, take, zlib.crc32(cut.tobytes()), n, at // length, at % length, cut.tobytes() if with_ids else None))
                    start, at = start + take, at + take
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 20_000], strict=True), [pa.int64()] * 7 + [pa.binary()], strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    order = tokens.repartitionById(ranges, "part").sortWithinPartitions("part", "place", "doc_id", "n", "ids")
    rows = order.select("part", "doc_id", "n", "ids").mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return rows if with_ids else rows.drop("ids")


def op7_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir), tokenizer_path())


def pack_all(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sequences of all documents that are left."""
    return pack(docs, tokenizer_path())
