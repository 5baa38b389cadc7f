"""Media columns kept in a store of content-defined chunks.

A payload becomes a portable graymap of 8-bit samples. A rolling gear hash cuts it into chunks; a chunk goes to
the store once, by the digest of its bytes, deduplicated with Spark joins; a medium is the ordered list of its
chunks' digests. Reading joins the lists with the store, puts each distinct medium together, holds it against its
own digest and only then takes features from it.

Defined cases: a null text is empty; an empty payload is padding alone. Equal payloads share one medium, and its
values. Rows repeat as often as they stand there; ids may be null. Other columns aren't looked at. A medium that
doesn't come back as it was stored raises an error.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, crc_bytes, documents, forget, saved, shuffle_files_end, slices

#: Bytes of a frame, and samples of its rows.
FRAME, ROW = 576, 24
#: Bytes of a chunk: at least, on average, at most. A cut needs the hash's upper bits to be 0.
LEAST, AVERAGE, MOST = 512, 2048, 8192
#: Chunks that the store's dictionary is made of, at most, and its bytes; how hard chunks are compressed.
SAMPLE, DICTIONARY, LEVEL = 400, 1 << 18, 9
#: Rounds in which media are put together again: each moves its share of the stored bytes.
ROUNDS = 2
GEAR = np.random.default_rng(9).integers(0, 1 << 32, 256, np.uint32)


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME or (FRAME if not text else 0))


def graymap(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def samples(media: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a graymap."""
    kind, size, most, data = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or most != b"255" or width * height != len(data):
        raise ValueError("not a graymap of 8-bit samples")
    return width, height, data


def gear(data: np.ndarray) -> np.ndarray:
    """After each byte: the sum of the last 32 bytes' gear values, each shifted by its age."""
    h, n = GEAR[data], 1
    while n < 32:
        older = np.zeros_like(h)
        older[n:] = h[:-n] << np.uint32(n)
        h, n = h + older, 2 * n
    return h


def cuts(media: list[bytes]) -> list[list[bytes]]:
    """Chunks of each medium. No cut looks at bytes before its medium: a chunk has LEAST bytes, the hash 32."""
    data = np.frombuffer(b"".join(media), np.uint8)
    at = np.flatnonzero(gear(data) < (1 << 32) // AVERAGE) + 1
    out, begin = [], 0
    for m in media:
        own = (at[np.searchsorted(at, begin) : np.searchsorted(at, begin + len(m))] - begin).tolist()
        chunks, start = [], 0
        for cut in [*own, len(m)]:
            while cut - start > MOST:
                chunks.append(m[start : start + MOST])
                start += MOST
            if cut - start >= LEAST or cut == len(m) and cut > start:
                chunks.append(m[start:cut])
                start = cut
        out.append(chunks)
        begin += len(m)
    return out


LISTS = "doc_id long, n_bytes long, media binary, media_bytes long, chunks array<binary>"


def media_lists(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> each row's medium and its chunks' digests."""

    def run(batches):
        for batch in slices(batches):
            texts = as_bytes(batch.column("text"))
            media = [graymap(payload_of(t)) for t in texts]
            lists = [[hashlib.sha256(c).digest() for c in chunks] for chunks in cuts(media)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(m).digest() for m in media]), pa.array([len(m) for m in media], pa.int64()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media", "media_bytes", "chunks"])

    return docs.mapInArrow(run, LISTS)


def dictionary(docs: DataFrame) -> bytes:
    """What chunks of docs (text) look like, which helps to compress short ones: of some texts, chosen by hash, a chunk each."""
    n = docs.count()
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 31)) < (1 << 31) * min(1.0, 4 * SAMPLE / max(1, n)))

    def run(batches):
        for batch in slices(batches):
            least = [min((hashlib.sha256(c).digest(), c) for c in chunks) for chunks in cuts([graymap(payload_of(t)) for t in as_bytes(batch.column("text"))])]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in least], pa.binary()), pa.array([c for _, c in least], pa.binary())], names=["digest", "chunk"])

    rows = some.mapInArrow(run, "digest binary, chunk binary").orderBy("digest").limit(SAMPLE).collect()
    return b"".join(dict.fromkeys(bytes(r.chunk) for r in rows))[:DICTIONARY]


def known_bytes(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(data) >= 8 else None


def media_chunks(docs: DataFrame, about: bytes = b"") -> DataFrame:
    """docs (text) -> digest, packed: each task's distinct chunks, compressed by a dictionary of what they are about."""

    def run(batches):
        seen, pack = set(), zstandard.ZstdCompressor(level=LEVEL, dict_data=known_bytes(about))
        for batch in slices(batches):
            digests, packed = [], []
            for chunks in cuts([graymap(payload_of(t)) for t in as_bytes(batch.column("text"))]):
                for chunk in chunks:
                    digest = hashlib.sha256(chunk).digest()
                    if digest not in seen:
                        seen.add(digest)
                        digests.append(digest)
                        packed.append(pack.compress(chunk))
            if len(seen) > 500_000:  # what a task has forgotten, the store's own grouping still finds
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "packed"])

    return docs.select("text").mapInArrow(run, "digest binary, packed binary")


def store(docs: DataFrame) -> str:
    """The chunk store of docs (text): the name of a table with a row for each digest, bucketed by it; its dictionary is the one row of the table beside it."""
    spark = docs.sparkSession
    name, buckets = f"webloom_chunks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    about = dictionary(docs)
    spark.createDataFrame([(bytearray(about),)], "dictionary binary").coalesce(1).write.saveAsTable(f"{name}_dictionary")
    with shuffle_files_end(spark):
        media_chunks(docs, about).repartition(buckets, "digest").dropDuplicates(["digest"]).write.option("compression", "none").bucketBy(buckets, "digest").saveAsTable(name)
    forget(spark)
    return name


def feature_of(width: int, height: int, data: bytes) -> str:
    """Size, mean and deviation in thousandths, an eighth-tone histogram, mean step between neighbours in a row."""
    x = np.frombuffer(data, np.uint8).reshape(height, width)
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    n = x.size
    deviation = int(round(max(0, square / n - (total / n) ** 2) ** 0.5 * 1000))
    step = int(np.abs(np.diff(x.astype(np.int16), axis=1)).sum(dtype=np.int64)) * 1000 // max(1, height * (width - 1))
    return f"{width}x{height} mean={total * 1000 // n} dev={deviation} step={step} tones={','.join(map(str, np.bincount((x >> 5).ravel(), minlength=8)))}"


READ = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def read_media(lists: DataFrame, chunk_table: str) -> DataFrame:
    """Of each distinct medium in lists (media, chunks): what its stored bytes say. A medium of one chunk is whole once the chunk is found, so only the others are brought together again, a share of them in each round."""
    spark = lists.sparkSession
    stored_chunks = spark.table(chunk_table)
    about = bytes(spark.table(f"{chunk_table}_dictionary").first()[0])
    distinct = lists.groupBy("media").agg(F.min("chunks").alias("chunks"))
    one = distinct.filter(F.size("chunks") == 1).select("media", F.lit(0).alias("place"), F.element_at("chunks", 1).alias("digest"))
    more = distinct.filter(F.size("chunks") > 1)

    def found(df: DataFrame) -> DataFrame:
        return df.join(stored_chunks, "digest", "left").select("media", "place", "packed")

    def run(batches):
        """Rows come by medium and place."""
        unpack, now, held = zstandard.ZstdDecompressor(dict_data=known_bytes(about)), None, []
        for batch in batches:
            out = []
            for key, packed in zip(batch.column("media").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        out.append(told(now, b"".join(held)))
                    now, held = key, []
                if packed is None:
                    raise ValueError(f"a chunk of medium {key.hex()} isn't in the store")
                held.append(unpack.decompress(packed))
            yield rows(out)
        if now is not None:
            yield rows([told(now, b"".join(held))])

    def told(key: bytes, media: bytes) -> tuple:
        if hashlib.sha256(media).digest() != key:
            raise ValueError(f"medium {key.hex()} came back changed")
        width, height, payload = samples(media)
        return key, len(payload), hashlib.sha256(payload).hexdigest(), crc_bytes(payload[-32:]), feature_of(width, height, payload)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["media", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    out = found(one).mapInArrow(run, READ)
    for k in range(ROUNDS):
        share = more.filter(F.pmod(F.xxhash64("media"), F.lit(ROUNDS)) == k).select("media", F.posexplode("chunks").alias("place", "digest"))
        out = out.unionByName(saved(found(share).repartition("media").sortWithinPartitions("media", "place").mapInArrow(run, READ), "media-read"))
    return out


def op9_media_columns(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunk_table = store(docs)
    lists = saved(media_lists(docs), "media")
    rows = lists.drop("chunks").join(read_media(lists, chunk_table), "media", "left")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature")
