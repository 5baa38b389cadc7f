"""Language identification by nearest centroid.

Each text becomes a TF-IDF vector of hashed letter n-grams, scaled to length 1. Several centroids per
language come from spherical k-means; a text takes the language of the centroid with the largest cosine
and is rejected where that cosine lies below the centroid's radius.

Defined cases: a null text, an empty one and one without any letter get ``und``, score 0, rejected. Rows
without a label teach nothing. Ties go to the language first by name. Repeated rows count as often as they
stand there. Without any labelled row all is ``und``. Other columns pass through; a new column whose name is
taken gets an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import as_bytes, crc_fold, documents, free_name, let_go, slices

DIMS = 4096
#: Bound of the labelled rows, for each language, that centroids are fitted on.
FIT_ROWS = 600
CENTROIDS = 3
#: A radius lies midway between the cosine that only this share of the language's own rows fall below and the one that
#: only this share of the other languages' rows exceed.
RADIUS_QUANTILE = 0.01
#: A-Z in lower case; what is neither an ASCII letter nor part of a longer character is a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray  # a row each, of length 1
    langs: list[str]  # of each centroid
    radius: np.ndarray


def has_letter(text: bytes) -> bool:
    folded = text.translate(FOLD)
    if folded.isspace() or not folded:
        return False
    return any(97 <= c <= 122 for c in folded) if folded.isascii() else any(c.isalpha() for c in text.decode())


def counts(texts: list[bytes]) -> np.ndarray:
    """A row for each text: how often each hashed 1-, 2- and 3-gram stands in it."""
    parts = [b" " + t.translate(FOLD) + b" " for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(parts), dtype=np.int64), [len(p) for p in parts]) * DIMS
    space = data == 32
    cells = []
    for n in (1, 2, 3):
        m = len(data) - n + 1
        code, blank, same = data[:m].copy(), space[:m].copy(), row[n - 1 :] == row[:m]
        for j in range(1, n):
            code = code * np.uint32(257) + data[j : j + m]
            blank &= space[j : j + m]
        code = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)
        cells.append((row[:m] + code)[same & ~blank])
    return np.bincount(np.concatenate(cells), minlength=len(parts) * DIMS).astype(np.float32).reshape(len(parts), DIMS)


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts(texts)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def small(batches, text: str, rows: int = 250) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in slices(batches, text):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Over all rows: how many texts have each n-gram. Summed in each partition, then by Spark."""

    def partial(batches):
        have, n = np.zeros(DIMS, np.int64), 0
        for batch in small(batches, text):
            have += (counts(as_bytes(batch.column(0))) > 0).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate([[n], have]))], names=["dim", "n"])

    rows = docs.select(text).mapInArrow(partial, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    n = {r.dim: r.n for r in rows}
    return np.array([n.get(d, 0) for d in range(DIMS)], np.float64), n.get(-1, 0)


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the row nearest the mean and the rows farthest from those taken."""
    mean = x.mean(axis=0)
    seeds = [x[np.argmax(x @ mean)]]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[np.argmin((x @ np.array(seeds).T).max(axis=1))])
    c = np.array(seeds)
    for _ in range(10):
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def gap(own: np.ndarray, foreign: np.ndarray) -> float:
    """Midway between the lowest own cosines and the highest foreign ones; the lowest own ones where these don't lie apart or nothing is foreign."""
    low = float(np.quantile(own, RADIUS_QUANTILE))
    return min(low, (low + float(np.quantile(foreign, 1 - RADIUS_QUANTILE))) / 2) if len(foreign) else low


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> LanguageModel:
    """IDF over all labelled rows; centroids and radii from fit_rows of each language, those of the smallest hash of id and text."""
    docs = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    have, n = document_frequencies(docs, "text")
    idf = (np.log((1 + n) / (1 + have)) + 0.1).astype(np.float32)
    # A hash cuts each language to some times fit_rows before its rows are ranked, so no task ranks a whole language.
    share = F.least(F.lit(1.0), F.lit(4.0 * fit_rows) / F.count(F.lit(1)))
    shares = docs.groupBy("lang").agg(share.alias("share"))  # a row for each language, as the model has: small
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 31))
    order = Window.partitionBy("lang").orderBy("place", "id", "text")
    few = docs.withColumn("place", place).join(F.broadcast(shares), "lang").filter(F.col("place") < F.col("share") * (1 << 31))
    chosen = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= fit_rows).select("id", "lang", "text")

    def sparse(batches):
        for batch in small(batches, "text"):
            x = vectors(as_bytes(batch.column("text")), idf)
            rows = [np.flatnonzero(r).astype(np.uint16) for r in x]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array([r.tobytes() for r in rows]), pa.array([x[i, r].astype(np.float32).tobytes() for i, r in enumerate(rows)])], names=["id", "lang", "at", "value"])

    sample = chosen.mapInArrow(sparse, T.StructType([docs.schema["id"], T.StructField("lang", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType())])).orderBy("lang", "id", "at").collect()
    x = np.zeros((len(sample), DIMS), np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.value, np.float32)
    names = np.array([r.lang for r in sample], dtype=object)
    found, langs, radius = [], [], []
    for name in sorted(set(names)):
        own = x[names == name]
        c = clustered(own, centroids)
        near = (own @ c.T).max(axis=1)
        found.append(c)
        langs += [name] * len(c)
        radius += [gap(near, (x[names != name] @ c.T).max(axis=1))] * len(c)
    return LanguageModel(idf, np.concatenate(found) if found else np.zeros((0, DIMS), np.float32), langs, np.array(radius))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the cosine) and rejected; one pass, no shuffle."""
    names = []
    for name in ("lang_pred", "score", "rejected"):
        names.append(free_name([*docs.columns, *names], name))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    names = [f.name for f in schema]

    def scored(batches):
        for batch in small(batches, text):
            texts = as_bytes(batch.column(text))
            known = np.array([has_letter(t) for t in texts]) & (len(model.langs) > 0)
            best, cosine = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if known.any():
                like = vectors([t for t, k in zip(texts, known, strict=True) if k], model.idf) @ model.centroids.T
                best[known] = np.argmax(like, axis=1)
                cosine[known] = np.clip(like.max(axis=1), 0, 1)
            lang = [model.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            out = ~known | (cosine < (model.radius[best] if len(model.radius) else 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(cosine), pa.array(out)], names=names)

    return docs.mapInArrow(scored, schema)


def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.filter(crc_fold("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go."""
    model = fit(docs.filter(crc_fold("doc_id", 4) != 2))
    found = identify(docs, model)
    return found.filter(~F.col(found.columns[-1])).select(*docs.columns)
