"""Quality classifier: kernel ridge regression by random Fourier features of document statistics.

A text becomes some statistics of its bytes, words and lines, standardised over the labelled rows. Fixed random
cosines of them approximate a Gaussian kernel; the normal equations of ridge regression are sums over rows, made
in each partition and added up by Spark, so every labelled row takes part. Isotonic regression of the labels on
the raw scores (pool adjacent violators over a fine grid) makes probabilities of them.

Defined cases: null and empty texts have all statistics 0 and are scored like any other. Rows whose label or id
is null teach nothing; repeated labels count as often as they stand there. Without a labelled row every score
is 0.5. Other columns aren't looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, crc_fold, documents, saved, slices

FEATURES, WIDTH, RIDGE, SEED = 384, 4.0, 1e-4, 7
#: Cells of the grid on which scores are calibrated, and the range of raw scores.
GRID, LOW, HIGH = 4096, -0.5, 1.5
THRESHOLD = 0.3

_KINDS = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (9, 11, 12, 13, 32), "line": (10,), "stop": b".,;:?", "loud": b"!",
    "bar": b"|", "symbol": b"#$%&*@^~+=<>\\/_`", "bracket": b"()[]{}\"'", "high": range(128, 256), "control": (*range(9), *range(14, 32), 127),
}
_KIND = np.zeros((256, len(_KINDS)))
for _i, _bytes in enumerate(_KINDS.values()):
    _KIND[list(_bytes), _i] = 1


def statistics(text: bytes) -> np.ndarray:
    out = np.zeros(len(_KINDS) + 14)
    if not text:
        return out
    n, words, lines = len(text), text.split(), text.split(b"\n")
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[: len(_KINDS)] = np.sqrt(count @ _KIND / n)
    size = np.array([len(w) for w in words] or [0])
    share = count[count > 0] / n
    distinct = len(set(words))
    out[len(_KINDS) :] = (
        np.log1p(n), np.log1p(len(words)), size.mean(), size.std(), np.log1p(size.max()), distinct / max(1, len(words)), np.log1p(len(lines)), np.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines), -(share * np.log2(share)).sum(), count.max() / n, sum(w.isalpha() for w in words) / max(1, len(words)),
        sum(w.isupper() for w in words) / max(1, len(words)), sum(w[-1] in b".!?" for w in words) / max(1, len(words)),
    )
    return out


STATISTICS = len(_KINDS) + 14


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features and the constant
    grid: np.ndarray  # calibrated score of each cell

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth is the raw score's own, so that ties of the steps keep their order. All 0.5 where nothing was learned."""
        if not self.weights.any():
            return np.full(len(x), 0.5)
        raw = np.clip(self.raw(x), LOW, HIGH)
        steps = np.interp((raw - LOW) / (HIGH - LOW) * GRID - 0.5, np.arange(GRID), self.grid)
        return np.clip(0.999 * steps + 0.001 * (raw - LOW) / (HIGH - LOW), 0, 1)


def fourier(x: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / WIDTH, (x.shape[1], FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.cos(np.clip(x, -8, 8) @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def described(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and x (the statistics as bytes of doubles), stored."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(t).tobytes() for t in as_bytes(batch.column("text"))], pa.binary())], names=["doc_id", "x"])

    return saved(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, x binary"), "statistics")


def matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, STATISTICS)


def summed(rows: DataFrame, part) -> np.ndarray:
    """part(x, y) -> a matrix; its sum over all rows. Partitions, a few for each core, sum their own, Spark adds each matrix row up."""
    rows = rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)

    def partial(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                cut = batch.slice(at, 4000)
                one = part(matrix(cut.column("x")), cut.column("y").to_numpy())
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([r.tobytes() for r in total])], names=["i", "v"])

    def added(batches):
        """Rows come by i."""
        now, total = None, 0
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if i != now and now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()])], names=["i", "v"])
                    total = 0
                now, total = i, total + np.frombuffer(v, np.float64)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()])], names=["i", "v"])

    parts = rows.mapInArrow(partial, "i long, v binary").repartition("i").sortWithinPartitions("i", "v").mapInArrow(added, "i long, v binary")
    return np.array([np.frombuffer(r.v, np.float64) for r in sorted(parts.collect(), key=lambda r: r.i)])


def pooled(positive: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Isotonic means of cells: neighbours that violate the order are pooled; empty cells lie between."""
    blocks: list[list[float]] = []
    at = np.flatnonzero(n)
    for p, m in zip(positive[at], n[at], strict=True):
        blocks.append([p, m, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, m2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + m2, blocks[-1][2] + k2]
    value = np.repeat([p / m for p, m, _ in blocks], [int(k) for *_, k in blocks])
    return np.interp(np.arange(len(n)), at, value)


def fit(rows: DataFrame) -> QualityModel:
    """rows: x, y (0 or 1)."""
    rows = saved(rows.select("x", F.col("y").cast("double").alias("y")), "labelled")
    first = summed(rows, lambda x, y: np.vstack([x.sum(axis=0), (x * x).sum(axis=0), np.full(x.shape[1], len(x))]))
    if not len(first):
        return QualityModel(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES + 1), np.full(GRID, 0.5))
    n = first[2, 0]
    mean = first[0] / n
    model = QualityModel(mean, np.sqrt(np.maximum(first[1] / n - mean**2, 1e-6)), np.zeros(FEATURES + 1), np.zeros(GRID))

    def equations(x, y):
        z = model.features(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    both = summed(rows, equations)
    model.weights = np.linalg.solve(both[:, :-1] + RIDGE * n * np.eye(len(both)), both[:, -1])

    def cells(x, y):
        cell = np.minimum(((np.clip(model.raw(x), LOW, HIGH) - LOW) / (HIGH - LOW) * GRID).astype(int), GRID - 1)
        return np.vstack([np.bincount(cell, y, GRID), np.bincount(cell, minlength=GRID)])

    positive, many = summed(rows, cells)
    model.grid = pooled(positive, many)
    return model


def scored(described_: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(matrix(part.column("x"))))], names=["doc_id", "score"])

    return described_.mapInArrow(run, "doc_id long, score double")


def op1_quality(spark, sf_dir):
    rows = described(documents(spark, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("y"))
    model = fit(rows.join(labels.filter(crc_fold("doc_id", 5) != 0), "doc_id"))
    return scored(rows, model).select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
