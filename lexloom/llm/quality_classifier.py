"""A quality classifier on document statistics: random Fourier features, ridge regression, isotonic calibration.

Statistics of whole texts are standardised and mapped to random Fourier features, whose inner products approximate a
Gaussian kernel. Partitions sum the normal equations; the driver adds a bounded number of such sums and solves them.
The ridge scores of rows that the fit doesn't use are binned and calibrated by pooling adjacent violators. Labels may
be read for at most about `train_rows` documents (a documented bound, chosen by a hash of the id); everything else
runs over all rows. Labels, language, source and id are never inputs of a score.

Edge cases: null and empty texts have statistics (zeros) and a score; without labels, or with labels of one class
only, every score is the share of label 1, or 0.5; repeated rows get equal scores; null labels aren't used; an empty
table gives an empty result; very long texts are taken whole; further columns pass through, and a column with an
output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import byte_texts

_MARKS = b"%#$&*|!?.,;:\"'()[]{}<>=-_/\\@"
_CLASSES = np.zeros(256, np.int64)
_CLASSES[list(range(97, 123))] = 1
_CLASSES[list(range(65, 91))] = 2
_CLASSES[list(range(48, 58))] = 3
_CLASSES[list(b" \t")] = 4
_CLASSES[list(b"\n\r")] = 5
_CLASSES[128:] = 6
_CLASSES[list(_MARKS)] = 7 + np.arange(len(_MARKS))
_N_CLASSES = 7 + len(_MARKS)


def statistics(text: bytes) -> np.ndarray:
    """Shares of character classes, and shape, variety and repetition of words and lines."""
    words = text.split()
    n, lines = len(words), [x for x in text.split(b"\n") if x.strip()]
    counts = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=_N_CLASSES) if text else np.zeros(_N_CLASSES)
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    one = max(1, n)
    return np.concatenate([
        np.sqrt(counts / max(1, len(text))),
        [
            np.log1p(n), np.log1p(len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.std()), (lengths <= 3).sum() / one,
            len(set(words)) / one, sum(a == b for a, b in zip(words, words[1:], strict=False)) / one,
            len(set(zip(words, words[1:], words[2:], strict=False))) / one, 1 - len(set(lines)) / max(1, len(lines)),
        ],
    ])


_N_STATISTICS = _N_CLASSES + 9


@dataclass(frozen=True)
class Settings:
    """Hyper-parameters, and the bound on labelled rows that the fit may read."""

    train_rows: int = 20_000
    features: int = 256
    ridge: float = 1e-3
    width: float = 2.0  # of the kernel, in units of the root of the number of statistics
    bins: int = 1024
    parts: int = 16
    seed: int = 11


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    ridge: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]
    constant: float | None = None

    def lift(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(x @ self.weights + self.phase) * np.sqrt(2 / len(self.phase)), np.ones(len(x))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        raw = self.raw(stats)
        level = np.interp(raw, *self.knots)
        # a thousandth keeps the order within a level
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30))), 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit through binned labels (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for a, n, k in zip(x.tolist(), total.tolist(), ones.tolist(), strict=True):
        blocks.append([a * n, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def training_rows(doc_id: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, modulo 3, isn't 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _statistics_column():
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def column(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            yield pa.array([statistics(t) for part in byte_texts(texts) for t in part], pa.list_(pa.float64()))

    return column


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from the labels of training rows."""
    rng = np.random.default_rng(settings.seed)
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & training_rows(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    share = min(1.0, settings.train_rows / max(1, n))
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    known = known.where(pick < int(share * 1_000_000))
    # at most about `train_rows` ids, so they may be broadcast
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.select("doc_id", "quality", _statistics_column()("text").alias("x"))
    rows = rows.repartition(settings.parts, "doc_id").persist()
    model = Model(np.zeros(_N_STATISTICS), np.ones(_N_STATISTICS), np.zeros((_N_STATISTICS, 0)), np.zeros(0), np.zeros(0), (np.zeros(1), np.zeros(1)))
    try:
        ends = rows.agg(F.count("*").alias("n"), F.avg(F.col("quality").cast("double")).alias("p"), F.min("quality").alias("lo"), F.max("quality").alias("hi")).first()
        if ends.n == 0 or ends.lo == ends.hi:
            model.constant = 0.5 if ends.n == 0 else float(ends.p)
            return model

        def moments(batches):
            sums = np.zeros((3, _N_STATISTICS))
            for b in batches:
                x = np.array(b.column("x").to_pylist()).reshape(-1, _N_STATISTICS)
                sums += np.stack([np.full(_N_STATISTICS, float(len(x))), x.sum(0), (x * x).sum(0)])
            yield pa.record_batch([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        def added(df, function, shape):  # one sum for each of at most `parts` partitions
            return sum((np.frombuffer(r.sums).reshape(shape) for r in df.mapInArrow(function, "sums binary").collect()), np.zeros(shape))

        count, total, squares = added(rows, moments, (3, _N_STATISTICS))
        model.mean = total / count
        model.scale = np.maximum(np.sqrt(np.maximum(squares / count - model.mean**2, 0)), 1e-3)
        model.weights = rng.normal(0, 1 / (settings.width * np.sqrt(_N_STATISTICS / 4)), (_N_STATISTICS, settings.features))
        model.phase = rng.uniform(0, 2 * np.pi, settings.features)
        size = settings.features + 1
        calibrate = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0

        def normal(batches):
            sums = np.zeros((size, size + 1))
            for b in batches:
                x = np.array(b.column("x").to_pylist()).reshape(-1, _N_STATISTICS)
                y = np.array(b.column("quality").to_pylist(), float)
                if len(x):
                    z = model.lift(x)
                    sums += np.column_stack([z.T @ z, z.T @ y])
            yield pa.record_batch([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        sums = added(rows.where(~calibrate), normal, (size, size + 1))
        level = max(1.0, sums[-1, -2])
        model.ridge = np.linalg.solve(sums[:, :-1] + settings.ridge * level * np.eye(size), sums[:, -1])

        @F.arrow_udf(T.DoubleType())
        def raw(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for c in columns:
                yield pa.array(model.raw(np.array(c.to_pylist()).reshape(-1, _N_STATISTICS)), pa.float64())

        binned = rows.where(calibrate).select("quality", F.round(F.greatest(F.lit(-1), F.least(F.lit(2), raw("x"))) * (settings.bins // 4)).alias("bin"))
        binned = binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum("quality").alias("k")).orderBy("bin").collect()  # at most `bins` rows
        if binned:
            x, m, k = (np.array([r[i] for r in binned], float) for i in range(3))
            model.knots = isotonic(x / (settings.bins // 4), m, k)
        else:
            model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        return model
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.arrow_udf(T.DoubleType())
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            out = [shared.value.score(np.stack([statistics(t) for t in part])) for part in byte_texts(texts) if part]
            yield pa.array(np.concatenate([np.zeros(0), *out]), pa.float64())

    held = F.coalesce(~training_rows(F.col("doc_id")), F.lit(False))
    out = docs.withColumns({"held_out": held, "score": scored(F.col("text").cast("binary"))})
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
