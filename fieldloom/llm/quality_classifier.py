"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of each document are standardised with the corpus's own means and deviations and mapped to cosines that
approximate a Gaussian kernel. Each partition of labelled rows adds up its normal equations, a tree of sums adds those of
the partitions, and the driver solves one system of ``dimension`` unknowns. Scores of labelled rows from a fit on the
other half of them are counted in bins, and pooling adjacent violators on the bins turns scores into probabilities.

Rules: a null text counts as empty and is scored like one; labels that are null are left out, and of several for one
document the smallest counts; without any usable label each score is 0.5; repeated rows are scored alike; an empty table
gives an empty result; further columns are ignored. Only the text enters a score.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, keyed, stash, text_slices
from .docstats import FEATURES, features

BINS = 512


def _statistics(batches):
    for batch in batches:
        for b in text_slices(batch, "text"):
            x = features(b.column("text")).astype(np.float32)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *KEY)), vectors], names=["doc_id", *KEY, "x"])


def statistics(docs: DataFrame) -> DataFrame:
    rows = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *KEY)
    return rows.mapInArrow(_statistics, f"doc_id long, {KEY[0]} long, {KEY[1]} long, x array<float>")


class Cosines:
    """Random Fourier features of standardised statistics, with a constant as the last one."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, dimension: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w, self.b = rng.normal(0, 1 / width, (len(mean), dimension)), rng.uniform(0, 2 * np.pi, dimension)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack((np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(x))))


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _equations(batches, cosines: Cosines):
    """Sums of both halves: z z', z y and the number of rows."""
    size = len(cosines.b) + 1
    sums = np.zeros((2, size, size + 1))
    for b in batches:
        if b.num_rows:
            z, y = cosines(vectors_of(b.column("x"))), b.column("y").to_numpy(zero_copy_only=False).astype(float)
            half = b.column("half").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                at = half == k
                sums[k] += z[at].T @ np.column_stack((z[at], y[at]))
    yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])


def _add(batches):
    total = None
    for b in batches:
        for s in b.column("sums"):
            part = np.frombuffer(s.as_buffer(), np.float64)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def tree_sum(parts: DataFrame, fan: int = 16) -> np.ndarray:
    """The sum of the partitions' arrays, ``fan`` at a time, so that no task and not the driver gets many."""
    n = parts.rdd.getNumPartitions()
    while n > fan:
        n = -(-n // fan)
        parts = parts.repartition(n).mapInArrow(_add, "sums binary")
    return sum(np.frombuffer(r["sums"], np.float64) for r in parts.collect())


def pooled(counts: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Isotonic regression by pooling adjacent violators: a non-decreasing probability for each bin."""
    blocks: list[list[float]] = []
    for n, y in zip(counts, hits):
        blocks.append([n, y, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n1, y1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n1, blocks[-1][1] + y1, blocks[-1][2] + k1]
    return np.concatenate([np.full(int(k), y / n if n else 0.5) for n, y, k in blocks])


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)


def _binned(batches, cosines: Cosines, solved: list[np.ndarray]):
    counts = np.zeros((2, BINS), np.int64)
    for b in batches:
        if b.num_rows:
            z, y, half = cosines(vectors_of(b.column("x"))), b.column("y").to_numpy(zero_copy_only=False), b.column("half").to_numpy(zero_copy_only=False)
            at = bin_of(np.where(half == 0, z @ solved[1], z @ solved[0]))
            counts += np.stack((np.bincount(at, minlength=BINS), np.bincount(at[y == 1], minlength=BINS)))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(counts[0]), pa.array(counts[1])], names=["bin", "n", "hits"])


def _scored(batches, cosines: Cosines, weights: np.ndarray, curve: np.ndarray):
    for b in batches:
        raw = cosines(vectors_of(b.column("x"))) @ weights if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *KEY)), pa.array(curve[bin_of(raw)])], names=["doc_id", *KEY, "score"])


def classify(docs: DataFrame, labels: DataFrame, *, dimension: int = 256, width: float = 4.0, ridge: float = 1e-3, seed: int = 11) -> DataFrame:
    """One row per document: row key, doc_id, score. ``labels`` (doc_id, quality) holds only rows to learn from."""
    x = stash(statistics(docs))
    each = [F.element_at("x", k + 1).cast("double") for k in range(len(FEATURES))]
    moments = x.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    moments = np.array([0.0 if v is None else v for v in moments])
    cosines = Cosines(*moments.reshape(2, -1), dimension, width, seed)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    rows = stash(x.join(known, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")))
    size = dimension + 1
    sums = tree_sum(rows.mapInArrow(partial(_equations, cosines=cosines), "sums binary"))
    sums = np.zeros((2, size, size + 1)) + (sums.reshape(2, size, size + 1) if isinstance(sums, np.ndarray) else 0)

    def solve(s: np.ndarray) -> np.ndarray:
        n = max(s[-1, size - 1], 1.0)
        return np.linalg.solve(s[:, :size] + ridge * n * np.eye(size), s[:, size])

    halves = [solve(s) for s in sums]
    binned = rows.mapInArrow(partial(_binned, cosines=cosines, solved=halves), "bin long, n long, hits long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    counts = np.zeros((2, BINS))
    for r in binned.collect():  # one row a bin
        counts[:, r["bin"]] = r["n"], r["hits"]
    # Empty bins pool with their neighbours.
    base = counts[1].sum() / counts[0].sum() if counts[0].sum() else 0.5
    curve = np.clip(pooled(counts[0] + 1e-6, counts[1] + 1e-6 * base), 0, 1)
    schema = f"doc_id long, {KEY[0]} long, {KEY[1]} long, score double"
    return x.mapInArrow(partial(_scored, cosines=cosines, weights=solve(sums.sum(0)), curve=curve), schema)
