"""Hard negatives by the threshold algorithm.

Vectors become whole numbers, floor(scale * x). Rows are dealt into tiles of about ``tile_rows`` by the hash of their row key,
anchors into chunks, and each tile meets each chunk as a job of bounded size: the stated anchors against all rows, in blocks. A
tile has a list of its rows for each dimension, sorted by component. For an anchor, rows are taken from the large end of the
lists of its positive components and from the small end of those of its negative ones, as deep in all lists; each new row is
scored in full (random access), and the anchor's product with the components reached is the threshold: no row that is not yet
seen scores higher. Reading stops once the threshold is strictly below the kth score of each window, or its lower end where it
has fewer rows, so that ties are complete.

Two rounds: the first finds each anchor's positives, the best rows of its own label, from lists of that label; their scores
span the windows of the second, whose rows have another label. Each job returns its first rows of a window, and a ranking by
anchor and window merges them. Scores are exact: products are summed in floating point only where no sum reaches 2^24 (single)
or 2^53 (double), else in whole numbers of any size; a result beyond 64 bits is an error.

Rules: rows with a null label, a null vector, or a null or non-finite component take no part; a row without an id is no anchor
and comes last among ties; repeated rows, and rows that repeat an id, are rows of their own, and an anchor is no positive of
itself; components that a shorter vector lacks count as 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import KEY, keyed, stash

FOUND = f"anchor_id long, anchor_file long, anchor_row long, window int, id long, score long, {KEY[0]} long, {KEY[1]} long"
ALL = (-math.inf, math.inf)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact; an array of Python integers where doubles can't hold them."""
    if np.abs(values).max(initial=0) * scale < 1 << 53:
        return np.floor(values * scale)
    flat = [math.floor(Fraction(float(v)) * scale) for v in values.ravel()]
    return np.array([*flat, None], object)[:-1].reshape(values.shape)


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros."""
    lens = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lens), width))
    if lens.sum():
        out[np.arange(width) < lens[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def fitting(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the narrowest type in which their products, and the sums of these, are exact."""
    if a.dtype != object and x.dtype != object:
        most = max(a.shape[1], 1) * float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0))
        if most < 1 << 24:
            return a.astype(np.float32), x.astype(np.float32)
        if most < 1 << 53:
            return a, x
    integer = lambda m: m if m.dtype == object else np.array([*map(int, m.ravel()), None], object)[:-1].reshape(m.shape)
    return integer(a), integer(x)


class Lists:
    """The rows of a tile, or of one of its labels, and for each dimension their places by component."""

    def __init__(self, x: np.ndarray, ties: np.ndarray):
        """``ties``: the place of each row among rows of equal score."""
        self.x, self.ties = x, ties
        self.places = np.argsort(x.T, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(x.T, self.places, 1)

    def first(self, a: np.ndarray, allowed: np.ndarray, windows: list[tuple], k: int, depth: int = 32) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of the first ``k`` allowed rows of each window (lowest, highest score)."""
        n, up, down = len(self.x), np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        seen, scores, before = np.zeros(n, bool), np.zeros(n, self.x.dtype), 0
        highest = min((w[1] for w in windows), default=0)
        while before < n:
            stop = min(depth, n) if len(up) + len(down) else n
            was = seen.copy()
            seen[self.places[up, n - stop : n - before]] = True
            seen[self.places[down, before:stop]] = True
            if stop == n:
                seen[:] = True
            new = np.flatnonzero(seen & ~was)
            scores[new] = self.x[new] @ a
            threshold = a[up] @ self.values[up, n - stop] + a[down] @ self.values[down, stop - 1]
            if seen.all() or threshold < highest and all(threshold < self._bound(scores[seen & allowed], w, k) for w in windows):
                break
            before, depth = stop, 2 * depth
        at = np.flatnonzero(seen & allowed)
        return [self._best(at, scores[at], w, k) for w in windows]

    @staticmethod
    def _bound(scores: np.ndarray, window: tuple, k: int):
        inside = scores[(scores >= window[0]) & (scores <= window[1])]
        return np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else window[0]

    def _best(self, at: np.ndarray, scores: np.ndarray, window: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
        inside = (scores >= window[0]) & (scores <= window[1])
        at, scores = at[inside], scores[inside]
        if len(at) > k:
            top = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[top], scores[top]
        order = np.lexsort((self.ties[at], -scores))[:k]
        return at[order], scores[order]


def _job(left: pa.Table, right: pa.Table, scale: int, k: int, low: int, high: int, own: bool) -> pa.Table:
    """The first rows of each window of each anchor (right) among the rows of a tile (left); ``own``: of its label, else of others."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    columns: list[list] = [[] for _ in names]
    if left.num_rows and right.num_rows:
        vectors = [t.column("vector").combine_chunks() for t in (left, right)]
        width = max(int(v.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for v in vectors)
        a, x = fitting(whole(matrix(vectors[1], width), scale), whole(matrix(vectors[0], width), scale))
        plain = lambda t, c: t.column(c).to_numpy()
        ids = left.column("id").to_pylist()
        file, row, label = plain(left, KEY[0]), plain(left, KEY[1]), np.array(left.column("label").to_pylist(), object)
        none = np.array([i is None for i in ids])
        ties = np.empty(len(ids), np.int64)
        ties[np.lexsort((row, file, np.array([i or 0 for i in ids], np.int64), none))] = np.arange(len(ids))
        lists: dict = {}
        if not own:
            lists[None] = np.arange(len(ids)), Lists(x, ties)
        for p, r in enumerate(right.select(["id", *KEY, "label", *([] if own else ["positives"])]).to_pylist()):
            if own and r["label"] not in lists:
                rows = np.flatnonzero(label == r["label"])
                lists[r["label"]] = rows, Lists(x[rows], ties[rows])
            rows, tile = lists[r["label"] if own else None]
            if not len(rows):
                continue
            allowed = ~((file == r[KEY[0]]) & (row == r[KEY[1]]))[rows] if own else label != r["label"]
            windows = [ALL] if own else [(-(-low * s // 100), high * s // 100) for s in r["positives"]]
            for w, (at, scores) in enumerate(tile.first(a[p], allowed, windows, k)):
                for place, score in zip(rows[at].tolist(), scores.tolist()):
                    for c, v in zip(columns, (r["id"], r[KEY[0]], r[KEY[1]], w, ids[place], int(score), int(file[place]), int(row[place]))):
                        c.append(v)
    return pa.table([pa.array(c, pa.int32() if n == "window" else pa.int64()) for n, c in zip(names, columns)], names=names)


def _round(tiles: DataFrame, anchors: DataFrame, n_tiles: int, n_chunks: int, k: int, **options) -> DataFrame:
    """The first ``k`` rows of each anchor and window over all tiles, with their rank."""

    def job(left: pa.Table, right: pa.Table) -> pa.Table:
        return _job(left, right, k=k, **options)

    left = tiles.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    right = anchors.select(*[F.col(c).alias(c) for c in anchors.columns], F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("tile"))  # names of its own beside ``left``
    found = left.groupBy("tile", "chunk").cogroup(right.groupBy("tile", "chunk")).applyInArrow(job, FOUND)
    order = W.Window.partitionBy("anchor_file", "anchor_row", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), *KEY)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, tile_rows: int = 8192, chunk_rows: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``anchors``: a condition on the column id. A negative
    scores between ``low`` and ``high`` per cent of the positive."""
    part = lambda n: F.pmod(F.xxhash64(*KEY), F.lit(n)).cast("int")
    real = keyed(rows, id, vector, label).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"), *KEY)
    real = real.where(F.col("label").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)))
    real = stash(real.withColumn("anchor", F.coalesce(anchors, F.lit(False))))
    n, n_anchors = real.agg(F.count("*"), F.count_if("anchor")).first()
    n_tiles, n_chunks = max(1, -(-n // tile_rows)), max(1, -(-n_anchors // chunk_rows))
    tiles = real.withColumn("tile", part(n_tiles)).drop("anchor")
    chosen = real.where("anchor").withColumn("chunk", part(n_chunks)).drop("anchor")
    options = {"scale": scale, "low": low, "high": high}

    best = stash(_round(tiles, chosen, n_tiles, n_chunks, positives, own=True, **options))
    windows = best.groupBy("anchor_file", "anchor_row").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p")).select("anchor_file", "anchor_row", F.col("p.score").alias("positives"))
    ready = chosen.join(windows, (chosen[KEY[0]] == windows["anchor_file"]) & (chosen[KEY[1]] == windows["anchor_row"])).drop("anchor_file", "anchor_row")
    worst = _round(tiles, ready, n_tiles, n_chunks, negatives, own=False, **options)
    of = best.select("anchor_file", "anchor_row", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = worst.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(of, ["anchor_file", "anchor_row", "window"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
