"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: 64 bits of the XXH64 hashes of all word shingles, by majority. Documents with equal fingerprints are one
class, and only the distinct fingerprints are compared. Two fingerprints within ``radius`` bits agree in one of radius + 1
bands of bits, so range partitioning by (band, value, population count, fingerprint) brings every linked pair together, and
splits a value that many share. The sorted rows are cut into tiles of bounded size; inside a tile all pairs are compared
with exclusive-or and bit counts in numpy. Tiles of one band value that are more than one tile or touch a partition's
boundary are paired by a join that skips pairs whose population counts differ beyond the radius. A comparison returns a
spanning forest of what it linked, not all pairs.

Rules: null text counts as empty and has fingerprint 0; null ids are in a component but never name one unless it has no
other; repeated rows share a component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, keyed, rooted, split_join, starts_of, stash, text_slices, unpacked
from .components import components

SEED = 42
TILE = 4096
#: Each bit of a byte in a byte of its own.
SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each run of ``width`` words, of all words if there are fewer, of none if there is none."""
    words, h = text.split(), xxhash.xxh64_intdigest
    if len(words) < width:
        return [h(b" ".join(words), SEED)] if words else []
    return [h(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(width)))]


def majority(hashes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: bits that are set in over half of them. Runs without hashes have 0."""
    out = np.zeros(len(lens), np.uint64)
    real = np.flatnonzero(lens)
    if not len(real):
        return out
    # Counts of eight bits share a word, so up to 255 hashes are added before they are taken apart.
    pieces = -(-lens[real] // 255)
    first = starts_of(pieces)
    at = np.repeat(starts_of(lens)[real], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    each = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.stack([np.add.reduceat(SPREAD[each[:, k]], at) for k in range(8)], 1)
    counts = np.add.reduceat(counts.view(np.uint8).reshape(len(at), 64).astype(np.int64), first, axis=0)
    bits = (2 * counts > lens[real][:, None]).astype(np.uint8)
    out[real] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprints(batches, width: int):
    for batch in batches:
        for b in text_slices(batch, "text"):
            texts = pc.ascii_lower(pc.fill_null(b.column("text"), "")).cast(pa.binary())
            lists = [shingle_hashes(t.as_buffer().to_pybytes(), width) for t in texts]
            lens = np.array([len(x) for x in lists], np.int64)
            hashes = np.fromiter((h for x in lists for h in x), np.uint64, int(lens.sum()))
            fp = pa.array(majority(hashes, lens).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *KEY)), fp], names=["doc_id", *KEY, "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """Row key, doc_id and fp, the fingerprint as a signed integer."""
    rows = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *KEY)
    return rows.mapInArrow(partial(_fingerprints, width=width), f"doc_id long, {KEY[0]} long, {KEY[1]} long, fp long")


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between or inside ``a`` and ``b`` (the same array: inside one tile) as pairs of fingerprints."""
    own = a is b
    every = a if own else np.concatenate((a, b))
    label, shift = np.arange(len(every)), 0 if own else len(a)
    for low in range(0, len(a), 256):
        near = np.bitwise_count(a[low : low + 256, None] ^ b[None, :]) <= radius
        if own and near.sum() == len(near):
            continue  # each is near itself only
        for i in np.flatnonzero(near.any(1)):
            group = np.unique(label[np.append(np.flatnonzero(near[i]) + shift, low + i)])
            if len(group) > 1:
                label[np.isin(label, group)] = group[0]
    joined = np.flatnonzero(label != np.arange(len(every)))
    return list(zip(every[joined].tolist(), every[label[joined]].tolist()))


TILES = "a long, b long, band int, value long, tile long, low int, high int, prints binary"
TILE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _tiles(batches, radius: int):
    """Links inside the tiles of a sorted partition, and the tiles that may have links to others."""
    pid, made = TaskContext.get().partitionId() << 32, 0
    rest: tuple[np.ndarray, ...] = ()
    first = True  # the first band value of the partition may have begun in the one before
    many = None  # the band value whose earlier tiles are out already

    def tile(key, prints, shared):
        nonlocal made
        links = linked(prints, prints, radius) if len(prints) > 1 else []
        rows = [[x, y, *[None] * 6] for x, y in links]
        if shared:
            made += 1
            pop = np.bitwise_count(prints)
            rows.append([None, None, *key, pid + made, int(pop.min()), int(pop.max()), prints.tobytes()])
        return rows

    def cut(band, value, prints, last):
        """Works off all band values but the last; of that one, full tiles, or all of it at the end."""
        nonlocal first, many
        rows, ends = [], np.append(np.flatnonzero((np.diff(band) != 0) | (np.diff(value) != 0)) + 1, len(band))
        start = 0
        for k, end in enumerate(ends):
            final, key = k == len(ends) - 1, (int(band[start]), int(value[start]))
            while start < end:
                if final and not last and end - start < TILE:
                    return rows, start
                stop = min(end, start + TILE)
                shared = first or final or many == key or stop < end
                if shared or stop - start > 1:
                    rows += tile(key, prints[start:stop], shared)
                many = key if shared else None
                start = stop
            first = False
        return rows, start

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(TILE_TYPES)], names=[c.split()[0] for c in TILES.split(", ")])

    for b in batches:
        got = [b.column(c).to_numpy(zero_copy_only=False) for c in ("band", "value", "fp")]
        got[2] = got[2].astype(np.int64).view(np.uint64)
        rest = tuple(np.concatenate(x) for x in zip(rest, got)) if rest else tuple(got)
        if len(rest[0]):
            rows, start = cut(*rest, False)
            rest = tuple(x[start:] for x in rest)
            if rows:
                yield batch_of([[_signed(x) if k < 2 else x for k, x in enumerate(r)] for r in rows])
    if rest and len(rest[0]):
        rows, _ = cut(*rest, True)
        if rows:
            yield batch_of([[_signed(x) if k < 2 else x for k, x in enumerate(r)] for r in rows])


def _signed(x):
    return x if x is None or x < 1 << 63 else x - (1 << 64)


def _pairs(batches, radius: int):
    for b in batches:
        rows = []
        for x, y in zip(b.column("prints").to_pylist(), b.column("others").to_pylist()):
            rows += linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), radius)
        yield pa.RecordBatch.from_arrays([pa.array([_signed(r[k]) for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints of column fp within ``radius`` bits, directly or through others."""
    n = radius + 1
    edges = [64 * k // n for k in range(n + 1)]
    value = lambda k: F.shiftrightunsigned(F.shiftleft("fp", 64 - edges[k + 1]), 64 - edges[k + 1] + edges[k])
    bands = prints.select("fp", F.posexplode(F.array(*map(value, range(n)))).alias("band", "value"))
    order = ["band", "value", "pop", "fp"]
    sorted_rows = bands.withColumn("pop", F.bit_count("fp")).repartitionByRange(*order).sortWithinPartitions(*order)
    tiled = stash(sorted_rows.select("band", "value", "fp").mapInArrow(partial(_tiles, radius=radius), TILES))
    tiles = tiled.where("tile is not null").drop("a", "b")
    # Numbers of tiles are paired first, by population count, so that a value with many tiles is as many keys; then prints are fetched.
    heads = tiles.select("band", "value", "tile", "low", "high")
    ones = heads.select("band", "value", F.col("tile").alias("one"), F.explode(F.sequence("low", "high")).alias("pop"))
    twos = heads.select("band", "value", F.col("tile").alias("two"), F.explode(F.sequence(F.col("low") - radius, F.col("high") + radius)).alias("pop"))
    pairs = ones.join(twos, ["band", "value", "pop"]).where("one < two").select("one", "two").distinct()
    own, other = (tiles.select(F.col("tile").alias(t), F.col("prints").alias(c)) for t, c in (("one", "prints"), ("two", "others")))
    more = pairs.join(own, "one").join(other, "two").select("prints", "others").repartition(F.xxhash64("prints"), F.xxhash64("others")).mapInArrow(partial(_pairs, radius=radius), "a long, b long")
    return tiled.where("tile is null").select("a", "b").union(more)


def near_groups(docs: DataFrame, *, width: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: row key, doc_id, fingerprint (hexadecimal), component_id."""
    prints = stash(fingerprints(docs, width))
    classes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")))
    roots = components(links(classes.select("fp"), radius))
    classes = stash(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "low", "rows", F.coalesce("root", "fp").alias("root")))
    named = classes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    classes = split_join(classes, named, "root", "members").select("fp", "component_id", "rows")
    return split_join(prints, classes, "fp", "rows").select(*KEY, "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """Of each component the row with the smallest doc_id, with all its columns."""
    docs = rooted(docs)
    groups = near_groups(docs, **options)
    me = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), *map(F.col, KEY))
    kept = groups.groupBy("component_id").agg(F.min(me).alias("kept"))
    return unpacked(keyed(docs).join(kept.select(F.col("kept")[KEY[0]].alias(KEY[0]), F.col("kept")[KEY[1]].alias(KEY[1])), KEY, "left_semi"))
