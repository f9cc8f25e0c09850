"""Near-duplicates by the Jaccard similarity of their shingle sets: every link is verified on the sets themselves.

Shingles and their XXH64 hashes are those of SimHash. Texts with equal sets are one class (the XXH64 hash of the sorted set),
and only distinct sets are compared. Candidates come from SimHash first: fingerprints within RADIUS bits link, by the tiled exact
comparison of ``simhash``, and a component of them is one key. Similar sets whose fingerprints lie farther apart share keys of
min-hashes: BANDS keys of ROWS minima each, and a pair with a similarity of s shares one with a chance of 1 - (1 - s^3)^36,
which leaves out 6e-12 of the pairs at 0.8 and fewer above. Each key is verified by itself: a set goes to the keys that it
shares, is compared with the sets there whose size allows the similarity, and only verified links make components. Candidates
that share no key never meet, and nothing percolates.

Keys come in three waves: fingerprints; a few min-hashes, which connect most other near copies; and the other min-hashes. Each
compares only sets that are not in one component yet, and skips keys all of whose sets are. A key of more than WEIGHT hashes is
dealt into tiles, each with the key's smallest set beside its own, which connects tiles of a large group of copies; after that, only sets
outside of the key's largest component, in chunks of WEIGHT hashes, go to its other tiles.

Rules: null text counts as empty, and empty texts equal each other; further columns stay as they are; of each component of links
the row with the smallest doc_id stays, one without an id only if there is no other.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, keyed, mix64, ragged, rooted, starts_of, stash, text_slices, unpacked
from .components import components
from . import simhash
from .simhash import SEED, majority, shingle_hashes

BANDS, ROWS = 36, 3
#: Bits by which linked fingerprints differ at most.
RADIUS = 3
WEIGHT = 1 << 18
_SALTS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS, ROWS), np.uint64)
_SALTS[1] = 2 * _SALTS[1] + 1


def band_keys(hashes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """BANDS keys of each set; sets have one hash at least."""
    starts = starts_of(lens)
    out = np.empty((len(lens), BANDS), np.uint64)
    for k in range(BANDS):
        key = np.full(len(lens), k, np.uint64)
        for j in range(ROWS):
            key = mix64(key ^ np.minimum.reduceat((hashes ^ _SALTS[0, k, j]) * _SALTS[1, k, j], starts))
        out[:, k] = key
    return out


def _shingles(b: pa.RecordBatch, width: int) -> list[np.ndarray]:
    texts = pc.ascii_lower(pc.fill_null(b.column("text"), "")).cast(pa.binary())
    return [np.array(shingle_hashes(t.as_buffer().to_pybytes(), width), np.uint64) for t in texts]


SKETCHES = f"doc_id long, {KEY[0]} long, {KEY[1]} long, set long, fp long, n int, keys array<long>"


def _sketches(batches, width: int):
    for batch in batches:
        for b in text_slices(batch, "text", 1 << 20):
            every = _shingles(b, width)
            prints = majority(np.concatenate(every), np.array([len(s) for s in every], np.int64))
            sets = [np.unique(s) for s in every]
            lens = np.array([len(s) for s in sets], np.int64)
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            real = lens > 0
            keys = band_keys(np.concatenate(sets), lens[real]) if real.any() else np.empty((0, BANDS), np.uint64)
            ends = np.concatenate(([0], np.cumsum(BANDS * real))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            columns = [*(b.column(c) for c in ("doc_id", *KEY)), pa.array(ids.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(lens.astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *KEY, "set", "fp", "n", "keys"])


def _hashes(batches, width: int):
    for batch in batches:
        for b in text_slices(batch, "text", 1 << 20):
            sets = pa.array([np.unique(s).tobytes() for s in _shingles(b, width)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("set"), sets], names=["set", "hashes"])


def verified(sets: list[np.ndarray], share: float, label: np.ndarray, side: np.ndarray | None = None) -> tuple[list[tuple[int, int]], int]:
    """A spanning forest of the pairs of positions whose sets have a Jaccard similarity of ``share`` or more, and the number of pairs compared.
    ``sets`` ascend by size and have one hash at least; sets of one ``label`` are connected already; with ``side``, a pair has one of it."""
    lens = np.array([len(s) for s in sets], np.int64)
    starts, (_, codes) = starts_of(lens), np.unique(np.concatenate(sets), return_inverse=True)
    mark, (_, label), out, compared = np.zeros(codes.max() + 1, np.bool_), np.unique(label, return_inverse=True), [], 0
    for i in range(len(sets) - 1):
        stop = int(np.searchsorted(lens, lens[i] / share * (1 + 1e-9), side="right"))
        wanted = label[i + 1 : stop] != label[i]
        if side is not None:
            wanted &= side[i + 1 : stop] != side[i]
        other = np.flatnonzero(wanted) + i + 1
        if not len(other):
            continue
        compared += len(other)
        own = codes[starts[i] : starts[i] + lens[i]]
        mark[own] = True
        both = np.add.reduceat(mark[codes[ragged(starts[other], lens[other])]], starts_of(lens[other]), dtype=np.int64)
        mark[own] = False
        for j in other[both / (lens[i] + lens[other] - both) >= share]:
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out, compared


LINKS = "a long, b long, compared long"


def _jobs(batches, share: float):
    """Links of each job (key, tile, chunk), whose rows follow one another and ascend by size; a last row has the number of pairs compared."""
    key, held, compared = None, [], 0

    def links():
        nonlocal compared
        if len(held) < 2:
            return []
        side = np.array([h[0] for h in held]) if held[0][0] is not None else None
        found, n = verified([np.frombuffer(h[3], np.uint64) for h in held], share, np.array([h[2] for h in held]), side)
        compared += n
        return [(held[i][1], held[j][1], None) for i, j in found]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["a", "b", "compared"])

    for b in batches:
        for *job, side, name, root, hashes in zip(*(b.column(c).to_pylist() for c in ("key", "tile", "chunk", "side", "set", "root")), b.column("hashes")):
            if key != job:
                if rows := links():
                    yield batch_of(rows)
                key, held = job, []
            held.append((side, name, root, hashes.as_py()))
    if rows := links():
        yield batch_of(rows)
    yield batch_of([(None, None, compared)])


#: Min-hash keys of the first of their waves.
FIRST = 3


def links(docs: DataFrame, sketches: DataFrame, width: int, share: float) -> DataFrame:
    """Verified links (a, b) between sets that connect all pairs of ``share`` or more, directly or through others; rows without a and b
    count the pairs compared."""
    spark = docs.sparkSession
    one = sketches.where("n > 0").groupBy("set", "n").agg(F.min(F.struct(*KEY)).alias("at"), F.first("keys").alias("keys"))
    one = stash(one)
    prints = stash(sketches.where("n > 0").select("set", "fp").distinct())
    near = components(simhash.links(prints.select("fp").distinct(), RADIUS))
    alike = prints.join(near, prints["fp"] == near["node"], "left").select("set", F.coalesce("root", "fp").alias("key"), F.lit(0).alias("wave")).distinct()
    keys = one.select("set", F.posexplode("keys").alias("band", "key")).select("set", "key", F.when(F.col("band") < FIRST, 1).otherwise(2).alias("wave")).union(alike)
    shared = keys.groupBy("key").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high").select("key")
    # Keys that sets share are few beside all keys, so that what a set has else is joined to these.
    own = one.select("set", "n", *[F.col("at")[k].alias(k) for k in KEY])
    keys = stash(keys.join(shared, "key").join(own, "set").select("key", "set", "wave", "n", *KEY))
    bodies = keys.groupBy("set").agg(*[F.first(k).alias(k) for k in KEY])
    rows = keyed(docs, "text").select(F.col("text").cast("string").alias("text"), *KEY).join(bodies, KEY)
    bodies = stash(rows.mapInArrow(partial(_hashes, width=width), "set long, hashes binary"))
    found, roots = spark.createDataFrame([], LINKS), None

    def compared(jobs: DataFrame) -> DataFrame:
        """``jobs``: key, tile, chunk, side, set, n, root."""
        jobs = jobs.join(bodies, "set").repartition("key", "tile", "chunk").sortWithinPartitions("key", "tile", "chunk", "n", "set")
        return stash(jobs.mapInArrow(partial(_jobs, share=share), LINKS))

    def rooted_keys(own: DataFrame) -> DataFrame:
        return own.withColumn("root", F.col("set")) if roots is None else own.join(roots, own["set"] == roots["node"], "left").withColumn("root", F.coalesce("root", "set")).drop("node")

    none = F.lit(None).cast("boolean")
    for wave in range(3):
        own = rooted_keys(keys.where(F.col("wave") == wave).select("key", "set", "n"))
        live = own.groupBy("key").agg(F.sum("n").alias("weight"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("set").alias("head")).where("low <> high")
        live = live.select("key", F.ceil(F.col("weight") / WEIGHT).cast("int").alias("tiles"), "head")
        tiled = own.join(live, "key").withColumn("tile", F.expr("cast(pmod(set, tiles) as int)"))
        guests = tiled.where("set = head and tiles > 1").select("key", "set", "n", "root", F.explode(F.expr("filter(sequence(0, tiles - 1), t -> t <> tile)")).alias("tile"))
        jobs = tiled.select("key", "set", "n", "root", "tile").unionByName(guests)
        found = found.union(compared(jobs.select("key", "tile", F.lit(0).alias("chunk"), none.alias("side"), "set", "n", "root")))
        roots = stash(components(found.where("a is not null").select("a", "b")))
        large = live.where("tiles > 1")
        if large.isEmpty():
            continue
        tiled = rooted_keys(keys.where(F.col("wave") == wave).select("key", "set", "n")).join(large, "key").withColumn("tile", F.expr("cast(pmod(set, tiles) as int)"))
        most = tiled.groupBy("key", "root").agg(F.sum("n").alias("w")).groupBy("key").agg(F.max_by("root", "w").alias("main"), F.ceil((F.sum("w") - F.max("w")) / WEIGHT).cast("int").alias("chunks")).where("chunks > 0")
        tiled = stash(tiled.join(most, "key"))
        # A set meets those of other components: of the largest one in all tiles, and of each other in the tiles that it is sent to.
        lone = tiled.where("root <> main").select("key", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), F.expr("cast(pmod(set, chunks) as int)").alias("chunk"), F.lit(True).alias("side"), "set", "n", "root")
        every = tiled.select("key", "tile", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.lit(False).alias("side"), "set", "n", "root")
        found = found.union(compared(lone.unionByName(every)))
        roots = stash(components(found.where("a is not null").select("a", "b")))
    return found


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """One row per document: doc_id, row key, its set, fingerprint, number of hashes and min-hash keys."""
    rows = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *KEY)
    return rows.mapInArrow(partial(_sketches, width=width), SKETCHES)


def near_groups(docs: DataFrame, *, width: int = 5, share: float = 0.8) -> DataFrame:
    """One row per document: doc_id, row key, component (the smallest set of its component). ``docs`` have a row key."""
    sketches = stash(sketched(docs, width))
    roots = components(links(docs, sketches, width, share).where("a is not null").select("a", "b"))
    return sketches.join(roots, sketches["set"] == roots["node"], "left").select("doc_id", *KEY, F.coalesce("root", "set").alias("component"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """Of each component the row with the smallest doc_id, with all its columns."""
    docs = rooted(docs)
    groups = stash(near_groups(docs, **options).withColumn("me", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), *KEY)))
    kept = groups.groupBy("component").agg(F.min("me").alias("kept"), F.count("*").alias("rows")).where("rows > 1").select("component", "kept")
    dropped = stash(groups.join(kept, "component").where("not (me <=> kept)").select(*KEY))
    return unpacked(keyed(docs).join(dropped, KEY, "left_anti"))
