"""Best-fit packing of tokenised documents with Martello-Toth dominance reduction.

Documents are cut into pieces of at most ``capacity`` tokens. A piece counts by its length alone, so the instance is the
histogram of lengths (at most ``capacity`` numbers), which is all that reaches the driver. There, dominance fixes bins for
good, for all pieces of a length at once, and best-fit decreasing packs the shrunken instance; the plan is a list of
patterns (lengths in a sequence) with their numbers of sequences. Pieces are numbered within their length in two steps
(hash buckets, then rows of a bucket), so that a length that a third of all documents share is spread over many tasks, and
each piece finds its sequence and offset from its number and the plan, whose size depends on ``capacity`` only.

Rules: a null or empty text is one piece with the end token alone; a null doc_id is packed like any other; repeated rows
are documents of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import KEY, keyed, ragged, starts_of, stash, text_slices, tokens

CAPACITY, END = 2048, 0
#: Words whose ids a Python worker keeps, so that its memory is bounded.
CACHED = 100_000
#: Hash buckets of a length; rows of a length and bucket are numbered in one task.
BUCKETS = 4096
PUNCTUATION = ".,;:!?"
#: The end of the Latin letters that have a lower case of one letter, or none, and one normal form.
LATIN_END = "\u0250"


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer, the default of the ``tokenizer`` parameters here."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
    return Tokenizer.from_file(path), {}, lru_cache(maxsize=1024)(lambda c: bytewise.pre_tokenize_str(c)[0][0])


def word_ids(words: list[str], path: str) -> list[bytes]:
    """Ids, as bytes of 32-bit integers, of words without white space. The tokenizer drops white space and merges within letters only,
    so that a text's ids are those of its words, one after another; a lower-case Latin word (with a full stop or the like after it)
    goes to the BPE model alone, its letters as the byte-level step writes them."""
    tokenizer, cache, letter = _tokenizer(path)
    model = tokenizer.model.tokenize
    if len(cache) > CACHED:
        cache.clear()

    def new(word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():  # its letters are their own bytes
            got = cache[word] = array("I", [t.id for t in model(word)]).tobytes()
            return got
        stem = word.rstrip(PUNCTUATION)
        lower = stem.lower()
        if not (stem.isalpha() and max(stem) < LATIN_END and len(lower) == len(stem)):
            got = array("I", tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        elif len(stem) < len(word):
            got = one(stem) + one(word[len(stem) :])
        elif lower != word:
            got = one(lower)
        else:
            got = array("I", [t.id for t in model("".join(map(letter, word)))]).tobytes()
        cache[word] = got
        return got

    def one(word: str) -> bytes:
        return cache.get(word) or new(word)

    return [cache.get(w) or new(w) for w in words]


def document_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts with their end tokens, number of ids of each)."""
    codes, words_in, words = tokens(texts, lower=False)
    known = word_ids(words.to_pylist(), path)
    size = np.fromiter(map(len, known), np.int64, len(known)) // 4
    flat = np.frombuffer(b"".join(known), np.uint32)
    each = size[codes] if len(codes) else np.zeros(0, np.int64)
    body = flat[ragged(starts_of(size)[codes], each)] if len(codes) else flat[:0]
    ends = np.concatenate(([0], np.cumsum(each)))
    lens = np.diff(ends[np.concatenate(([0], np.cumsum(words_in)))])
    return np.insert(body, np.cumsum(lens), np.uint32(END)), lens + 1


def _pieces(batches, path: str, capacity: int):
    for batch in batches:
        for b in text_slices(batch, "text", 3 << 20):
            ids, lens = document_ids(b.column("text"), path)
            count = -(-lens // capacity)
            doc = np.repeat(np.arange(len(lens)), count)
            piece = np.arange(len(doc)) - np.repeat(starts_of(count), count)
            start = piece * capacity
            length = np.minimum(lens[doc] - start, capacity)
            data, at = ids.astype("<u4").tobytes(), 4 * (starts_of(lens)[doc] + start)
            crc = [zlib.crc32(data[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist())]
            own = [b.column(c).take(pa.array(doc)) for c in ("doc_id", *KEY)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", *KEY, "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    rows = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *KEY)
    return rows.mapInArrow(partial(_pieces, path=tokenizer, capacity=capacity), f"doc_id long, {KEY[0]} long, {KEY[1]} long, piece int, start long, length long, ids_crc32 long")


class _Sizes:
    """A multiset of lengths."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, times: int) -> None:
        self.n[size] -= times
        if not self.n[size]:
            del self.n[size]
            del self.order[bisect.bisect_left(self.order, size)]

    def at_most(self, size: int) -> int | None:
        k = bisect.bisect_right(self.order, size)
        return self.order[k - 1] if k else None

    def smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for s in self.order:
            out += [s] * min(self.n[s], k - len(out))
            if len(out) == k:
                break
        return out


def _best_pair(sizes: _Sizes, room: int) -> tuple[int, int] | None:
    """The pair of remaining lengths with the largest sum of at most ``room``; of equal sums the most even one."""
    best, low, high = None, 0, bisect.bisect_right(sizes.order, room) - 1
    while low <= high:
        a, b = sizes.order[low], sizes.order[high]
        if a + b > room or (a == b and sizes.n[a] < 2):
            high -= 1
        else:
            if best is None or a + b >= sum(best):
                best = (a, b)
            low += 1
    return best


def _dominant(sizes: _Sizes, j: int, capacity: int) -> tuple[tuple[int, ...], int] | None:
    """(set, bins): a set with a piece of length j that dominates all others with one, and in how many bins it can be fixed at once."""
    times, room = sizes.n[j], capacity - j
    others = _Sizes(sizes.n)
    others.take(j, 1)
    low = others.smallest(3)
    if not low or low[0] > room:  # nothing fits beside it
        return (j,), times
    mate = others.at_most(room)
    pairs = times // 2 if mate == j else min(times, sizes.n[mate])
    if mate == room or len(low) < 2 or low[0] + low[1] > room:  # a full bin; or one piece at a time fits, the largest best
        return (j, mate), pairs
    if len(low) < 3 or sum(low) > room:  # two at most fit
        best = _best_pair(others, room)
        if best is not None and mate >= sum(best):
            return (j, mate), pairs  # fewer pieces only make the rival pair smaller
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(patterns fixed for good with their numbers, what remains): takes the lengths from the largest down and fixes a bin whenever a
    set of at most three pieces dominates every other set with that length. What remains is tried again until nothing is fixed."""
    sizes, fixed, changed = _Sizes(counts), [], True
    while changed:
        changed = False
        for j in reversed(list(sizes.order)):
            while j in sizes.n and (found := _dominant(sizes, j, capacity)) is not None:
                fixed.append(found)
                changed = True
                for s in set(found[0]):
                    sizes.take(s, found[0].count(s) * found[1])
    return fixed, sizes.n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on lengths with their numbers: patterns with their numbers of bins."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # by the room left
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if room not in open_:
            open_[room] = {}
            bisect.insort(rooms, room)
        open_[room][pattern] = open_[room].get(pattern, 0) + n

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):  # a new bin holds as many as fit
                each = min(capacity // size, n)
                put((size,) * each, n // each)
                n -= each * (n // each)
                continue
            room = rooms[k]
            pattern, bins = next(iter(open_[room].items()))
            each = min(room // size, n)
            used = min(bins, n // each)
            if used == bins:
                del open_[room][pattern]
                if not open_[room]:
                    del open_[room]
                    del rooms[k]
            else:
                open_[room][pattern] = bins - used
            put(pattern + (size,) * each, used)
            n -= each * used
    return [x for patterns in open_.values() for x in patterns.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, offset, first sequence, number of pieces): where the pieces of each length go, by their numbers."""
    given: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for size in pattern:
            first = given.get(size, 0)
            out.append((size, first, offset, sequence, n))
            given[size] = first + n
            offset += size
        sequence += n
    return out


def _place(batches, slots: dict):
    for b in batches:
        key = b.column("length").to_numpy() * (1 << 48) + b.column("number").to_numpy()
        at = np.searchsorted(slots["key"], key, side="right") - 1
        sequence = slots["sequence"][at] + (key - slots["key"][at])
        names = ["doc_id", *KEY, "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(slots["offset"][at], pa.int64())], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: row key, doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = stash(pieces(docs, tokenizer, capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", *KEY, "piece"), F.lit(BUCKETS)).cast("int")))
    per_bucket = stash(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = sorted(_slots(plan(counts, capacity)))
    columns = dict(zip(("length", "first", "offset", "sequence", "n"), np.array(slots, np.int64).reshape(-1, 5).T))
    columns["key"] = columns["length"] * (1 << 48) + columns["first"]
    before = W.Window.partitionBy("length").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    base = per_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.Window.partitionBy("length", "bucket").orderBy("doc_id", *KEY, "piece")
    numbered = rows.withColumn("row", F.row_number().over(within)).join(base, ["length", "bucket"])
    numbered = numbered.select("doc_id", *KEY, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("row") - 1).alias("number"))
    return numbered.mapInArrow(partial(_place, slots=columns), f"doc_id long, {KEY[0]} long, {KEY[1]} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
