"""Blocks of documents, and their questions to shards of a key space.

A block is a slice of a text column as word codes with the distinct words. Operators that need to know of the whole corpus
hash what they count into a key space of a power of two, and cut it into shards of equal ranges. A block sends each shard
its distinct keys, in order and Elias-Fano coded, with their counts in the block; a shard goes through what all blocks sent
and answers each with one bit per key. A key that is frequent in the corpus is one entry per block, whatever its share, so no
shard is hot; messages are some ten bits per key, and neither blocks nor shards are ever seen whole by a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import stash, text_slices
from .elias_fano import packed, unpacked

ASKED = "part int, block long, keys binary, counts binary"
ANSWER = "block long, part int, bits binary"
TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def arrow_schema(columns: str) -> pa.Schema:
    return pa.schema([(c.split()[0], TYPES[c.split()[1]]) for c in columns.split(", ")])


def record_batch(rows: list, columns: str) -> pa.RecordBatch:
    schema = arrow_schema(columns)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def packed_words(words: list[bytes]) -> bytes:
    """A list of byte strings, whatever bytes they have."""
    lens = np.fromiter(map(len, words), np.uint32, len(words))
    return zlib.compress(np.int64(len(words)).tobytes() + lens.tobytes() + b"".join(words), 1)


def unpacked_words(data: bytes) -> list[bytes]:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = 8 + 4 * n + np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint32, n, 8), dtype=np.int64)))
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def packed_codes(codes: np.ndarray) -> bytes:
    """Codes below 2^32, the frequent ones small: their low bytes, and the rest, which is mostly zero, compressed apart."""
    codes = codes.astype(np.uint32)
    low, high = (zstandard.compress(np.ascontiguousarray(x).tobytes(), 1) for x in (codes.astype(np.uint8), codes >> np.uint32(8)))
    return np.int64(len(low)).tobytes() + low + high


def unpacked_codes(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    low, high = np.frombuffer(zstandard.decompress(data[8 : 8 + n]), np.uint8), np.frombuffer(zstandard.decompress(data[8 + n :]), np.uint32)
    return high << np.uint32(8) | low


def ranked(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes by falling frequency, the old code of each of the ``k`` new ones)."""
    order = np.argsort(-np.bincount(codes, minlength=k), kind="stable")
    place = np.empty(k, np.int64)
    place[order] = np.arange(k)
    return place[codes], order


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 up in the narrowest type that holds them, compressed."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return np.dtype(kind).char.encode() + zlib.compress(x.astype(kind).tobytes(), 1)


def unnarrow(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), np.dtype(data[:1].decode()))


def _blocks(batches, of: Callable, columns: str, max_bytes: int):
    top, n = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for b in text_slices(batch, "text", max_bytes):
            yield record_batch([(top + n, *of(b))], columns)
            n += 1


def blocks(rows: DataFrame, of: Callable, columns: str, *, max_bytes: int = 8 << 20) -> DataFrame:
    """One stashed row per slice of about ``max_bytes`` of the column text: its number, then what ``of`` makes of it."""
    return stash(rows.mapInArrow(partial(_blocks, of=of, columns=columns, max_bytes=max_bytes), columns), compression="zstd")


def each_row(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for k in range(table.num_rows):
        yield {c: table.column(c)[k].as_py() for c in table.schema.names}


def key_bits(mass: int, per_key: int) -> int:
    """So many bits that the key space has ``per_key`` keys or more for each of ``mass`` occurrences."""
    return max(12, (max(mass, 1) * per_key - 1).bit_length())


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of each key among them, and their counts."""
    keys, place, n = np.unique(keys, return_inverse=True, return_counts=True)
    return keys, place, n


def pieces(keys: np.ndarray, counts: np.ndarray, bits: int, span: int, first: int = 0) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, keys, counts) of each shard, of 2^span keys, that ``keys``, below 2^bits, fall into; parts count from ``first``."""
    part = (keys >> np.uint64(span)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        p = int(part[low])
        yield first + p, packed(keys[low:high] - (np.uint64(p) << np.uint64(span)), 1 << min(span, bits)), narrow(counts[low:high])


def _asked(batches, of: Callable):
    for b in batches:
        for row in each_row(b):
            rows = [(p, row["block"], k, c) for p, k, c in of(row)]
            if rows:
                yield record_batch(rows, ASKED)


def _answers(table: pa.Table, judge: Callable) -> pa.Table:
    rows = list(each_row(table.select(["block", "part"])))
    keys, counts = table.column("keys"), table.column("counts")
    read = lambda: ((unpacked(k.as_py()), unnarrow(c.as_py())) for k, c in zip(keys, counts))
    said = [(r["block"], r["part"], np.packbits(yes).tobytes()) for r, yes in zip(rows, judge(read))]
    return pa.Table.from_batches([record_batch(said, ANSWER)])


def ask(blocks: DataFrame, of: Callable[[dict], Iterable], judge: Callable[[Callable], Iterable[np.ndarray]]) -> DataFrame:
    """One bit for each key that each block asks about, stashed. ``of`` gives a block's pieces. ``judge`` gets a function that goes
    through a shard's (keys, counts) as often as it is called, one block's at a time, and gives an array of flags for each."""

    def answered(table: pa.Table) -> pa.Table:
        return _answers(table, judge)

    asked = blocks.mapInArrow(partial(_asked, of=of), ASKED)
    return stash(asked.groupBy("part").applyInArrow(answered, ANSWER))


def flags(answers: pa.Table, keys: np.ndarray, span: int, first: int = 0) -> np.ndarray:
    """A block's answer for each of the ``keys`` that it asked about with ``pieces``."""
    bits = dict(zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist()))
    part, n = np.unique((keys >> np.uint64(span)).astype(np.int64), return_counts=True)
    said = [np.unpackbits(np.frombuffer(bits[first + p], np.uint8), count=c) for p, c in zip(part.tolist(), n.tolist())]
    return np.concatenate(said).astype(bool) if said else np.zeros(0, bool)
