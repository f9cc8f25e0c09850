"""Removal of passages that an earlier document has, by exact windows of words behind a count-min prefilter.

A window is a run of ``width`` words of one document. First pass: each block of documents adds its windows to a count-min
sketch of two rows, whose counters, four to eight for each window of the corpus, are held by range in shards; the blocks'
sparse sketches are merged there by addition, and a block learns which of its windows may occur twice. The sketch never
counts too low, so no repeated window is lost. Second pass: only those windows are grouped exactly, by two independent 64-bit
hashes of the word sequence (128 bits), with the smallest doc_id of each block, and a block learns which of them an earlier
document has. Words that such a window covers go; windows are judged on the input.

A window that many documents share is one entry per block in either pass. Nothing but bits comes back to the blocks.

Rules: a null text has no words; a row without a doc_id comes after all that have one, and never takes words from another;
rows that repeat a doc_id don't take words from each other; texts of fewer than ``width`` words stay whole; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, keyed, mix64, release, starts_of, stash, tokens
from .elias_fano import packed, unpacked
from .shards import arrow_schema, ask, blocks, each_row, flags, key_bits, narrow, packed_codes, packed_words, pieces, ranked, record_batch, unnarrow, unpacked_codes, unpacked_words

#: Rows of the sketch, counters for each window at least, and bits of the number of counters in a shard.
ROWS, COUNTERS, SPAN = 2, 4, 25
FACTOR = np.uint64(0xD6E8FEB86659FD93)
BLOCK = f"block long, windows long, doc_id binary, none binary, {KEY[0]} binary, {KEY[1]} binary, lens binary, codes binary, words binary"
EXACT = "part int, block long, keys binary, seconds binary, base long, lows binary, none binary"
KEPT = f"{KEY[0]} long, {KEY[1]} long, doc_id long, n_words long, n_removed long, kept_text string"


def _block(b: pa.RecordBatch, width: int) -> tuple:
    codes, lens, words = tokens(b.column("text"), lower=False)
    plain = lambda c: b.column(c).to_numpy(zero_copy_only=False)
    doc = pc.fill_null(b.column("doc_id"), 0).to_numpy(zero_copy_only=False)
    none = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    own = (zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in (doc, none, plain(KEY[0]), plain(KEY[1]), lens))
    codes, order = ranked(codes, len(words))
    return int(np.maximum(lens - width + 1, 0).sum()), *own, packed_codes(codes), packed_words(words.take(pa.array(order)).cast(pa.binary()).to_pylist())


class Windows:
    """The windows of a block: ``at``, the place of the first word of each."""

    def __init__(self, row: dict, width: int):
        array = lambda c, kind: np.frombuffer(zlib.decompress(row[c]), kind)
        self.doc_id, self.none, self.file, self.row, self.lens = map(array, ("doc_id", "none", *KEY, "lens"), (np.int64, bool, np.int64, np.int64, np.int64))
        self.codes, self.words, self.width = unpacked_codes(row["codes"]), unpacked_words(row["words"]), width
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        end = (starts_of(self.lens) + self.lens)[self.doc]
        self.at = np.flatnonzero(np.arange(len(self.codes)) + width <= end)

    def hashes(self, seed: int) -> np.ndarray:
        each = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        h = each[self.codes]
        out = np.zeros(max(len(h) - self.width + 1, 0), np.uint64)
        for k in range(self.width if len(out) else 0):
            out = out * FACTOR + h[k : k + len(out)]
        return mix64(out[self.at])


def counters(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each window in a row of the sketch."""
    return mix64(hashes ^ (np.uint64(row) * FACTOR)) >> np.uint64(64 - bits)


def _sketch(row: dict, width: int, bits: int):
    hashes = Windows(row, width).hashes(1)
    for k in range(ROWS):
        keys, n = np.unique(counters(hashes, k, bits), return_counts=True)
        yield from pieces(keys, n, bits, SPAN, k << max(bits - SPAN, 0))


def _merged(read, bits: int):
    """Adds up a shard of the sketch; counters stop at 255."""
    total = np.zeros(1 << min(bits, SPAN), np.uint8)
    for keys, n in read():
        total[keys] = np.minimum(total[keys].astype(np.int64) + n, 255)
    return (total[keys] > 1 for keys, _ in read())


class Repeated:
    """The windows of a block that the sketch counts twice or more, grouped."""

    def __init__(self, row: dict, answers: pa.Table, width: int, bits: int):
        own = self.own = Windows(row, width)
        first, maybe = own.hashes(1), np.ones(len(own.at), bool)
        for k in range(ROWS):
            keys, place = np.unique(counters(first, k, bits), return_inverse=True)
            maybe &= flags(answers, keys, SPAN, k << max(bits - SPAN, 0))[place]
        self.at, first, second = own.at[maybe], first[maybe], own.hashes(2)[maybe]
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.first, self.second = first[new], second[new]
        doc = own.doc[self.at]
        self.id, self.without = own.doc_id[doc], own.none[doc]
        starts = np.flatnonzero(new)
        ids = np.where(self.without, np.iinfo(np.int64).max, self.id)[order]
        self.low = np.minimum.reduceat(ids, starts) if len(starts) else ids
        #: Groups all of whose documents here have no id.
        self.none = np.logical_and.reduceat(self.without[order], starts) if len(starts) else self.without

    def pieces(self, span: int):
        """(part, keys, seconds, base, lows, none) of each shard; the part is the top of the first hash."""
        part = (self.first >> np.uint64(span)).astype(np.int64)
        cuts = np.concatenate((np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            low = np.where(self.none[a:b], 0, self.low[a:b])
            base = int(low.min())
            yield int(part[a]), packed(self.first[a:b] - (np.uint64(part[a]) << np.uint64(span)), 1 << span), self.second[a:b].tobytes(), base, narrow((low - base).view(np.uint64)), np.packbits(self.none[a:b]).tobytes()

    def removed(self, answers: pa.Table, span: int) -> np.ndarray:
        """Which words go, given the groups that a document of another block with a smaller id has."""
        earlier = flags(answers, self.first, span)
        taken = earlier[self.group] | (~self.none[self.group] & (self.without | (self.low[self.group] < self.id)))
        edges = np.zeros(len(self.own.codes) + 1, np.int64)
        np.add.at(edges, self.at[taken], 1)
        np.add.at(edges, self.at[taken] + self.own.width, -1)
        return np.cumsum(edges)[:-1] > 0


def _exact(left: pa.Table, right: pa.Table, width: int, bits: int, span: int) -> pa.Table:
    rows = [(p[0], row["block"], *p[1:]) for row in each_row(left) for p in Repeated(row, right, width, bits).pieces(span)]
    return pa.Table.from_batches([record_batch(rows, EXACT)])


def _earlier(table: pa.Table) -> pa.Table:
    """Whether each group of each block also is in a document of a smaller id than all that the block has."""
    rows = list(each_row(table))
    firsts = [unpacked(r["keys"]) for r in rows]
    seconds = [np.frombuffer(r["seconds"], np.uint64) for r in rows]
    lens = np.array([len(f) for f in firsts], np.int64)
    first, second = np.concatenate(firsts), np.concatenate(seconds)
    low = np.concatenate([unnarrow(r["lows"]).astype(np.uint64).view(np.int64) + r["base"] for r in rows])
    none = np.concatenate([np.unpackbits(np.frombuffer(r["none"], np.uint8), count=n) for r, n in zip(rows, lens.tolist())]).astype(bool)
    order = np.lexsort((np.where(none, np.iinfo(np.int64).max, low), none, second, first))
    f, s, lowest, real = first[order], second[order], low[order], ~none[order]
    new = np.ones(len(order), bool)
    new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]  # those with an id come first, the smallest before the others
    yes = np.empty(len(order), bool)
    yes[order] = real[head] & (~real | (lowest[head] < lowest))
    said = [(r["block"], r["part"], np.packbits(y).tobytes()) for r, y in zip(rows, np.split(yes, np.cumsum(lens)[:-1]))]
    return pa.Table.from_batches([record_batch(said, "block long, part int, bits binary")])


def _kept(left: pa.Table, right: pa.Table, width: int, bits: int, span: int) -> pa.Table:
    """``right`` has both passes' answers, of the second with parts below 0."""
    out = []
    for row in each_row(left):
        part = right.column("part")
        one = right.filter(pc.greater_equal(part, 0))
        two = right.filter(pc.less(part, 0))
        two = two.set_column(two.schema.get_field_index("part"), "part", pc.cast(pc.subtract(-1, two.column("part")), pa.int32()))
        found = Repeated(row, one, width, bits)
        own, gone = found.own, found.removed(two, span)
        words = np.array([*own.words, None], object)[:-1]
        kept, n_gone = words[own.codes[~gone]].tolist(), np.bincount(own.doc[gone], minlength=len(own.lens))
        ends = np.cumsum(own.lens - n_gone)
        texts = [b" ".join(kept[a:b]) for a, b in zip((ends - own.lens + n_gone).tolist(), ends.tolist())]
        columns = [own.file, own.row, pa.array(own.doc_id, mask=own.none), own.lens, n_gone.astype(np.int64), pa.array(texts, pa.binary()).cast(pa.string())]
        out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=arrow_schema(KEPT)))
    return pa.Table.from_batches(out, schema=arrow_schema(KEPT))


def without_repeats(docs: DataFrame, *, width: int = 13, shard_windows: int = 1 << 21) -> DataFrame:
    """One row per document: row key, doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space)."""
    rows = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *KEY)
    held = blocks(rows, partial(_block, width=width), BLOCK)
    n = held.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    bits = key_bits(n, COUNTERS)
    maybe = ask(held, partial(_sketch, width=width, bits=bits), partial(_merged, bits=bits))
    release(docs.sparkSession)
    span = 63 - (n // shard_windows).bit_length()

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        return _exact(left, right, width, bits, span)

    def kept(left: pa.Table, right: pa.Table) -> pa.Table:
        return _kept(left, right, width, bits, span)

    asked = held.groupBy("block").cogroup(maybe.groupBy("block")).applyInArrow(exact, EXACT)
    earlier = stash(asked.groupBy("part").applyInArrow(_earlier, "block long, part int, bits binary"))
    del asked
    release(docs.sparkSession)
    answers = maybe.unionByName(earlier.withColumn("part", -1 - F.col("part")))
    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(kept, KEPT)
