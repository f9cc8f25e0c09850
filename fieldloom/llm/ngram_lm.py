"""Scoring documents with an n-gram model in Elias-Fano tries.

Model, of order n (3 by default): p(w) = (c + 0.5) / (N + 0.5 (V + 1)); with a context x, p(w | x) = (c(xw) + k p(w | y)) / (c(x) + k),
where y is x without its first word and k belongs to the order. All training documents count, without pruning. A document
begins with begin marks and ends with the end.

Documents are cut into blocks of at most ``block_tokens`` tokens. For each order, a block sends its distinct n-grams with
their training counts to shards: a context's hash gives its shard, so that a context meets all its words there; a context
that occurs ``hot`` times or more is dealt over several by the hash of the word. A shard adds up what all blocks sent and
builds its part of the trie from the n-grams of the training documents: level one has the contexts, level two their words,
made monotone by the context's place, with the quantised value c(xw) / (c(x) + k); both are Elias-Fano coded, as are the
pointers between them, and live in a memory-mapped file. Each n-gram of a block, trained or not, is then looked up by a
successor search for the context and one within the context's range. What returns to a block is a 12-bit code per n-gram; the
levels themselves stay in the shared folder only if asked for (``keep``). A frequent n-gram is one entry per block, whatever
its share of the corpus, and no task sees the whole model.

Messages number blocks times shards, each of about block_tokens / shards n-grams. Contexts go by 64-bit hashes, a word within a
context by 40 bits, in a corpus of any size: a context's part has at most two million words, so that an unseen word is taken for
a seen one with a chance of 2e-6 at most. A quantised value is off by up to 0.4 %.

Rules: a null text counts as empty, so its only token is the end; a null doc_id is a training document; repeated rows count
and are scored like any other; an empty table gives an empty result; without training documents p(w) is 1; further columns are ignored.
"""

from __future__ import annotations

import mmap
import tempfile
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, keyed, mix64, release, starts_of, stash, text_slices, tokens
from .elias_fano import EliasFano, joined, packed, unpacked
from .shards import packed_codes, packed_words, ranked, unpacked_codes, unpacked_words

BLOCK = f"block long, n_tokens long, n_train long, doc_id binary, {KEY[0]} binary, {KEY[1]} binary, held binary, lens binary, codes binary, words binary"
#: Hashes that stand for the begin and the end of a document.
BEGIN_HASH, END_HASH = 0x9AE16A3B2F90404F, 0xC949D7C7509E6557
#: Quantised logarithms: CODES steps from LOWEST to 0, and a code for n-grams that are not in the model.
CODES, LOWEST, ABSENT = 1 << 12, -14.0, (1 << 16) - 1
#: The value of each code.
VALUES = np.append(10 ** (LOWEST * (1 - (np.arange(CODES) + 0.5) / CODES)), np.zeros(ABSENT + 1 - CODES))
#: Bits of a word's hash within a context.
WORD_BITS = 40
NODE_BITS = 64
WORD_MASK = np.uint64((1 << WORD_BITS) - 1)
#: N-grams that are searched at once.
SEARCH = 1 << 18


def _blocks(batches, block_tokens: int):
    from pyspark import TaskContext

    top, n = TaskContext.get().partitionId() << 32, 0
    held: list = []

    def out():
        nonlocal n, held
        ids: dict[bytes, int] = {}
        codes, columns = [], [np.concatenate([h[k] for h in held]) for k in range(5)]
        for *_, own, words in held:
            place = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint32, len(words))
            codes.append(place[own] if len(own) else place[:0])
        doc, file, row, is_held, lens = columns
        codes, order = ranked(np.concatenate(codes), len(ids))
        words = list(ids)
        n += 1
        values = [top + n, int(lens.sum()), int((~is_held).sum()), *(x.tobytes() for x in (doc, file, row, is_held, lens)), packed_codes(codes), packed_words([words[k] for k in order.tolist()])]
        held = []
        names = [c.split()[0] for c in BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k < 3 else pa.binary()) for k, v in enumerate(values)], names=names)

    size = 0
    for batch in batches:
        for b in text_slices(batch, "text"):
            codes, lens, words = tokens(b.column("text"))
            doc = pc.fill_null(b.column("doc_id"), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            if held and size + len(codes) > block_tokens:
                yield out()
                size = 0
            held.append((doc, b.column(KEY[0]).to_numpy(), b.column(KEY[1]).to_numpy(), b.column("held").to_numpy(zero_copy_only=False), lens, codes, words.cast(pa.binary()).to_pylist()))
            size += len(codes)
    if held:
        yield out()


class Block:
    """The tokens of a block with its distinct words and their hashes. Word k is the begin, k + 1 the end."""

    def __init__(self, row: dict):
        array = lambda name, kind: np.frombuffer(row[name], kind)
        self.doc_id, self.file, self.row = (array(c, np.int64) for c in ("doc_id", *KEY))
        self.held, self.lens, codes = array("held", bool), array("lens", np.int64), unpacked_codes(row["codes"]).astype(np.int64)
        words = unpacked_words(row["words"])
        k = self.k = len(words)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, k)
        self.hashes = np.append(hashes, np.array([BEGIN_HASH, END_HASH], np.uint64))
        self.codes = np.insert(codes, np.cumsum(self.lens), k + 1)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens + 1)
        self.starts = starts_of(self.lens + 1)
        self.train = ~self.held[self.doc]
        self.word_hash = mix64(self.hashes)
        self.short = self.word_hash & WORD_MASK
        self.by_word, self.rank = _ranks(self.short)

    def words(self) -> Keys:
        return Keys(self.hashes[: self.k], np.bincount(self.codes[self.train & (self.codes < self.k)], minlength=self.k))


def _lookup(known: dict[int, int], keys: np.ndarray) -> np.ndarray:
    """The value of each key, -1 where it is not known."""
    out = np.full(len(keys), -1)
    if known and len(keys):
        names = np.array(sorted(known), np.uint64)
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        hit = names[at] == keys
        out[hit] = np.array([known[n] for n in names.tolist()])[at[hit]]
    return out


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of the keys, and each one's number in it."""
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.uint64)
    rank[order] = np.arange(len(keys), dtype=np.uint64)
    return order, rank


def _distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, of ``bits`` bits, in order, and where each key is among them. A place fits beside a key as a rule, and
    sorting numbers is several times as fast as sorting places."""
    room = np.uint64(len(keys).bit_length())
    if bits + int(room) > 64:
        return np.unique(keys, return_inverse=True)
    both = keys << room | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    place = (both & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)
    both >>= room
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.empty(len(both), np.int64)
    at[place] = np.cumsum(new) - 1
    return both[new], at


class Grams:
    """The distinct n-grams of a block; those of the order before are the contexts. A node is a context, or a part of a hot one."""

    def __init__(self, block: Block, lower: Grams | None, node_bits: int, hot: dict[int, int], limit: int):
        """``hot``: counts of the contexts, by their key, that occur ``limit`` times or more."""
        if lower is None:  # contexts are words
            at, hashes, keys, begin = block.codes, block.hashes, block.hashes, block.k
        else:
            at, (hashes, keys) = lower.at, lower.contexts()
            begin = len(hashes)
            hashes, keys = np.append(hashes, mix64(np.array([BEGIN_HASH], np.uint64))), np.append(keys, np.uint64(BEGIN_HASH))
        context = np.insert(at, 0, begin)[:-1]
        context[block.starts] = begin
        mixed = mix64(hashes)
        nodes = mix64(mixed) >> np.uint64(64 - node_bits)
        by_node, rank = _ranks(nodes)
        shift = np.uint64((block.k + 2).bit_length())
        pairs, self.at = _distinct(rank[context] << shift | block.rank[block.codes], len(nodes).bit_length() + int(shift))
        context, word = by_node[(pairs >> shift).astype(np.int64)], block.by_word[(pairs & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)]
        self.block, self.above, self.context, self.of_word, self.n = block, hashes, context, word, len(pairs)
        self.node, self.word, self.order = nodes[context], block.short[word], None
        total = _lookup(hot, keys)
        self.total = total[context]
        if (total >= 0).any():  # only parts of hot contexts leave the order of the pairs
            part = np.where(self.total < 0, 0, (block.word_hash[word] >> np.uint64(32)).astype(np.int64) % (1 + np.maximum(self.total, 0) // limit))
            self.node = mix64(mixed[context] + part.astype(np.uint64)) >> np.uint64(64 - node_bits)
            self.order = np.lexsort((self.word, self.node))

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and key of each n-gram as a context of the next order; the hash is another function of the context than of the word."""
        return mix64(mix64(self.above ^ np.uint64(END_HASH))[self.context] + self.block.word_hash[self.of_word]), gram_keys(self.node, self.word)

    def messages(self, shard_bits: int, node_bits: int):
        """(shard, nodes, words of each node, words, counts, totals of hot nodes) of each shard that is asked."""
        span = node_bits - shard_bits
        node, word, total, counts = self.node, self.word, self.total, np.bincount(self.at[self.block.train], minlength=self.n).astype(np.uint32)
        if self.order is not None:
            node, word, total, counts = (x[self.order] for x in (node, word, total, counts))
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        nodes, fan, total = node[first], np.diff(np.append(first, self.n)), total[first]
        cuts = np.concatenate(([0], np.searchsorted(nodes, np.arange(1, 1 << shard_bits, dtype=np.uint64) << np.uint64(span)), [len(nodes)]))
        ends = np.append(first, self.n)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            low, high = cuts[s], cuts[s + 1]
            rows = slice(ends[low], ends[high])
            is_hot = np.flatnonzero(total[low:high] >= 0)
            yield s, packed(nodes[low:high] - (np.uint64(s) << np.uint64(span)), 1 << span), _small(fan[low:high]), _narrow(word[rows]), _small(counts[rows]), np.stack((is_hot, total[low:high][is_hot])).astype(np.int64).tobytes()

    def answered(self, parts: list[bytes]) -> np.ndarray:
        """The value of each token's n-gram, 0 where the model lacks it."""
        codes = np.frombuffer(b"".join(map(zlib.decompress, parts)), np.uint16)
        if self.order is not None:
            sorted_codes, codes = codes, np.empty(self.n, np.uint16)
            codes[self.order] = sorted_codes
        return VALUES[codes][self.at]


def gram_keys(node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of an n-gram as a context of the next order."""
    return mix64(node + mix64(word))


class Keys:
    """Hashes in order, with their training counts in the block."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.order = np.argsort(keys)
        self.keys, self.counts = keys[self.order], counts[self.order].astype(np.uint32)

    def shards(self, bits: int):
        cuts = np.searchsorted(self.keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        return zip(np.split(self.keys, cuts), np.split(self.counts, cuts))

    def answered(self, parts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(self.keys), np.int64)
        out[self.order] = np.frombuffer(b"".join(map(zlib.decompress, parts)), np.uint32)
        return out


def _rows(b: pa.RecordBatch):
    for k in range(b.num_rows):
        yield {c: b.column(c)[k].as_py() for c in b.schema.names}


def _small(counts: np.ndarray) -> bytes:
    kind = np.uint8 if counts.max(initial=0) < 256 else np.uint32
    return np.dtype(kind).char.encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unsmall(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), np.dtype(data[:1].decode()))


def _narrow(words: np.ndarray) -> bytes:
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : WORD_BITS // 8].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // WORD_BITS, 8), np.uint8)
    out[:, : WORD_BITS // 8] = np.frombuffer(data, np.uint8).reshape(len(out), -1)
    return out.view("<u8").ravel()


def _asked(batches, columns: list[str], kinds: list, of):
    """Rows of ``of(block, row)`` for each block."""
    for b in batches:
        for row in _rows(b):
            made = list(of(Block(row), row["block"]))
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(kinds)], names=columns)


def _words(batches, bits: int):
    of = lambda block, n: ((s, n, packed(k - (np.uint64(s) << np.uint64(64 - bits)), 1 << (64 - bits)), _small(c)) for s, (k, c) in enumerate(block.words().shards(bits)) if len(k))
    return _asked(batches, ["shard", "block", "keys", "counts"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()], of)


def _block_grams(block: Block, hots: list[dict[int, int]], node_bits: int, limit: int) -> Grams:
    """The n-grams of the order that the number of tables of hot contexts gives."""
    grams = None
    for hot in hots:
        grams = Grams(block, grams, node_bits, hot, limit)
    return grams


def _grams(batches, shard_bits: int, hots: list[dict[int, int]], node_bits: int, limit: int):
    of = lambda block, n: ((m[0], n, *m[1:]) for m in _block_grams(block, hots, node_bits, limit).messages(shard_bits, node_bits))
    return _asked(batches, ["shard", "block", "nodes", "fan", "words", "counts", "totals"], [pa.int32(), pa.int64(), *[pa.binary()] * 5], of)


#: What a shard answers a block; its own rows are MODEL (the trie's levels, and numbers of n-grams and tokens) and HOT (contexts of the next order).
ANSWER = "block long, size int, shard int, answer binary, distinct long, total long"
MODEL, HOT = -1, -2


def _hot(keys: np.ndarray, n: np.ndarray, limit: int, order: int, shard: int) -> tuple:
    at = np.flatnonzero(n >= limit)
    return HOT, order, shard, np.stack((keys[at].view(np.int64), n[at].astype(np.int64))).tobytes(), len(at), 0


def _word_counts(pdf: pd.DataFrame, limit: int, bits: int) -> pd.DataFrame:
    """Total training counts for all questions to a shard."""
    keys, counts = [unpacked(x) for x in pdf["keys"]], [_unsmall(x) for x in pdf["counts"]]
    known, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
    each = np.split(total[place].astype(np.uint32), np.cumsum([len(k) for k in keys])[:-1])
    out = [(b, 1, s, zlib.compress(a.tobytes(), 1), 0, 0) for b, s, a in zip(pdf["block"], pdf["shard"], each)]
    shard = int(pdf["shard"].iloc[0])
    known = known + (np.uint64(shard) << np.uint64(64 - bits))
    out += [(MODEL, 1, shard, b"", int((total > 0).sum()), int(total.sum())), _hot(known, total, limit, 1, shard)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])


def _trie_answers(pdf: pd.DataFrame, order: int, k: float, span: int, limit: int, keep: bool) -> pd.DataFrame:
    """Builds a shard's trie and looks up all that was asked."""
    fans, words, counts = ([f(x) for x in pdf[c]] for c, f in (("fan", _unsmall), ("words", _wide), ("counts", _unsmall)))
    nodes = [unpacked(x) for x in pdf["nodes"]]
    known, place = np.unique(np.concatenate(nodes), return_inverse=True)
    total, first = np.full(len(known), -1), starts_of(np.array([len(n) for n in nodes]))
    for start, data in zip(first, pdf["totals"]):
        at, value = np.frombuffer(data, np.int64).reshape(2, -1)
        total[place[start + at]] = value
    keys = np.repeat(place, np.concatenate(fans)).astype(np.uint64) << np.uint64(WORD_BITS) | np.concatenate(words)
    keys, place = np.unique(keys, return_inverse=True)
    n = np.bincount(place, weights=np.concatenate(counts))
    context = (keys >> np.uint64(WORD_BITS)).astype(np.int64)
    total = np.where(total < 0, np.bincount(context, weights=n, minlength=len(known)), total)
    seen = np.flatnonzero(n)
    trie = Trie.built(known, 1 << span, context[seen], keys[seen] & WORD_MASK, np.log10(n[seen] / (total[context[seen]] + k)))
    pieces = range(0, len(keys), SEARCH)
    codes = np.concatenate([trie.codes_of(known[context[k : k + SEARCH]], keys[k : k + SEARCH] & WORD_MASK) for k in pieces] or [np.zeros(0, np.uint16)])[place]
    each = np.split(codes, np.cumsum([len(w) for w in words])[:-1])
    out = [(b, order, s, zlib.compress(a.tobytes(), 1), 0, 0) for b, s, a in zip(pdf["block"], pdf["shard"], each)]
    shard = int(pdf["shard"].iloc[0])
    own = known[context] + (np.uint64(shard) << np.uint64(span))
    out += [(MODEL, order, shard, trie.data() if keep else b"", len(seen), int(n.sum())), _hot(gram_keys(own, keys & WORD_MASK), n, limit, order, shard)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])


class Levels:
    """Arrays in a memory-mapped file without a name."""

    def __init__(self, room: int):
        self.file = tempfile.TemporaryFile()
        self.file.truncate(max(room, mmap.PAGESIZE))
        self.map, self.end = mmap.mmap(self.file.fileno(), 0), 0

    def place(self, x: np.ndarray) -> np.ndarray:
        start = -(-self.end // 8) * 8
        self.end = start + x.nbytes
        out = np.frombuffer(self.map, x.dtype, len(x), start)
        out[:] = x
        return out


class Trie:
    """A shard of the model: contexts, pointers to the words after each, and those words with their quantised values."""

    def __init__(self, arrays: list[np.ndarray]):
        """``arrays``: what ``data`` has, apart. Ranks, two numbers per 64 high bits, are added to the levels."""
        levels = Levels(sum(3 * x.nbytes + 64 for x in arrays))
        self.contexts, self.pointers, self.words = (EliasFano.of_arrays(*arrays[3 * k : 3 * k + 3], levels.place) for k in range(3))
        self.codes = levels.place(arrays[9])

    @classmethod
    def built(cls, contexts: np.ndarray, universe: int, context: np.ndarray, word: np.ndarray, log10: np.ndarray) -> Trie:
        """``context`` (places in ``contexts``) and ``word`` in order."""
        width = 1 << WORD_BITS
        starts = np.searchsorted(context, np.arange(len(contexts) + 1))
        parts = (contexts, universe), (starts, len(word) + 1), (context.astype(np.uint64) * np.uint64(width) + word.astype(np.uint64), len(contexts) * width)
        codes = np.clip((log10 / -LOWEST + 1) * CODES, 0, CODES - 1).astype(np.uint16)
        return cls([x for values, top in parts for x in EliasFano(values, top).arrays()] + [codes])

    def data(self) -> bytes:
        return joined([x for s in (self.contexts, self.pointers, self.words) for x in s.arrays()] + [self.codes])

    def codes_of(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The code of each n-gram, by successor searches; n-grams of one context follow one another."""
        first = np.flatnonzero(np.diff(contexts.astype(np.int64), prepend=-1) != 0)
        each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(contexts))))
        n = self.contexts.n
        at, known = self.contexts.successor(contexts[first], np.zeros(len(first), np.int64), np.full(len(first), n))
        at = np.minimum(at, max(n - 1, 0))
        start, stop = (np.where(known, self.pointers.access(at + k).astype(np.int64), 0)[each] for k in (0, 1))
        place, found = self.words.successor(at[each].astype(np.uint64) << np.uint64(WORD_BITS) | words.astype(np.uint64), start, stop)
        out = np.full(len(contexts), ABSENT, np.uint16)
        out[found] = self.codes[place[found]]
        return out


def _scores(asked: pd.DataFrame, answers: pd.DataFrame, total: int, distinct: int, n_train: int, ks: tuple[float, ...], hots: list[dict[int, int]], node_bits: int, limit: int) -> pd.DataFrame:
    out = []
    for row in asked.to_dict("records"):
        block, answers, grams = Block(row), answers.sort_values("shard"), None
        parts = lambda order: list(answers.loc[answers["size"] == order, "answer"])
        # The end is a token with one count per training document; the begin is a context with as many.
        counts = np.append(block.words().answered(parts(1)), [0, n_train])
        p = (counts + 0.5) / (total + 0.5 * (distinct + 1))
        base, p = np.log10(p)[block.codes], p[block.codes]
        before = np.append(counts[:-2], [n_train, 0])[np.insert(block.codes, 0, block.k)[:-1]]
        before[block.starts] = n_train
        for order, (k, hot) in enumerate(zip(ks, hots), 2):
            grams = Grams(block, grams, node_bits, hot, limit)
            value = grams.answered(parts(order))
            p = value + k / (before + k) * p
            # A context's count is that of its n-gram a place earlier, as the lower order's trie has it.
            count = np.rint(value * (before + k))
            before = np.insert(count, 0, 0)[:-1]
            before[block.starts] = n_train
        sums = lambda x: np.bincount(block.doc, weights=x, minlength=len(block.lens))
        none = block.doc_id == np.iinfo(np.int64).min
        out.append(pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(block.doc_id.copy(), none), KEY[0]: block.file, KEY[1]: block.row, "held_out": block.held, "n_tokens": block.lens + 1,
            "n_known": sums(counts[block.codes] > 0).astype(np.int64), "train_tokens": total, "base_score": sums(base), "score": sums(np.log10(p)),
        }))
    return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in SCORES.split(", ")})


SCORES = f"doc_id long, {KEY[0]} long, {KEY[1]} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Weights of the lower order, from order two on; their number sets the order.
WEIGHTS = (3000.0, 30.0)


def _hot_contexts(answers: DataFrame, n_train: int, limit: int) -> dict[int, int]:
    """At most a million contexts with their counts."""
    out = {BEGIN_HASH: n_train} if n_train >= limit else {}
    for r in answers.where(f"block = {HOT} and distinct > 0").select("answer").toLocalIterator():
        keys, n = np.frombuffer(r["answer"], np.int64).reshape(2, -1)
        out |= zip(keys.view(np.uint64).tolist(), n.tolist())
    return out


def score(docs: DataFrame, held_out, *, ks: tuple[float, ...] = WEIGHTS, block_tokens: int = 2_000_000, shard_tokens: int = 1_000_000, hot: int = 2_000_000, keep: bool = False) -> DataFrame:
    """One row per document, with its row key. ``held_out``: a condition on doc_id; the other documents are learnt from. With ``keep``
    the levels of all shards, about 1.5 times the text, stay in the shared folder."""
    rows = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *KEY)
    rows = rows.withColumn("held", F.coalesce(held_out, F.lit(False)))
    blocks = stash(rows.mapInArrow(partial(_blocks, block_tokens=block_tokens), BLOCK), compression="zstd")
    n_tokens, n_train = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    shard_bits = max(6, (n_tokens // shard_tokens).bit_length())
    node_bits = NODE_BITS
    limit = max(hot, n_tokens // 1_000_000)  # so that at most a million contexts are hot

    asked = blocks.mapInArrow(partial(_words, bits=shard_bits), "shard int, block long, keys binary, counts binary")
    answers = stash(asked.groupBy("shard").applyInPandas(partial(_word_counts, limit=limit, bits=shard_bits), ANSWER), compression="zstd")
    del asked
    distinct, total = answers.where(f"block = {MODEL}").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    distinct, total = (distinct + (n_train > 0), total + n_train) if total + n_train else (0, 0)
    hots, last = [], answers
    for order, k in enumerate(ks, 2):
        hots.append(_hot_contexts(last, n_train, limit))
        asked = blocks.mapInArrow(partial(_grams, shard_bits=shard_bits, hots=list(hots), node_bits=node_bits, limit=limit), "shard int, block long, nodes binary, fan binary, words binary, counts binary, totals binary")
        last = stash(asked.groupBy("shard").applyInPandas(partial(_trie_answers, order=order, k=k, span=node_bits - shard_bits, limit=limit, keep=keep), ANSWER), compression="zstd")
        answers = answers.union(last)
        del asked
        release(docs.sparkSession)
    options = {"total": total, "distinct": distinct, "n_train": n_train, "ks": tuple(ks), "hots": hots, "node_bits": node_bits, "limit": limit}

    def scored(asked: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        return _scores(asked, answered, **options)

    return blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInPandas(scored, SCORES)
