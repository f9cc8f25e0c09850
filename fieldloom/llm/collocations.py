"""Phrases whose words occur together more often than apart, from Misra-Gries summaries and an exact second pass.

Per language, the phrases of 2 to 5 words with ``least`` occurrences or more are found in two passes. First pass: blocks of
documents send their n-grams, hashed and with counts, to shards of the key space; a shard merges them into one Misra-Gries
summary of more counters than its mass divided by ``least``, in fact eight times as many. What a summary has taken off a counter
stays below an eighth of ``least``, and a key whose counter and that sum together fall short of ``least`` can't be frequent; every
other key survives and is told to the blocks as one bit. This is done for the words, and then for the n-grams of surviving words only, as a frequent phrase has
frequent words. Second pass: blocks count the surviving words and n-grams by their words, as lists that are dealt by hash, and
added up by the phrases themselves. Hash collisions only add survivors.

Cuts, covering and ranking are joins and grouped aggregates of frequent phrases. A language of any size spreads over all tasks.

Rules: a null text is empty; a null language is ``und``; words are runs without 0x20 and 0x09 within pieces; repeated rows
count; a null or repeated doc_id changes nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import discard, mix64, release, stash, tokens
from .shards import ask, blocks, counted, each_row, flags, key_bits, narrow, packed_codes, packed_words, pieces, ranked, record_batch, unnarrow, unpacked_codes, unpacked_words

#: What ends a piece.
BREAKS = r"[.,;:!?\x0A-\x0D]+"
#: Keys for each occurrence, and bits of the number of keys in a shard.
PER_KEY, SPAN = 16, 28
#: Occurrences for each shard of the exact counts, of which at most one in ``least`` is a phrase that the shard holds, and least number of shards.
SHARE, SHARDS = 1 << 25, 32
#: Counters of a summary, in units of mass / threshold; what is taken off a counter stays below threshold / ROOM, so few others survive.
ROOM = 8
FACTOR = np.uint64(0xD6E8FEB86659FD93)
BLOCK = "block long, n long, codes binary, terms binary"
LISTS = "part int, block long, texts binary, counts binary"
FREQUENT = "lang string, phrase string, size int, f long"
#: Exact products: 10^38 is beyond a thousand times the square of 10^17 words.
WIDE = "decimal(38,0)"


def _block(b: pa.RecordBatch) -> tuple:
    """Codes of (language, word), from 1 up; 0 ends a piece."""
    codes, lens, words = tokens(pc.replace_substring_regex(pc.fill_null(b.column("text"), ""), BREAKS, " . "))
    langs = pc.fill_null(b.column("lang"), "und").dictionary_encode()
    words, names = words.cast(pa.binary()).to_pylist(), langs.dictionary.cast(pa.binary()).to_pylist()
    stop = words.index(b".") if b"." in words else -1
    lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), lens)
    pairs, place = np.unique(lang * max(len(words), 1) + codes, return_inverse=True)
    of, word = np.divmod(pairs, max(len(words), 1))
    real = word != stop
    place, order = ranked(place, len(pairs))
    of, word, real = of[order], word[order], real[order]
    code = np.where(real, np.cumsum(real), 0)[place]
    code = np.insert(code, np.cumsum(lens), 0)  # a document's end
    terms = [names[a] + b"\t" + words[w] for a, w in zip(of[real].tolist(), word[real].tolist())]
    return int((code > 0).sum()), packed_codes(code), packed_words(terms)


def _opened(row: dict) -> tuple[np.ndarray, list[bytes]]:
    return unpacked_codes(row["codes"]).astype(np.int64), unpacked_words(row["terms"])


def _term_hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, 1) for t in terms), np.uint64, len(terms))


def _term_keys(terms: list[bytes], codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of the words, the place of each word among them, and the keys' counts."""
    n = np.bincount(codes, minlength=len(terms) + 1)[1:]
    keys, place = np.unique(_term_hashes(terms) >> np.uint64(64 - bits), return_inverse=True)
    return keys, place, np.bincount(place, weights=n, minlength=len(keys)).astype(np.int64)


def _words(row: dict, bits: int):
    codes, terms = _opened(row)
    keys, _, n = _term_keys(terms, codes, bits)
    return pieces(keys, n, bits, SPAN)


def ngrams(codes: np.ndarray, hashes: np.ndarray, longest: int, bits: int):
    """(size, places of the first words, keys) of the n-grams of two words or more inside the pieces."""
    h = np.append(np.uint64(0), hashes)[codes]
    acc, real = h.copy(), codes > 0
    for size in range(2, longest + 1):
        m = len(codes) - size + 1
        if m <= 0:
            return
        acc = acc[:m] * FACTOR + h[size - 1 :]
        real = real[:m] & (codes[size - 1 :] > 0)
        at = np.flatnonzero(real)
        yield size, at, mix64(acc[at] + np.uint64(size)) >> np.uint64(64 - bits)


def _phrases(row: dict, bits: int, longest: int):
    codes, terms = _opened(row)
    keys = [k for _, _, k in ngrams(codes, _term_hashes(terms), longest, bits)]
    keys, _, n = counted(np.concatenate(keys)) if keys else counted(np.zeros(0, np.uint64))
    return pieces(keys, n, bits, SPAN)


def merged(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A summary of ``capacity`` counters at most, in the order of the keys, and what was taken off each counter for it."""
    keys, place = np.unique(keys, return_inverse=True)
    counts = np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64)
    if len(keys) <= capacity:
        return keys, counts, 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > off
    return keys[left], counts[left] - off, off


def _survive(read, least: int):
    """Which keys may occur ``least`` times or more, by a summary that takes the blocks' counts in groups."""
    mass = sum(int(n.sum(dtype=np.int64)) for _, n in read())
    capacity = ROOM * (mass // least + 1)
    keys, counts, off, held, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, [], 0
    for k, n in read():
        held.append((k, n))
        waiting += len(k)
        if waiting > max(2 * capacity, 1 << 19):
            keys, counts, more = merged(np.concatenate([keys, *(x for x, _ in held)]), np.concatenate([counts, *(x for _, x in held)]), capacity)
            off, held, waiting = off + more, [], 0
    if held:
        keys, counts, more = merged(np.concatenate([keys, *(x for x, _ in held)]), np.concatenate([counts, *(x for _, x in held)]), capacity)
        off += more
    keys = keys[counts + off >= least]
    return (np.isin(k, keys, assume_unique=True) for k, _ in read())


def _pruned(left: pa.Table, right: pa.Table, bits: int, longest: int) -> pa.Table:
    """Blocks with the surviving words only, the others end pieces; n is the number of n-grams of two words or more."""
    rows = []
    for row in each_row(left):
        codes, terms = _opened(row)
        keys, place, _ = _term_keys(terms, codes, bits)
        stay = flags(right, keys, SPAN)[place] if len(keys) else np.zeros(0, bool)
        codes = np.append(0, np.where(stay, np.cumsum(stay), 0))[codes]
        codes = codes[(codes > 0) | (np.append(1, codes[:-1]) > 0)]  # one break between pieces
        runs = np.diff(np.flatnonzero(np.concatenate(([True], codes == 0, [True])))) - 1
        mass = sum(int(np.maximum(runs - k, 0).sum()) for k in range(1, longest))
        rows.append((row["block"], mass, packed_codes(codes), packed_words([t for t, s in zip(terms, stay.tolist()) if s])))
    return pa.Table.from_batches([record_batch(rows, BLOCK)])


def _counts(left: pa.Table, right: pa.Table, bits: int, longest: int, shards: int) -> pa.Table:
    """Exact numbers, in a block, of surviving words and n-grams, as one list for each shard of their hashes."""
    rows = []
    for row in each_row(left):
        codes, terms = _opened(row)
        if not terms:
            continue
        hashes, words = _term_hashes(terms), [t.rsplit(b"\t", 1)[1] for t in terms]
        found, sums, n = [terms], [hashes], [np.bincount(codes, minlength=len(terms) + 1)[1:]]
        grams = list(ngrams(codes, hashes, longest, bits))
        keys, place, _ = counted(np.concatenate([k for *_, k in grams])) if grams else counted(np.zeros(0, np.uint64))
        stay = flags(right, keys, SPAN)[place]
        for size, at, k in grams:
            own, stay = stay[: len(k)], stay[len(k) :]
            at, k = at[own], k[own]
            if not len(at):
                continue
            ids = codes[at]
            for j in range(1, size):  # numbers of the distinct sequences so far, exact
                _, ids = np.unique(ids * (len(terms) + 1) + codes[at + j], return_inverse=True)
            _, first, count = np.unique(ids, return_index=True, return_counts=True)
            places = codes[at[first][:, None] + np.arange(size)] - 1
            found.append([terms[x[0]] + b" " + b" ".join([words[p] for p in x[1:]]) for x in places.tolist()])
            sums.append(k[first] << np.uint64(64 - bits))
            n.append(count)
        texts, part, n = np.array([*(t for f in found for t in f), None], object)[:-1], (mix64(np.concatenate(sums)) % np.uint64(shards)).astype(np.int64), np.concatenate(n)
        order = np.argsort(part, kind="stable")
        for p, own in zip(range(shards), np.split(order, np.searchsorted(part[order], np.arange(1, shards)))):
            if len(own):
                own = own[np.argsort(texts[own], kind="stable")]  # alike phrases side by side
                rows.append((p, row["block"], packed_words(texts[own].tolist()), narrow(n[own])))
    return pa.Table.from_batches([record_batch(rows, LISTS)])


def _summed(table: pa.Table, least: int) -> pa.Table:
    """Adds up a shard's lists, one block's at a time, and keeps what is frequent."""
    total = held = None
    for row in each_row(table):
        own = pa.table({"text": pa.array(unpacked_words(row["texts"]), pa.binary()), "n": pa.array(unnarrow(row["counts"]).astype(np.int64))})
        held = own if held is None else pa.concat_tables([held, own])
        if held.num_rows > 1 << 20:
            total = _added(total, held)
            held = None
    total = _added(total, held) if held is not None else total
    total = total.filter(pc.greater_equal(total.column("n"), least))
    text = total.column("text").to_pylist()
    langs, phrases = zip(*(t.rsplit(b"\t", 1) for t in text)) if text else ((), ())
    string = lambda x: pa.array(x, pa.binary()).cast(pa.string())
    return pa.table([string(langs), string(phrases), pa.array([p.count(b" ") + 1 for p in phrases], pa.int32()), total.column("n")], names=["lang", "phrase", "size", "f"])


def _added(total: pa.Table | None, more: pa.Table) -> pa.Table:
    both = more if total is None else pa.concat_tables([total, more])
    return both.group_by("text").aggregate([("n", "sum")]).rename_columns(["text", "n"])


def _lang_words(batches):
    for b in batches:
        for row in each_row(b):
            codes, terms = _opened(row)
            n, totals = np.bincount(codes, minlength=len(terms) + 1)[1:], {}
            for t, k in zip(terms, n.tolist()):
                lang = t.rsplit(b"\t", 1)[0]
                totals[lang] = totals.get(lang, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in totals], pa.string()), pa.array(list(totals.values()), pa.int64())], names=["lang", "n"])


def frequent(docs: DataFrame, *, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of every word and phrase of up to ``longest`` words with ``least`` occurrences or more, and (lang, n), the
    words of each language."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = blocks(rows, _block, BLOCK, max_bytes=6 << 20)
    totals = stash(held.mapInArrow(_lang_words, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")))
    n = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    word_bits = key_bits(n, PER_KEY)
    words = ask(held, partial(_words, bits=word_bits), partial(_survive, least=least))

    def pruned(left: pa.Table, right: pa.Table) -> pa.Table:
        return _pruned(left, right, word_bits, longest)

    runs = stash(held.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(pruned, BLOCK), compression="zstd")
    discard(held)
    discard(words)
    n = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = key_bits(n, PER_KEY)
    release(docs.sparkSession)
    phrases = ask(runs, partial(_phrases, bits=bits, longest=longest), partial(_survive, least=least))
    release(docs.sparkSession)

    def counts(left: pa.Table, right: pa.Table) -> pa.Table:
        return _counts(left, right, bits, longest, max(SHARDS, n // SHARE))

    def summed(table: pa.Table) -> pa.Table:
        return _summed(table, least)

    found = runs.groupBy("block").cogroup(phrases.groupBy("block")).applyInArrow(counts, LISTS)
    known = stash(found.groupBy("part").applyInArrow(summed, FREQUENT))
    discard(runs)
    discard(phrases)
    return known, totals


def collocations(docs: DataFrame, *, least: int = 100, longest: int = 5, top: int = 2000, cover: int = 100, salts: int = 64) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score. A phrase goes if a longer candidate that has its
    words in a row occurs at least ``cover`` per cent as often."""
    known, totals = frequent(docs, least=least, longest=longest)
    parts = known.select("lang", "phrase", "f")
    split, wide = F.split("phrase", " "), lambda c: F.col(c).cast(WIDE)
    candidates = known.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", split.alias("w"))

    longer = candidates.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    longer = longer.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    covers = longer.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = candidates.join(covers, ["lang", "phrase"], "left").where((F.col("most").isNull()) | (100 * F.col("most") < cover * F.col("a")))

    cuts = left.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ").alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(totals, "lang").withColumn("up", wide("a") * wide("n")).withColumn("down", wide("l") * wide("r"))
    scored = cuts.withColumn("score", F.expr("cast(up * 1000 as decimal(38,0)) div cast(down as decimal(38,0))"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The first of each part of a language, by hash, hold the first of all.
    some = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(W.Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(W.Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
