"""Hard negatives, collocations and substring removal against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import collocations, hard_negatives, shards, substring_dedup


def test_words_and_numbers_come_back():
    for words in ([], [b""], [b"a", b"", b"\n\t", b"x" * 70000]):
        assert shards.unpacked_words(shards.packed_words(words)) == words
    for top in (0, 255, 256, 1 << 40, (1 << 64) - 1):
        x = np.array([0, top], np.uint64)
        assert shards.unnarrow(shards.narrow(x)).tolist() == x.tolist()


# Hard negatives


def brute_negatives(rows, every=3, scale=256, positives=2, negatives=3, low=30, high=90):
    """``rows``: (id, vector, label)."""
    real = [(i, [math.floor(Fraction(x) * scale) for x in v], y) for i, v, y in rows if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    first = lambda found, k: sorted(found, key=lambda f: (-f[1], f[0] is None, f[0] or 0))[:k]
    out = []
    for n, (i, v, y) in enumerate(real):
        if i is None or i % every:
            continue
        scores = [(j, dot(v, w), z == y) for m, (j, w, z) in enumerate(real) if m != n]
        for p, s in first([(j, s) for j, s, own in scores if own], positives):
            inside = [(j, t) for j, t, own in scores if not own and low * s <= 100 * t <= high * s]
            out += [(i, p, r, j, s, t) for r, (j, t) in enumerate(first(inside, negatives), 1)]
    return Counter(out)


def vectors(seed, n, width=5, values=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(values)) if values else (lambda: rng.uniform(-1, 1))
    return [(i, [draw() for _ in range(width)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("tile_rows, chunk_rows", [(1000, 1000), (7, 4)])
@pytest.mark.parametrize("kind", ["plain", "ties", "odd"])
def test_hard_negatives(spark, kind, tile_rows, chunk_rows):
    rows = vectors(1, 60) if kind == "plain" else vectors(2, 60, values=[0.0, 0.25, -0.5, 1.0])
    if kind == "odd":
        rows += [(3, None, 1), (6, [0.1, None, 0.2], 0), (9, [math.nan] * 5, 1), (12, [math.inf] * 5, 1), (15, [0.5] * 5, None), (None, [0.9, 0.4, 0.1, 0.2, 0.3], 1), (18, [0.5], 1), (21, [], 0), (24, [0.0] * 5, 2), rows[0], rows[0], (0, [0.5] * 5, 1)]
    df = spark.createDataFrame([(*r, 7, "t") for r in rows], "vec_id long, embedding array<double>, label int, id long, tile string")
    got = hard_negatives.mine(df, F.col("id") % 3 == 0, positives=2, negatives=3, tile_rows=tile_rows, chunk_rows=chunk_rows)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows)


def test_hard_negatives_beyond_doubles(spark):
    rows = [(i, [x * 1e6 for x in v], y) for i, v, y in vectors(3, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert Counter(map(tuple, hard_negatives.mine(df, F.col("id") % 3 == 0, positives=2, negatives=3, tile_rows=9).collect())) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(df, F.col("id") % 3 == 0).collect() == []
    df = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(df, F.col("id") % 3 == 0).collect() == []


def test_threshold_stops_early():
    """A clear winner on each list ends the reading before all rows are scored."""
    x = np.random.default_rng(1).integers(-5, 5, (20_000, 4)).astype(np.float64)
    x[77] = 1000
    tile = hard_negatives.Lists(x, np.arange(len(x)))
    scored = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            scored.append(len(at))
            return np.asarray(self)[at]

    tile.x = x.view(Watched)
    (found,) = tile.first(np.ones(4), np.ones(len(x), bool), [hard_negatives.ALL], 1)
    assert found[0].tolist() == [77] and found[1].tolist() == [4000] and sum(scored) < 1000


# Collocations


def brute_collocations(texts, least, top, longest=5):
    """``texts``: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        known = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        covered = {g[i : i + m] for g, a in known.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if 100 * a >= 100 * own[g[i : i + m]]}
        rows = []
        for g, a in known.items():
            if g not in covered:
                score, _, l, r = min((1000 * a * n[lang] // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, k, g.decode(), -a, l, r, n[lang], -s) for k, (s, a, g, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def phrase_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["É", "x\x1cy", "\x85", "(a)", "'s"]
    text = lambda: "".join(rng.choice(words[: rng.choice((3, 35))]).swapcase() + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \r\x0b"]) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "de", None, "und", "a\tb\nc"]), text()) for _ in range(n)] + [("en", None), (None, ""), ("en", " . ,\t"), ("fr", "one"), ("en", "w0 w1 w2 " * 3000)]


@pytest.mark.parametrize("least, top", [(3, 2000), (9, 4)])
def test_collocations(spark, least, top, monkeypatch):
    monkeypatch.setattr(collocations, "SPAN", 10)  # several shards
    texts = phrase_texts(5, 150)
    df = spark.createDataFrame([(k % 7, t, x, k, "p") for k, (x, t) in enumerate(texts)], "doc_id long, text string, lang string, n long, phrase string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, least=least, top=top, salts=3).collect()))
    assert got == brute_collocations(texts, least, top) and len(got) > 10


def test_collocations_of_nothing(spark, nothing):
    assert collocations.collocations(nothing).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_every_frequent_key_survives(seed):
    rng = np.random.default_rng(seed)
    least, blocks, total = 20, [], Counter()
    for _ in range(40):
        keys = np.unique(np.where(rng.random(3000) < 0.3, rng.integers(0, 40, 3000), rng.integers(0, 1 << 30, 3000)).astype(np.uint64))
        n = rng.integers(1, 4, len(keys))
        total.update(dict(zip(keys.tolist(), n.tolist())))
        blocks.append((keys, n))
    flags = list(collocations._survive(lambda: iter(blocks), least))
    said = {k for (keys, _), yes in zip(blocks, flags) for k in keys[yes].tolist()}
    must = {k for k, n in total.items() if n >= least}
    assert must <= said and len(said) < 3 * len(must)
    mass, capacity = sum(total.values()), 50
    keys, counts, off = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for k, n in blocks:
        keys, counts, more = collocations.merged(np.concatenate([keys, k]), np.concatenate([counts, n]), capacity)
        off += more
    assert len(keys) <= capacity and off * (capacity + 1) <= mass
    assert all(total[k] - off <= c <= total[k] for k, c in zip(keys.tolist(), counts.tolist()))


# Substrings


def brute_kept(rows, width):
    """``rows``: (doc_id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = defaultdict(list)
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - width + 1):
            if i is not None:
                ids[tuple(w[k : k + width])].append(i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - width + 1):
            found = ids.get(tuple(w[k : k + width]))
            if found and (i is None or min(found) < i):
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("width, shard_windows", [(13, 1 << 21), (3, 1 << 21), (3, 100), (1, 1000)])
def test_substrings(spark, docs, width, shard_windows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SPAN", 12)  # several shards of the sketch
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = substring_dedup.without_repeats(docs, width=width, shard_windows=shard_windows).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter(map(tuple, got)) == brute_kept(rows, width)


def test_substrings_of_nothing(nothing):
    assert substring_dedup.without_repeats(nothing).collect() == []


def test_sketch_never_counts_too_low():
    rng = np.random.default_rng(2)
    blocks = []
    for _ in range(30):
        keys, n = np.unique(rng.integers(0, 1 << 12, 500).astype(np.uint64), return_counts=True)
        blocks.append((keys, n * 20))
    total = Counter()
    for keys, n in blocks:
        total.update(dict(zip(keys.tolist(), n.tolist())))
    for (keys, _), yes in zip(blocks, substring_dedup._merged(lambda: iter(blocks), 12)):
        assert yes.tolist() == [total[k] > 1 for k in keys.tolist()]
