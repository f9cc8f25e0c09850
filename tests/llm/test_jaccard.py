"""The near-duplicate stage of the pipeline against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from fieldloom.llm import jaccard
from fieldloom.llm.common import rooted, stash

from .test_scores import fingerprint

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def survivors(rows, share=0.8):
    """Ids that stay of (doc_id, text), by all pairs."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= share:
                label = [label[j] if x == label[i] else x for x in label]
    best = {}
    for x, (i, _) in zip(label, rows):
        best[x] = min(best.get(x, i), i)
    return sorted(best.values())


def edited(rng, words, times):
    out = list(words)
    for k in rng.sample(range(len(out)), times):
        out[k] = f"n{rng.random()}"
    return out


def kept(spark, rows):
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    return sorted(r["doc_id"] for r in out.collect())


def test_all_similar_texts_go(spark):
    """Near copies of all similarities, most of which differ by more than 7 bits of their fingerprints."""
    rng, rows = random.Random(5), []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 400))]
        rows += [" ".join(words), " ".join(edited(rng, words, max(1, len(words) // rng.randint(50, 90))))]
    rows = list(enumerate(rows))
    near = [(a, b) for (_, a), (_, b) in zip(rows[::2], rows[1::2]) if similarity(shingles(a), shingles(b)) >= 0.8]
    assert sum((fingerprint(a, 5) ^ fingerprint(b, 5)).bit_count() > 7 for a, b in near) > 5
    want = survivors(rows)
    assert len(rows) - len(want) >= len(near) > 20 and kept(spark, rows) == want


def test_stage_on_the_smallest_table(spark):
    docs = corpus_pipeline.exact_duplicates(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = survivors(rows)
    assert len(want) < len(rows) and sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()) == want


@pytest.mark.parametrize("weight", [1, 500, 1 << 18])
def test_clusters_in_parts(spark, monkeypatch, weight):
    """One group of chained copies, one shared passage, equal sets, empty and null texts."""
    monkeypatch.setattr(jaccard, "WEIGHT", weight)
    rng = random.Random(weight)
    words = [f"w{k}" for k in range(120)]
    rows, chain = [], words
    for _ in range(25):
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 2)
    rows += [" ".join(words[:60] + [f"x{rng.random()}" for _ in range(n)]) for n in range(0, 60, 4)]
    rows += [rows[3].upper(), "", " ", None, "one two", "One  two", "one two three"]
    rows = list(enumerate(rows))
    assert kept(spark, rows) == survivors(rows)


def test_keys_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(2)
    common, own = rng.integers(0, 1 << 63, 80, np.uint64), rng.integers(0, 1 << 63, (400, 20), np.uint64)
    sets = [np.concatenate((common, *own[k : k + 1])) for k in range(400)]
    keys = jaccard.band_keys(np.concatenate(sets), np.full(400, 100))
    agree = (keys[::2] == keys[1::2]).mean()
    assert agree == pytest.approx((80 / 120) ** 3, abs=0.04) and (keys[::2] == keys[1::2]).any(1).all()


def test_near_fingerprints_alone_do_not_link(spark):
    """Unrelated short texts whose fingerprints come within 7 bits, and copies below the similarity, all stay."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) for _ in range(3000)]
    prints = np.array([fingerprint(t, 5) for t in texts], np.uint64)
    close = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 7, 1))
    rows = [texts[k] for pair in close[:8] for k in pair]
    below = 0
    for _ in range(150):
        words = [f"w{rng.randrange(3000)}" for _ in range(100)]
        other = edited(rng, words, 3)
        a, b = " ".join(words), " ".join(other)
        if similarity(shingles(a), shingles(b)) < 0.8 and (fingerprint(a, 5) ^ fingerprint(b, 5)).bit_count() <= 7:
            rows += [a, b]
            below += 1
    assert len(close) >= 2 and below >= 2
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(rows))]
    assert kept(spark, rows) == survivors(rows) == [i for i, _ in rows]


def test_fingerprints_give_links_of_their_own(spark):
    """Without a min-hash key in common, near copies within three bits link, and texts of one fingerprint with other sets don't."""
    rng, pairs = random.Random(4), []
    while len(pairs) < 12:
        words = [f"w{rng.randrange(10**6)}" for _ in range(800)]
        a, b = " ".join(words), " ".join(edited(rng, words, 1))
        if (fingerprint(a, 5) ^ fingerprint(b, 5)).bit_count() <= 3:
            pairs.append((a, b))
    filled = ["w " * 100 + " ".join(f"x{rng.random()}" for _ in range(9)) for _ in range(2)]
    assert fingerprint(filled[0], 5) == fingerprint(filled[1], 5) and similarity(*map(shingles, filled)) < 0.8
    rows = [(i, t) for i, t in enumerate([t for p in pairs for t in p] + filled)]
    docs = rooted(spark.createDataFrame(rows, "doc_id long, text string"))
    sketches = jaccard.sketched(docs, 5).withColumn("keys", jaccard.F.expr("transform(keys, (k, i) -> xxhash64(doc_id, i))"))
    sketches = stash(sketches)
    sets = {r["set"]: r["doc_id"] for r in sketches.collect()}
    got = {frozenset((sets[r["a"]], sets[r["b"]])) for r in jaccard.links(docs, sketches, 5, 0.8).where("a is not null").collect()}
    assert got == {frozenset((2 * k, 2 * k + 1)) for k in range(12)}
