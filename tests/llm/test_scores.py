"""Fingerprints, language model, rules and classifiers against brute force and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import ngram_lm, quality_classifier, quality_rules, simhash, toxicity
from fieldloom.llm.components import components
from fieldloom.llm.elias_fano import EliasFano, packed, parted, unpacked


def fingerprint(text, width):
    w = text.encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + width]), 42) for k in range(len(w) - width + 1)] or ([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [])
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def reach(prints, radius):
    f = np.array(prints, np.uint64)
    near, label = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius, np.arange(len(f))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(f))])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("width,tile", [(3, 4096), (3, 4), (5, 16)])
def test_near_groups(docs, rows, width, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    got = simhash.near_groups(docs, width=width).collect()
    prints = [fingerprint(t, width) for _, t, _ in rows]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{p:016x}") for (i, _, _), p in zip(rows, prints))
    label, low = reach(prints, 3), defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        low[label[k]].append(i)
    best = {c: min((i for i in ids if i is not None), default=None) for c, ids in low.items()}
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((i, best[label[k]]) for k, (i, _, _) in enumerate(rows))


def tile_links(spark, prints, radius=3):
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long").distinct()
    return {r["node"]: r["root"] for r in components(simhash.links(df, radius)).collect()}


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_links_of_dense_and_chained_prints(spark, radius):
    rng = random.Random(radius)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            for _ in range(rng.randint(1, radius + 1)):
                p ^= 1 << rng.randint(0, 63)
    prints = [*prints, 0, 1, (1 << 64) - 1]
    got, label = tile_links(spark, prints, radius), reach(prints, radius)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    mine = {frozenset(s for s in signed if got.get(s, s) == r) for r in {got.get(s, s) for s in signed}}
    assert mine == {frozenset(s for s, x in zip(signed, label) if x == c) for c in set(label)}


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(((F.col("id") * 7919) % 301).alias("a"), (((F.col("id") + 1) * 7919) % 301).alias("b"))
    assert {r["root"] for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_simhash_deduplicate(docs):
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == simhash.near_groups(docs).select("component_id").distinct().count()


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano(seed):
    rng = np.random.default_rng(seed)
    universe = int(rng.choice([1, 10, 1000, 10**9, 10**13]))
    x = np.sort(rng.integers(0, universe, int(rng.integers(0, 500))))
    ef = EliasFano(x, universe)
    if len(x):
        assert ef.access(np.arange(len(x))).tolist() == x.tolist()
    assert unpacked(packed(x, universe)).tolist() == x.tolist()
    q = np.concatenate((x, rng.integers(0, universe, 200)))
    lo = rng.integers(0, len(x) + 1, len(q))
    hi = np.maximum(lo, rng.integers(0, len(x) + 1, len(q)))
    at, found = ef.successor(q, lo, hi)
    for k in range(len(q)):
        want = next((i for i in range(lo[k], hi[k]) if x[i] >= q[k]), hi[k])
        assert found[k] == (want < hi[k] and x[want] == q[k])
        if found[k]:
            assert x[at[k]] == q[k]


def brute_scores(rows, ks):
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in rows]
    toks = [[*t.encode().lower().split(), "end"] for _, t, _ in rows]
    pad = ["begin"] * len(ks)
    counts, contexts = Counter(), Counter()
    for h, w in zip(held, toks):
        w = [*pad, *w]
        for n in range(len(ks) + 1) if not h else ():
            counts.update(tuple(w[i - n : i + 1]) for i in range(len(pad), len(w)))
            contexts.update((n, *w[i - n : i]) for i in range(len(pad), len(w)))
    uni = {g[0]: c for g, c in counts.items() if len(g) == 1}
    n, v = sum(uni.values()), len(uni)
    p = lambda w: (uni.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))

    def smooth(g):
        return p(g[0]) if len(g) == 1 else (counts[g] + ks[len(g) - 2] * smooth(g[1:])) / (contexts[(len(g) - 1, *g[:-1])] + ks[len(g) - 2])

    for (i, _, _), h, w in zip(rows, held, toks):
        full = [*pad, *w]
        yield i, h, len(w), sum(x in uni for x in w), n, sum(math.log10(p(x)) for x in w), sum(math.log10(smooth(tuple(full[j : j + len(ks) + 1]))) for j in range(len(w)))


@pytest.mark.parametrize("block,hot,ks", [(4_000_000, 2_000_000, (1000.0, 20.0)), (500, 40, (1000.0, 20.0)), (500, 3, (10.0, 2.0, 1.0))])
def test_language_model(docs, rows, block, hot, ks):
    out = ngram_lm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, ks=ks, block_tokens=block, shard_tokens=100, hot=hot)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 3))
    got = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out.collect()], key=key)
    for a, b in zip(got, sorted(brute_scores(rows, ks), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)
        assert abs(a[6] - b[6]) <= 0.003 * b[2]


def test_trie_answers_what_it_was_built_from():
    rng = np.random.default_rng(4)
    contexts = np.unique(rng.integers(0, 1 << 40, 500).astype(np.uint64))
    keys = np.unique(rng.integers(0, len(contexts), 3000).astype(np.uint64) << np.uint64(ngram_lm.WORD_BITS) | rng.integers(0, 1 << ngram_lm.WORD_BITS, 3000).astype(np.uint64))
    context, word, value = (keys >> np.uint64(ngram_lm.WORD_BITS)).astype(np.int64), keys & ngram_lm.WORD_MASK, -rng.random(len(keys)) * 9
    trie = ngram_lm.Trie.built(contexts, 1 << 40, context, word, value)
    again = ngram_lm.Trie(parted(trie.data()))
    for t in (trie, again):
        codes = t.codes_of(contexts[context], word)
        assert np.abs(ngram_lm.LOWEST * (1 - (codes + 0.5) / ngram_lm.CODES) - value).max() < 0.002
        lost = t.codes_of(contexts[context] + np.uint64(1), word)
        assert (lost == ngram_lm.ABSENT).mean() > 0.99


def test_language_model_learns_context(spark):
    rng = random.Random(1)
    text = lambda: " ".join(f"a{k} b{k}" for k in (rng.randint(0, 30) for _ in range(60)))
    df = spark.createDataFrame([(k, text()) for k in range(200)], "doc_id long, text string")
    out = ngram_lm.score(df, F.col("doc_id") % 5 == 0, ks=(10.0, 10.0)).where("held_out")
    assert out.where("score <= base_score").count() == 0


def test_unseen_words_after_a_context_of_a_million(spark):
    """None of them is taken for a seen one: all held-out texts of one unseen word score alike."""
    seen = spark.range(1000).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(id * 1000, id * 1000 + 999), k -> concat('a w', k)))").alias("text"))
    unseen = spark.range(1000, 11000).select(F.col("id").alias("doc_id"), F.expr("concat('a u', id)").alias("text"))
    out = ngram_lm.score(seen.union(unseen), F.col("doc_id") >= 1000).where("held_out")
    low, high, n = out.agg(F.min("score"), F.max("score"), F.count("*")).first()
    assert n == 10000 and high - low < 1e-9


def test_language_model_without_training(spark, nothing):
    assert ngram_lm.score(nothing, F.lit(False)).count() == 0
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = ngram_lm.score(df, F.lit(True)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def base(text):
    w, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c, inside = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if c[tuple(w[k : k + 3])] > 1:
            inside |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(inside)


def test_rules(docs, rows, labels):
    got = quality_rules.judge(docs, labels).collect()
    assert Counter((r["doc_id"], *(r[c] for c in quality_rules.BASE)) for r in got) == Counter((i, *base(t)) for i, t, _ in rows)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["score"] >= -0.045)


def test_rules_tell_texts_apart(spark):
    rng = random.Random(2)
    good, bad = (lambda: " ".join(f"g{rng.randint(0, 500)}" for _ in range(80))), (lambda: " ".join(f"b{rng.randint(0, 500)}" for _ in range(80)))
    df = spark.createDataFrame([(k, good() if k % 2 else bad()) for k in range(400)], "doc_id long, text string")
    labels = df.where("doc_id < 200 and doc_id % 2 = 1").select("doc_id", F.lit(1).alias("quality"))
    options = {"buckets": 256, "prior": 1.0}
    out = quality_rules.judge(df, labels, **options).where("doc_id >= 200")
    assert out.where("kept <> (doc_id % 2 = 1)").count() <= 0.03 * out.count()
    scores = sorted((r["doc_id"], r["score"]) for r in out.collect())
    assert scores == sorted((r["doc_id"], r["score"]) for r in quality_rules.judge(df.repartition(7), labels, **options).where("doc_id >= 200").collect())


def test_many_words_take_the_other_path():
    from fieldloom.llm.docstats import repeat_words

    codes, lens = np.array([0, 1, 2, 0, 1, 2, 5, 0, 1, 2]), np.array([7, 3])
    assert repeat_words(codes, lens, 6).tolist() == repeat_words(codes, lens, 1 << 21).tolist() == [6, 0]


def test_classifier(spark, docs, labels):
    out = quality_classifier.classify(docs, labels)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert {r["score"] for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(4)
    text = lambda good: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(120)) if good else "$$ ## " * 40 + "x\n" * 30
    df = spark.createDataFrame([(k, text(k % 3 > 0)) for k in range(600)], "doc_id long, text string")
    labels = df.where("doc_id < 400").select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    wrong = quality_classifier.classify(df, labels).where("doc_id >= 400 and (score >= 0.3) <> (doc_id % 3 > 0)").count()
    assert wrong <= 4


@pytest.mark.parametrize("seed", range(5))
def test_isotonic(seed):
    rng = np.random.default_rng(seed)
    n, y = rng.integers(1, 9, 30).astype(float), None
    y = np.minimum(rng.integers(0, 9, 30), n)
    got = quality_classifier.pooled(n, y)
    assert (np.diff(got) >= -1e-12).all()
    want = [max(min(y[a : b + 1].sum() / n[a : b + 1].sum() for b in range(k, 30)) for a in range(k + 1)) for k in range(30)]
    assert got == pytest.approx(want)


def toxic_frame(spark, n=500):
    rng = random.Random(6)
    words = lambda k: [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.choice('aeiou')}" for _ in range(k)]

    def text(bad):
        w = words(rng.randint(20, 200))
        for _ in range(max(1, len(w) // 25) if bad else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(["zorgtax", "zorgple", "zorgmin", "kwaxx"]))
        return " ".join(w)

    return spark.createDataFrame([(k, text(k % 4 == 0)) for k in range(n)], "doc_id long, text string")


def test_toxicity_on_held_out_rows(spark):
    df = toxic_frame(spark)
    labels = df.where("doc_id < 350").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    out = toxicity.score(df, labels).where("doc_id >= 350").collect()
    wrong = sum((r["score"] >= 0.3) != (r["doc_id"] % 4 == 0) for r in out)
    assert wrong <= 0.1 * len(out)


def test_toxicity_edges(docs, labels, nothing):
    out = toxicity.score(docs, labels, epochs=1, steps=1)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, labels.where("toxic = 1")).collect()} == {1.0}
    kept = toxicity.clean(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_windows_cover_every_word():
    lens = np.array([0, 1, 32, 33, 100, 57])
    ids, doc = toxicity.windows_of(np.arange(lens.sum()), lens)
    seen = defaultdict(set)
    for row, d in zip(ids, doc):
        seen[d] |= set(row[row > 0])
    start = 0
    for d, n in enumerate(lens):
        assert seen[d] == set(range(start + 1, start + n + 1))
        start += n


def test_gradients():
    p = {k: v.astype(np.float64) for k, v in toxicity.start_weights(0).items()}
    texts = pa.array(["ab cd ab efg", "x", "cd efg h"])
    codes, lens, words = toxicity.tokens(texts)
    ids, doc = toxicity.windows_of(codes, lens)
    vocabulary = toxicity.Vocabulary(words.cast(pa.binary()).to_pylist())
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = toxicity.forward(p, vocabulary.inputs(p) @ p["in"] + p["in_bias"], ids)
        return (np.logaddexp(0, z) - y * z).sum()

    x = vocabulary.inputs(p)
    logit, parts = toxicity.forward(p, x @ p["in"] + p["in_bias"], ids, True)
    g = toxicity.backward(p, vocabulary, x, ids, parts, toxicity.sigmoid(logit) - y)
    for name in ("in", "forth", "back", "attend", "out", "in_bias"):
        flat, at = p[name].ravel(), int(np.abs(g[name]).argmax())
        old = flat[at]
        flat[at] = old + 1e-2
        up = loss()
        flat[at] = old - 1e-2
        down = loss()
        flat[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[name].ravel()[at], rel=0.05), name


def test_empty_tables(nothing, labels):
    assert simhash.near_groups(nothing).count() == 0 and simhash.deduplicate(nothing).count() == 0
    assert ngram_lm.score(nothing, F.lit(False)).count() == 0
    assert quality_rules.judge(nothing, labels).count() == 0
    assert quality_classifier.classify(nothing, labels).count() == 0
    assert toxicity.score(nothing, labels).count() == 0


def test_rule_scores_by_hand(docs, rows, labels):
    """Counts of every word and pair, the two multinomials and each document's mean ratio, without batches."""
    buckets, prior = 1 << 10, 20.0
    good = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            good[r["doc_id"]] = min(good.get(r["doc_id"], 1), r["quality"])

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.lower()) for w in text.encode().split()]
        h = np.array(h, np.uint64)
        pairs = quality_rules.mix64(quality_rules.mix64(h[:-1]) + h[1:])
        return (np.concatenate((h, pairs)) % np.uint64(buckets)).astype(int)

    raw, target = np.zeros(buckets), np.zeros(buckets)
    for i, t, _ in rows:
        raw += np.bincount(grams(t), minlength=buckets)
        if good.get(i) == 1:
            target += np.bincount(grams(t), minlength=buckets)
    p = (raw + 1) / (raw.sum() + buckets)
    q = (target + prior * buckets * p) / (target.sum() + prior * buckets)
    want = sorted((i if i is not None else -1, round(float(np.log(q / p)[grams(t)].mean()), 9) if t.split() else 0.0) for i, t, _ in rows)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(r["score"], 9)) for r in quality_rules.judge(docs, labels, buckets=buckets, prior=prior).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-8)


def test_toxicity_forward_pass_by_hand():
    """A window's logit, one step and one number at a time."""
    p = toxicity.start_weights(3)
    words = [b"idiot,", b"a", "gr\u00fc\u00df".encode()]
    table = toxicity.Vocabulary(words).inputs(p) @ p["in"] + p["in_bias"]
    ids = np.zeros((1, toxicity.WINDOW), np.int64)
    ids[0, :5] = [1, 2, 3, 1, 2]
    h, sig, states = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x)), np.zeros((toxicity.WINDOW, 2 * toxicity.HIDDEN))
    for side, name in enumerate(("forth", "back")):
        state = np.zeros(h)
        for t in range(toxicity.WINDOW) if side == 0 else range(toxicity.WINDOW - 1, -1, -1):
            x, u = table[ids[0, t], side * 3 * h : (side + 1) * 3 * h], state @ p[name]
            z, r = sig(x[:h] + u[:h]), sig(x[h : 2 * h] + u[h : 2 * h])
            state = (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :]) + z * state
            states[t, side * h : (side + 1) * h] = state
    heat = np.exp(states[:5] @ p["attend"])
    want = (heat / heat.sum()) @ states[:5] @ p["out"] + p["bias"][0]
    assert toxicity.forward(p, table.astype(np.float32), ids)[0] == pytest.approx(want, abs=1e-4)


def test_classifier_fit_by_hand(spark, docs, labels):
    """Statistics, kernel features, both ridge systems and the calibration, from all rows at once."""
    from fieldloom.llm import docstats

    label = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            label[r["doc_id"]] = min(label.get(r["doc_id"], 1), r["quality"])
    all_ = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")).collect()
    x = docstats.features(pa.array([r["text"] for r in all_], pa.string())).astype(np.float32).astype(float)
    cosines = quality_classifier.Cosines(x.mean(0), x.std(0), 64, 4.0, 11)
    z = cosines(x)
    known = np.array([r["doc_id"] in label for r in all_])
    y = np.array([label.get(r["doc_id"], 0) for r in all_], float)
    half = np.array([r["half"] for r in all_])

    def ridge(at):
        return np.linalg.solve(z[at].T @ z[at] + 1e-3 * at.sum() * np.eye(65), z[at].T @ y[at])

    other = np.where(half == 0, z @ ridge(known & (half == 1)), z @ ridge(known & (half == 0)))
    bins = quality_classifier.bin_of(other[known])
    n, hits = np.bincount(bins, minlength=quality_classifier.BINS), np.bincount(bins, weights=y[known], minlength=quality_classifier.BINS)
    curve = np.clip(quality_classifier.pooled(n + 1e-6, hits + 1e-6 * y[known].mean()), 0, 1)
    want = curve[quality_classifier.bin_of(z @ ridge(known))]
    got = quality_classifier.classify(docs, labels, dimension=64).collect()
    key = lambda i: -1 if i is None else i
    a, b = sorted((key(r["doc_id"]), round(w, 6)) for r, w in zip(all_, want)), sorted((key(r["doc_id"]), round(r["score"], 6)) for r in got)
    assert sum(s != t for s, t in zip(a, b)) <= 1  # a score may fall on the other side of a bin's edge
