"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a hashed word vector beside the mean of hashed vectors of its runs of three and five characters. Two gated recurrent
layers read a window of ``WINDOW`` words in both directions, attention pools their states, and a document's logit is the
largest of its windows, which start every ``STRIDE`` words, so that they overlap and cover the whole text. Inputs are
projected once per distinct word of a batch.

Training: one task gets a sample of at most ``per_class`` labelled documents of each class (chosen by hash) and reads all
windows of each; word vectors start with what the sample's counts say of each word. A quarter of the sample is set aside to
calibrate the logits, weighted to the labels' own shares. The weights are written to the shared folder and are the same for all tasks.

Rules: a null text counts as empty and is one window without words; labels that are null are left out, and a document in several
label rows is toxic if one says so; with labels of one class only, or none, the score is their share of toxic ones;
repeated rows are scored alike; an empty table gives an empty result; further columns are kept by ``clean``, whatever
their names, and ignored otherwise. Only the text enters a score.
"""

from __future__ import annotations

import io
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, keyed, mix64, starts_of, stash, text_slices, tokens

WINDOW, STRIDE = 32, 16
HIDDEN, VECTOR = 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 14
#: Marks around a word that its own vector passes over.
MARKS = b".,;:!?\"'()[]"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_rows(words: list[bytes]) -> np.ndarray:
    """Rows of the word table."""
    return np.fromiter((xxhash.xxh32_intdigest(w.strip(MARKS) or w) for w in words), np.int64, len(words)) % WORD_ROWS


class Vocabulary:
    """Rows of the word and character tables for the words of a batch; word 0 is the absent one."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.word = word_rows(words)
        data = np.frombuffer(b"\n\n" + b"\n\n".join(words) + b"\n\n", np.uint8).astype(np.uint64)
        length = np.array([len(w) for w in words], np.int64)
        inside = np.flatnonzero(data[2:-2] != 10) + 2
        three = data[inside - 1] << np.uint64(8) | data[inside] << np.uint64(16) | data[inside + 1] << np.uint64(24)
        five = data[inside - 2] | three | data[inside + 2] << np.uint64(32)
        # Of each character, the three and the five characters around it, line ends beyond the word.
        self.char = (mix64(np.column_stack((three, five)).ravel()) % np.uint64(CHAR_ROWS)).astype(np.int32)
        self.size, self.at = 2 * length, starts_of(2 * length)

    def inputs(self, p: dict, kept: np.ndarray | float = 0.5) -> np.ndarray:
        """``kept``: which words' own vectors are used in a training step, half of them; their share otherwise."""
        x = np.zeros((self.n + 1, 2 * VECTOR), np.float32)
        self.kept = kept if np.isscalar(kept) else kept[:, None]
        if self.n:
            x[1:, :VECTOR] = p["word"][self.word] * self.kept
            x[1:, VECTOR:] = np.add.reduceat(p["char"][self.char], self.at, axis=0) / self.size[:, None]
        return x

    def gradients(self, dx: np.ndarray) -> dict:
        dword, dchar = dx[1:, :VECTOR] * self.kept, np.repeat(dx[1:, VECTOR:] / self.size[:, None], self.size, axis=0)
        return {"word": _scatter(self.word, dword, WORD_ROWS), "char": _scatter(self.char, dchar, CHAR_ROWS)}


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    flat = (rows[:, None] * VECTOR + np.arange(VECTOR)).ravel()
    return np.bincount(flat, weights=values.ravel(), minlength=n * VECTOR).reshape(n, VECTOR).astype(np.float32)


def windows_of(codes: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of each window from 1, 0 beyond the end of the text; document of each window)."""
    count = np.maximum(1, 1 + -(-(lens - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(lens)), count)
    place = STRIDE * (np.arange(len(doc)) - np.repeat(starts_of(count), count))
    at = place[:, None] + np.arange(WINDOW)
    inside = at < lens[doc][:, None]
    padded = np.append(codes, 0)
    return np.where(inside, padded[np.minimum(starts_of(lens)[doc][:, None] + at, len(codes))] + 1, 0).astype(np.int32), doc


def start_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return {
        "word": draw(WORD_ROWS, VECTOR) / 3, "char": draw(CHAR_ROWS, VECTOR), "in": draw(2 * VECTOR, 6 * HIDDEN), "in_bias": np.zeros(6 * HIDDEN, np.float32),
        "forth": draw(HIDDEN, 3 * HIDDEN), "back": draw(HIDDEN, 3 * HIDDEN), "attend": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32),
    }


def _layer(table: np.ndarray, ids: np.ndarray, u: np.ndarray, order, keep: bool):
    """States of one direction, (n, WINDOW, HIDDEN), and what its gradient needs."""
    h = np.zeros((len(ids), HIDDEN), np.float32)
    states, saved = np.empty((len(ids), WINDOW, HIDDEN), np.float32), []
    for t in order:
        x, hu = table[ids[:, t]], h @ u
        gates = x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        if keep:
            saved.append((t, h, z, r, new, hu[:, 2 * HIDDEN :]))
        h = new + z * (h - new)
        states[:, t] = h
    return states, saved


def forward(p: dict, table: np.ndarray, ids: np.ndarray, keep: bool = False):
    """Logit of each window (and the parts for its gradient)."""
    sides = (slice(None, 3 * HIDDEN), slice(3 * HIDDEN, None))
    tables = [np.ascontiguousarray(table[:, s]) for s in sides]
    runs = [_layer(tables[0], ids, p["forth"], range(WINDOW), keep), _layer(tables[1], ids, p["back"], range(WINDOW - 1, -1, -1), keep)]
    states = np.concatenate([runs[0][0], runs[1][0]], axis=2)
    heat = np.where(ids > 0, states @ p["attend"], np.float32(-1e9))
    heat = np.exp(heat - heat.max(1, keepdims=True)) * (ids > 0)
    share = heat / np.maximum(heat.sum(1, keepdims=True), 1e-9)
    pooled = np.einsum("nt,nth->nh", share, states)
    logit = pooled @ p["out"] + p["bias"][0]
    return (logit, (runs, states, share, pooled)) if keep else logit


def backward(p: dict, vocabulary: Vocabulary, x: np.ndarray, ids: np.ndarray, parts, dlogit: np.ndarray) -> dict:
    runs, states, share, pooled = parts
    g = {"out": pooled.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
    dpooled = dlogit[:, None] * p["out"]
    dshare = np.einsum("nth,nh->nt", states, dpooled)
    dheat = share * (dshare - (dshare * share).sum(1, keepdims=True))
    g["attend"] = np.einsum("nt,nth->h", dheat, states)
    dstates = share[:, :, None] * dpooled[:, None, :] + dheat[:, :, None] * p["attend"]
    dtable = np.zeros((len(x), 6 * HIDDEN), np.float32)
    flat = ids.ravel()
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    for k, name in enumerate(("forth", "back")):
        u, du, dh = p[name], np.zeros_like(p[name]), np.zeros((len(ids), HIDDEN), np.float32)
        dx = np.empty((len(ids), WINDOW, 3 * HIDDEN), np.float32)
        for t, before, z, r, new, hu in reversed(runs[k][1]):
            dh = dh + dstates[:, t, k * HIDDEN : (k + 1) * HIDDEN]
            dnew = dh * (1 - z) * (1 - new * new)
            dz, dr = dh * (before - new) * z * (1 - z), dnew * hu * r * (1 - r)
            dx[:, t] = np.concatenate((dz, dr, dnew), 1)
            dhu = np.concatenate((dz, dr, dnew * r), 1)
            du += before.T @ dhu
            dh = dh * z + dhu @ u.T
        g[name] = du
        dtable[flat[order][first], k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN] = np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
    g["in"], g["in_bias"] = x.T @ dtable, dtable.sum(0)
    return g | vocabulary.gradients(dtable @ p["in"].T)


def word_evidence(codes: np.ndarray, lens: np.ndarray, words: list[bytes], y: np.ndarray) -> np.ndarray:
    """A start for the first number of each word's vector: the signed root of the likelihood ratio of the word's documents being toxic
    as often as all are, less 2, so that a word of one document has nothing."""
    doc = np.repeat(np.arange(len(lens)), lens)
    rows = word_rows(words)[codes] if len(codes) else np.zeros(0, np.int64)
    pairs = np.unique(doc * WORD_ROWS + rows)
    n, t = np.bincount(pairs % WORD_ROWS, minlength=WORD_ROWS), np.bincount(pairs % WORD_ROWS, weights=y[pairs // WORD_ROWS], minlength=WORD_ROWS)
    share, own = y.mean(), t / np.maximum(n, 1)
    part = lambda k, q, p: k * np.log(np.maximum(q, 1e-12) / p)
    root = np.sqrt(np.maximum(2 * (part(t, own, share) + part(n - t, 1 - own, 1 - share)), 0)) * np.sign(own - share)
    return np.where(n > 0, np.sign(root) * np.maximum(np.abs(root) - 2, 0), 0).clip(-6, 6) / 2


def train(texts: pa.Array, y: np.ndarray, *, epochs: int, steps: int, most: int, batch: int, rate: float, seed: int, warm: float = 0.375, top: float = 0.2, l2: float = 1e-4) -> dict[str, np.ndarray]:
    """Weights from documents and their labels, from all their windows. In the first epochs, the share ``warm``, each window has its
    document's label, later of a toxic document the share ``top`` of its windows with the largest logits. A small sample gets
    more epochs and a large one fewer, so that there are about ``steps`` steps at least and ``most`` at most."""
    rng, p = np.random.default_rng(seed), start_weights(seed)
    codes, lens, words = tokens(texts)
    words = words.cast(pa.binary()).to_pylist()
    p["word"][:, 0] = word_evidence(codes, lens, words, y)
    ids, doc = windows_of(codes, lens)
    label = y[doc]
    low, high = (max(1, round(n * batch / max(len(doc), 1))) for n in (steps, most))
    epochs = min(max(epochs, low), max(high, 3))
    tables = min(0.3, y.sum() / 400)  # few documents would be learnt by heart by the large tables
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        used = np.arange(len(doc))
        if epoch >= warm * epochs:  # of a toxic document, only the windows that look most toxic are taken as such
            logits = np.concatenate([_logits(p, *_own_words(words, ids[k : k + 4096])) for k in range(0, len(ids), 4096)])
            place = np.lexsort((-logits, doc))
            nth = np.arange(len(doc)) - np.searchsorted(doc[place], doc[place])
            used = place[(label[place] == 0) | (nth < np.maximum(1, top * np.bincount(doc)[doc[place]]))]
        # Each document weighs the same, and so does each class.
        weight = 1 / np.bincount(doc[used], minlength=len(y))[doc]
        for c in (0, 1):
            weight[label == c] /= max(weight[used][label[used] == c].sum(), 1e-9)
        weight *= len(used) / 2
        order = used[rng.permutation(len(used))]
        for low in range(0, len(order), batch):
            at = order[low : low + batch]
            vocabulary, local = _own_words(words, ids[at])
            x = vocabulary.inputs(p, (rng.random(vocabulary.n) < 0.5).astype(np.float32))
            logit, parts = forward(p, x @ p["in"] + p["in_bias"], local, True)
            dlogit = ((sigmoid(logit) - label[at]) * weight[at] / len(at)).astype(np.float32)
            g, step = backward(p, vocabulary, x, local, parts, dlogit), step + 1
            for k, d in g.items():
                d = d + l2 * p[k] if k not in ("word", "char") else d
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                own = rate * (tables if k in ("word", "char") else 1)
                p[k] -= (own * (1 - epoch / (epochs + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def _own_words(words: list[bytes], ids: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary of some windows alone, and their word numbers in it."""
    own, local = np.unique(ids, return_inverse=True)
    return Vocabulary([words[k - 1] for k in own if k]), local.reshape(ids.shape) + (0 if own[0] == 0 else 1)


def _logits(p: dict, vocabulary: Vocabulary, ids: np.ndarray, rows: int = 2048) -> np.ndarray:
    table = (vocabulary.inputs(p) @ p["in"] + p["in_bias"]).astype(np.float32)
    return np.concatenate([forward(p, table, ids[k : k + rows]) for k in range(0, len(ids), rows)]) if len(ids) else np.zeros(0, np.float32)


def document_logits(p: dict, texts: pa.Array) -> np.ndarray:
    """The largest logit of a document's windows."""
    codes, lens, words = tokens(texts)
    ids, doc = windows_of(codes, lens)
    logits = _logits(p, Vocabulary(words.cast(pa.binary()).to_pylist()), ids)
    return np.maximum.reduceat(logits, np.searchsorted(doc, np.arange(len(lens)))) if len(lens) else logits


def calibration(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(slope, offset) of a logistic curve through the logits, with targets drawn in a little and a prior for slope 1."""
    x, n = np.column_stack((logits, np.ones(len(y)))), np.array([(1 - y).sum(), y.sum()])
    goal = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    loss = lambda w: (weight * (np.logaddexp(0, x @ w) - goal * (x @ w))).sum() + 0.5 * (w[0] - 1) ** 2
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = sigmoid(x @ w)
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([1.0, 1e-6])
        step = np.linalg.solve(h, x.T @ (weight * (q - goal)) + [w[0] - 1, 0])
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
    return np.array([max(w[0], 1e-3), w[1]])


def _fit(batches, share: float, options: dict):
    rows = [(b.column("doc_id").to_numpy(), b.column("text").to_pylist(), b.column("y").to_numpy()) for b in batches if b.num_rows]
    doc, y = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k in (0, 2))
    texts = [t for r in rows for t in r[1]]
    order = sorted(range(len(doc)), key=lambda k: (doc[k], texts[k] or ""))
    y, texts = y[order].astype(float), pa.array([texts[k] for k in order], pa.string())
    p = {"constant": np.array([share])}
    if 0 < y.mean() < 1 if len(y) else False:
        aside = np.arange(len(y)) % 4 == 3
        for c in (0, 1):
            aside[np.flatnonzero(y == c)] = np.arange(int((y == c).sum())) % 4 == 3
        p = train(texts.filter(pa.array(~aside)), y[~aside], **options)
        held = y[aside]
        weight = np.where(held == 1, share / max(held.sum(), 1), (1 - share) / max((1 - held).sum(), 1)) * len(held)
        p["curve"] = calibration(document_logits(p, texts.filter(pa.array(aside))), held, weight)
    file = io.BytesIO()
    np.savez(file, **p)
    yield pa.RecordBatch.from_arrays([pa.array([file.getvalue()], pa.binary())], names=["weights"])


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, epochs: int = 8, steps: int = 400, most: int = 1200, batch: int = 256, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights learnt from ``labels`` (doc_id, toxic), which holds only rows to learn from."""
    known = stash(labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("y")))
    share = known.agg(F.coalesce(F.avg("y"), F.lit(0.0))).first()[0]
    # Both classes, by hash; at most 2 * per_class rows are broadcast.
    sample = [known.where(F.col("y") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    sample = stash(sample[0].union(sample[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y").dropDuplicates(["doc_id"]).coalesce(1)
    options = {"epochs": epochs, "steps": steps, "most": most, "batch": batch, "rate": rate, "seed": seed}
    made = stash(rows.mapInArrow(partial(_fit, share=share, options=options), "weights binary")).first()
    return dict(np.load(io.BytesIO(made["weights"])).items()) if made else {"constant": np.array([share])}


def _scored(batches, p: dict):
    for batch in batches:
        for b in text_slices(batch, "text", 2 << 20):
            if "constant" in p:
                score = np.full(b.num_rows, p["constant"][0])
            else:
                score = sigmoid(document_logits(p, b.column("text")) * p["curve"][0] + p["curve"][1]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, "score"])


def with_scores(docs: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with a column ``score``, which they must not have."""
    return docs.mapInArrow(partial(_scored, p=p), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: row key, doc_id, score."""
    rows = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *KEY)
    return with_scores(rows, fit(docs, labels, **options)).select(*KEY, "doc_id", "score")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``."""
    plain = docs.toDF(*["text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)])  # any names may be among theirs
    kept = with_scores(plain, fit(docs, labels, **options)).where(F.col("score") < threshold).drop("score")
    return kept.toDF(*docs.columns)
