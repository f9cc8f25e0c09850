"""Quality rules: hashed n-gram likelihood ratio between a trusted target and the raw corpus.

Word and word-pair counts are hashed into ``buckets``; the raw multinomial comes from all documents, the trusted one from
documents labelled as good (a sample of at most ``trusted`` of them, by hash), smoothed with ``prior`` counts a bucket. A document's score is the mean over its
n-grams of log p_trusted - log p_raw, and it stays if the score is at least ``threshold``: every document is decided
alone and the same way in each run. Plain rules (too short, too repetitive) come before.

Rules: a null text has no words and fails the plain rules; a document in several label rows is trusted if all say so; repeated
rows are scored alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, keyed, mix64, stash, text_slices
from .docstats import base_counts

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def ngram_buckets(codes: np.ndarray, lens: np.ndarray, words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of each lower-cased word and of each pair of neighbours."""
    own = np.fromiter((xxhash.xxh64_intdigest(w.lower()) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
    doc = np.repeat(np.arange(len(lens)), lens)
    h = own[codes] if len(codes) else own[:0]
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = mix64(mix64(h[inside]) + h[inside + 1])
    hashed = np.concatenate((h, pairs)) % np.uint64(buckets)
    return hashed.astype(np.int64), np.concatenate((doc, doc[inside]))


def _counts(batches, buckets: int):
    raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for batch in batches:
        for b in text_slices(batch, "text"):
            codes, lens, words = base_tokens(b)
            bucket, doc = ngram_buckets(codes, lens, words, buckets)
            raw += np.bincount(bucket, minlength=buckets)
            trusted = b.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            good += np.bincount(bucket[trusted[doc]], minlength=buckets)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])


def base_tokens(b: pa.RecordBatch):
    from .common import tokens

    return tokens(b.column("text"), lower=False)


def _scores(batches, weights: np.ndarray, threshold: float):
    for batch in batches:
        for b in text_slices(batch, "text"):
            base, (codes, lens, words) = base_counts(b.column("text"))
            bucket, doc = ngram_buckets(codes, lens, words, len(weights))
            n = np.bincount(doc, minlength=len(lens))
            score = np.bincount(doc, weights=weights[bucket], minlength=len(lens)) / np.maximum(n, 1)
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            own = [b.column(c) for c in ("doc_id", *KEY)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(base[c]) for c in BASE), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], names=["doc_id", *KEY, *BASE, "base_failed", "kept", "score"])


def judge(docs: DataFrame, labels: DataFrame, *, buckets: int = 1 << 14, trusted: int = 20_000, prior: float = 20.0, threshold: float = -0.045) -> DataFrame:
    """One row per document: row key, doc_id, the base columns, base_failed, kept, score."""
    rows = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *KEY)
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q")).where("_q = 1")
    good = stash(good.orderBy(F.xxhash64("_id"), "_id").limit(trusted).select("_id"))  # at most ``trusted`` rows are broadcast
    marked = rows.join(F.broadcast(good), F.col("doc_id") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("trusted"))
    counted = marked.mapInArrow(partial(_counts, buckets=buckets), "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in stash(counted).collect():  # one row a bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["good"]
    p = (raw + 1) / (raw.sum() + buckets)
    # The trusted counts are smoothed towards the raw multinomial: a good text outside the trusted sample is not judged by its rare n-grams.
    q = (target + prior * buckets * p) / (target.sum() + prior * buckets)
    weights = np.log(q) - np.log(p)
    schema = ", ".join(["doc_id long", f"{KEY[0]} long", f"{KEY[1]} long", *(f"{c} long" for c in BASE), "base_failed boolean", "kept boolean", "score double"])
    return rows.mapInArrow(partial(_scores, weights=weights, threshold=threshold), schema)
