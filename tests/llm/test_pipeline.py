"""The stages of the pipeline against brute force on the smallest tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm.common import stash

from .test_exact import canonical, gapless, size

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = stash(spark.read.parquet(f"{DATA}/documents.parquet"))
    out = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stash(stage(spark, docs, DATA))
    return {k: [r.asDict() for r in v.collect()] for k, v in out.items()}


def test_names_and_columns(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "packing"]
    for name in ("toxicity", "exact_dedup", "simhash", "mixing"):
        assert set(results[name][0]) == set(results["start"][0])


def test_toxicity_only_drops(results):
    start = {r["doc_id"]: r for r in results["start"]}
    assert 0.7 * len(start) < len(results["toxicity"]) <= len(start) and all(start[r["doc_id"]] == r for r in results["toxicity"])


def test_exact_stage(results):
    first = {}
    for r in sorted(results["toxicity"], key=lambda r: r["doc_id"]):
        first.setdefault(canonical(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in results["exact_dedup"]) == sorted(first.values())


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def test_near_stage(results):
    """Links are all pairs with a Jaccard similarity of 0.8 or more, found by comparing every pair."""
    rows = sorted(results["exact_dedup"], key=lambda r: r["doc_id"])
    sets = [shingles(r["text"]) for r in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (a == b or (a and b and len(a & b) >= 0.8 * len(a | b))) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    first = {}
    for r, c in zip(rows, label):
        first.setdefault(c, r["doc_id"])
    assert sorted(r["doc_id"] for r in results["simhash"]) == sorted(first.values())


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_stages_on_odd_tables(spark, docs, kind):
    """Empty tables; nulls, empty and very long texts, repeated rows and ids, and further columns with clashing names."""
    rows = docs.limit(0) if kind == "empty" else docs.withColumns({"_size": F.lit(1), "__row_no": F.lit(2), "root": F.lit("x")})
    rows = stash(rows)
    for name, stage in corpus_pipeline.STAGES:
        after = stash(stage(spark, rows, DATA))
        if name != "packing":
            assert after.columns == rows.columns
            if name != "mixing":
                assert after.count() <= rows.count() and after.exceptAll(rows).count() == 0
        rows = after
    assert (rows.count() == 0) == (kind == "empty")


def test_mixing_stage(results):
    before, after = {r["doc_id"]: size(r["text"]) for r in results["simhash"]}, Counter()
    for r in results["mixing"]:
        after[r["doc_id"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert all(after[i] <= 3 * before[i] for i in after)
    assert abs(sum(after.values()) - sum(before.values())) <= 0.05 * sum(before.values())


def test_packing_stage(results):
    used = gapless(results["packing"])
    total = sum(r["length"] for r in results["packing"])
    assert used <= -(-total // 2048) * 1.1 + 1
    copies = Counter((r["doc_id"], r["start"]) for r in results["packing"])
    for r in results["mixing"]:
        assert copies[r["doc_id"], 0] == sum(x["doc_id"] == r["doc_id"] for x in results["mixing"])


def test_run_gives_the_last_stage(spark, results):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == list(results["packing"][0]) and out.count() == pytest.approx(len(results["packing"]), rel=0.02)


def test_no_local_checkpoint_or_product():
    import pathlib

    import fieldloom.llm as package

    for f in pathlib.Path(package.__file__).parent.glob("*.py"):
        assert not re.search(r"localCheckpoint|crossJoin", f.read_text()), f
