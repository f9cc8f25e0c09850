"""Exact de-duplication by a content sort.

Sampled splitters range-partition the rows by their normalised bytes (a fixed-length prefix, then the content hash, then
``doc_id``), Spark's external sort puts equal texts next to each other, and a scan of each partition compares neighbours
in full. ``doc_id`` is part of the splitters, so a group of any size is spread over as many partitions as its rows need;
runs that cross a partition boundary are joined afterwards by the hashes of two edges per partition, and then by their texts.

Rules: a null text counts as empty; a null ``doc_id`` sorts after every id; of rows that repeat one ``doc_id`` and text,
exactly one is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, SPACES, keyed, rooted, stash, unpacked

#: Characters of the normalised text that the splitters hold, so that the sample on the driver stays small.
PREFIX = 32
RUNS = f"pid int, run long, doc_id long, text_sha256 string, first boolean, {KEY[0]} long, {KEY[1]} long, edge string, edge_text string"


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _runs(batches):
    """Numbers the runs of equal neighbours in a sorted partition; two last rows give its first and last text."""
    pid, run, before, head = TaskContext.get().partitionId(), -1, None, None
    schema = pa.schema([("pid", pa.int32()), ("run", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("first", pa.bool_()), (KEY[0], pa.int64()), (KEY[1], pa.int64()), ("edge", pa.string()), ("edge_text", pa.string())])
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        text = b.column("norm")
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = text[0].as_py() != before
        before = text[n - 1].as_py()
        head = text[0].as_py() if head is None else head
        runs = run + np.cumsum(new)
        run = int(runs[-1])
        gap = pa.nulls(n, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, pid, np.int32)), pa.array(runs, pa.int64()), b.column("doc_id"), b.column("text_sha256"), pa.array(new), b.column(KEY[0]), b.column(KEY[1]), gap, gap], schema=schema)
    if head is not None:
        two = [[pid, pid], [0, run], [None] * 2, [None] * 2, [None] * 2, [None] * 2, [None] * 2, ["first", "last"], [head, before]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(two, schema)], schema=schema)


def _chains(marked: DataFrame) -> DataFrame:
    """(pid, run, chain, joins) of the runs at the partitions' edges: runs of one chain are one group, ``joins`` if an earlier partition began
    it. The driver gets two hashes of each partition; whole texts are compared where the hashes of two neighbours agree."""
    edges = marked.where("edge is not null")
    found = edges.select("pid", "run", "edge", F.sha2("edge_text", 256).alias("mark")).collect()  # two rows a partition
    last, first = ({r["pid"]: r for r in found if r["edge"] == e} for e in ("last", "first"))
    pids = sorted(first)
    maybe = [(a, b) for a, b in zip(pids, pids[1:]) if last[a]["mark"] == first[b]["mark"]]
    same = set()
    if maybe:
        pairs = marked.sparkSession.createDataFrame(maybe, "a int, b int")
        left, right = (edges.where(F.col("edge") == e).select(F.col("pid").alias(c), F.col("edge_text").alias(t)) for e, c, t in (("last", "a", "text"), ("first", "b", "other")))
        same = {r["b"] for r in pairs.join(left, "a").join(right, "b").where("text = other").select("b").collect()}
    rows, chain = [], 0
    for p in pids:
        chain += p not in same
        rows.append((p, first[p]["run"], chain, p in same))
        if last[p]["run"] != first[p]["run"]:
            chain += 1
            rows.append((p, last[p]["run"], chain, False))
    return marked.sparkSession.createDataFrame(rows, "pid int, run long, chain long, joins boolean")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: row key, doc_id, keep_id, group_size, kept, text_sha256."""
    rows = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"), *KEY)
    rows = rows.withColumns({"text_sha256": F.sha2("norm", 256), "prefix": F.substring("norm", 1, PREFIX)})
    order = [F.col("prefix"), F.col("text_sha256"), F.col("doc_id").asc_nulls_last(), *map(F.col, KEY)]
    marked = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, RUNS))

    runs = marked.where("edge is null").groupBy("pid", "run").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    ends = runs.join(_chains(marked), ["pid", "run"])
    chains = ends.groupBy("chain").agg(F.min("low").alias("chain_low"), F.sum("n").alias("chain_n"))
    ends = ends.join(chains, "chain").select("pid", "run", "chain_low", "chain_n", "joins")

    fixed = runs.join(ends, ["pid", "run"], "left").select("pid", "run", F.when(F.col("chain_n").isNull(), F.col("low")).otherwise(F.col("chain_low")).alias("keep_id"), F.coalesce("chain_n", "n").alias("group_size"), F.coalesce("joins", F.lit(False)).alias("joins"))
    out = marked.where("edge is null").join(fixed, ["pid", "run"])
    return out.select(*KEY, "doc_id", "keep_id", "group_size", (F.col("first") & ~F.col("joins")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = rooted(docs)
    kept = exact_groups(docs).where("kept").select(*KEY)
    return unpacked(keyed(docs).join(kept, KEY, "left_semi"))
