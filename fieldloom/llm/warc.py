"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Writing is DataFrame work: a record is one string, Spark's text sink puts the two closing line ends after it, and a lost
task is written again under Spark's commit protocol. Only rows that revisit another are looked up while writing, so the
payloads are not shuffled unless that table is too large for a broadcast join.

Reading: Spark's text source, with the record magic as its separator, deals byte ranges of the archives to tasks. Each
chunk between two magics is a candidate record; its task emits the candidate's offset and, from the Content-Length of its
header, the offset of its successor, and follows the links inside its own range. Pointer jumping over the links between
ranges then keeps the ranges' true entry points, starting at offset 0 of each file, and only candidates on the chain from
an entry are records. A magic inside a payload starts a candidate that no chain reaches.

Rules: a null payload is empty; a null page_id or url is an empty header value and comes back as null; repeated rows are
records of their own; an empty table gives no records; further columns are ignored. Payloads are UTF-8.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import KEY, keyed, shared_dir, stash

MAGIC = "WARC/1.0\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Fixed value: the alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FOUND = ["payload_bytes long", "payload_digest string", "record_type string", "page_id long", "refers_to long", "url string"]
CANDIDATES = ", ".join(["file string", "split long", "at long", "next long", "leaves long", "split_bytes long", "whole boolean", *FOUND])


def base32_sha1(data) -> F.Column:
    """Base 32 of a SHA-1: five hexadecimal digits are four of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Row key and ``refers_to`` of each row that repeats the payload of a row with a smaller page_id."""
    rows = pages.select(*KEY, "page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= min_bytes)
    me = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), *map(F.col, KEY))
    groups = rows.groupBy("payload_digest", "payload_bytes").agg(F.min(me).alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = rows.join(groups, ["payload_digest", "payload_bytes"]).where(me != F.col("lead"))
    return again.select(*KEY, F.col("lead.page_id").alias("refers_to"), record_id(*[F.col("lead")[c] for c in ("page_id", *KEY)]).alias("refers_to_record"), F.lit(True).alias("revisit"))


def record_id(page_id, *key) -> F.Column:
    """The record's name, from its page and its row."""
    unique = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), *key))
    return F.regexp_replace(unique, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) under ``path``, one archive a task."""
    rows = keyed(pages, "page_id", "url", "html").select(*KEY, F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.col("html"))})
    rows = rows.join(stash(revisits(rows, min_bytes)), KEY, "left")
    again = F.coalesce("revisit", F.lit(False))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), text("payload_bytes"), F.lit("\r\n\r\n"))
    block = F.when(again, head).otherwise(F.concat(head, "html"))
    fields = [
        ("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", record_id(F.col("page_id"), *map(F.col, KEY))), ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.regexp_replace(text("url"), r"[\r\n]", " ")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), ("Page-ID", text("page_id")), ("WARC-Refers-To", text("refers_to_record")), ("Refers-To-Page-ID", text("refers_to")),
        ("WARC-Profile", F.when(again, REVISIT_PROFILE).otherwise("")), ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    lines = [F.when(value == "", "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))) for name, value in fields]  # no empty fields
    record = F.concat(F.lit(MAGIC), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _fields(header: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in header.split(b"\r\n"))
    return {name.strip().lower().decode("utf-8", "replace"): value.strip().decode("utf-8", "replace") for name, _, value in pairs}


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def parse_record(record: bytes) -> tuple[int, int, list | None]:
    """(header bytes, block bytes, fields of the record if all its block is there) of the bytes after a magic; block -1: no record."""
    end = record.find(b"\r\n\r\n")
    head = _fields(record[:end]) if end >= 0 else {}
    size = _number(head.get("content-length"))
    if size is None or size < 0:
        return 0, -1, None
    if len(record) < end + 4 + size:
        return end + 4, size, None
    block = record[end + 4 : end + 4 + size]
    cut = block.find(b"\r\n\r\n")
    page, kind = _number(head.get("page-id")), head.get("warc-type")
    url = head.get("warc-target-uri") or None
    if kind == "revisit":
        stated = _number(_fields(block[: max(cut, 0)]).get("content-length"))
        return end + 4, size, [stated, head.get("warc-payload-digest", "").removeprefix("sha1:"), kind, page, _number(head.get("refers-to-page-id")), url]
    payload = block[cut + 4 :] if cut >= 0 else block
    return end + 4, size, [len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, page, None, url]


def chain(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Pointer jumping inside a byte range: for each candidate, the first offset on its chain that is no candidate here."""
    place = np.minimum(np.searchsorted(at, after), len(at) - 1)
    hop = np.where(at[place] == after, place, -1)
    last = after.copy()
    while (hop >= 0).any():
        on = hop >= 0
        last = np.where(on, last[hop], last)
        hop = np.where(on, hop[hop], -1)
    return last


def _candidates(batches):
    """Candidates of each byte range, with offsets from its start; ``at`` is null in the range's own row."""
    names = [c.split()[0] for c in CANDIDATES.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in CANDIDATES.split(", ")])
    where, at, rows = None, 0, []

    def flush():
        if where is None:
            return
        starts = np.array([r[0] for r in rows], np.int64)
        after = np.array([r[1] for r in rows], np.int64)
        out = chain(starts, after) if rows else after
        table = [[*where, r[0], r[1], int(x), None, *r[2:]] for r, x in zip(rows, out)] + [[*where, None, None, None, at, *[None] * 7]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in table], f.type) for k, f in enumerate(schema)], schema=schema)

    assert len(names) == 13
    for b in batches:
        for file, split, value in zip(b.column("file").to_pylist(), b.column("split").to_pylist(), b.column("value")):
            if (file, split) != where:
                yield from flush()
                where, at, rows = (file, split), 0, []
            record = value.as_buffer().to_pybytes()
            start = at - len(MAGIC)
            if split or start >= 0:
                head, size, found = parse_record(record)
                rows.append([start, start + len(MAGIC) + head + size + 4 if size >= 0 else -1 << 62, found is not None, *(found or [None] * 6)])
            at += len(record) + len(MAGIC)
    yield from flush()


def _on_chain(pdf):
    """The candidates of one byte range that its entry point reaches."""
    pdf = pdf.sort_values("at", kind="stable", ignore_index=True)
    at, after = pdf["at"].to_numpy(), pdf["next"].to_numpy()
    hop = np.minimum(np.searchsorted(at, after), len(at) - 1)
    hop = np.where(at[hop] == after, hop, np.arange(len(at)))
    on = at == pdf["entry"].to_numpy()
    for _ in range(len(at).bit_length() + 1):
        on[hop[on]] = True
        hop = hop[hop]
    return pdf.loc[on, [c for c in pdf.columns if c != "entry"]]


def _entries(cands: DataFrame) -> DataFrame:
    """(file, at): where the chain from offset 0 enters each byte range, by pointer jumping over the ranges."""
    starts = cands.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    targets = cands.select("file", F.col("leaves").alias("at")).distinct().union(starts).distinct()
    links = stash(cands.select("file", "at", "leaves").join(targets, ["file", "at"], "left_semi"))
    reached, n = starts, -1
    while (now := (reached := stash(reached)).count()) != n:
        n = now
        step = reached.join(links, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        reached = reached.union(step).distinct()
        far = links.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("beyond"))
        links = stash(links.join(far, ["file", "leaves"], "left").select("file", "at", F.coalesce("beyond", "leaves").alias("leaves")))
    return reached


def _assembled(spark: SparkSession, path: str, cut: DataFrame, bases: DataFrame) -> DataFrame:
    """Records whose block has a magic in it: their chunks are read again and put together, a record at a time. Within each byte range
    a chunk belongs to the last record that begins before it, so that records and chunks meet in one sorted pass."""
    chunks = _scan(spark, path).mapInArrow(_raw, "file string, split long, at long, bytes binary")
    chunks = chunks.join(bases, ["file", "split"]).select("file", "split", (F.col("at") + F.col("base")).alias("at"), "bytes")
    spans = cut.select("file", F.struct(F.col("at").alias("start"), F.col("next").alias("stop")).alias("span"))
    spans = spans.join(bases, "file").where("base < span.stop and base + split_bytes > span.start").select("file", "split", F.greatest(F.col("span.start"), F.col("base") - len(MAGIC)).alias("at"), F.lit(None).cast("binary").alias("bytes"), "span")
    along = W.Window.partitionBy("file", "split").orderBy("at", F.col("bytes").isNotNull())
    both = chunks.withColumn("span", F.lit(None).cast(spans.schema["span"].dataType)).unionByName(spans).withColumn("span", F.last("span", ignorenulls=True).over(along))
    parts = both.where("bytes is not null and at >= span.start and at < span.stop").select("file", F.col("span.start").alias("start"), "at", "bytes")

    def put(pdf):
        data = MAGIC.encode().join(pdf.sort_values("at")["bytes"])
        found = parse_record(bytes(data))[2] or [None] * 6
        return pdf.iloc[:1][["file", "start"]].assign(**{c.split()[0]: [v] for c, v in zip(FOUND, found)})

    return parts.groupBy("file", "start").applyInPandas(put, ", ".join(["file string", "start long", *FOUND]))


def _raw(batches):
    where, at = None, 0
    for b in batches:
        out = []
        for file, split, n in zip(b.column("file").to_pylist(), b.column("split").to_pylist(), [len(v.as_buffer()) for v in b.column("value")]):
            if (file, split) != where:
                where, at = (file, split), 0
            out.append(at - len(MAGIC))
            at += n + len(MAGIC)
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("split"), pa.array(out, pa.int64()), b.column("value")], names=["file", "split", "at", "bytes"])


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """The chunks between magics, in order within each byte range."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", MAGIC).text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), F.col("value").cast("binary").alias("value"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record that the chain from its file's start reaches: file, offset, page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    found = stash(_scan(spark, path).mapInArrow(_candidates, CANDIDATES))
    bases = found.where("at is null").select("file", "split", "split_bytes")
    before = W.Window.partitionBy("file").orderBy("split").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = bases.select("file", "split", "split_bytes", F.coalesce(F.sum("split_bytes").over(before), F.lit(0)).alias("base"))
    cands = found.where("at is not null").drop("split_bytes").join(bases.drop("split_bytes"), ["file", "split"])
    cands = cands.withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "leaves")}).drop("base")
    entries = _entries(cands.select("file", "at", "leaves")).join(cands.select("file", "split", "at"), ["file", "at"]).select("file", "split", F.col("at").alias("entry"))
    schema = cands.schema
    records = stash(cands.join(entries, ["file", "split"]).groupBy("file", "split").applyInPandas(_on_chain, schema))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    out = records.where("whole").select("file", F.col("at").alias("offset"), *names)
    cut = records.where("not whole")
    if cut.isEmpty():
        return out
    return out.unionByName(_assembled(spark, path, cut, bases).select("file", F.col("start").alias("offset"), *names))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    path = shared_dir(pages.sparkSession)
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
