"""Exact de-duplication, mixing, packing, chat and WARC against brute force and round trips."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import chat, common, exact_dedup, jaccard, mixing, packing, queries, simhash, toxicity, warc
from fieldloom.llm.common import SPACES
from fieldloom.llm.common import KEY, keyed, shared_dir

SPACE = r"[\x20\x09-\x0D]+"


def canonical(text):
    return re.sub(SPACE, " ", text)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def smallest(ids):
    real = [i for i in ids if i is not None]
    return min(real) if real else None


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_exact_groups(spark, docs, rows, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.exact_groups(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[canonical(t)].append(i)
    want = Counter((i, smallest(groups[canonical(t)]), len(groups[canonical(t)]), hashlib.sha256(canonical(t).encode()).hexdigest()) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_one_group_over_many_partitions(spark):
    df = spark.range(5000).select((5000 - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, "same  text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    got = exact_dedup.exact_groups(df).where("group_size > 1").agg(F.count("*").alias("n"), F.max("group_size").alias("g"), F.count_if("kept").alias("k"), F.min("keep_id").alias("low"), F.max("keep_id").alias("high")).first()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tuple(got) == (3333, 3333, 1, 1, 1)


def test_deduplicate_keeps_columns(docs, rows):
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == len({canonical(t) for _, t, _ in rows})


def water(sizes, cap=3.0):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_:
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / w > cap * sizes[s]}
        if not full:
            for s in open_:
                target[s] = left * weight[s] / w
            return target
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(docs, rows):
    got = mixing.mix(docs, shard_words=5000).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    target = water(sizes)
    source = Counter()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    by_target = {round(v, 6): s for s, v in target.items()}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        s = by_target[round(r["target"], 6)]
        assert r["source_size"] == sizes[s]
        source[s] += r["taken"]
    for s in sizes:
        assert abs(source[s] - target[s]) <= 0.02 * target[s] + 100
    same = lambda rows: Counter((r["doc_id"], r["size"], r["target"], r["taken"]) for r in rows)
    assert same(got) == same(mixing.mix(docs, shard_words=5000).collect())


def highest_quotients(shares, seats):
    won = dict.fromkeys(shares, 0)
    for _ in range(seats):
        k = max(sorted(shares), key=lambda k: shares[k] / (2 * won[k] + 1))
        won[k] += 1
    return won


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1003])
def test_sainte_lague(spark, seats):
    shares = {f"k{i}": float(x) for i, x in enumerate([0, 1, 3, 3, 9, 40, 111, 500, 499.5, 2])}
    df = spark.createDataFrame([("g", k, v, seats) for k, v in shares.items()], "g string, k string, share double, seats long")
    got = {r["k"]: r["won"] for r in mixing.sainte_lague(df, ["g"], "share", "seats", ["k"]).collect()}
    assert got == highest_quotients(shares, seats)


def test_mixed_copies(docs):
    out = mixing.mixed(docs, shard_words=3000)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += size(r["text"])
    want = Counter()
    for r in mixing.mix(docs, shard_words=3000).collect():
        want[r["doc_id"]] += r["taken"]
    assert got == +want


def test_native_plans_have_no_python(spark, docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString() + queries.op7_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pack(docs, rows):
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    tk = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = tk.encode(t, add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    gapless(got)


def gapless(got, capacity=2048):
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_whole_and_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 200)))
    counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    plan = packing.plan(counts, capacity)
    used = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= capacity and n > 0
        for s in pattern:
            used[s] += n
    assert used == Counter(counts)
    bins, bound = sum(n for _, n in plan), -(-int(sizes.sum()) // capacity)
    big = int((sizes > capacity / 2).sum())
    assert max(bound, big) <= bins <= max(bound, big) * 1.25 + 1


def fewest(sizes, capacity):
    """Exact number of bins by search, for a few pieces."""
    sizes = sorted(sizes, reverse=True)

    def fits(k, rooms):
        if k == len(sizes):
            return True
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= sizes[k]:
                rooms[j] -= sizes[k]
                if fits(k + 1, rooms):
                    return True
                rooms[j] += sizes[k]
        return False

    return next(n for n in range(1, len(sizes) + 1) if fits(0, [capacity] * n))


def test_reduction_fixes_all_equal_pairs_at_once():
    """Patterns depend on the lengths, not on how many pieces there are."""
    found = []
    for n in (1000, 3000):
        counts = {900: n, 880: n, 400: n, 420: n}
        fixed, left = packing.reduce_by_dominance(counts, 2048)
        used = Counter()
        for pattern, bins in fixed:
            for s in pattern:
                used[s] += bins
        assert all(used[s] + left.get(s, 0) == n for s in counts)
        found.append(len(fixed))
    assert max(found) < 20, found


@pytest.mark.parametrize("seed", range(40))
def test_fixed_sets_lose_no_bin(seed):
    rng = np.random.default_rng(100 + seed)
    sizes = rng.integers(3, 21, 9).tolist()
    fixed, left = packing.reduce_by_dominance(dict(Counter(sizes)), 20)
    rest = list(Counter(left).elements())
    assert sum(n for _, n in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20)


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x", "<\\\\|", "a<||b", "<|<|", "\\n", "plain", "<|im_start|>user\nhi<|im_end|>\n", "$1 \\1 é<|"])
def test_escape_round_trip(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).first()
    assert "<|" not in r["e"] and r["u"] == text and r["r"] == text


def test_layouts(spark):
    import json

    records = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b<|"}]}, [("user", "a"), ("assistant", "b<|")]),
        ({"id": "7", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"response": "b", "prompt": "a"}, [("user", "a"), ("assistant", "b")]),
        ({"prompt": "a", "completion": "b", "id": "x"}, [("user", "a"), ("assistant", "b")]),
        ({"instruction": "s", "output": "b"}, [("user", "s"), ("assistant", "b")]),
        ({"instruction": "s", "input": "a", "output": "b\n "}, [("system", "s"), ("user", "a"), ("assistant", "b\n ")]),
        ({"messages": []}, []), ({"other": 1}, []), ({"messages": [{"role": None, "content": None}]}, [("", "")]),
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _) in enumerate(records)] + [(99, None)], "k int, record string")
    out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted")))
    for r in out.collect():
        want = records[r["k"]][1] if r["k"] < 99 else []
        assert [tuple(t) for t in r["turns"] or []] == want
        assert [tuple(t) for t in r["back"] or []] == want
        for span, text in zip(r["loss_spans"], [t for a, t in want if a == "assistant"]):
            assert re.sub(r"<(\\*)\\\|", r"<\1|", r["formatted"][span["start"] : span["start"] + span["length"]]) == text
    assert {r["layout"] for r in out.where("k in (7, 99)").collect()} == {None}


def test_chats_of_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, "user", "x"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "a"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"record": F.lit(1), "turns": F.lit(2)})
    got = {r["conv_id"]: [tuple(t) for t in r["back"]] for r in chat.format_chats(chat.records_of_rows(df)).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert got == {1: [("user", ""), ("assistant", "b")], 2: [("", "x"), ("user", "x")], 3: [("system", "s"), ("user", "u"), ("assistant", "a")], None: [("user", "n")]}
    assert chat.format_chats(chat.records_of_rows(df.limit(0))).count() == 0


def test_chat_of_any_length(spark):
    long = F.repeat(F.lit("ab<|\n"), 5_000_000)
    rows = spark.range(2).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 0, "hi").otherwise(long).alias("text"))
    more = rows.select(F.lit(2).alias("conv_id"), F.explode(F.array("turn", F.col("turn") + 2)).alias("turn"), "role", "text")
    out = chat.format_chats(chat.records_of_rows(rows.union(more))).select("layout", chat.read_back(F.col("formatted")).alias("b")).select("layout", F.transform("b", lambda t: F.length(t["text"])).alias("n"))
    assert sorted((r["layout"], r["n"]) for r in out.collect()) == [("messages", [2, 25_000_000, 2, 25_000_000]), ("prompt_response", [2, 25_000_000])]


def test_chat_texts_that_look_like_json(spark):
    texts = ['[{"a": 1}]', "[1, 2]", "{}", '{"messages": [{"role": "x"}]}', "null", '"', "\\"]
    rows = [(k, t, role, x) for k, x in enumerate(texts) for t, role in enumerate(("user", "assistant"))] + [(100 + k, t, "user", x) for k, x in enumerate(texts) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.format_chats(chat.records_of_rows(df)).collect()}
    assert got == {k: [x] * (2 if k < 100 else 3) for k, x in [*enumerate(texts), *((100 + k, x) for k, x in enumerate(texts))]}


def test_chat_records_of_other_kinds(spark):
    known = spark.createDataFrame([('{"messages": []}',), (None,), ('{"messages": ["a", {"role": "user", "content": "b"}]}',), ('{"messages": "text"}',), ('{"prompt": "a", "response": 5}',)], "record string")
    got = [(r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.canonical_turns(known).collect()]
    assert got == [("messages", []), (None, []), (None, []), (None, []), ("prompt_response", [("user", "a"), ("assistant", "5")])]
    for bad in ("not json", "[1]", '{"a": '):
        with pytest.raises(Exception, match="not a JSON object"):
            chat.canonical_turns(spark.createDataFrame([(bad,)], "record string")).collect()


@pytest.mark.parametrize("block", ["128m", "700"])
def test_archives(spark, block):
    nested = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n\r\nWARC/1.0\r\nContent-Length: 999999\r\n\r\n"
    texts = [None, "", "x" * 3000, "é" * 50, nested, nested * 9, "WARC/1.0\r\n", "\r\n\r\n", "same", "same", "same", None, "a\r\nContent-Length: 5\r\n\r\nb"]
    rows = [(len(texts) - k, f"http://h/{k}\r\nX: y", t, 1, "f") for k, t in enumerate(texts)] + [(None, None, "same", 1, "f"), (3, "u", "same", 2, "f")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at int, file string").repartition(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.round_trip(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = Counter((r[0], len((r[2] or "").encode()), digest(r[2])) for r in rows)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    low = defaultdict(list)
    for r in rows:
        low[digest(r[2])].append(r[0])
    for d, ids in low.items():
        mine = [r for r in got if r["payload_digest"] == d]
        lead = [r for r in mine if r["record_type"] == "response"]
        assert len(lead) == 1 and lead[0]["page_id"] == smallest(ids) and lead[0]["refers_to"] is None
        assert all(r["refers_to"] == smallest(ids) for r in mine if r["record_type"] == "revisit")


def test_small_payloads_do_not_revisit(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, min_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_tables(spark, nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0 and exact_dedup.deduplicate(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    assert packing.pack(nothing, packing.public_tokenizer()).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_row_keys_are_unique(docs):
    assert keyed(docs).select(*KEY).distinct().count() == docs.count()
    assert shared_dir(docs.sparkSession) != shared_dir(docs.sparkSession)


def test_word_ids_equal_the_tokenizer():
    import random

    from tokenizers import Tokenizer

    path, rng = packing.public_tokenizer(), random.Random(0)
    tk = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(33, 0x250) if not chr(c).isspace()]
    words = [*letters, "don't", "<|ENDOFTEXT|>", "<|endoftext|>x", "iİ.", "İ", "é.", "ŉ", "ǅ", "a.b", "...", "3.5"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", "!?"]) for _ in range(3000)]
    words = [w for w in words if len(w.split()) == 1]
    assert [np.frombuffer(x, np.uint32).tolist() for x in packing.word_ids(words, path)] == [tk.encode(w, add_special_tokens=False).ids for w in words]


CLASHES = ["__row_file", "__row_no", "__row", "_part", "_size", "_first", "_copies", "_again", "_cut", "score", "toxicity_score_", "me", "kept", "component", "root", "cut", "copies", "first", "a.b", "x`y"]


def _frames(spark, docs):
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    twice = spark.range(2).withColumnRenamed("id", "_twice")
    return {
        "exploded": plain.withColumn("_twice", F.explode(F.array(F.lit(0), F.lit(1)))),
        "joined": plain.join(twice, F.length("lang") * 0 == F.col("_twice") * 0),
        "united": plain.unionAll(plain),
        "chosen": plain.where(F.rand() < 0.5),
        "clashing": plain.select("*", *[F.lit(3).alias(c) for c in CLASHES]),
    }


@pytest.fixture(scope="module")
def frames(spark, docs):
    return _frames(spark, docs)


@pytest.mark.parametrize("name", ["exploded", "joined", "united", "clashing"])
def test_row_keys_and_names(spark, frames, name, labels):
    df = frames[name]
    texts = {canonical(r["text"]) for r in df.select("text").collect()}
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns and out.count() == len(texts)
    near = simhash.deduplicate(df)
    assert near.columns == df.columns and near.count() == simhash.near_groups(df).select("component_id").distinct().count()
    near = jaccard.deduplicate(df)
    assert near.columns == df.columns and near.count() <= len(texts)
    sizes = df.select(F.sum(F.size(F.filter(F.split("text", SPACES), lambda w: w != "")))).first()[0]
    mix = mixing.mixed(df)
    assert mix.columns == df.columns
    assert mix.select(F.sum(F.size(F.filter(F.split("text", SPACES), lambda w: w != "")))).first()[0] == pytest.approx(sizes, rel=0.05)
    clean = toxicity.clean(df, labels.limit(0))
    assert clean.columns == df.columns and clean.count() == df.count()


def test_row_keys_of_a_random_choice(frames):
    out = exact_dedup.deduplicate(frames["chosen"]).collect()
    assert len({canonical(r["text"]) for r in out}) == len(out)


def test_mixing_deals_rows_without_an_id(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    plan = mixing.mix(df, shard_words=2000)
    assert plan.count() == 20_000 and plan.where("taken > 12").count() == 0
    assert plan.select(F.sum("taken")).first()[0] == pytest.approx(80_000, rel=0.02)


def test_scratch_tables_are_deleted(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/table")
    with common.scratch(spark):
        assert common.stash(spark.range(3)).count() == 3 and len(os.listdir(tmp_path)) == 1
    assert os.listdir(tmp_path) == []


def test_ascii_words_go_to_the_model_as_they_are(monkeypatch):
    """The ids of the whole tokenizer, without a call of its letter step for lower-case ASCII words."""
    from fieldloom.llm import packing

    path = packing.public_tokenizer()
    whole, _, _ = packing._tokenizer(path)
    words = ["plain", "zzxqjvk", "Plain", "plain.", "über", "x1", "a" * 300, "don't", "ÀB"]
    monkeypatch.setattr(packing, "_tokenizer", lambda p: (whole, {}, None))
    got = packing.word_ids(["plain", "zzxqjvk", "a" * 300], path)
    monkeypatch.undo()
    assert got == [np.array(whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in ("plain", "zzxqjvk", "a" * 300)]
    assert packing.word_ids(words, path) == [np.array(whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
