"""Mixing sources to target weights, with DataFrame functions only.

Targets come from water-filling: sources in code-point order (null last) weigh 5, 2, 1, repeating; no target exceeds
``cap`` times its source's words and the excess goes to the others by weight. The targets are turned into whole blocks of
``block`` words by the Sainte-Lague method (highest quotients target / (2 k - 1)), and a source's blocks are apportioned
to its shards by the same method. A shard is a seeded shuffle of some of the source's documents; its stream of words is
cut into blocks, and a shard with q of n blocks takes each block q div n times and a seeded run of q mod n blocks once more.

Words are counted natively; the source table (one row per distinct source) is the only global window. Rules: null text
has size 0; a null source is a source of its own; rows that repeat one doc_id are documents of their own; an empty table
gives an empty result; further columns are ignored. With a fractional cap a source stays below it, a document below the next
whole number. Reruns over the same files agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import KEY, ROW, SPACES, WORD, column, keyed, rooted, stash, unpacked

#: The weights of the sources, repeating.
WEIGHTS = (5, 2, 1)


def sainte_lague(df: DataFrame, group: list[str], share: str, seats: str, keys: list[str]) -> DataFrame:
    """Adds ``won``: of ``seats`` seats of each group, those of each row by the highest quotients of ``share``.

    The divisor lies between sum / (seats + rows / 2) and sum / (seats - rows / 2); the rounded shares at these two bound
    each row's seats, so only the few between them have to be ranked, whatever the number of seats.
    """
    per = W.Window.partitionBy(*group)
    df = df.withColumns({"_sum": F.sum(share).over(per), "_n": F.sum(F.when(F.col(share) > 0, 1).otherwise(0)).over(per)})
    at = lambda house: F.when((F.col("_sum") > 0) & (F.col(share) > 0), F.floor(F.col(share).cast("double") * F.greatest(house, F.lit(0.0)) / F.col("_sum") + 0.5)).otherwise(F.lit(0))
    df = df.withColumns({"_low": F.greatest(at(F.col(seats) - F.col("_n") / 2.0) - 1, F.lit(0)).cast("long"), "_high": (at(F.col(seats) + F.col("_n") / 2.0) + 1).cast("long")})
    df = df.withColumn("_left", (F.col(seats) - F.sum("_low").over(per)).cast("long"))
    kept = [c for c in df.columns if c not in ("_sum", "_n", "_high")]
    rows = df.where(F.col(share) > 0).select(*keys, *[g for g in group if g not in keys], share, "_left", F.explode(F.sequence(F.col("_low") + 1, F.greatest(F.col("_high"), F.col("_low") + 1))).alias("_seat"))
    rows = rows.withColumn("_quotient", F.col(share).cast("double") / (2 * F.col("_seat") - 1))
    best = W.Window.partitionBy(*group).orderBy(F.desc("_quotient"), *[F.col(k).asc_nulls_last() for k in keys], "_seat")
    won = rows.withColumn("_rank", F.row_number().over(best)).where("_rank <= _left").groupBy(*keys).agg(F.count("*").alias("_more"))
    won = won.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [df[k].eqNullSafe(won[f"_k_{k}"]) for k in keys]
    return df.join(won, on, "left").select(*[df[c] for c in kept if c not in ("_low", "_left")], (F.col("_low") + F.coalesce("_more", F.lit(0))).alias("won"))


def source_targets(sizes: DataFrame, cap: float) -> DataFrame:
    """Per source: rank, source_size, target."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.Window.partitionBy()
    src = src.withColumn("rank", F.row_number().over(W.Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    src = src.withColumns({"weight": weight, "limit": F.lit(cap) * F.col("source_size"), "total": F.sum("source_size").over(everything).cast("double"), "weights": F.sum(weight).over(everything)})
    # In the order of limit / weight, the first sources are those at their limit: the level is the first that the next one's limit reaches.
    by = W.Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(W.Window.unboundedPreceding, -1)
    src = src.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(by), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(by), F.lit(0))))
    src = src.withColumn("level", F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull() | (F.col("limit") <= F.col("level") * F.col("weight")), F.col("limit")).otherwise(F.col("level") * F.col("weight"))
    return src.select("source", "rank", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, cap: float = 3.0, block: int = 16, shard_words: int = 1 << 18, max_shards: int = 1 << 16, seed: int = 7, hot_rows: int = 4096) -> DataFrame:
    """One row per document: row key, doc_id, size, source_size, target, taken, and the words [cut_from, cut_to) of its last, partial copy."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = keyed(docs, "doc_id", "text", "source").select(*KEY, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"))
    sizes = stash(sizes)
    targets = source_targets(sizes, cap).withColumns({"total": F.sum("target").over(W.Window.partitionBy()), "all": F.lit(0)})
    targets = targets.withColumn("house", F.round(F.col("total") / block).cast("long"))
    targets = sainte_lague(targets, ["all"], "target", "house", ["rank"])
    targets = stash(targets.select("source", "rank", "source_size", "target", F.col("won").alias("blocks"), F.least(F.lit(max_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("long").alias("shards")))

    # A document's id places it; rows without an id, or that share theirs with many, are placed one by one, so that no shard is theirs alone.
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    hot = stash(sizes.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where(F.col("rows") > hot_rows).select(F.col("doc_id").alias("hot_id")))
    alone = F.col("doc_id").isNull() | F.col("hot_id").isNotNull()
    mark = F.md5(F.when(alone, F.concat_ws(":", F.lit(str(seed)), own, *[F.col(k).cast("string") for k in KEY])).otherwise(F.concat_ws(":", F.lit(str(seed)), own)))
    number = lambda text, n: F.conv(F.substring(text, n, 8), 16, 10).cast("long")
    t = targets.withColumnRenamed("source", "_source")
    rows = sizes.join(t, sizes["source"].eqNullSafe(t["_source"])).drop("_source")
    rows = rows.join(hot, rows["doc_id"] == hot["hot_id"], "left").withColumn("mark", mark).drop("hot_id")
    rows = rows.withColumn("shard", number(F.col("mark"), 1) % F.col("shards"))
    shards = rows.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.max("blocks").alias("blocks"))
    shards = sainte_lague(shards, ["rank"], "shard_size", "blocks", ["rank", "shard"])
    shards = shards.withColumn("n", F.ceil(F.col("shard_size") / block))
    shards = shards.withColumn("won", F.least(F.col("won"), F.floor(F.lit(float(cap)) * F.col("n"))))
    shards = shards.withColumns({"full": F.when(F.col("n") > 0, F.floor(F.col("won") / F.col("n"))).otherwise(0), "run": F.when(F.col("n") > 0, F.col("won") % F.col("n")).otherwise(0)})
    start = number(F.md5(F.concat_ws(":", F.lit(f"run{seed}"), "rank", "shard")), 1)
    shards = shards.withColumn("from", F.when(F.col("n") > 0, start % F.greatest(F.col("n"), F.lit(1))).otherwise(0) * block)
    shards = shards.select("rank", "shard", "shard_size", "full", "from", (F.col("from") + F.col("run") * block).alias("to"), F.col("n").alias("shard_blocks"))
    rows = rows.join(shards, ["rank", "shard"])
    stream = W.Window.partitionBy("rank", "shard").orderBy("mark", F.col("doc_id").asc_nulls_last(), "size", *KEY)
    end = F.sum("size").over(stream)
    rows = rows.withColumns({"end": end, "begin": end - F.col("size")})
    # The run may pass the end of the stream and go on at its start.
    ring = F.col("shard_blocks") * block
    first = F.greatest(F.lit(0), F.least(F.col("end"), F.col("to")) - F.greatest(F.col("begin"), F.col("from")))
    again = F.greatest(F.lit(0), F.least(F.col("end"), F.col("to") - ring) - F.col("begin"))
    cut_from = F.when(first > 0, F.greatest(F.col("begin"), F.col("from")) - F.col("begin")).otherwise(F.lit(0))
    return rows.select(*KEY, "doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + first + again).alias("taken"), F.col("full").alias("copies"), first.alias("first"), again.alias("again"), cut_from.alias("cut_from"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies of a document, and for a partly taken one a copy cut to the
    words taken (the first words, and the words from ``cut_from`` on, joined by a space; n_chars follows)."""
    docs = rooted(docs)
    plan = mix(docs, **options).select(*KEY, "size", "copies", "first", "again", "cut_from").where("copies * size + first + again > 0")
    part = F.col("first") + F.col("again")
    whole = F.array_repeat(F.lit(False), (F.col("copies") + F.when(part == F.col("size"), 1).otherwise(0)).cast("int"))
    cut = (part > 0) & (part < F.col("size"))
    rows = keyed(docs).join(plan.withColumn("cut", F.explode(F.when(cut, F.array_append(whole, F.lit(True))).otherwise(whole))), KEY)
    text = F.col(ROW)["text"]
    split = F.filter(F.split(text, SPACES), lambda w: w != "")
    taken = F.array_join(F.concat(F.slice(split, F.lit(1), F.col("again").cast("int")), F.slice(split, (F.col("cut_from") + 1).cast("int"), F.col("first").cast("int"))), " ")
    rows = rows.withColumn(ROW, F.col(ROW).withField("text", F.when(F.col("cut"), taken).otherwise(text)))
    if "n_chars" in docs.columns:
        count = F.length(F.col(ROW)["text"]).cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn(ROW, F.col(ROW).withField("n_chars", F.when(F.col("cut"), count).otherwise(F.col(ROW)["n_chars"])))
    return unpacked(rows).select(*map(column, docs.columns))
