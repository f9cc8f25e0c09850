"""Tree heads over all folds and seeds from one binned table: a random forest, boosted trees, and an additive head.

A representation's features are cut once, at quantiles, into at most 256 bins. A cell is a head, a fold and a seed; it trains
on the rows of its fold that are not test and predicts those that are. Trees grow level by level: a level is one aggregate of
(weight, gradient, rows) over (cell, tree, node, feature, bin), from which each node's best split follows by running sums, in
all cells at once. Where a node has ``local_rows`` rows or fewer, its subtree, and where a whole representation has, a cell, is
grown by the same rule inside one task, so that no task holds more than that and small nodes cost no job. Gradients are whole
numbers (targets in units of 2^-32 of the largest) and random draws are hashes of row, tree and seed: sums are exact, and both
ways give the same trees, whatever the partitions.

Boosting starts from the mean; a round's rows and features are drawn without regard to other rounds. The forest's bootstrap
weights are Poisson(1) draws. Rows whose features have a null or NaN value take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.tables import scratch_dir

SEEDS = [0, 1, 2]
BINS = 256
#: Units of the largest target.
UNITS = float(1 << 32)
PREDICTIONS = "representation string, key string, fold int, regressor string, seed int, observed double, predicted double"
GOLDEN = 0x9E3779B97F4A7C15
#: Chances of at most 0, 1, 2, ... draws of a row in a bootstrap sample.
POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1.0, k + 1)) for k in range(12)])


@dataclass(frozen=True)
class Head:
    """``trees`` are rounds where ``rate`` is above 0, else a forest's. ``depth`` None: until a node has no split that leaves ``leaf``
    rows on both sides. ``rows`` and ``columns`` are drawn shares of a round."""

    trees: int
    rate: float = 0.0
    depth: int | None = None
    leaf: int = 2
    rows: float = 1.0
    columns: float = 1.0
    penalty: float = 0.0


HEADS = {
    "random_forest": Head(600),
    "boosted": Head(600, rate=0.03, depth=6, rows=0.8, columns=0.8, penalty=1.0),
    "additive": Head(300, rate=0.1, depth=1),
}


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit integers."""
    x = x.astype(np.uint64) * np.uint64(GOLDEN)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def draws(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number from 0 to 1 for each row hash."""
    salt = mixed(np.array([seed * 1_000_003 + tree + 1], np.uint64))
    return (mixed(rows.astype(np.uint64) ^ salt) >> np.uint64(11)) / float(1 << 53)


def weights(head: Head, rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    if head.rate:
        return (draws(rows, seed, tree) < head.rows).astype(np.int64)
    return np.searchsorted(POISSON, draws(rows, seed, tree), side="right")


def columns_of(head: Head, width: int, seed: int, tree: int) -> np.ndarray:
    """Which features a tree may use."""
    order = np.argsort(draws(np.arange(width, dtype=np.uint64), seed + 7919, tree))
    return np.isin(np.arange(width), order[: max(1, int(head.columns * width))])


def _gain(lw, lg, ln, w, g, n, score, head: Head):
    """What a split wins, 0 where it leaves too few rows on a side."""
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = lg * lg / (lw + head.penalty) + (g - lg) * (g - lg) / (w - lw + head.penalty) - score
    return np.where((ln >= head.leaf) & (n - ln >= head.leaf), gain, 0.0)


def _by_bins(bins: np.ndarray, node: np.ndarray, w: np.ndarray, g: np.ndarray, of: tuple, features: np.ndarray, head: Head):
    """(gain, feature, cut) of each node's best split, from sums over all its bins: for many rows in few nodes."""
    every, sums, count, score, allowed = of
    k = len(every)
    best, feature, cut = np.zeros(k), np.full(k, -1), np.zeros(k, np.int64)
    for f in features.tolist():
        key = node * BINS + bins[:, f]
        run = lambda x: np.bincount(key, x, k * BINS).reshape(k, BINS)[:, :-1].cumsum(1)  # noqa: B023, E731
        gain = _gain(run(w), run(g), run(w > 0), *(x[:, None] for x in (every, sums, count, score)), head)
        gain[~allowed[:, f]] = 0
        at = gain.argmax(1)
        most = gain[np.arange(k), at]
        better = most > best
        best, feature, cut = np.where(better, most, best), np.where(better, f, feature), np.where(better, at, cut)
    return best, feature, cut


def _by_rows(bins: np.ndarray, node: np.ndarray, w: np.ndarray, g: np.ndarray, of: tuple, features: np.ndarray, head: Head):
    """The same from the rows in the order of (node, feature, bin): for few rows in many nodes."""
    every, sums, count, score, allowed = of
    k, d = len(every), bins.shape[1]
    best, feature, cut = np.zeros(k), np.full(k, -1), np.zeros(k, np.int64)
    real = np.flatnonzero(w > 0)
    step = max(1, (1 << 20) // max(len(real), 1))
    for first in range(0, len(features), step):
        some = features[first : first + step]
        key = ((node[real, None] * d + some) * BINS + bins[real][:, some]).ravel()
        order = np.argsort(key, kind="stable")
        key, row = key[order], real[order // len(some)]
        group = key // BINS
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        inside = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))

        def run(x):
            total = np.cumsum(x)
            return total - (total[starts] - x[starts])[inside]  # noqa: B023

        lw, lg, ln = run(w[row]), run(g[row]), np.arange(len(key)) - starts[inside] + 1.0
        last = np.append((key[1:] != key[:-1]) & (group[1:] == group[:-1]), False)
        at = np.flatnonzero(last)
        if not len(at):
            continue
        own, f = np.divmod(group[at], d)
        gain = _gain(lw[at], lg[at], ln[at], every[own], sums[own], count[own], score[own], head)
        gain[~allowed[own, f]] = 0
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        most = np.maximum.reduceat(gain, heads)
        hit = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(heads, len(own)))))
        hit = hit[np.flatnonzero(np.diff(own[hit], prepend=-1))]  # the first of equals
        better = gain[hit] > best[own[hit]]
        hit = hit[better]
        best[own[hit]], feature[own[hit]], cut[own[hit]] = gain[hit], f[hit], key[at[hit]] % BINS
    return best, feature, cut


def grow(bins: np.ndarray, row: np.ndarray, tree: np.ndarray, w: np.ndarray, g: np.ndarray, head: Head, allowed: np.ndarray, depth: int | None) -> np.ndarray:
    """The leaf value that each (row, tree) reaches; those of weight 0 are led along. ``allowed``: features by tree."""
    node, live, out = tree.copy(), np.arange(len(row)), np.zeros(len(row))
    of_tree, level, features = np.arange(len(allowed)), 0, np.flatnonzero(allowed.any(0))
    w, g = w.astype(np.float64), w * g.astype(np.float64)
    while len(live):
        k, r, own, grad = len(of_tree), row[live], w[live], g[live]
        every, sums, count = (np.bincount(node, x, k) for x in (own, grad, own > 0))
        with np.errstate(invalid="ignore", divide="ignore"):
            value, score = sums / (every + head.penalty), sums * sums / (every + head.penalty)
        if level == depth:
            out[live] = value[node]
            break
        best, feature, cut = (_by_bins if 4 * k * BINS <= len(live) else _by_rows)(bins[r], node, own, grad, (every, sums, count, score, allowed[of_tree]), features, head)
        split = best > 1e-12 * np.maximum(score, 1.0)
        done = ~split[node]
        out[live[done]] = value[node[done]]
        live, node, r = live[~done], node[~done], r[~done]
        right = bins[r, feature[node]] > cut[node]
        order = np.cumsum(split) - 1
        node, of_tree, level = 2 * order[node] + right, np.repeat(of_tree[split], 2), level + 1
    return out


def fit_cell(bins: np.ndarray, y: np.ndarray, rows: np.ndarray, test: np.ndarray, head: Head, seed: int, scale: float) -> np.ndarray:
    """Predictions of the test rows of a cell whose rows are all here."""
    train, every = np.flatnonzero(~test), np.arange(len(y))
    target = np.rint(y * scale)
    base = target[train].sum() / len(train)
    if head.rate:
        at, zero = np.full(len(y), base), np.zeros(len(y), np.int64)
        for t in range(head.trees):
            w = np.where(test, 0, weights(head, rows, seed, t))
            at += head.rate * grow(bins, every, zero, w, np.rint(target - at), head, columns_of(head, bins.shape[1], seed, t)[None], head.depth)
        return at[test] / scale
    total, some = np.zeros(len(y)), max(1, (1 << 15) // len(y))
    for first in range(0, head.trees, some):
        trees = range(first, min(first + some, head.trees))
        w = np.stack([np.where(test, 0, weights(head, rows, seed, t)) for t in trees])
        tree, row = np.nonzero((w > 0) | test)
        total += np.bincount(row, grow(bins, row, tree, w[tree, row], np.rint(target - base)[row], head, np.stack([columns_of(head, bins.shape[1], seed, t) for t in trees]), head.depth), len(y))
    return (base + total[test] / head.trees) / scale


def _matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _cell_task(table: pa.Table, heads: dict[str, Head], scales: dict[str, float]) -> pa.Table:
    # Rows in the order of their hash: sums are exact, but rows of a fold should come out alike in each run.
    table = table.sort_by([("mark", "ascending"), ("key", "ascending")])
    first = {c: table.column(c)[0].as_py() for c in ("representation", "regressor", "fold", "seed")}
    test = table.column("test").to_numpy().astype(bool)
    if not test.any() or test.all():
        return pa.Table.from_batches([], schema=_schema())
    y, rows = table.column("target").to_numpy(), table.column("mark").to_numpy().view(np.uint64)
    guess = fit_cell(_matrix(table), y, rows, test, heads[first["regressor"]], first["seed"], scales[first["representation"]])
    n = int(test.sum())
    own = table.column("key").filter(pa.array(test))
    return pa.table([pa.array([first["representation"]] * n), own, pa.array([first["fold"]] * n, pa.int32()), pa.array([first["regressor"]] * n), pa.array([first["seed"]] * n, pa.int32()), pa.array(y[test]), pa.array(guess)], schema=_schema())


def _schema() -> pa.Schema:
    return pa.schema([("representation", pa.string()), ("key", pa.string()), ("fold", pa.int32()), ("regressor", pa.string()), ("seed", pa.int32()), ("observed", pa.float64()), ("predicted", pa.float64())])


def binned(panel: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One row per representation and key: target, bins (a byte per feature: how many cuts lie below the value), mark (a hash of the key),
    and the folds in which it is test or not."""
    real = panel.where(F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))) & F.col("target").isNotNull() & ~F.isnan(F.col("target").cast("double")))
    rows = real.groupBy("representation", "key").agg(F.first("features").alias("features"), F.first("target").cast("double").alias("target"), F.collect_list(F.struct("fold", (F.col("split") == "test").alias("test"))).alias("folds"))
    values = rows.select("representation", F.posexplode("features").alias("f", "v"))
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    cuts = values.groupBy("representation", "f").agg(F.array_distinct(F.percentile_approx(F.col("v").cast("double"), shares, accuracy)).alias("c"))
    cuts = cuts.groupBy("representation").agg(F.array_sort(F.collect_list(F.struct("f", "c"))).alias("cuts")).select("representation", F.col("cuts.c").alias("cuts"))
    place = F.zip_with("features", "cuts", lambda v, c: F.size(F.filter(c, lambda x: x < v.cast("double"))))
    code = F.transform(place, lambda n: F.lpad(F.hex(n), 2, "0"))
    return rows.join(cuts, "representation").select("representation", F.col("key").cast("string").alias("key"), "target", F.unhex(F.array_join(code, "")).alias("bins"), F.xxhash64("key").alias("mark"), "folds")


def _write(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


NODE = ["representation", "regressor", "fold", "seed", "tree", "node"]


def splits(slots: DataFrame, heads: dict[str, Head]) -> DataFrame:
    """One level: the best split of each node, of ``slots`` (a row of a tree: NODE, bins, w, g): feature, cut. One aggregate over (node, feature, bin)."""
    of = lambda name: reduce(lambda e, h: e.when(F.col("regressor") == h, getattr(heads[h], name)), heads, F.when(F.lit(False), 0.0))
    real = slots.where("w > 0").withColumn("f", F.explode(F.sequence(F.lit(1), F.length("bins")))).where(F.expr("columns is null or array_contains(columns, f - 1)"))
    real = real.withColumn("bin", F.conv(F.hex(F.substring(F.col("bins"), F.col("f"), F.lit(1))), 16, 10).cast("int"))
    sums = real.groupBy(*NODE, "f", "bin").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("g")).alias("g"), F.count("*").alias("n"))
    before, every = W.Window.partitionBy(*NODE, "f").orderBy("bin").rowsBetween(W.Window.unboundedPreceding, 0), W.Window.partitionBy(*NODE, "f")
    columns = {f"l{c}": F.sum(c).over(before) for c in "wgn"} | {f"t{c}": F.sum(c).over(every) for c in "wgn"}
    runs = sums.withColumns(columns).withColumns({"leaf": of("leaf"), "penalty": of("penalty").cast("double")})
    d = lambda e: F.expr(e).cast("double")
    score = lambda g, w: d(g) * d(g) / (d(w) + F.col("penalty"))
    runs = runs.where("ln >= leaf and tn - ln >= leaf").withColumn("score", score("tg", "tw"))
    runs = runs.withColumn("gain", score("lg", "lw") + score("tg - lg", "tw - lw") - F.col("score")).where(F.col("gain") > 1e-12 * F.greatest("score", F.lit(1.0)))
    best = runs.groupBy(*NODE).agg(F.max(F.struct("gain", -F.col("f"), -F.col("bin"))).alias("b"))
    return best.select(*NODE, (-F.col("b.col2")).alias("f"), (-F.col("b.col3")).alias("cut"))


def _leaves(table: pa.Table, heads: dict[str, Head]) -> pa.Table:
    """Grows the subtree of one small node to its end."""
    one = {c: table.column(c)[0].as_py() for c in ("regressor", "depth", "columns")}
    head, bins, n = heads[one["regressor"]], _matrix(table), table.num_rows
    allowed = np.ones((1, bins.shape[1]), bool) if one["columns"] is None else np.isin(np.arange(bins.shape[1]), one["columns"])[None]
    value = grow(bins, np.arange(n), np.zeros(n, np.int64), table.column("w").to_numpy().astype(np.int64), table.column("g").to_numpy().astype(np.float64), head, allowed, None if head.depth is None else head.depth - one["depth"])
    return table.select([*NODE[:5], "key"]).append_column("value", pa.array(value))


def leaf_values(slots: DataFrame, heads: dict[str, Head], local_rows: int) -> DataFrame:
    """(cell, tree, key, value) of trees that grow level by level over all tasks until their nodes are small."""

    def small(table: pa.Table) -> pa.Table:
        return _leaves(table, heads)

    deepest = reduce(lambda e, h: e.when(F.col("regressor") == h, heads[h].depth), heads, F.when(F.lit(False), 0))
    own = "representation string, regressor string, fold int, seed int, tree int, key string, value double"
    penalty = reduce(lambda e, h: e.when(F.col("regressor") == h, heads[h].penalty), heads, F.when(F.lit(False), 0.0)).cast("double")
    state, done = slots.withColumns({"node": F.lit(1).cast("long"), "depth": F.lit(0)}), []
    while True:
        size = F.count("*").over(W.Window.partitionBy(*NODE))
        state = _write(state.withColumn("size", size))
        done.append(state.where(F.col("size") <= local_rows).groupBy(*NODE).applyInArrow(small, own))
        large = state.where(F.col("size") > local_rows)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done)
        found = splits(large.where(F.coalesce(F.col("depth") < deepest, F.lit(True))), heads)
        routed = _write(large.drop("size").join(found, NODE, "left"))
        ended = routed.where("f is null").groupBy(*NODE).agg((F.sum(F.col("w") * F.col("g")).cast("double") / (F.sum("w").cast("double") + F.first(penalty))).alias("value"))
        done.append(routed.where("f is null").join(ended, NODE).select(*NODE[:5], "key", "value"))
        right = (F.conv(F.hex(F.substring(F.col("bins"), F.col("f"), F.lit(1))), 16, 10).cast("int") > F.col("cut")).cast("long")
        state = routed.where("f is not null").withColumns({"node": 2 * F.col("node") + right, "depth": F.col("depth") + 1}).drop("f", "cut")


def _draws(batches, heads: dict[str, Head], tree: int | None):
    """Slots of each row of a cell: of the given round, or of every tree of a forest."""
    for b in batches:
        table = pa.Table.from_batches([b])
        names, seeds, test, rows = table.column("regressor").to_pylist(), table.column("seed").to_pylist(), table.column("test").to_numpy().astype(bool), table.column("mark").to_numpy().view(np.uint64)
        width = len(table.column("bins")[0].as_py()) if table.num_rows else 0
        for name, seed in sorted(set(zip(names, seeds))):
            head, at = heads[name], np.flatnonzero([x == (name, seed) for x in zip(names, seeds)])
            for t in range(head.trees) if tree is None else [tree]:
                w = np.where(test[at], 0, weights(head, rows[at], seed, t))
                keep = np.ones(len(at), bool) if head.rate else (w > 0) | test[at]
                some = table.take(pa.array(at[keep]))
                chosen = np.flatnonzero(columns_of(head, width, seed, t)).tolist() if head.columns < 1 else None
                some = some.append_column("tree", pa.array(np.full(int(keep.sum()), t, np.int32))).append_column("w", pa.array(w[keep].astype(np.int64)))
                some = some.append_column("columns", pa.array([chosen] * int(keep.sum()), pa.list_(pa.int32())))
                yield from some.to_batches()


def _distributed(cells: DataFrame, heads: dict[str, Head], scale: DataFrame, local_rows: int) -> DataFrame:
    """Cells of any size. ``cells``: a row of a cell (representation, key, target, bins, mark, regressor, fold, seed, test)."""
    cell = ["representation", "regressor", "fold", "seed"]
    rows = cells.join(scale, "representation").withColumn("y", F.rint(F.col("target") * F.col("scale")))
    base = rows.where("not test").groupBy(*cell).agg((F.sum(F.col("y").cast("long")).cast("double") / F.count("*")).alias("base"))
    rows = rows.join(base, cell).withColumn("at", F.col("base"))
    kept = "representation string, key string, target double, bins binary, mark long, regressor string, fold int, seed int, test boolean, scale double, y double, base double, at double"
    columns = [c.split()[0] for c in kept.split(", ")]
    rows = _write(rows.select(*columns))
    slots = f"{kept}, tree int, w long, columns array<int>"
    out, names = [], lambda forest: [h for h in heads if (heads[h].rate == 0) == forest]
    if forests := names(True):
        own = {h: heads[h] for h in forests}
        trees = rows.where(F.col("regressor").isin(forests)).mapInArrow(lambda b: _draws(b, own, None), slots).withColumn("g", F.rint(F.col("y") - F.col("base")).cast("long"))
        value = leaf_values(trees.select(*NODE[:5], "key", "bins", "w", "g", "columns"), own, local_rows).groupBy(*cell, "key").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
        out.append(rows.where("test").join(value, [*cell, "key"]).withColumn("at", F.col("base") + F.col("value") / F.col("n")))
    if boosted := names(False):
        state = rows.where(F.col("regressor").isin(boosted))
        for t in range(max(heads[h].trees for h in boosted)):
            going = {h: heads[h] for h in boosted if heads[h].trees > t}
            more = state.where(F.col("regressor").isin(list(going))).mapInArrow(lambda b, t=t, own=going: _draws(b, own, t), slots).withColumn("g", F.rint(F.col("y") - F.col("at")).cast("long"))
            value = leaf_values(more.select(*NODE[:5], "key", "bins", "w", "g", "columns"), going, local_rows)
            rate = reduce(lambda e, h: e.when(F.col("regressor") == h, heads[h].rate), going, F.when(F.lit(False), 0.0))
            state = _write(state.join(value.drop("tree"), [*cell, "key"], "left").withColumn("at", F.col("at") + F.coalesce(rate * F.col("value"), F.lit(0.0))).select(*columns))
        out.append(state.where("test"))
    both = reduce(DataFrame.unionByName, [o.select("representation", "key", "fold", "regressor", "seed", F.col("target").alias("observed"), (F.col("at") / F.col("scale")).alias("predicted")) for o in out])
    return both.select(*[c.split()[0] for c in PREDICTIONS.split(", ")])


def evaluate(panel: DataFrame, heads: dict[str, dict], folds: list[int], seeds: list[int], *, local_rows: int = 1 << 16, tasks: int = 64) -> DataFrame:
    """Test predictions of every representation, head, fold and seed. ``panel``: key, fold, split, features, target and, where there are
    several, representation. ``heads``: names of HEADS with what differs from them."""
    panel = panel if "representation" in panel.columns else panel.withColumn("representation", F.lit("all"))
    own = {h: replace(HEADS[h], **options) for h, options in heads.items()}
    rows = _write(binned(panel))
    sizes = rows.groupBy("representation").agg(F.count("*").alias("n"), F.max(F.abs("target")).alias("top")).withColumn("scale", UNITS / F.greatest("top", F.lit(1e-300)))
    sizes = {r["representation"]: r for r in sizes.collect()}  # a row for each representation
    jobs = F.array(*[F.struct(F.lit(h).alias("regressor"), F.lit(s).cast("int").alias("seed")) for h in own for s in seeds])
    cells = rows.select("*", F.explode("folds").alias("x")).where(F.col("x.fold").isin(list(folds))).select("representation", "key", "target", "bins", "mark", F.col("x.fold").cast("int").alias("fold"), F.col("x.test").alias("test"), F.explode(jobs).alias("j"))
    cells = cells.select("representation", "key", "target", "bins", "mark", "j.regressor", "fold", "j.seed", "test")
    small = [r for r, s in sizes.items() if s["n"] <= local_rows]
    scales = {r: s["scale"] for r, s in sizes.items()}

    def task(table: pa.Table) -> pa.Table:
        return _cell_task(table, own, scales)

    cell = ["representation", "regressor", "fold", "seed"]
    out = cells.where(F.col("representation").isin(small)).repartition(tasks, *cell).groupBy(*cell).applyInArrow(task, PREDICTIONS)
    if len(small) < len(sizes):
        table = panel.sparkSession.createDataFrame([(r, s["scale"]) for r, s in sizes.items()], "representation string, scale double")
        out = out.unionByName(_distributed(cells.where(~F.col("representation").isin(small)), own, table, local_rows))
    return out


def cell_checks(predictions: DataFrame, folds: int, seeds: int) -> DataFrame:
    """Per regressor: missing (fold, seed) cells and keys predicted twice in a cell."""
    cells = predictions.groupBy("regressor").agg(F.count_distinct("fold", "seed").alias("cells"))
    twice = predictions.groupBy("regressor", "fold", "seed", "key").count().where("count > 1").groupBy("regressor").agg(F.count("*").alias("repeated"))
    return cells.join(twice, "regressor", "left").select("regressor", (F.lit(folds * seeds) - F.col("cells")).alias("missing_cells"), F.coalesce("repeated", F.lit(0)).alias("repeated_keys"))
