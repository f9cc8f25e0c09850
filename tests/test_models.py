"""Ridge, components, trees and bootstrap against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import grid, linear, metrics, trees
from fieldloom.operators.numbering import numbered
from fieldloom.plans import queries as plans


def panel(n=120, d=4, k=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 10, 0.1, 3] + [100, 0, 5, -2]
    x[:, 2] = 5.0  # without variance
    y = x @ [0.5, -0.2, 3, 1] + rng.normal(size=n) * 0.3
    return x, y, np.arange(n) % k


def frame(spark, x, y, fold):
    rows = [("r", int(f), v.tolist(), float(t), f"k{i}") for i, (v, t, f) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, "rep string, fold int, features array<double>, target double, key string")


def ridge(x, y, alpha):
    m, s = x.mean(0), x.std(0)
    s = np.where(s > 1e-10, s, 1)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda q: y.mean() + (q - m) / s @ w


def error(f, x, y):
    return float(np.sqrt(np.mean((f(x) - y) ** 2)))


def test_ridge_folds(spark):
    x, y, fold = panel()
    rows = frame(spark, x, y, fold)
    fits = linear.fit_folds(linear.grams(rows, "rep", "fold", "target"))
    got = {r["key"]: r["predicted"] for r in linear.predict(rows, fits, "rep", "fold").collect()}
    alphas = {int(r["fold"]): r["alpha"] for r in fits.collect()}
    for f in range(5):
        val, test = fold == (f + 1) % 5, fold == f
        best = min((error(ridge(x[~val & ~test], y[~val & ~test], a), x[val], y[val]), a) for a in linear.ALPHAS)[1]
        assert alphas[f] == best
        want = ridge(x[~test], y[~test], best)(x[test])
        assert [got[f"k{i}"] for i in np.flatnonzero(test)] == pytest.approx(want.tolist(), abs=1e-8)


def test_ridge_years(spark):
    x, y, year = panel(k=4)
    rows = frame(spark, x, y, year)
    for r in linear.fit_years(linear.grams(rows, "rep", "fold", "target")).collect():
        rest = year != int(r["fold"])
        mean = {a: np.mean([error(ridge(x[rest & (year != u)], y[rest & (year != u)], a), x[year == u], y[year == u]) for u in set(year[rest])]) for a in linear.ALPHAS}
        assert r["alpha"] == min((v, a) for a, v in mean.items())[1]
        assert r["val_rmse"] == pytest.approx(mean[r["alpha"]])


def test_more_features_than_rows(spark):
    rng = np.random.default_rng(1)
    x, y, fold = rng.normal(size=(20, 60)), rng.normal(size=20), np.arange(20) % 5
    rows = frame(spark, x, y, fold)
    fits = linear.fit_folds(linear.grams(rows, "rep", "fold", "target"), alphas=(1.0,))
    got = {r["key"]: r["predicted"] for r in linear.predict(rows, fits, "rep", "fold").collect()}
    want = ridge(x[fold != 0], y[fold != 0], 1.0)(x[fold == 0])
    assert [got[f"k{i}"] for i in np.flatnonzero(fold == 0)] == pytest.approx(want.tolist(), abs=1e-8)


def test_first_component(spark):
    x, y, fold = panel()
    load, share, rows = linear.first_component(frame(spark, x, y, fold), "features")
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert share == pytest.approx(values[-1] / values.sum()) and abs(load @ vectors[:, -1]) == pytest.approx(1)
    got = {r["key"]: r["pc1"] for r in rows.collect()}
    assert [got[f"k{i}"] for i in range(len(x))] == pytest.approx(((x - x.mean(0)) @ load).tolist(), abs=1e-8)


def test_recoverability(spark):
    x, y, fold = panel()
    rows = frame(spark, x, y, fold).select(F.lit(0).alias("timestep"), F.explode(F.array(F.lit(0), F.lit(1))).alias("f"), "fold", "features", "target")
    rows = rows.select("timestep", F.when(F.col("fold") == F.col("f"), "test").otherwise("train").alias("split"), F.col("f").alias("fold"), "features", "target")
    scores = []
    for f in (0, 1):
        test = fold == f
        a = min((np.mean([(y[i] - ridge(x[(~test) & (np.arange(len(y)) != i)], y[(~test) & (np.arange(len(y)) != i)], a)(x[i])) ** 2 for i in np.flatnonzero(~test)]), a) for a in (0.1, 100.0))[1]
        guess = ridge(x[~test], y[~test], a)(x[test])
        scores.append(1 - ((y[test] - guess) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
    got = linear.recoverability(rows, alphas=(0.1, 100.0)).first()
    assert got["folds"] == 2 and got["r2_mean"] == pytest.approx(np.mean(scores), abs=1e-6)


def test_scaler_uses_training_rows_only(spark):
    rows = [("train", 0, [float(k)]) for k in range(3)] + [("test", 0, [1e6])]
    df = spark.createDataFrame(rows, "split string, timestep int, features array<double>")
    out = linear.scaled_sequences(df, linear.sequence_scaler(df)).collect()
    assert sum(r["features"][0] for r in out if r["split"] == "train") == pytest.approx(0) and max(r["features"][0] for r in out) > 1000


def two_folds(spark, n=200):
    x, y, fold = panel(n)
    rows = frame(spark, x, y, fold).select("key", "features", "target", F.explode(F.array(F.lit(0), F.lit(1))).alias("fold"), F.col("fold").alias("own"))
    return rows.withColumn("split", F.when(F.col("own") == F.col("fold"), "test").otherwise("train"))


def test_tree_heads(spark):
    out = trees.evaluate(two_folds(spark), {"random_forest": {"trees": 15, "depth": 8}, "boosted": {"trees": 15, "rate": 0.2}, "additive": {"trees": 30}}, [0, 1], [0])
    scores = {r["regressor"]: r["r2"] for r in metrics.metrics(out, ["regressor"]).collect()}
    assert all(v > 0.6 for v in scores.values()), scores
    assert all(r["missing_cells"] == 0 and r["repeated_keys"] == 0 for r in trees.cell_checks(out, 2, 1).collect())


def test_levels_over_all_tasks_grow_the_trees_of_one_task(spark):
    """A bound on rows only moves where the work is done."""
    rows = two_folds(spark, 60)
    heads = {"random_forest": {"trees": 3}, "boosted": {"trees": 2, "rate": 0.5, "depth": 2}, "additive": {"trees": 2}}
    cells = [{(r["key"], r["fold"], r["regressor"], r["seed"]): r["predicted"] for r in trees.evaluate(rows, heads, [0, 1], [4], local_rows=bound).collect()} for bound in (1000, 8)]
    assert cells[0].keys() == cells[1].keys() and {k[2] for k in cells[0]} == set(heads)
    assert all(cells[1][k] == pytest.approx(v, rel=1e-12) for k, v in cells[0].items())


def brute_tree(x, y, w, row, leaf, penalty, depth):
    """The leaf value of ``row``, splits tried at every value of every feature."""
    inside = np.flatnonzero(w > 0)
    while depth != 0:
        best = (0.0, None)
        score = lambda at: (w[at] * y[at]).sum() ** 2 / (w[at].sum() + penalty)  # noqa: B023, E731
        for f in range(x.shape[1]):
            for cut in np.unique(x[inside, f]):
                left, right = inside[x[inside, f] <= cut], inside[x[inside, f] > cut]
                if min(len(left), len(right)) >= leaf:
                    gain = score(left) + score(right) - score(inside)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
        if best[1] is None:
            break
        f, cut = best[1]
        inside = inside[(x[inside, f] <= cut) == (x[row, f] <= cut)]
        depth = None if depth is None else depth - 1
    return (w[inside] * y[inside]).sum() / (w[inside].sum() + penalty)


@pytest.mark.parametrize("leaf, penalty, depth", [(2, 0.0, None), (2, 1.0, 2), (5, 0.0, 1)])
def test_one_tree(leaf, penalty, depth):
    rng = np.random.default_rng(leaf)
    bins, y, w = rng.integers(0, 20, (50, 3)).astype(np.uint8), rng.integers(-1000, 1000, 50).astype(float), rng.integers(0, 3, 50)
    head = trees.Head(1, leaf=leaf, penalty=penalty)
    got = trees.grow(bins, np.arange(50), np.zeros(50, np.int64), w, y, head, np.ones((1, 3), bool), depth)
    assert got == pytest.approx([brute_tree(bins, y, w, k, leaf, penalty, depth) for k in range(50)])


def test_one_split_as_an_aggregate(spark):
    rng = np.random.default_rng(8)
    bins, y, w = rng.integers(0, 256, (40, 4)).astype(np.uint8), rng.integers(-1000, 1000, 40), rng.integers(0, 3, 40)
    rows = [("r", "random_forest", 0, 0, 0, 1, bytearray(b.tobytes()), int(g), int(n), None) for b, g, n in zip(bins, y, w)]
    df = spark.createDataFrame(rows, "representation string, regressor string, fold int, seed int, tree int, node long, bins binary, g long, w long, columns array<int>")
    split = trees.splits(df, {"random_forest": trees.HEADS["random_forest"]}).first()
    left = bins[:, split["f"] - 1] <= split["cut"]
    score = lambda at: (w[at] * y[at]).sum() ** 2 / max(w[at].sum(), 1e-9)
    gains = [score(bins[:, f] <= c) + score(bins[:, f] > c) for f in range(4) for c in range(255) if min((w[bins[:, f] <= c] > 0).sum(), (w[bins[:, f] > c] > 0).sum()) >= 2]
    assert score(left) + score(~left) == pytest.approx(max(gains))


def test_odd_panels(spark):
    """Nulls take no part, a constant target is met, equal features give the mean, an empty panel has no predictions."""
    schema = "key string, fold int, split string, features array<double>, target double"
    rows = [(f"k{k}", 0, "test" if k % 4 == 0 else "train", [1.0, 2.0], float(k)) for k in range(12)]
    odd = [("n1", 0, "train", None, 1.0), ("n2", 0, "train", [1.0, None], 1.0), ("n3", 0, "test", [1.0, float("nan")], 1.0), ("n4", 0, "train", [1.0, 2.0], None)]
    heads = {h: {"trees": 2} for h in trees.HEADS}
    got = trees.evaluate(spark.createDataFrame(rows + odd, schema), heads, [0], [0]).collect()
    assert len(got) == 9 and {round(r["predicted"], 6) for r in got if r["regressor"] == "additive"} == {round(np.mean([k for k in range(12) if k % 4]), 6)}
    same = [(k, f, s, x, 5.0) for k, f, s, x, _ in rows]
    assert {round(r["predicted"], 6) for r in trees.evaluate(spark.createDataFrame(same, schema), heads, [0], [0]).collect()} == {5.0}
    assert trees.evaluate(spark.createDataFrame([], schema), heads, [0], [0]).collect() == []


def test_tree_heads_are_registered_whole(spark, monkeypatch):
    """All folds and seeds with the production parameters."""
    asked = []

    def evaluate(rows, heads, folds, seeds):
        asked.append((heads, folds, seeds))
        return rows.select("fold", F.lit("x").alias("regressor"), F.lit(0).alias("seed"), F.col("target").alias("observed"), F.col("target").alias("predicted"))

    monkeypatch.setattr(trees, "evaluate", evaluate)
    plans.QUERIES["m04_tree_heads"](spark, "/root/testdata/sf0.001")
    [(heads, folds, seeds)] = asked
    assert sorted(folds) == [0, 1, 2, 3, 4] and seeds == [0, 1, 2] and not any(heads.values())
    assert [(h.trees, h.depth, h.leaf, h.rate, h.rows, h.columns) for h in (trees.HEADS[name] for name in heads)] == [(600, None, 2, 0.0, 1.0, 1.0), (600, 6, 2, 0.03, 0.8, 0.8), (300, 1, 2, 0.1, 1.0, 1.0)]


def test_metrics_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("b", 2.0, 3.0)], "k string, observed double, predicted double")
    got = {r["k"]: r for r in metrics.metrics(df, ["k"]).collect()}
    assert got["a"]["r2"] is None and got["b"]["r2"] is None and got["b"]["rmse"] == 1.0


def test_subsets_share_one_factor(spark):
    """Prefixes, and subsets without some features, equal their own fits."""
    x, y, fold = panel(100)
    subsets = [[0], [0, 1], [0, 1, 2, 3], [1, 2, 3], [0, 3], [3]]
    rows = frame(spark, x, y, fold)
    fits = linear.fit_folds(linear.grams(rows.repartition(7), "rep", "fold", "target"), subsets=subsets)
    got = {(r["key"], r["subset"]): r["predicted"] for r in linear.predict(rows, fits, "rep", "fold").collect()}
    assert len(got) == 100 * len(subsets)
    for s, kept in enumerate(subsets):
        for f in range(5):
            val, test, own = fold == (f + 1) % 5, fold == f, x[:, kept]
            best = min((error(ridge(own[~val & ~test], y[~val & ~test], a), own[val], y[val]), a) for a in linear.ALPHAS)[1]
            want = ridge(own[~test], y[~test], best)(own[test])
            assert [got[f"k{i}", s] for i in np.flatnonzero(test)] == pytest.approx(want.tolist(), abs=1e-7)


def test_moments_keep_their_digits():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(300, 3)) + 1e8
    parts = [linear.Moments.of_rows(p) for p in np.split(rows, [1, 50, 60])]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    want = linear.Moments.of_rows(rows)
    assert total.n == 300 and total.mean == pytest.approx(want.mean) and total.products == pytest.approx(want.products, rel=1e-6, abs=1e-4)
    rest, alone = total - parts[3], linear.Moments.of_rows(rows[:60])
    assert rest.n == 60 and rest.products == pytest.approx(alone.products, rel=1e-5, abs=1e-3)
    back = linear.Moments.of_bytes(total.bytes())
    assert back.n == total.n and (back.products == total.products).all() and (total - total).n == 0


def test_moments_of_many_tasks(spark):
    x, y, fold = panel(400)
    rows = frame(spark, x, y, fold)
    one, many = ({r["block"]: linear.Moments.of_bytes(r["moments"]) for r in linear.grams(df, "rep", "fold", "target").collect()} for df in (rows.coalesce(1), rows.repartition(80)))
    assert one.keys() == many.keys() and all(one[b].products == pytest.approx(many[b].products) and one[b].n == many[b].n for b in one)


def test_first_component_of_wide_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 300)) + 0.1 * rng.normal(size=(80, 300)) + 7
    load, share, rows = linear.first_component(frame(spark, x, x[:, 0], np.zeros(80)).repartition(5), "features")
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = vt[0] * (1 if vt[0][np.abs(vt[0]).argmax()] > 0 else -1)
    assert load == pytest.approx(want, abs=1e-7) and share == pytest.approx(s[0] ** 2 / (s**2).sum())
    got = {r["key"]: r["pc1"] for r in rows.collect()}
    assert [got[f"k{i}"] for i in range(80)] == pytest.approx(((x - x.mean(0)) @ want).tolist(), abs=1e-6)


def test_recoverability_in_turns(spark, monkeypatch):
    """Cells whose arrays don't fit one broadcast are done one after another."""
    x, y, fold = panel()
    rows = frame(spark, x, y, fold).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("f"), "fold", "features", "target").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("timestep"))
    rows = rows.select("timestep", F.when(F.col("fold") == F.col("f"), "test").otherwise("train").alias("split"), F.col("f").alias("fold"), "features", "target")
    want = sorted(map(tuple, linear.recoverability(rows).collect()))
    monkeypatch.setattr(linear, "BROADCAST", 1)
    got = sorted(map(tuple, linear.recoverability(rows).collect()))
    assert [g[:2] for g in got] == [(0, 2), (1, 2)] and [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_grid_goes_on(spark, tmp_path, monkeypatch):
    rows = two_folds(spark, 80).withColumn("representation", F.explode(F.array(F.lit("a"), F.lit("b"))))
    heads, path = {"ridge": {"alphas": (1.0,)}, "additive": {"trees": 4}}, f"file://{tmp_path}/grid"
    assert grid.missing(rows, path, list(heads), [0, 1], [0, 1]).count() == 2 * 2 * (1 + 2)
    monkeypatch.setattr(trees, "evaluate", lambda *a, **b: 1 / 0)  # killed after the ridge cells
    with pytest.raises(ZeroDivisionError):
        grid.run(rows, path, heads, [0, 1], [0, 1])
    monkeypatch.undo()
    assert {r["regressor"] for r in grid.missing(rows, path, list(heads), [0, 1], [0, 1]).collect()} == {"additive"}
    one = grid.run(rows, path, {"additive": {"trees": 4}}, [0], [1])
    assert {(r["fold"], r["seed"]) for r in one.where("regressor = 'additive'").collect()} == {(0, 1)}
    files = {r["f"] for r in one.select(F.input_file_name().alias("f")).distinct().collect()}
    out = grid.run(rows, path, heads, [0, 1], [0, 1])
    assert files < {r["f"] for r in out.select(F.input_file_name().alias("f")).distinct().collect()}  # what was there is not fitted again
    cells = {(r["representation"], r["regressor"], r["fold"], r["seed"]): r["count"] for r in out.groupBy(*grid.CELL).count().collect()}
    assert len(cells) == 12 and grid.missing(rows, path, list(heads), [0, 1], [0, 1]).isEmpty()
    assert out.groupBy(*grid.CELL, "key").count().where("count > 1").isEmpty()
    whole = {(r["key"], r["fold"], r["seed"]): r["predicted"] for r in trees.evaluate(rows.where("representation = 'a'"), {"additive": {"trees": 4}}, [0, 1], [0, 1]).collect()}
    assert {(r["key"], r["fold"], r["seed"]): r["predicted"] for r in out.where("representation = 'a' and regressor = 'additive'").collect()} == whole
    n = out.count()
    assert grid.run(rows, path, heads, [0], [0], redo=True).count() == n


def test_ridge_of_any_manifest(spark):
    """Folds that leave keys out, and overlap, are fitted on their own training rows."""
    x, y, _ = panel(60)
    roles = {0: lambda i: "test" if i < 10 else "val" if i < 20 else "train", 1: lambda i: "test" if 5 <= i < 15 else "train" if i % 2 else None, 2: lambda i: "val" if i % 3 else "test"}
    rows = [("r", f"k{i}", f, role(i), x[i].tolist(), float(y[i])) for f, role in roles.items() for i in range(60) if role(i)]
    df = spark.createDataFrame(rows, "representation string, key string, fold int, split string, features array<double>, target double")
    fits = {int(r["fold"]): r for r in linear.fit_roles(df).collect()}
    assert set(fits) == {0, 1}
    at = lambda f, *kinds: [i for i in range(60) if roles[f](i) in kinds]
    best = min((error(ridge(x[at(0, "train")], y[at(0, "train")], a), x[at(0, "val")], y[at(0, "val")]), a) for a in linear.ALPHAS)[1]
    for f, alpha in ((0, best), (1, linear.ALPHAS[0])):
        own = at(f, "train", "val")
        assert fits[f]["alpha"] == alpha and fits[f]["train_n"] == len(own)
        beta = np.array(fits[f]["beta"])
        assert beta[0] + x @ beta[1:] == pytest.approx(ridge(x[own], y[own], alpha)(x), abs=1e-7)


def test_numbered(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"), F.col("id").alias("v"))
    got = numbered(df.repartition(6), [F.desc("k")], "place", 1)
    assert all(r["place"] == 1000 - r["k"] for r in got.collect())
    assert "WindowExec" not in got._jdf.queryExecution().executedPlan().toString()
    assert numbered(df.limit(0), ["k"]).collect() == []


def test_recoverability_of_equal_targets(spark):
    """Test targets without spread: minus infinity, or NaN where they are met exactly, however sums of squares are rounded."""
    rng = np.random.default_rng(3)
    rows = [(t, "test" if i % 3 == 0 else "train", 0, [float(rng.normal())], 50.0 if t == 1 or i % 3 == 0 else 50 - rng.random() / 7) for t in range(2) for i in range(90)]
    got = {r["timestep"]: r for r in linear.recoverability(spark.createDataFrame(rows, "timestep int, split string, fold int, features array<double>, target double")).collect()}
    assert [got[t]["folds"] for t in range(2)] == [1, 1]
    assert got[0]["r2_mean"] == -np.inf and np.isnan(got[1]["r2_mean"]) and all(np.isnan(g["r2_std"]) for g in got.values())
