"""Forests: one tree against a plain recursive one, properties the search uses, Spark fit and search."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.operators import forest as FO
from spendlens.operators import metrics as M


def slow_tree(x, y, times, weight, max_depth, min_leaf, min_split):
    """Recursive best weighted Gini cut over all columns; nested (column, cut, left, right) or class shares."""
    def gini_mass(yy, tt):
        w = np.bincount(yy, tt, minlength=len(weight)) * weight
        return (w ** 2).sum() / w.sum()

    def node(rows, depth):
        n = times[rows].sum()
        w = np.bincount(y[rows], times[rows], minlength=len(weight)) * weight
        if depth < max_depth and n >= max(min_split, 2 * min_leaf) and len(set(y[rows])) > 1:
            best = (gini_mass(y[rows], times[rows]) + 1e-9, None)
            for c in range(x.shape[1]):
                for cut in range(FO.BINS - 1):
                    left, right = rows[x[rows, c] <= cut], rows[x[rows, c] > cut]
                    if min(times[left].sum(), times[right].sum()) >= min_leaf:
                        score = gini_mass(y[left], times[left]) + gini_mass(y[right], times[right])
                        if score > best[0] + 1e-12:
                            best = (score, (c, cut, left, right))
            if best[1]:
                c, cut, left, right = best[1]
                return node(left, depth + 1), node(right, depth + 1), c, cut
        return w / w.sum()

    def say(at, row):
        while isinstance(at, tuple):
            at = at[0] if row[at[2]] <= at[3] else at[1]
        return at

    top = node(np.nonzero(times)[0], 0)
    return np.array([say(top, r) for r in x])


def made(n, d, seed, classes=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, d)).astype(np.uint8)
    y = (x[:, 0] > 5).astype(int) + (x[:, 1 % d] > 8) * (classes - 2)
    return x, np.where(rng.random(n) < 0.2, rng.integers(0, classes, n), y)


@pytest.mark.parametrize("depth, leaf, split", [(3, 1, 2), (5, 4, 2), (4, 1, 40)])
def test_tree_of_all_columns_is_the_plain_one(depth, leaf, split):
    x, y = made(300, 3, 1)
    weight = FO.balanced(y, 3)
    tree = FO.grow(x, y, weight, np.random.default_rng(9), depth, leaf, split, 3)
    times = np.random.default_rng(9).poisson(1.0, len(x)).astype(float)
    got, want = tree.at_depths(x, [depth])[0], slow_tree(x, y, times, weight, depth, leaf, split)
    # Cuts between the same neighbours may differ where no row of the bootstrap lies between them.
    bag = times > 0
    assert np.allclose(got[bag], want[bag])


def test_deep_trees_begin_like_shallow_ones():
    x, y = made(400, 5, 2)
    weight = FO.balanced(y, 3)
    deep = FO.grow(x, y, weight, np.random.default_rng(3), 9, 2, 2, 2)
    for depth in (0, 1, 4, 7):
        shallow = FO.grow(x, y, weight, np.random.default_rng(3), depth, 2, 2, 2)
        assert np.allclose(shallow.at_depths(x, [depth])[0], deep.at_depths(x, [depth, 9])[0])


def frame(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, float(a), float(b), None if c < 0.05 else float(c), int((a > 0) + 2 * (b > 0.5))) for i, (a, b, c) in
            enumerate(zip(rng.normal(size=n), rng.normal(size=n), rng.random(n)))]
    return spark.createDataFrame(rows, "i long, a double, b double, c double, y int")


def test_fit_transform_save_and_repeat(spark, tmp_path):
    df = frame(spark)
    fit = lambda d, **kw: FO.fit_forest(d, ["a", "b", "c"], "y", n_trees=21, max_depth=8, max_features=2, **kw)
    model = fit(df.repartition(3), trees_per_group=5)
    out = model.transform(frame(spark, 300, 5))
    rows = out.collect()
    assert len(rows) == 300 and all(abs(sum(r["probability"]) - 1) < 1e-5 for r in rows)
    assert np.mean([r["prediction"] == r["y"] for r in rows]) > 0.9
    assert abs(sum(model.importances) - 1) < 1e-9 and model.importances[2] < min(model.importances[:2])
    key = lambda m: [t.cut.tolist() + t.column.tolist() for t in m.trees]
    assert key(fit(df.repartition(3), trees_per_group=8)) == key(model)       # however trees are dealt out
    FO.save_forest(spark, model, f"{tmp_path}/forest")
    again = FO.load_forest(spark, f"{tmp_path}/forest")
    assert [r["probability"] for r in again.transform(frame(spark, 300, 5)).orderBy("i").collect()] == [
        r["probability"] for r in out.orderBy("i").collect()]
    small = fit(df, rows_per_group=200)
    assert len(small.trees) == 21 and sum(len(t.cut) for t in small.trees) < sum(len(t.cut) for t in model.trees)


def test_search_equals_single_fits(spark):
    df = frame(spark, 400)
    folds = [(df.where("i < 200"), df.where("i >= 200 AND i < 300")), (df.where("i < 300"), df.where("i >= 300"))]
    settings = [{"n_trees": t, "max_depth": d, "min_split": s, "min_leaf": 2, "max_features": 2} for t in (3, 6) for d in (2, 5) for s in (5, 40)]
    got = FO.search_confusions(df, folds, ["a", "b", "c"], "y", settings).collect()
    assert len(got) == 2 * len(settings) * 16
    sizes = {}
    for r in got:
        sizes[r["setting"], r["fold"]] = sizes.get((r["setting"], r["fold"]), 0) + r["n"]
    assert set(sizes.values()) == {100} and len(sizes) == 16
    k, fold = settings.index({"n_trees": 6, "max_depth": 2, "min_split": 5, "min_leaf": 2, "max_features": 2}), 1
    train, test = folds[fold]
    edges = FO.bin_edges(train, ["a", "b", "c"])

    def arrays(d):
        t = FO.binned_rows(d, ["a", "b", "c"], "y", edges, []).toArrow()
        return FO._ordered(t)[:2]

    (x, y), (u, v) = arrays(train), arrays(test)
    p = sum(FO.grow(x, y, FO.balanced(y, 4), np.random.default_rng([42, fold, t]), 2, 2, 5, 2).at_depths(u, [2])[0] for t in range(6))
    want = np.bincount(v * 4 + p.argmax(axis=1), minlength=16)
    assert [r["n"] for r in sorted((r for r in got if (r["setting"], r["fold"]) == (k, fold)), key=lambda r: (r["y_true"], r["y_pred"]))] == want.tolist()


def test_summary_of_counts_equals_that_of_rows(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(f), int(y), int(p)) for f, y, p in rng.integers(0, [2, 4, 3], (200, 3))], "fold int, y int, p int")
    counts = M.confusion(df, by=["fold"])
    a, b = (sorted(map(tuple, d.select("fold", *[F.round(c, 9) for c in ("f1_macro", "f1_macro_fixed", "f1_weighted", "accuracy", "balanced_accuracy")],
                                       "n_rows").collect())) for d in (M.summary_of_counts(counts, ["fold"]), M.classification_summary(df, by=["fold"])))
    assert a == b


def test_scoring_walks_no_further_than_the_tree_and_sets_leaves_aside(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(0, FO.BINS, (3000, 5)).astype(np.uint8)
    y = (x[:, 0] // 9 + (x[:, 1] > x[:, 2])).astype(np.int64) % 4
    trees = [FO.grow(x, y, np.ones(4), np.random.default_rng(k), 9, 1, 2, 2) for k in range(3)]

    def plain(t, row):
        node, out = 0, [0]
        while t.child[node] > 0:
            node = t.child[node] + int(row[t.column[node]] > t.cut[node])
            out.append(node)
        return out

    for t in trees:
        paths = [plain(t, r) for r in x]
        depths = [0, 3, 5, 64]
        for d, nodes in zip(depths, t.nodes_at_depths(x, depths)):
            assert nodes.tolist() == [p[min(d, len(p) - 1)] for p in paths]
    monkeypatch.setattr(FO, "ROWS_AT_ONCE", 700)
    f = FO.Forest(list("abcde"), [np.arange(FO.BINS - 1)] * 5, trees)
    assert np.array_equal(f.probabilities(x), sum(t.at_depths(x, [9])[0] for t in trees) / 3)
    assert f.probabilities(x[:0]).shape == (0, 4)


def test_trees_grow_once_and_chunks_of_a_test_block_add_up(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(k, float(a), float(b), int((a > 0.5) + 2 * (b > 0.3))) for k, (a, b) in enumerate(rng.random((400, 2)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    folds = [(df.where("k < 200"), df.where("k >= 200"))]
    settings = [{"n_trees": t, "max_depth": d, "min_split": 2, "min_leaf": m, "max_features": 1} for t in (2, 4) for d in (2, 6) for m in (1, 3)]
    whole = FO.search_confusions(df, folds, ["a", "b"], "y", settings)
    parts = FO.search_confusions(df, folds, ["a", "b"], "y", settings, test_rows_per_group=30)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    # A sort behind the fits would run them twice, once to sample its input.
    monkeypatch.setattr(type(df), "orderBy", lambda *a, **k: pytest.fail("sorted in Spark"))
    assert len(FO.fit_forest(df, ["a", "b"], "y", n_trees=10, max_depth=3, trees_per_group=2).trees) == 10


def same_tree(a, b):
    return all(np.allclose(getattr(a, c), getattr(b, c)) for c in ("column", "cut", "child", "share", "gain"))


def test_every_tree_learns_from_all_rows(spark):
    """More rows than a group of trees once got (half a million of them)."""
    df = spark.range(510_000).selectExpr("CAST(pmod(xxhash64(id), 1000) AS double) AS a", "CAST(pmod(xxhash64(id, 1), 997) AS double) AS b",
                                         "CAST(pmod(xxhash64(id), 1000) > 400 AS int) + CAST(pmod(xxhash64(id, 2), 10) = 0 AS int) AS y")
    model = FO.fit_forest(df, ["a", "b"], "y", n_classes=3, n_trees=2, max_depth=3, min_leaf=5)
    x, y, _ = FO._ordered(FO.binned_rows(df, ["a", "b"], "y", model.edges, []).toArrow())
    assert len(y) == 510_000
    for k, tree in enumerate(model.trees):
        assert same_tree(tree, FO.grow(x, y, FO.balanced(y, 3), np.random.default_rng([42, k]), 3, 5, 2, 1))


def test_parts_strings_and_files_hold_all_rows_in_order(spark, monkeypatch):
    df = frame(spark, 700).unionByName(frame(spark, 700)).repartition(5)      # every row twice
    edges = FO.bin_edges(df, ["a", "b", "c"])
    rows = FO.binned_rows(df, ["a", "b", "c"], "y", edges, [])
    x, y, _ = FO._ordered(rows.toArrow())
    monkeypatch.setattr(FO, "ROWS_OF_A_PART", 90)
    monkeypatch.setattr(FO, "ROWS_OF_A_STRING", 16)
    packed, firsts, n = FO.packed_rows(rows, 1400, 3)
    strings = packed.orderBy("start").collect()
    packed.unpersist()
    assert n == 1400 and len(firsts) > 10 and max(r["n"] for r in strings) == 16
    for held in (1 << 20, 100):
        monkeypatch.setattr(FO, "BYTES_IN_MEMORY", held)
        got = FO.Rows(n, 3, firsts)
        for r in strings:
            got.put(*r)
        assert isinstance(got.x, np.memmap) == (held == 100)
        assert np.array_equal(got.x, x) and np.array_equal(got.y, y)


def test_rows_in_pieces_and_nodes_in_ranges_grow_the_same_tree(monkeypatch):
    x, y = made(3000, 6, 7)
    weight = FO.balanced(y, 3)
    whole = FO.grow(x, y, weight, np.random.default_rng(5), 14, 1, 2, 3)
    assert whole.child.size > 400
    for piece, nodes in ((100, 4096), (100_000, 7), (64, 5)):
        monkeypatch.setattr(FO, "ROWS_OF_A_PIECE", piece)
        monkeypatch.setattr(FO, "NODES_OF_A_RANGE", nodes)
        assert same_tree(whole, FO.grow(x, y, weight, np.random.default_rng(5), 14, 1, 2, 3))


def test_search_grows_the_trees_of_a_large_block_once_and_refits_without_a_model(spark, monkeypatch):
    df = frame(spark, 500)
    # In chunks of a quarter of a million test rows every chunk grew all trees again.
    assert inspect.signature(FO.search_confusions).parameters["test_rows_per_group"].default > 2_500_000
    train, test = df.where("i < 300"), df.where("i >= 300")
    setting = {"n_trees": 9, "max_depth": 24, "min_split": 5, "min_leaf": 1, "max_features": 2}
    pred = FO.fit_forest(train, ["a", "b", "c"], "y", **setting).transform(test)
    want = {(r["y"], int(r["prediction"])): r["n"] for r in pred.groupBy("y", "prediction").agg(F.count("*").alias("n")).collect()}
    monkeypatch.setattr(FO, "ROWS_AT_ONCE", 64)
    for each in (None, 2):
        got = FO.forest_confusion(train, test, ["a", "b", "c"], "y", **setting, trees_per_group=each)
        assert {(r["y_true"], r["y_pred"]): r["n"] for r in got.collect()} == want
    assert FO.forest_confusion(train, test.limit(0), ["a", "b", "c"], "y", **setting).count() == 0
