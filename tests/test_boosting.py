"""Boosted trees against a plain search of every split."""

import numpy as np
import pandas as pd

from granary.operators import boosting
from granary.operators.boosting import Boosting


def plain_tree(x, g, how, node=0, depth=0):
    """node -> (feature, cut, value) by trying every cut of every feature on the node's own rows."""
    total = g.sum() ** 2 / (len(g) + how.penalty)
    best = (how.least_gain, None, None)
    for f in range(x.shape[1] if depth < how.depth else 0):
        for cut in np.unique(x[:, f])[1:]:
            left = x[:, f] < cut
            gain = round(g[left].sum() ** 2 / (left.sum() + how.penalty) + g[~left].sum() ** 2 / ((~left).sum() + how.penalty) - total, 6)
            if gain > best[0]:
                best = (gain, f, cut)
    _, f, cut = best
    if f is None:
        return {node: (None, None, -how.rate * g.sum() / (len(g) + how.penalty))}
    left = x[:, f] < cut
    return {node: (f, cut, None)} | plain_tree(x[left], g[left], how, 2 * node + 1, depth + 1) | plain_tree(x[~left], g[~left], how, 2 * node + 2, depth + 1)


def paths(tree, x):
    """Leaf of every row, by following the cuts."""
    out = []
    for row in x:
        node = 0
        while tree[node][0] is not None:
            node = 2 * node + 1 + (row[tree[node][0]] >= tree[node][1])
        out.append(tree[node][2])
    return np.array(out)


def test_trees_equal_a_plain_search():
    rng = np.random.default_rng(3)
    for how in (Boosting(trees=3), Boosting(trees=2, depth=2, penalty=0.0, rate=1.0), Boosting(trees=1, least_gain=50.0)):
        x = np.stack([rng.integers(0, 30, 60), rng.normal(0, 1, 60), rng.integers(1, 13, 60), np.full(60, 2.0)], 1).astype(float)
        y = (x[:, 0] + 5 * (x[:, 2] > 6) + rng.normal(0, 1, 60)).round(1)
        rows = boosting.fit(x, y, how)
        predicted = np.full(60, y.mean())
        for t in range(how.trees):
            want = plain_tree(x, predicted - y, how)
            leaf = paths(want, x)
            got = {n: (f, c, v) for tree, n, f, c, v, _ in rows if tree == t}
            # Cuts of a node may lie anywhere between its values: the rows on either side count.
            assert {n for n, v in got.items() if v[0] is not None} == {n for n, v in want.items() if v[0] is not None}
            assert np.allclose(paths(got, x), leaf)
            predicted = predicted + leaf
        nodes = pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "value", "n"])
        assert np.allclose(boosting.predict(nodes, x), predicted)


def test_more_trees_fit_better_and_bins_are_bounded():
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (2000, 2))
    y = np.sin(3 * x[:, 0]) + x[:, 1] ** 2
    errors = []
    for trees in (1, 20, 100):
        nodes = pd.DataFrame(boosting.fit(x, y, Boosting(trees=trees, bins=32)), columns=["tree", "node", "feature", "cut", "value", "n"])
        errors.append(np.sqrt(np.mean((boosting.predict(nodes, x) - y) ** 2)))
        assert nodes.cut.dropna().nunique() <= 62
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.2
    assert boosting.fit(np.zeros((3, 1)), np.array([1.0, 2.0, 6.0]), Boosting(trees=1))[1:] == [(0, 0, None, None, 0.0, 3)]


def test_products(spark):
    rows = [(c, f"2024-01-{d + 1:02d}", d * k, float(d), float(d % 3), 1.0, 1, "train" if d < 15 else "test") for c, k in (("a", 2), ("b", 5), ("c", 1)) for d in range(20)]
    parts = spark.createDataFrame(rows, "stock_code string, week string, weekly_sales bigint, lag_1_week double, lag_2_week double, rolling_4_wk_avg double, month int, part string").withColumn("week", __import__("pyspark").sql.functions.to_timestamp_ntz("week"))
    models = boosting.fit_products(parts.where("stock_code != 'c' or part = 'test'"), Boosting(trees=60, rate=0.2))
    assert {r.stock_code for r in models.collect()} == {"a", "b"}
    got = boosting.predict_products(models, parts.where("part = 'test'")).collect()
    assert len(got) == 10 and all(abs(r.prediction - 14 * {"a": 2, "b": 5}[r.stock_code]) < 6 for r in got)
