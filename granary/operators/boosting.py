"""Second-order gradient boosted trees, one model for each product.

Trees grow level by level on histograms: gradients and Hessians of squared error are
summed by node, feature and bin, and a node is split where

    GL² / (HL + penalty) + GR² / (HR + penalty) - G² / (H + penalty)

is greatest; a leaf adds ``rate`` times -G / (H + penalty). A product's rows, one a
calendar week at most, meet in one task; products are spread over all tasks, and models
are rows (one for each node), so they are stored, read and joined like other tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from granary.operators.demand import by_product

FEATURES = ("lag_1_week", "lag_2_week", "rolling_4_wk_avg", "month")
#: Gains are compared to so many places, so that equal splits are equal in any order of the sums.
PLACES = 6
NODES = "stock_code string, tree int, node int, feature int, cut double, value double, n bigint"
PREDICTED = "stock_code string, week timestamp_ntz, weekly_sales bigint, prediction double"


@dataclass(frozen=True)
class Boosting:
    trees: int = 100
    rate: float = 0.05
    depth: int = 4
    penalty: float = 1.0
    least_weight: float = 1.0
    least_gain: float = 1e-6
    bins: int = 256


def cuts_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Values that rows are divided at (below, and from them on): all but the least, or quantiles if there are too many."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(values[np.linspace(0, len(values) - 1, bins).round().astype(int)])
    return values[1:]


def grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, how: Boosting) -> tuple[list[tuple], np.ndarray]:
    """One tree's nodes (node, feature, cut, value, rows), and the leaf value of every row.

    Node 0 is the root, and 2i + 1 (below the cut) and 2i + 2 are the children of node i.
    ``binned`` has for each row and feature how many cuts its value reaches.
    """
    node = np.zeros(len(g), np.int64)
    width = max(len(c) for c in cuts) + 1
    out, value, level = [], np.zeros(len(g)), np.array([0])
    for depth in range(how.depth + 1):
        if not len(level):
            break
        place = np.full(level[-1] + 1, -1)
        place[level] = np.arange(len(level))
        active = np.flatnonzero(np.isin(node, level))
        at = place[node[active]]
        n, sum_g, sum_h = (np.bincount(at, w, len(level)) for w in (None, g[active], h[active]))
        split = np.full(len(level), -1)
        if depth < how.depth:
            gains = np.full((len(level), len(cuts), width), -np.inf)
            for f, c in enumerate(cuts):
                if len(c):
                    key = at * width + binned[active, f]
                    left_g, left_h = (np.cumsum(np.bincount(key, w[active], len(level) * width).reshape(len(level), width), 1)[:, : len(c)] for w in (g, h))
                    right_g, right_h = sum_g[:, None] - left_g, sum_h[:, None] - left_h
                    fits = (left_h >= how.least_weight) & (right_h >= how.least_weight)
                    left_h, right_h = np.where(fits, left_h, 1.0), np.where(fits, right_h, 1.0)
                    gain = left_g**2 / (left_h + how.penalty) + right_g**2 / (right_h + how.penalty) - (sum_g**2 / (sum_h + how.penalty))[:, None]
                    gains[:, f, : len(c)] = np.where(fits, np.round(gain, PLACES), -np.inf)
            flat = gains.reshape(len(level), -1)
            best = flat.argmax(1)  # the first of equals: the first feature, the least cut
            split = np.where(flat[np.arange(len(level)), best] > how.least_gain, best, -1)
        following = []
        for k, (i, s) in enumerate(zip(level.tolist(), split.tolist(), strict=True)):
            leaf = -how.rate * sum_g[k] / (sum_h[k] + how.penalty)
            if s < 0:
                out.append((i, None, None, leaf, int(n[k])))
                value[active[at == k]] = leaf
            else:
                f, b = divmod(s, width)
                out.append((i, f, float(cuts[f][b]), None, int(n[k])))
                mine = active[at == k]
                node[mine] = 2 * i + 1 + (binned[mine, f] > b)
                following += [2 * i + 1, 2 * i + 2]
        level = np.array(following, np.int64)
    return out, value


def fit(x: np.ndarray, y: np.ndarray, how: Boosting) -> list[tuple]:
    """(tree, node, feature, cut, value, rows) of all trees; tree -1 is the mean that they begin from."""
    base = float(y.mean())
    out, predicted = [(-1, 0, None, None, base, len(y))], np.full(len(y), base)
    cuts = [cuts_of(c, how.bins) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)], 1)
    for t in range(how.trees):
        nodes, value = grow(binned, cuts, predicted - y, np.ones(len(y)), how)
        predicted += value
        out += [(t, *row) for row in nodes]
    return out


def predict(nodes: pd.DataFrame, x: np.ndarray) -> np.ndarray:
    """Sum of all trees' leaves: every row goes down all trees at once."""
    trees = nodes[nodes.tree >= 0]
    base = nodes.loc[nodes.tree < 0, "value"].sum()
    if trees.empty:
        return np.full(len(x), base)
    size = int(trees.node.max()) + 1
    n = int(trees.tree.max()) + 1
    feature, cut, value = np.full((n, size), -1), np.full((n, size), np.nan), np.zeros((n, size))
    place = trees.tree.to_numpy(), trees.node.to_numpy()
    feature[place] = trees.feature.fillna(-1).to_numpy(int)
    cut[place], value[place] = trees.cut.to_numpy(float), trees.value.fillna(0.0).to_numpy(float)
    tree, at = np.arange(n)[None, :], np.zeros((len(x), n), np.int64)
    while (inner := feature[tree, at] >= 0).any():
        f = np.maximum(feature[tree, at], 0)
        at = np.where(inner, 2 * at + 1 + (x[np.arange(len(x))[:, None], f] >= cut[tree, at]), at)
    return base + value[tree, at].sum(1)


def fit_products(parts: DataFrame, how: Boosting = Boosting()) -> DataFrame:
    """Models of all products from their train rows, a row for each node. Products without train rows have none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("week")
        out = pd.DataFrame(fit(rows[list(FEATURES)].to_numpy(float), rows.weekly_sales.to_numpy(float), how), columns=["tree", "node", "feature", "cut", "value", "n"])
        return out.assign(stock_code=rows.stock_code.iloc[0], feature=out.feature.astype("Int32"))[["stock_code", "tree", "node", "feature", "cut", "value", "n"]]

    return by_product(parts.where("part = 'train'").select("stock_code", "week", "weekly_sales", *FEATURES)).groupBy("stock_code").applyInPandas(run, NODES)


def predict_products(models: DataFrame, rows: DataFrame) -> DataFrame:
    """Predictions of ``rows`` by the models of their products; rows without a model go."""

    def run(own: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if own.empty or nodes.empty:
            return pd.DataFrame(columns=["stock_code", "week", "weekly_sales", "prediction"])
        return own[["stock_code", "week", "weekly_sales"]].assign(prediction=predict(nodes, own[list(FEATURES)].to_numpy(float)))

    asked = rows.select("stock_code", "week", "weekly_sales", *FEATURES)
    return asked.groupBy("stock_code").cogroup(models.groupBy("stock_code")).applyInPandas(run, PREDICTED)
