"""K-Means: draws of first centers, exactness, the best of all starts against plain runs."""

import hashlib
import math

import numpy as np
import pytest

from granary.operators import segmenting

COLUMNS = ["x", "y"]


def points(spark, rows):
    return spark.createDataFrame([(float(i), float(x), float(y)) for i, (x, y) in enumerate(rows)], "id double, x double, y double")


def plain(xs, centers):
    """Lloyd's steps in whole numbers, one start."""
    centers = [tuple(map(int, c)) for c in centers]
    while True:
        own = [min(range(len(centers)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(x, centers[i], strict=True)), i)) for x in xs]
        moved = []
        for i, c in enumerate(centers):
            mine = [x for x, o in zip(xs, own, strict=True) if o == i]
            moved.append(tuple((2 * sum(v) + len(mine)) // (2 * len(mine)) for v in zip(*mine, strict=True)) if mine else c)
        if moved == centers:
            return centers, sum(sum((a - b) ** 2 for a, b in zip(x, centers[o], strict=True)) for x, o in zip(xs, own, strict=True))
        centers = moved


def test_starts_are_drawn_by_squared_distance(spark):
    """Of 600 starts from one place, the second center is the point three away nine times as often as the one a unit away."""
    df = segmenting.in_units(points(spark, [(0, 0), (1, 0), (0, 3)]), COLUMNS, "id").cache()
    found = segmenting.plus_plus(df, ["u0", "u1"], 2, 300, 1)
    first = [c[0] for c in found]
    assert 60 < first.count((0, 0)) < 140
    second = [c[1] for c in found if c[0] == (0, 0)]
    assert (0, 0) not in second and 0.8 < second.count((0, 3 * segmenting.UNIT)) / len(second) < 0.97


def test_all_starts_equal_plain_runs(spark):
    rng = np.random.default_rng(7)
    rows = rng.normal(0, 2, (90, 2)).round(3)
    df = points(spark, rows)
    units = segmenting.in_units(df.repartition(5), COLUMNS, "id").cache()
    xs = [(int(r.u0), int(r.u1)) for r in units.collect()]
    starts = segmenting.plus_plus(units, ["u0", "u1"], 4, 5, 42)
    centers, costs = segmenting.lloyd(units, ["u0", "u1"], starts, 300)
    assert [(c, k) for c, k in zip(centers, costs, strict=True)] == [plain(xs, s) for s in starts]
    one, cost = segmenting.k_means(df, COLUMNS, "id", starts=5)
    two, same = segmenting.k_means(df.repartition(3), COLUMNS, "id", starts=5)
    assert cost == same == min(costs) / segmenting.UNIT**2 and sorted(one.collect()) == sorted(two.collect())


def test_edges(spark):
    """Fewer different points than clusters, repeated points, none at all."""
    out, cost = segmenting.k_means(points(spark, [(1, 1)] * 5 + [(2, 2)]), COLUMNS, "id", starts=2)
    assert cost == 0 and len({r.cluster for r in out.collect()}) == 2
    with pytest.raises(ValueError):
        segmenting.k_means(points(spark, [(1, 1)]).limit(0), COLUMNS, "id")


@pytest.mark.parametrize("open_points", [0, 150, 600, 10_000])
def test_few_passes_make_many_steps(spark, monkeypatch, open_points):
    """Steps on the points that may change are full steps, exactly, and passes do not follow their number."""
    monkeypatch.setattr(segmenting, "OPEN", open_points, raising=False)
    passes, sums = [], segmenting._sums
    monkeypatch.setattr(segmenting, "_sums", lambda *args: passes.append(1) or sums(*args))
    rows = np.random.default_rng(3).uniform(-1, 1, (2000, 2)).round(2)  # many points alike, many at equal distances
    units = segmenting.in_units(points(spark, rows).repartition(4), COLUMNS, "id").cache()
    xs = [(int(r.u0), int(r.u1)) for r in units.collect()]
    starts = [[(0, 0), (10_000, 0), (0, 10_000), (10_000, 10_000)], [(-900_000, -900_000), (-890_000, -900_000), (-900_000, -880_000), (5_000_000, 0)]]
    centers, costs = segmenting.lloyd(units, ["u0", "u1"], starts, 300)
    assert list(zip(centers, costs, strict=True)) == [plain(xs, s) for s in starts]
    steps = next(n for n in range(300) if stepped(xs, starts[1], n) == centers[1])
    assert steps > 12
    if open_points >= 600:
        assert len(passes) <= steps / 2
    few, _ = segmenting.lloyd(units, ["u0", "u1"], starts, 7)
    assert few[1] == stepped(xs, starts[1], 7)


def stepped(xs, centers, steps):
    """Centers after so many steps."""
    xs, centers = np.array(xs), [tuple(map(int, c)) for c in centers]
    for _ in range(steps):
        own = np.array([((xs - c) ** 2).sum(1) for c in centers]).argmin(0)
        centers = [tuple(int((2 * v.sum() + len(v)) // (2 * len(v))) for v in xs[own == i].T) if (own == i).any() else c for i, c in enumerate(centers)]
    return centers


def test_draws_are_those_of_the_formula(spark):
    """The least waiting time over all partitions, by SHA-256 of seed, start, place and key."""
    rows = np.random.default_rng(5).normal(0, 1, (300, 2)).round(3)
    units = segmenting.in_units(points(spark, rows).repartition(7), COLUMNS, "id").cache()
    table = [(r.key, (r.u0, r.u1)) for r in units.collect()]
    want = []
    for s in range(3):
        drawn = []
        for nth in range(4):
            def wait(row):
                chance = (int(hashlib.sha256(f"42:{s}:{nth}:{row[0]}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
                rate = min(sum((a - b) ** 2 for a, b in zip(row[1], c, strict=True)) for c in drawn) if drawn else 1
                return (-math.log(chance) / rate if rate else math.inf, row[0])

            drawn.append(min(table, key=wait)[1])
        want.append(drawn)
    assert segmenting.plus_plus(units, ["u0", "u1"], 4, 3, 42) == want
