"""K-Means with k-means++ starts, all starts in one pass over the points, and few passes for many steps.

Coordinates are whole millionths, so distances, sums, means and costs are exact: the same
points give the same clusters whatever their order or partitions, and SQL can repeat them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from granary.tables import written

#: Parts of one that coordinates are counted in.
UNIT = 1_000_000
#: Greatest coordinate, so that squared distances fit in 64 bits.
MOST = 100 * UNIT
#: Scales of ways, powers of two, that points are counted by; lower bits of squared distances, summed apart.
LEVELS, LOW = 32, 24
#: Most points of a start that one task takes steps with; a step is short at this part of the way that the others allow.
OPEN, SHORT = 250_000, 2

Center = tuple[int, ...]


def _far(columns: list[str], center: Center) -> Column:
    """Squared distance to a center."""
    parts = [(F.col(c) - F.lit(x)) * (F.col(c) - F.lit(x)) for c, x in zip(columns, center, strict=True)]
    return sum(parts[1:], parts[0])


def chances(seed: int, start: int, nth: int, keys: list[bytes]) -> np.ndarray:
    """A number between 0 and 1 for each key, the same whenever and wherever it is made."""
    prefix = f"{seed}:{start}:{nth}:".encode()
    digests = b"".join([hashlib.sha256(prefix + key).digest()[:4] for key in keys])
    return (np.frombuffer(digests, ">u4") + 0.5) / 4294967296.0


def plus_plus(points: DataFrame, columns: list[str], k: int, starts: int, seed: int) -> list[list[Center]]:
    """First centers of every start, each drawn in proportion to the squared distance from those before it.

    The least of exponential waiting times with these rates is such a draw, so an added
    center costs one pass over the points, for all starts together: each task sends its
    least for each start, and of these the least, the smaller key among equals, is drawn.
    Where all points are on centers already, the last center is repeated.
    """
    found: list[list[Center]] = [[] for _ in range(starts)]
    schema = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("wait", T.DoubleType()), T.StructField("key", T.StringType()), *(T.StructField(c, T.LongType()) for c in columns)])
    target, narrow = to_arrow_schema(schema), points.select("key", *columns)

    def draw(nth: int, chosen: list[list[Center]]) -> dict[int, Center]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least: dict[int, tuple] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                xs = [batch.column(c).to_numpy() for c in columns]
                keys = batch.column("key").cast(pa.binary()).to_pylist()
                for s, centers in enumerate(chosen):
                    rate = nearest(xs, centers)[1].astype(np.float64) if centers else np.ones(len(keys))
                    with np.errstate(divide="ignore"):
                        wait = np.where(rate > 0, -np.log(chances(seed, s, nth, keys)) / rate, np.inf)
                    if (first := wait.min()) < np.inf:
                        i = min(np.flatnonzero(wait == first), key=lambda i: keys[i])
                        mine = (float(first), keys[i], *(int(x[i]) for x in xs))
                        least[s] = min(least.get(s, mine), mine)
            if least:
                rows = [(s, wait, key.decode(), *x) for s, (wait, key, *x) in least.items()]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

        drawn = narrow.mapInArrow(run, schema).groupBy("start").agg(F.min(F.struct("wait", "key", *columns)).alias("drawn")).collect()
        return {r.start: tuple(r.drawn[c] for c in columns) for r in drawn}

    for nth in range(k):
        drawn = draw(nth, [list(c) for c in found])
        if not drawn and not nth:
            raise ValueError("no points to cluster")
        for s, centers in enumerate(found):
            centers.append(drawn[s] if s in drawn else centers[-1])
    return found


def two_nearest(xs: list[np.ndarray], centers: list[Center]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of each point's nearest center, the first of equals, its squared distance, and that to the next one.

    Points come a coordinate at a time; with one center alone, the next is as far as can be.
    """
    at, second = np.zeros(len(xs[0]), np.int64), np.full(len(xs[0]), np.iinfo(np.int64).max)
    first = None
    for i, center in enumerate(centers):
        far = np.zeros(len(xs[0]), np.int64)
        for x, c in zip(xs, center, strict=True):
            off = x - c
            off *= off
            far += off
        if first is None:
            first = far
            continue
        at[far < first] = i
        second = np.minimum(second, np.maximum(first, far))
        first = np.minimum(first, far)
    return at, first, second


def nearest(xs: list[np.ndarray], centers: list[Center]) -> tuple[np.ndarray, np.ndarray]:
    return two_nearest(xs, centers)[:2]


def levels(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How far centers may move before a point can change to another: at least 2 ** (level - 1), for levels above 0.

    A point stays while its distances to both centers differ by more than twice the way of
    any center. One unit is taken off for the roots' rounding.
    """
    slack = (np.sqrt(second.astype(np.float64)) - np.sqrt(first.astype(np.float64))) / 2 - 1
    return np.clip(np.frexp(np.clip(slack, 0.0, 2.0**30))[1], 0, LEVELS - 1)


def _summed(xs: list[np.ndarray], group: np.ndarray, far: np.ndarray, groups: int) -> np.ndarray:
    """A row for each group: n, the squared distances' upper and lower part, sums of coordinates."""
    out = np.zeros((groups, 3 + len(xs)), np.int64)
    if len(group):
        order = np.argsort(group.astype(np.int16), kind="stable")
        put = group[order]
        begin = np.flatnonzero(np.concatenate([[True], put[1:] != put[:-1]]))
        parts = [np.ones(len(order), np.int64), far >> LOW, far & ((1 << LOW) - 1), *xs]
        out[put[begin]] = np.stack([np.add.reduceat(p[order], begin) for p in parts], 1)
    return out


def _sums(points: DataFrame, columns: list[str], centers: list[list[Center]]) -> list:
    """(start, cluster, level, n, high, low, sums of coordinates): each task adds up its own points, for all starts."""
    names = ("start", "cluster", "level", "n", "high", "low", *columns)
    schema, size = T.StructType([T.StructField(c, T.LongType()) for c in names]), len(centers[0]) * LEVELS
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centers), size, 3 + len(columns)), np.int64)
        for batch in batches:
            xs = [batch.column(c).to_numpy() for c in columns]
            for s, own in enumerate(centers):
                at, first, second = two_nearest(xs, own)
                total[s] += _summed(xs, at * LEVELS + levels(first, second), first, size)
        s, group = np.nonzero(total[:, :, 0])
        rows = [s, group // LEVELS, group % LEVELS, *total[s, group].T]
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in rows], schema=target)

    total = points.select(*columns).mapInArrow(run, schema)
    return total.groupBy("start", "cluster", "level").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names[3:])).collect()


def _mean(total: int, n: int) -> int:
    """total / n, to the nearest whole number, halves up."""
    return (2 * total + n) // (2 * n)


def _way(a: list[Center], b: list[Center]) -> float:
    """The longest way of a center from ``a`` to ``b``, rounded up."""
    return max(math.isqrt(sum((x - y) ** 2 for x, y in zip(p, q, strict=True))) + 1 if p != q else 0 for p, q in zip(a, b, strict=True))


def _moved(centers: list[Center], total: list[list[int]]) -> list[Center]:
    """Means of the clusters (n, cost, sums of coordinates); a cluster without points keeps its center."""
    return [tuple(_mean(x, n) for x in sums) if n else own for own, (n, _, *sums) in zip(centers, total, strict=True)]


def _shifted(fixed: list[list[int]], before: list[Center], centers: list[Center]) -> int:
    """Squared distances to ``centers`` of clusters whose squared distances to the centers ``before`` are known."""
    cost = 0
    for (n, far, *sums), a, b in zip(fixed, before, centers, strict=True):
        cost += far + sum(n * (y - x) ** 2 - 2 * (y - x) * (total - n * x) for x, y, total in zip(a, b, sums, strict=True))
    return cost


def settled(xs: list[np.ndarray], fixed: list[list[int]], before: list[Center], centers: list[Center], reach: float, steps: int) -> tuple[list[Center], int, int | None]:
    """Steps of one start on the points that may change, ``xs``; all others are in ``fixed``, sums by cluster.

    They hold while no center is further than ``reach`` from where it was ``before``. Returns
    the centers, the steps made, and the cost, or None if centers went too far to know it.
    """
    made = 0
    while _way(before, centers) <= reach:
        at, far = nearest(xs, centers)
        own = _summed(xs, at, far, len(centers)).tolist()
        total = [[n + m, 0, *(a + b for a, b in zip(sums, more, strict=True))] for (n, _, *sums), (m, _, _, *more) in zip(fixed, own, strict=True)]
        moved = _moved(centers, total)
        if moved == centers or made == steps:
            return centers, made, _shifted(fixed, before, centers) + sum((high << LOW) + low for _, high, low, *_ in own)
        centers, made = moved, made + 1
    return centers, made, None


def _settle(points: DataFrame, columns: list[str], tasks: dict[int, tuple]) -> dict[int, tuple[list[Center], int, int | None]]:
    """:func:`settled` for several starts side by side, each in a task of its own with at most ``OPEN`` points.

    ``tasks``: for each start its level, and the other arguments of :func:`settled`.
    """
    k = len(next(iter(tasks.values()))[2])
    some = T.StructType([T.StructField(c, T.LongType()) for c in ("start", *columns)])
    schema = T.StructType([T.StructField("start", T.LongType()), T.StructField("centers", T.ArrayType(T.LongType())), T.StructField("made", T.LongType()), T.StructField("cost", T.StringType())])
    open_, target = to_arrow_schema(some), to_arrow_schema(schema)

    def changing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [batch.column(c).to_numpy() for c in columns]
            for s, (level, _, before, *_) in tasks.items():
                _, first, second = two_nearest(xs, before)
                near = levels(first, second) <= level
                yield pa.RecordBatch.from_arrays([pa.array(np.full(near.sum(), s, np.int64)), *(pa.array(x[near]) for x in xs)], schema=open_)

    def run(table: pa.Table) -> pa.Table:
        s = table.column("start")[0].as_py()
        centers, made, cost = settled([table.column(c).to_numpy() for c in columns], *tasks[s][1:])
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(([s], [[x for c in centers for x in c]], [made], [None if cost is None else str(cost)]), target, strict=True)], schema=target)

    found = {}
    for r in points.select(*columns).mapInArrow(changing, some).groupBy("start").applyInArrow(run, schema).collect():
        d = len(columns)
        found[r.start] = [tuple(r.centers[i * d:(i + 1) * d]) for i in range(k)], r.made, None if r.cost is None else int(r.cost)
    none = [np.zeros(0, np.int64) for _ in columns]
    return {s: found[s] if s in found else settled(none, *rest) for s, (_, *rest) in tasks.items()}


def lloyd(points: DataFrame, columns: list[str], centers: list[list[Center]], steps: int) -> tuple[list[list[Center]], list[int]]:
    """Centers of every start once they stay where they are, or after so many steps, and their costs.

    A pass reads the points once, for all starts that still move, and makes a step; the driver
    gets rows for each start, cluster and level, the scale of the way that centers may go
    before a point can change to another. Once a step is short beside the way that all but
    ``OPEN`` points allow, the others' sums hold, and a second pass brings these few to a task
    for each start, which makes steps until the centers stay or have gone that way. So the
    number of passes does not follow the number of steps, and the result is that of full
    steps, exactly. A cluster without points keeps its center.
    """
    centers, costs, made = list(centers), [0] * len(centers), [0] * len(centers)
    moving = list(range(len(centers)))
    while moving:
        sums: dict[int, list] = {s: [] for s in moving}
        for r in _sums(points, columns, [centers[s] for s in moving]):
            sums[moving[r.start]].append((r.cluster, r.level, [int(r.n), (int(r.high) << LOW) + int(r.low), *(int(r[c]) for c in columns)]))
        still, tasks = [], {}
        for s in moving:
            def over(level: int, rows: list = sums[s], k: int = len(centers[s])) -> list[list[int]]:
                return [[sum(v) for v in zip([0] * (2 + len(columns)), *(x for c, at, x in rows if c == i and at > level), strict=True)] for i in range(k)]

            total, before = over(-1), centers[s]
            costs[s] = sum(far for _, far, *_ in total)
            moved = _moved(before, total)
            if moved == before or made[s] == steps:
                continue
            centers[s], made[s] = moved, made[s] + 1
            still.append(s)
            counts = [sum(x[0] for _, at, x in sums[s] if at <= level) for level in range(LEVELS)]
            level = sum(n <= OPEN for n in counts) - 1
            reach = 2.0**level if level < LEVELS - 1 else math.inf
            if level >= 0 and SHORT * _way(before, moved) <= reach:
                tasks[s] = (level, over(level), before, moved, reach, steps - made[s])
        moving = still
        if tasks:
            for s, (own, more, cost) in _settle(points, columns, tasks).items():
                centers[s], made[s] = own, made[s] + more
                if cost is not None:
                    costs[s] = cost
                    moving.remove(s)
    return centers, costs


def in_units(points: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Adds ``key`` as text, and the coordinates in whole millionths in columns u0, u1..."""
    units = [F.least(F.greatest(F.round(F.col(c), 6), F.lit(-100.0)), F.lit(100.0)) * float(UNIT) for c in columns]
    return points.select("*", F.col(key).cast("decimal(20,2)").cast("string").alias("key"), *(F.rint(u).cast("long").alias(f"u{i}") for i, u in enumerate(units)))


def k_means(points: DataFrame, columns: list[str], key: str, k: int = 4, starts: int = 10, seed: int = 42, steps: int = 300) -> tuple[DataFrame, float]:
    """``points`` with ``cluster`` by the best of several starts, and its cost (the sum of squared distances).

    Points are computed once and written; every pass reads only their coordinates. The
    earlier of equally good starts wins. Coordinates are bounded to 100 either way.
    """
    table = written(in_units(points, columns, key), "points")
    units = [f"u{i}" for i in range(len(columns))]
    narrow = table.select("key", *units)
    centers, costs = lloyd(narrow, units, plus_plus(narrow, units, k, starts, seed), steps)
    best = min(range(starts), key=lambda s: (costs[s], s))
    ranked = F.array(*(F.struct(_far(units, c).alias("far"), F.lit(i).alias("i")) for i, c in enumerate(centers[best])))
    return table.select(*points.columns, F.array_min(ranked)["i"].alias("cluster")), costs[best] / UNIT**2
