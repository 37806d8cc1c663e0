"""Several k-means runs over the same rows at a time: every pass reads the rows once for all runs that still move.

Rows are stored once as blocks, the doubles of some hundred rows after one another, so a pass is matrix arithmetic in the tasks,
and what leaves a task are sums per centre. Starts are found as in k-means||: rows are drawn with weights of their squared distance from those
drawn before (exponential keys, the smallest of which win), the drawn rows are weighted by the rows nearest to them, and k-means++ follows on these few.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.columns import numeric_matrix
from tabwright.session import materialise, spread

#: Bytes of a stored block; numbers of a matrix that is worked on at once; rounds of a start; steps on the drawn rows.
_BLOCK, _AT_ONCE, _ROUNDS, _LOCAL_STEPS = 8192, 1 << 18, 2, 30


@dataclass
class Points:
    """Stored rows (no, x) as blocks, how many there are, and their columns' moments."""

    features: list[str]
    blocks: DataFrame
    n: int
    means: list[float]
    variances: list[float]

    @property
    def width(self) -> int:
        return len(self.features)

    def step(self, tol: float, k: int) -> float:
        """How far a centre may still move at the end: ``tol`` times the mean variance of the columns, shared out as a squared distance."""
        return float(np.sqrt(tol * np.mean(self.variances) / k))


@dataclass
class Run:
    """Centres of one run, the rows nearest to each and what they cost."""

    centers: np.ndarray
    sizes: np.ndarray
    totals: np.ndarray
    cost: float
    iterations: int = 0


def moments(rows: DataFrame, features: Sequence[str]) -> tuple[int, list[float], list[float]]:
    """Number of rows, mean and population variance of each column, in one pass."""
    parts = [f(c).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("v", F.var_pop))]
    r = rows.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return r["n"], [r[f"m{i}"] or 0.0 for i in range(len(features))], [r[f"v{i}"] or 0.0 for i in range(len(features))]


def store_points(df: DataFrame, features: Sequence[str]) -> Points:
    """The features of every row, missing and infinite values as 0, in blocks less their means."""
    rows = numeric_matrix(df.select(*features)).select(*[F.col(f).cast("double").alias(f) for f in features])
    n, means, variances = moments(rows, features)
    middle, per = np.array(means), max(1, _BLOCK // (8 * len(features)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - middle
            yield pa.RecordBatch.from_arrays([pa.array([x[k : k + per].tobytes() for k in range(0, len(x), per)], pa.binary())], ["x"])

    packed = spread(rows).mapInArrow(pack, "x binary")
    blocks = materialise(packed.select(F.monotonically_increasing_id().alias("no"), "x"), "points")
    return Points(list(features), blocks, n, means, variances)


def _slices(batches: Iterator[pa.RecordBatch], width: int, columns: int) -> Iterator[tuple[np.ndarray, list[int], np.ndarray]]:
    """Some blocks at a time: their numbers, their rows' counts, and the rows."""
    for b in batches:
        per = max(1, len(b.column(1)[0].as_py()) // (8 * width)) if b.num_rows else 1
        some = max(1, _AT_ONCE // (per * max(columns, width)))
        for k in range(0, b.num_rows, some):
            held = b.column(1).slice(k, some).to_pylist()
            x = np.frombuffer(b"".join(held)).reshape(-1, width)
            yield b.column(0).slice(k, some).to_numpy(), [len(h) // (8 * width) for h in held], x


def _row(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.astype(float).tobytes()], pa.binary())], ["part"])


def _mixed(h: np.ndarray) -> np.ndarray:
    for times, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(31))


def _gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances less the rows' own squares, a line per centre."""
    return (-2 * centers) @ x.T + (centers * centers).sum(1)[:, None]


def _nearest(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per column the least value and its first line."""
    least, at = gaps[0].copy(), np.zeros(gaps.shape[1], np.int32)
    for i in range(1, len(gaps)):
        at[gaps[i] < least] = i
        np.minimum(least, gaps[i], out=least)
    return least, at


def _draw(points: Points, pools: list[np.ndarray], seeds: list[int], want: int) -> list[np.ndarray]:
    """Per pool up to ``want`` more rows, drawn with weights of their squared distance from the pool (all alike if it is empty)."""
    width = points.width

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = [np.empty(0)] * len(pools), [np.empty((0, width))] * len(pools)
        for no, sizes, x in _slices(batches, width, max(1, *map(len, pools))):
            own = (x * x).sum(1)
            place = np.concatenate([np.arange(s, dtype=np.uint64) for s in sizes])
            number = np.repeat(_mixed(no.astype(np.uint64) + np.uint64(1)), sizes) + place
            for i, (pool, seed) in enumerate(zip(pools, seeds)):
                away = np.ones(len(x))
                if len(pool):
                    away = own + _nearest(_gaps(x, pool))[0]
                    away[away <= 1e-12 * (own + (pool * pool).sum(1).max())] = 0  # a row of the pool
                even = (_mixed(number ^ _mixed(np.array([seed], np.uint64))) >> np.uint64(11)).astype(float) + 0.5
                with np.errstate(divide="ignore"):
                    key = -np.log(even * 2.0**-53) / away
                last = keys[i].max() if len(keys[i]) == want else np.inf
                met = np.flatnonzero(key < last)
                if len(met):
                    both, all_rows = np.concatenate([keys[i], key[met]]), np.concatenate([rows[i], x[met]])
                    kept = np.argsort(both, kind="stable")[:want]
                    keys[i], rows[i] = both[kept], all_rows[kept]
        order = np.repeat(np.arange(len(pools), dtype=float), [len(k) for k in keys])
        yield _row(np.column_stack([order, np.concatenate(keys), np.concatenate(rows)]))

    offered = [np.frombuffer(r["part"]).reshape(-1, width + 2) for r in points.blocks.mapInArrow(gather, "part binary").collect()]
    every = np.concatenate([np.empty((0, width + 2)), *offered])  # ``want`` rows per pool and task
    every = every[np.argsort(every[:, 1], kind="stable")]
    return [np.unique(np.vstack([p, every[every[:, 0] == i][:want, 2:]]), axis=0) for i, p in enumerate(pools)]


def sums(points: Points, centers: list[np.ndarray]) -> list[Run]:
    """Every run's rows under its centres: their number, sum and sum of squares (last column) per centre, and their cost; one pass."""
    width, ks = points.width, [len(c) for c in centers]
    ends = np.cumsum(ks).tolist()
    every = np.concatenate(centers)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, cost = np.zeros(len(every), np.int64), np.zeros((len(every), width + 1)), np.zeros(len(every))
        for _, _, x in _slices(batches, width, len(every)):
            own = (x * x).sum(1)
            wide, gaps = np.column_stack([x, own]), _gaps(x, every)
            place = np.empty(gaps.shape)
            for k, end in zip(ks, ends):
                least, at = _nearest(gaps[end - k : end])
                cost[end - k] += float(np.maximum(own + least, 0.0).sum())
                count[end - k : end] += np.bincount(at, minlength=k)
                place[end - k : end] = at == np.arange(k)[:, None]
            total += place @ wide
        yield _row(np.column_stack([count, cost, total]))

    # A task's sums are one row; a count stays exact as a double.
    parts = [np.frombuffer(r["part"]) for r in points.blocks.mapInArrow(gather, "part binary").collect()]
    added = np.sum(parts, axis=0).reshape(len(every), width + 3) if parts else np.zeros((len(every), width + 3))
    count, cost, total = added[:, 0].astype(np.int64), added[:, 1], added[:, 2:]
    return [Run(c, count[e - k : e], total[e - k : e], float(cost[e - k])) for c, k, e in zip(centers, ks, ends)]


def _begin(pool: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Start of ``k`` centres from the weighted rows of a pool: k-means++ and some steps on them; the whole pool if it has no more."""
    if len(pool) <= k:
        return pool
    rng = np.random.default_rng([seed, k])
    weight = np.maximum(weight, 1).astype(float)
    chosen = [int(rng.choice(len(pool), p=weight / weight.sum()))]
    away = ((pool - pool[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(int(rng.choice(len(pool), p=weight * away / (weight * away).sum())))
        away = np.minimum(away, ((pool - pool[chosen[-1]]) ** 2).sum(1))
    centers = pool[chosen]
    for _ in range(_LOCAL_STEPS):
        at = ((pool[:, None] - centers) ** 2).sum(2).argmin(1)
        held = np.array([weight[at == i].sum() for i in range(k)])
        new = np.array([np.average(pool[at == i], axis=0, weights=weight[at == i]) if held[i] else centers[i] for i in range(k)])
        if (new == centers).all():
            break
        centers = new
    return centers


def run_together(points: Points, jobs: Sequence[tuple[int, int]], max_iter: int, tol: float) -> list[Run]:
    """k-means for every (k, seed), each from its own start, until no centre moves further than the tolerance or ``max_iter`` steps are done.

    Jobs of one seed share the rows drawn for their starts. Centres are relative to the points' means; a centre without rows stays.
    """
    seeds, most = sorted({s for _, s in jobs}), max(k for k, _ in jobs)
    pools = _draw(points, [np.empty((0, points.width))] * len(seeds), [s << 8 for s in seeds], 1)
    for r in range(_ROUNDS):
        pools = _draw(points, pools, [(s << 8) + 1 + r for s in seeds], 2 * most)
    weights = {s: run for s, run in zip(seeds, sums(points, pools))}
    centers = [_begin(weights[s].centers, weights[s].sizes, k, s) for k, s in jobs]
    done, live = [0] * len(jobs), list(range(len(jobs)))
    for _ in range(max_iter):
        moving = []
        for i, met in zip(live, sums(points, [centers[i] for i in live])):
            new = np.where(met.sizes[:, None] > 0, met.totals[:, :-1] / np.maximum(met.sizes, 1)[:, None], centers[i])
            moved = ((new - centers[i]) ** 2).sum(1).max()
            centers[i], done[i] = new, done[i] + 1
            if moved > points.step(tol, jobs[i][0]) ** 2:
                moving.append(i)
        live = moving
        if not live:
            break
    out = sums(points, centers)
    for run, steps in zip(out, done):
        run.iterations = steps
    return out


def silhouettes(points: Points, runs: list[Run]) -> list[float]:
    """Mean silhouette of squared distances of all rows under each run, which has several clusters with rows; one pass.

    The mean squared distance from a cluster follows from its size, sum and sum of squares.
    """
    width = points.width
    met = [(r.centers[r.sizes > 0], r.sizes[r.sizes > 0].astype(float), r.totals[r.sizes > 0]) for r in runs]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(met))
        for _, _, x in _slices(batches, width, max(len(c) for c, _, _ in met)):
            own, column = (x * x).sum(1), np.arange(len(x))
            for i, (centers, size, total) in enumerate(met):
                at = _nearest(_gaps(x, centers))[1]
                away = own + (total[:, -1] / size)[:, None] - (2 * total[:, :-1] / size[:, None]) @ x.T
                inner = np.maximum(away[at, column], 0.0) * (size / np.maximum(size - 1, 1))[at]
                away[at, column] = np.inf
                outer = np.maximum(away.min(0), 0.0)
                most = np.maximum(inner, outer)
                value = np.divide(outer - inner, most, out=np.zeros(len(x)), where=most > 0)
                found[i] += value[size[at] > 1].sum()
        yield _row(found)

    parts = [np.frombuffer(r["part"]) for r in points.blocks.mapInArrow(gather, "part binary").collect()]  # one row per task
    return (np.sum(parts, axis=0) / points.n).tolist()
