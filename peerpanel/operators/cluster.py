"""K-means, elbow sweep, nearest-centre assignment, two-component projection (M3-M7).

The rows are first reduced to distinct vectors with their numbers, written once to the cluster's shared checkpoint
folder: copies cost nothing, and no result depends on how rows are partitioned or ordered.

Starting centres (k-means||, Bahmani et al. 2012): over all vectors, a few rounds draw candidates with probability by number
and squared distance to the candidates so far; each candidate is weighted by the rows nearest
to it, and k-means++ runs on the weighted candidates only.  A draw is a race: a vector's time is a
uniform number from its hash, the seed and the round, turned exponential with its rate, and the first ones win, so a
round is one pass and draws as many as it should.

All fits of a call (every k with every restart) run in one loop: an iteration is one pass in which tasks assign their
rows and emit sums, which Spark adds up.  A row keeps, per fit, its centre, an upper bound of the distance to it and a
lower bound of the distance to any other (Hamerly 2010).  Bounds are written with the rows after the 1st, 2nd, 4th, 8th .. pass; in
between they widen by what the centres moved since.  A row whose bounds do not meet keeps its centre
and is not compared.  Written rows are packed, a few at a time in a binary value, and later passes add up only the rows that
changed their centre since.

Components come from block Krylov iteration on rows that are centred algebraically, so sparse rows stay sparse.  What
reaches the driver is model sized: candidates, k centres of d numbers for each fit, a few blocks of d x (k + 10) numbers.
"""

from __future__ import annotations

import sys
import uuid
import warnings
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._names import col
from ..session import cut_lineage, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Rounds of drawing, and candidates of a round for each centre of the largest k.
ROUNDS, OVERSAMPLE = 4, 2
#: Bounds are single precision, moved apart by this share.
SLACK = 1e-6
#: Numbers of vectors that are packed into one binary value, so that a batch of such values stays small.
PACK = 256
#: Centres up to which sums are a product of matrices, and share of the rows to be compared from which all are.
FEW, MANY = 64, 0.5
_STATE = "x binary, n binary, near binary, upper binary, lower binary"
_SUMS = "fit int, sums array<double>"
_NAMES = ["x", "n", "near", "upper", "lower", "fit", "sums"]


@dataclass
class Fit:
    """One (k, seed): its centres, their inertia, whether it converged, and the distances each pass computed."""

    k: int
    seed: int
    centres: np.ndarray
    cost: float = float("inf")
    converged: bool = False
    iterations: int = 0
    distances: list[int] = field(default_factory=list)


def _vectors(df: DataFrame, features: str) -> DataFrame:
    """Distinct vectors as arrays ``x`` with their number of rows ``n``, written once.  A NaN raises: it would
    spoil every centre."""
    x = F.transform(vector_to_array(F.col(features)), lambda v: v + F.lit(0.0))  # -0.0 and 0.0 are equal
    bad = F.raise_error(F.lit(f"k-means: {features} holds NaN; fill missing values first"))
    out = df.select(F.when(F.exists(x, lambda v: F.isnan(v)), bad).otherwise(x).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(out.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, a column per centre."""
    out = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]
    return np.maximum(out, 0, out=out)


def _mean(data: DataFrame) -> np.ndarray:
    """The mean vector."""
    each = data.select("n", F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum(F.col("v") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    return np.array([r["s"] / r["n"] for r in sorted(each.collect())], float)


def _uniform(hashes: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """A number in (0, 1) for each hash, another for each seed and round."""
    x = hashes.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + round_ * 0xD1342543DE82EF95 + 1) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2.0**-54


def candidates(data: DataFrame, seeds: Sequence[int], k: int, mean: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each seed, vectors drawn from all of ``data`` (less the mean) and the rows nearest to each."""
    context = data.sparkSession.sparkContext
    hashed = data.select("x", "n", F.xxhash64("x").alias("h"))
    chosen = {s: np.zeros((0, len(mean))) for s in seeds}
    for round_ in range(ROUNDS + 1):
        most = OVERSAMPLE * k if round_ else 1
        shared = context.broadcast((chosen, mean))

        def race(batches: Iterator[pa.RecordBatch], shared=shared, round_=round_, most=most) -> Iterator[pa.RecordBatch]:
            sets, shift = shared.value
            first: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, n = _matrix(batch.column(0)) - shift, batch.column(1).to_numpy().astype(float)
                for s, c in sets.items():
                    rate = n * (_squares(x, c).min(axis=1) if len(c) else 1.0)
                    with np.errstate(divide="ignore"):
                        time = np.where(rate > 1e-18, -np.log(_uniform(batch.column(2).to_numpy(), s, round_)) / rate, np.inf)
                    best = np.argsort(time, kind="stable")[:most]
                    best = best[np.isfinite(time[best])]
                    times, rows = first.get(s, (np.zeros(0), np.zeros((0, x.shape[1]))))
                    times, rows = np.concatenate([times, time[best]]), np.concatenate([rows, x[best]])
                    keep = np.argsort(times, kind="stable")[:most]
                    first[s] = times[keep], rows[keep]
            for s, (times, rows) in first.items():
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(times), pa.int64()), pa.array(times), pa.array(list(rows), pa.list_(pa.float64()))], ["seed", "time", "x"])

        order = Window.partitionBy("seed").orderBy("time", "x")  # at most ``most`` rows a seed and task
        won = hashed.mapInArrow(race, "seed long, time double, x array<double>").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        rows: dict[int, list] = {}
        for r in sorted(won.collect(), key=lambda r: (r["seed"], r["rank"])):
            rows.setdefault(r["seed"], []).append(r["x"])
        chosen = {s: np.concatenate([c, np.array(rows[s], float)]) if s in rows else c for s, c in chosen.items()}

    shared = context.broadcast((chosen, mean))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, shift = shared.value
        weights = {s: np.zeros(len(c)) for s, c in sets.items()}
        for batch in batches:
            if batch.num_rows:
                x, n = _matrix(batch.column(0)) - shift, batch.column(1).to_numpy()
                for s, c in sets.items():
                    weights[s] += np.bincount(_squares(x, c).argmin(axis=1), n, len(c))
        yield pa.RecordBatch.from_arrays([pa.array(list(weights), pa.int32()), pa.array(list(weights.values()), pa.list_(pa.float64()))], ["fit", "sums"])

    weights = _added(data.select("x", "n").mapInArrow(weigh, _SUMS))
    return {s: (c, weights[s]) for s, c in chosen.items()}


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """The tasks' arrays added up by Spark, for each ``fit``."""
    each = parts.select("fit", F.posexplode("sums").alias("at", "v")).groupBy("fit", "at").agg(F.sum("v").alias("v")).toArrow()
    fit, at, v = (each.column(c).to_numpy() for c in ("fit", "at", "v"))
    out = {int(f): np.zeros(int(at[fit == f].max()) + 1) for f in np.unique(fit)}
    for f, values in out.items():
        values[at[fit == f]] = v[fit == f]
    return out


def start(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ on the candidates, then a few steps of weighted k-means on them.

    Of several draws for a centre the one that helps most is taken; the centres are distinct."""
    rng = np.random.default_rng(seed)
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    nearest = _squares(points, chosen[0][None, :])[:, 0]
    nearest[(points == chosen[0]).all(axis=1)] = 0
    while len(chosen) < k:
        share = nearest * weights
        if not share.sum() > 0:
            raise ValueError(f"k-means needs {k} distinct vectors, there are {len(chosen)}")
        tried = rng.choice(len(points), size=2 + int(np.log(k)), p=share / share.sum())
        after = np.minimum(nearest[None, :], _squares(points, points[tried]).T)
        best = int((after * weights).sum(axis=1).argmin())
        chosen.append(points[tried[best]])
        nearest = after[best]
        nearest[(points == chosen[-1]).all(axis=1)] = 0
    centres = np.array(chosen)
    for _ in range(10):
        near = _squares(points, centres).argmin(axis=1)
        own = np.bincount(near, weights, k)
        if not (own > 0).all():
            return np.array(chosen)
        centres = np.stack([np.bincount(near, weights * x, k) for x in points.T], axis=1) / own[:, None]
    return centres


def _packed(rows: np.ndarray, each: int) -> pa.Array:
    """A matrix as binary values of ``each`` rows."""
    rows = np.ascontiguousarray(rows)
    ends = np.minimum(np.arange(-(-len(rows) // each) + 1) * each, len(rows)) * (rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows)])


def _unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The rows of all binary values of a column as a matrix."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind).reshape(-1, width)


def _nearest(far: np.ndarray, second: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """For each column the place of its smallest number (the first on a tie), that number and, if asked for, the next one."""
    near, best = np.zeros(far.shape[1], np.int64), far[0].copy()
    next_ = np.full(far.shape[1], np.inf) if second else None
    for j in range(1, len(far)):
        if second:
            np.minimum(next_, np.maximum(best, far[j]), out=next_)
        np.putmask(near, far[j] < best, j)
        np.minimum(best, far[j], out=best)
    return near, best, next_


def _add(total: np.ndarray, near: np.ndarray, rows: np.ndarray, sign: int = 1) -> None:
    """Adds the rows to those of ``total`` that ``near`` names."""
    if len(total) <= FEW:
        total += sign * ((near == np.arange(len(total))[:, None]).astype(float) @ rows)
    else:
        for j in range(rows.shape[1]):
            total[:, j] += sign * np.bincount(near, rows[:, j], len(total))


def _steps(batches: Iterator[pa.RecordBatch], fits: dict[int, np.ndarray], shift: np.ndarray, saved: tuple | None, keep: bool) -> Iterator[pa.RecordBatch]:
    """A task's part of a pass: sums for each fit and, with ``keep``, its rows with their bounds, packed.

    ``saved`` has the fits whose bounds come along with the rows, and their centres then; the sums are those of the
    rows that changed their centre since, taken off the old one and added to the new one."""
    fit_ids, d = list(fits), len(shift)
    sizes = [len(c) for c in fits.values()]
    first = np.cumsum([0, *sizes[:-1]])  # a fit's first centre among those of all
    every = np.concatenate(list(fits.values()))
    minus, squares = -2 * every, (every**2).sum(axis=1)
    totals, counted, square = [np.zeros((k, d + 1)) for k in sizes], np.zeros(len(fits)), 0.0
    if saved:
        at = [saved[0].index(f) for f in fit_ids]
        apart, moved = np.zeros(len(every)), np.zeros(len(every))
        for place, (f, c) in enumerate(fits.items()):
            between = np.sqrt(_squares(c, c))
            np.fill_diagonal(between, np.inf)
            apart[first[place]:first[place] + len(c)] = between.min(axis=1) / 2
            moved[first[place]:first[place] + len(c)] = np.sqrt(((c - saved[1][f]) ** 2).sum(axis=1))
        farthest = np.maximum.reduceat(moved, first)
    most = max(256, min(4096, (1 << 20) // len(every)))  # rows that are compared at once
    for batch in batches:
        if not batch.num_rows:
            continue
        if saved:
            values, numbers = _unpacked(batch.column(0), np.float64, d), _unpacked(batch.column(1), np.int64, 1)[:, 0]
            nears, uppers, lowers = (_unpacked(batch.column(j), kind, len(saved[0])) for j, kind in ((2, np.int16), (3, np.float32), (4, np.float32)))
        else:
            values, numbers = _matrix(batch.column(0)), batch.column(1).to_numpy()
        new = [np.zeros((len(values), len(fits)), kind) for kind in (np.int16, np.float32, np.float32)] if keep else None
        for start_ in range(0, len(values), most):
            part = slice(start_, start_ + most)
            x, n = values[part] - shift, numbers[part].astype(float)
            if saved:
                old = nears[part][:, at].astype(np.int64)
                own = old + first
                upper, lower = uppers[part][:, at] + moved[own], lowers[part][:, at] - farthest
                look = upper * (1 + SLACK) >= np.maximum(lower, apart[own]) * (1 - SLACK)
                shares = look.mean(axis=0)
            else:
                shares = np.ones(len(fits))
                square += float(((x**2).sum(axis=1) * n).sum())
            whole = [j for j in range(len(fits)) if shares[j] > MANY]
            if whole:
                centres = np.concatenate([np.arange(first[j], first[j] + sizes[j]) for j in whole])
                all_far = minus[centres] @ x.T
                all_far += squares[centres][:, None]
            if keep:
                norms = (x**2).sum(axis=1)
            done, weighted = 0, None
            for j, k in enumerate(sizes):
                if shares[j] > MANY:
                    some, of = slice(None), np.arange(len(x))
                    far = all_far[done:done + k]
                    done += k
                elif shares[j] > 0:
                    some = of = np.flatnonzero(look[:, j])
                    far = minus[first[j]:first[j] + k] @ x[some].T + squares[first[j]:first[j] + k, None]
                else:
                    some = of = np.zeros(0, np.int64)
                near, best, next_ = _nearest(far, keep) if len(of) else (of, None, None)
                counted[j] += len(of) * k
                if saved:
                    was = old[some, j]
                    other = np.flatnonzero(near != was)
                    if len(other):
                        rows = np.concatenate([x[of[other]], np.ones((len(other), 1))], axis=1) * n[of[other], None]
                        _add(totals[j], near[other], rows)
                        _add(totals[j], was[other], rows, -1)
                else:
                    if weighted is None:
                        weighted = np.concatenate([x, np.ones((len(x), 1))], axis=1) * n[:, None]
                    _add(totals[j], near, weighted)
                if keep:
                    if saved:
                        for kept, now in zip(new, (old, upper, lower)):
                            kept[part, j] = now[:, j] * (1 + SLACK if now is upper else 1 - SLACK if now is lower else 1)
                    if len(of):
                        new[0][part][some, j] = near
                        new[1][part][some, j] = np.sqrt(np.maximum(best + norms[some], 0)) * (1 + SLACK)
                        new[2][part][some, j] = np.sqrt(np.maximum(next_ + norms[some], 0)) * (1 - SLACK)
        if keep:
            each = max(1, PACK // d)
            packed = [_packed(v, each) for v in (values, numbers.reshape(-1, 1).astype(np.int64), *new)]
            yield pa.RecordBatch.from_arrays([*packed, pa.nulls(len(packed[0]), pa.int32()), pa.nulls(len(packed[0]), pa.list_(pa.float64()))], _NAMES)
    sums = [pa.array(fit_ids, pa.int32()), pa.array([np.append(t.ravel(), [square, c]) for t, c in zip(totals, counted)], pa.list_(pa.float64()))]
    if keep:
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(fits), pa.binary()) for _ in range(5)), *sums], _NAMES)
    else:
        yield pa.RecordBatch.from_arrays(sums, ["fit", "sums"])


class _Rows:
    """The rows as the passes read them, with bounds from the last time they were written."""

    def __init__(self, data: DataFrame) -> None:
        self.spark, self.read = data.sparkSession, data
        self.saved: tuple | None = None
        self.base: dict[int, np.ndarray] = {}
        self.path: str | None = None

    def run(self, fits: dict[int, np.ndarray], shift: np.ndarray, keep: bool) -> dict[int, np.ndarray]:
        """One pass over the rows at the fits' centres; with ``keep`` it writes new bounds."""
        shared = self.spark.sparkContext.broadcast((fits, shift, self.saved))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _steps(batches, *shared.value, keep)

        def whole(sums: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
            """With the sums when the bounds were written, of which the tasks sent the changes; the last number is the pass's own."""
            return {f: v + np.append(self.base[f][:-1], 0.0) if f in self.base else v for f, v in sums.items()}

        if not keep:
            return whole(_added(self.read.mapInArrow(task, _SUMS)))
        schema, path, old = f"{_STATE}, {_SUMS}", scratch_path(self.spark, f"kmeans-{uuid.uuid4().hex}"), self.path
        self.read.mapInArrow(task, schema).write.parquet(path)
        written = self.spark.read.schema(schema).parquet(path)
        self.read, self.path, self.saved = written.where("fit IS NULL").select("x", "n", "near", "upper", "lower"), path, (list(fits), fits)
        self.base = whole(_added(written.where("fit IS NOT NULL").select("fit", "sums")))
        self.remove(old)
        return self.base

    def remove(self, path: str | None) -> None:
        if path:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def lloyd(data: DataFrame, fits: list[Fit], max_iter: int = 300, tol: float = 1e-4, bounds: bool = True) -> list[Fit]:
    """Move the centres of all fits until none moves by more than ``tol`` or ``max_iter`` steps are
    done.  An empty cluster keeps its centre.  ``cost`` is the inertia at the final centres.

    ``data`` has arrays ``x`` and may have their number of rows ``n``.  Without ``bounds`` every pass compares all rows."""
    rows = data if "n" in data.columns else data.withColumn("n", F.lit(1).cast("long"))
    mean = _mean(rows)
    state = _Rows(rows.select("x", "n"))
    active = dict(enumerate(fits))
    for step in range(max_iter + 1):
        if not active:
            break
        power = bounds and step > 0 and step & (step - 1) == 0 and step < max_iter
        sums = state.run({i: f.centres - mean for i, f in active.items()}, mean, power)
        for i, f in list(active.items()):
            k, own = len(f.centres), sums[i]
            both = own[:-2].reshape(k, -1)
            total, n = both[:, :-1], both[:, -1]
            now = f.centres - mean
            f.cost = float(own[-2] - 2 * (now * total).sum() + (n * (now**2).sum(axis=1)).sum())
            f.iterations = step
            f.distances.append(int(own[-1]))
            moved = f.centres.copy()
            moved[n > 0] = total[n > 0] / n[n > 0, None] + mean
            f.converged = bool(np.sqrt(((moved - f.centres) ** 2).sum(axis=1)).max() <= tol)
            if f.converged or step == max_iter:
                del active[i]
            else:
                f.centres = moved
    state.remove(state.path)
    late = [(f.k, f.seed) for f in fits if not f.converged]
    if late and max_iter > 20:
        warnings.warn(f"k-means stopped at {max_iter} iterations without converging for (k, seed) in {late}", stacklevel=2)
    return fits


def fit_many(data: DataFrame, specs: Sequence[tuple[int, int]], max_iter: int = 300, tol: float = 1e-4) -> dict[int, Fit]:
    """The fit with the lowest inertia (lowest seed on a tie) of each k, from distinct arrays in ``x`` with ``n`` rows each.
    Fewer than k distinct vectors raise ``ValueError``."""
    k, seeds = max(k for k, _ in specs), sorted({s for _, s in specs})
    mean = _mean(data)
    if not len(mean):
        raise ValueError("k-means needs rows")
    drawn = candidates(data, seeds, k, mean)
    fits = lloyd(data, [Fit(k, seed, start(*drawn[seed], k, seed) + mean) for k, seed in specs], max_iter, tol)
    best: dict[int, Fit] = {}
    for f in sorted(fits, key=lambda f: (f.cost, f.seed)):
        best.setdefault(f.k, f)
    return best


def fit_kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 42, restarts: int = 10,
               max_iter: int = 300, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """M3 fit: (centres, inertia) of the best of the seeds ``seed .. seed+restarts-1``."""
    if k < 2:
        raise ValueError("k-means needs k >= 2; use inertia_k1 for k = 1")
    data = _vectors(df, features)
    best = fit_many(data, [(k, seed + r) for r in range(max(1, restarts))], max_iter, tol)[k]
    return best.centres, best.cost


def relabel_order(centres: Sequence[np.ndarray]) -> list[int]:
    """Stable cluster numbering: larger centre coordinate sum first (index breaks ties), so
    labels do not depend on MLlib's arbitrary order."""
    sums = [float(np.sum(c)) for c in centres]
    order = sorted(range(len(centres)), key=lambda i: (-sums[i], i))
    new = [0] * len(centres)
    for rank, i in enumerate(order):
        new[i] = rank
    return new


def kmeans(df: DataFrame, k: int, features: str = "features", out: str = "cluster", seed: int = 42,
           restarts: int = 10, max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """M3: fit (with restarts) and assign each row its nearest centre; clusters are numbered by
    :func:`relabel_order`."""
    centres, _ = fit_kmeans(df, k, features, seed, restarts, max_iter, tol)
    order = relabel_order(centres)
    ordered = [centres[order.index(i)] for i in range(len(centres))]
    return assign_nearest(df, ordered, vector=features, out=out)


def inertia_k1(df: DataFrame, features: str = "features") -> DataFrame:
    """Inertia at k = 1: the sum of squared deviations from the mean over every dimension.
    One aggregate per dimension (MLlib rejects k = 1)."""
    arr = df.select(F.posexplode(vector_to_array(F.col(features))).alias("d", "x"))
    per_dim = arr.groupBy("d").agg((F.var_pop("x") * F.count("x")).alias("ss"))
    return per_dim.agg(F.sum("ss").alias("inertia")).select(F.lit(1).alias("k"), "inertia")


def elbow(df: DataFrame, ks: Iterable[int], features: str = "features", seed: int = 42, restarts: int = 10,
          max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """M4: inertia for each k (k = 1 in closed form).  Returns (k, inertia)."""
    spark = df.sparkSession
    ks = list(ks)
    data = _vectors(df, features)
    specs = [(k, seed + r) for k in ks if k >= 2 for r in range(max(1, restarts))]
    rows = [(k, f.cost) for k, f in sorted(fit_many(data, specs, max_iter, tol).items())] if specs else []
    if 1 in ks:  # one centre is the mean
        rows = [(1, lloyd(data, [Fit(1, 0, _mean(data)[None, :])], max_iter=0)[0].cost), *rows]
    return spark.createDataFrame([(int(k), float(c)) for k, c in rows], "k int, inertia double")


#: Centres x dimensions that are written into the plan as literals; beyond, centres are broadcast.
LITERALS = 2000
#: Centres and rows that are compared at once.
CENTRES, ROWS = 128, 256


class NearestCentres:
    """Centres in the order of their norms, searched outwards from a row's own norm.

    Norms differ by no more than vectors do, so the search ends where the norms are further apart than
    the best centre so far."""

    def __init__(self, centres: np.ndarray) -> None:
        norms = np.sqrt((centres**2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.centres, self.norms = centres[self.order], norms[self.order]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest centre, the smallest on a tie; squared distance) of each row."""
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x))
        norms = np.sqrt((x**2).sum(axis=1))
        by_norm = np.argsort(norms, kind="stable")
        for at in range(0, len(x), ROWS):
            rows = by_norm[at:at + ROWS]
            index[rows], distance[rows] = self._group(x[rows], norms[rows])
        return index, distance

    def _group(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of similar norm, by rising norm."""
        k = len(self.centres)
        low = high = int(np.searchsorted(self.norms, norms[len(norms) // 2]))
        best, of = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        room = 1e-9 * (1 + norms[-1] ** 2)  # for rounding in what is only a bound
        while low > 0 or high < k:
            below = norms[0] - self.norms[low - 1] if low > 0 else np.inf  # least difference of norms on either side
            above = self.norms[high] - norms[-1] if high < k else np.inf
            reach = np.sqrt(best.max() + room)
            if min(below, above) > reach:
                break
            if below <= above:
                part = slice(max(0, low - CENTRES), low)
                low = part.start
            else:
                part = slice(high, min(k, high + CENTRES))
                high = part.stop
            own, ids = self.centres[part], self.order[part]
            near = _squares(x, own)
            least = near.min(axis=1)
            for r in np.flatnonzero(least <= best + room):
                close = np.flatnonzero(near[r] <= least[r] + room)
                exact = ((own[close] - x[r]) ** 2).sum(axis=1)
                first = np.lexsort((ids[close], exact))[0]
                if (exact[first], ids[close][first]) < (best[r], of[r]):
                    best[r], of[r] = exact[first], ids[close][first]
        return of, best


def assign_nearest(df: DataFrame, centres: Sequence[Sequence[float]], columns: Sequence[str] | None = None,
                   vector: str | None = "features", out: str = "cluster", distance: str | None = None,
                   literals: int = LITERALS) -> DataFrame:
    """M6: index of the nearest centre by squared Euclidean distance (smallest index on a tie).

    Either named ``columns`` or a ``vector`` column supply the coordinates.  At most ``literals`` numbers of centres are
    literals of one projection (``array_min`` over ``struct(distance, index)``); with more the centres
    are broadcast and searched by :class:`NearestCentres`.  A row with a NULL coordinate gets the index 0
    either way, and a NULL distance.
    """
    if columns is not None:
        xs = [col(c).cast("double") for c in columns]
        src = df
    else:
        src = df.withColumn("__xs", vector_to_array(F.col(vector)))
        d = len(centres[0])
        xs = [F.col("__xs")[i] for i in range(d)]
    if len(centres) * len(centres[0]) > literals:
        best = _searched(df, np.array(centres, float))(F.array(*xs) if columns is not None else F.col("__xs"))
        res = src.withColumn("__best", best).withColumn(out, F.col("__best")["j"])
        if distance:
            res = res.withColumn(distance, F.col("__best")["d"])
        return res.drop("__best", "__xs") if columns is None else res.drop("__best")
    cands = []
    for j, c in enumerate(centres):
        dist = None
        for x, cj in zip(xs, c):
            t = (x - F.lit(float(cj))) * (x - F.lit(float(cj)))
            dist = t if dist is None else dist + t
        cands.append(F.struct(dist.alias("d"), F.lit(j).alias("j")))
    best = F.array_min(F.array(*cands))
    res = src.withColumn(out, best["j"])
    if distance:
        res = res.withColumn(distance, best["d"])
    return res.drop("__xs") if columns is None else res


def _searched(df: DataFrame, centres: np.ndarray):
    """A function of an array column: struct of ``d`` and ``j`` of the nearest centre."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf("struct<d:double,j:int>")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = NearestCentres(shared.value)
        for batch in batches:
            x = batch.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)
            missing = np.isnan(x).any(axis=1)
            j, d = search(np.where(missing[:, None], 0.0, x))
            yield pa.StructArray.from_arrays([pa.array(d, mask=missing), pa.array(np.where(missing, 0, j), pa.int32())], ["d", "j"])

    return nearest


@dataclass
class Components:
    """Principal components: ``pc`` (d x k), ``explainedVariance`` (shares of the total variance), passes over the data."""

    pc: DenseMatrix
    explainedVariance: DenseVector
    passes: int


#: Dimensions up to which all directions are taken at once, directions beyond k otherwise, and passes at most.
WHOLE, EXTRA, PASSES = 64, 10, 40


def _sparse(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, index, value) of the entries of a column of unwrapped vectors, dense or sparse, and their length."""
    kind, size, indices, values = (column.field(k) for k in range(4))
    sparse = kind.to_numpy(zero_copy_only=False) == 0
    lengths = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # a dense vector's own positions
    if sparse.any():
        at[sparse[row]] = indices.flatten().to_numpy(zero_copy_only=False)
    width = int(size.fill_null(0).to_numpy(zero_copy_only=False)[sparse].max()) if sparse.any() else int(lengths.max(initial=0))
    return row, at, values.flatten().to_numpy(zero_copy_only=False), width


class _Centred:
    """The rows less their mean as an operator: ``A'A`` times a block of vectors, one pass each.

    Rows stay sparse; the mean is taken off algebraically: ``(X - 1m')'(X - 1m')V = X'Z - m(1'Z)`` with ``Z = XV - 1(m'V)``."""

    def __init__(self, df: DataFrame, features: str) -> None:
        self.data = df.where(F.col(features).isNotNull()).select(F.unwrap_udt(F.col(features)).alias("x"))
        self.context, self.passes = df.sparkSession.sparkContext, 0
        first = self.data.select(F.coalesce(F.col("x")["size"], F.size(F.col("x")["values"])).alias("d")).agg(F.max("d").alias("d"), F.min("d").alias("low"), F.count("*").alias("n")).first()
        if first["d"] != first["low"]:
            raise ValueError(f"{features} holds vectors of different lengths")
        self.d, self.n = first["d"] or 0, first["n"]
        width = self.d

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, square = np.zeros(width), 0.0
            for batch in batches:
                _, at, v, _ = _sparse(batch.column(0))
                total += np.bincount(at, v, width)
                square += float((v**2).sum())
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.append(total, square)], pa.list_(pa.float64()))], ["fit", "sums"])

        found = _added(self.data.mapInArrow(sums, _SUMS))[0]
        self.mean = found[:-1] / max(1, self.n)

    def variance(self) -> float:
        """Sum of squares of the centred rows."""
        shared = self.context.broadcast(self.mean)

        def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, total = shared.value, 0.0
            whole = float((mean**2).sum())
            for batch in batches:
                _, at, v, _ = _sparse(batch.column(0))
                m = mean[at]
                total += whole * batch.num_rows + float(((v - m) ** 2 - m**2).sum())
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([[total]], pa.list_(pa.float64()))], ["fit", "sums"])

        return float(_added(self.data.mapInArrow(squares, _SUMS))[0][0])

    def apply(self, block: np.ndarray) -> np.ndarray:
        shared = self.context.broadcast((block, self.mean @ block))
        self.passes += 1

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            right, shift = shared.value
            d, q = right.shape
            out, total = np.zeros((q, d)), np.zeros(q)
            for batch in batches:
                row, at, v, _ = _sparse(batch.column(0))
                for c in range(q):
                    z = np.bincount(row, v * right[at, c], batch.num_rows) - shift[c]
                    out[c] += np.bincount(at, v * z[row], d)
                    total[c] += z.sum()
            yield pa.RecordBatch.from_arrays([pa.array(range(q), pa.int32()), pa.array([np.append(out[c], total[c]) for c in range(q)], pa.list_(pa.float64()))], ["fit", "sums"])

        found = _added(self.data.mapInArrow(task, _SUMS))
        return np.stack([found[c][:-1] - self.mean * found[c][-1] for c in range(block.shape[1])], axis=1)


def fit_pca(df: DataFrame, k: int = 2, features: str = "features"):
    """M5/M7 fit: (components, ``df``, mean, signs) by block Krylov iteration on the implicitly centred rows.

    A pass applies the covariance to a block of ``k + EXTRA`` directions (d x (k + EXTRA) numbers; all d of them for
    d up to ``WHOLE``, which is the covariance itself); the leading directions are sought in the span
    of all blocks so far, until they no longer change.  Sparse vectors stay sparse and no d x d matrix is made.
    Component signs are fixed so the largest-magnitude loading of each component is positive (raw signs are arbitrary)."""
    rows = _Centred(df, features)
    d = rows.d
    if not 1 <= k <= d:
        raise ValueError(f"{k} components of vectors of length {d}")
    block = np.eye(d) if d <= WHOLE else np.linalg.qr(np.random.default_rng(0).standard_normal((d, min(d, k + EXTRA))))[0]
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    while True:
        basis, images = np.hstack([basis, block]), np.hstack([images, rows.apply(block)])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:k]
        values, turn = np.maximum(values[order], 0), turn[:, order]
        left = np.sqrt(((images @ turn - basis @ turn * values) ** 2).sum(axis=0))
        if basis.shape[1] >= d or (left <= 1e-10 * max(values[0], 1e-300)).all() or rows.passes >= PASSES:
            break
        block = images[:, -block.shape[1]:]
        for _ in range(2):  # twice is enough
            block = block - basis @ (basis.T @ block)
        block, size = np.linalg.qr(block)
        block = block[:, np.abs(np.diag(size)) > 1e-12 * max(values[0], 1e-300)][:, :d - basis.shape[1]]
        if not block.shape[1]:
            break
    pc = basis @ turn
    total = rows.variance()
    signs = []
    for j in range(k):
        mags = np.abs(pc[:, j])
        # first loading within rounding of the largest magnitude: equal loadings
        # (two standardised features) must not flip on the last bit
        i = int(np.flatnonzero(mags >= mags.max() - 1e-9)[0])
        signs.append(1.0 if pc[i, j] >= 0 else -1.0)
    shares = values / total if total > 0 else np.zeros(k)
    return Components(DenseMatrix(d, k, pc.ravel(order="F").tolist()), DenseVector(shares.tolist()), rows.passes), df, rows.mean.tolist(), signs


def pca_project(df: DataFrame, k: int = 2, features: str = "features",
                names: Sequence[str] | None = None) -> DataFrame:
    """M5: centred projection on the first ``k`` components, as columns ``pc1``.. ``pck``
    (with the sign rule applied).  A NULL vector has NULL coordinates."""
    model, _, mean, signs = fit_pca(df, k, features)
    names = list(names) if names else [f"pc{i + 1}" for i in range(k)]
    right = model.pc.toArray() * np.array(signs)
    shared = df.sparkSession.sparkContext.broadcast((right, np.array(mean) @ right))

    @F.arrow_udf("array<double>")
    def projected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        to, shift = shared.value
        for batch in batches:
            row, at, v, _ = _sparse(batch)
            z = np.stack([np.bincount(row, v * to[at, c], len(batch)) for c in range(to.shape[1])], axis=1) - shift
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * to.shape[1]), pa.array(z.ravel()))

    arr = F.when(F.col(features).isNotNull(), projected(F.unwrap_udt(F.col(features))))
    out = df.withColumn("__pcs", arr)
    return out.withColumns({n: F.col("__pcs")[j] for j, n in enumerate(names)}).drop("__pcs")


def pca_explained(df: DataFrame, k: int = 2, features: str = "features") -> DataFrame:
    """M7: explained-variance ratio of each of the first ``k`` components."""
    model, *_ = fit_pca(df, k, features)
    ev = [float(x) for x in model.explainedVariance.toArray()]
    return df.sparkSession.createDataFrame([(i + 1, v) for i, v in enumerate(ev)],
                                           "component int, explained_variance_ratio double")
