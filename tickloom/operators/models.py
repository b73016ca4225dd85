"""Models from aggregated sufficient statistics: purged folds, ridge, calibration, recursive least squares, scorers and quotes.

The rows are only ever summed: a fold's Gram matrix is one row of p * p numbers however many rows it covers, and the
driver solves systems of at most a few hundred columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.cluster import missing
from tickloom.operators.ordered import exact_percentiles, numbered

NS = 1_000_000_000
ALPHAS = (1e0, 1e1, 1e2, 1e3, 1e4, 1e5, 1e6)
#: Target, purge and embargo of the four horizons, in milliseconds.
HORIZONS = {"fast": (50, 2000, 1000), "medium": (500, 5000, 2500), "slow": (1000, 10_000, 5000), "macro": (5000, 20_000, 10_000)}


# ---- folds --------------------------------------------------------------------------------------------------------


def folds(df: DataFrame, n: int, k: int = 5, position: str = "rn") -> DataFrame:
    """Adds ``fold``: equal runs of rows by position, the last takes the rest."""
    return df.withColumn("fold", F.least(F.floor(F.col(position) / max(n // k, 1)), F.lit(k - 1)).cast("int"))


def fold_bounds(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy("fold").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))


def _by_test(df: DataFrame, bounds: DataFrame, time: str, purge_ns: int, embargo_ns: int, allowed: bool) -> DataFrame:
    t, out = F.col(time), []
    for r in bounds.collect():  # one row a fold
        ok = ((F.col("fold") < r["fold"]) & (t < r["start"] - purge_ns)) | ((F.col("fold") > r["fold"]) & (t > r["end"] + embargo_ns))
        out.append(F.when((F.col("fold") != r["fold"]) & (ok if allowed else ~ok), F.lit(r["fold"])))
    return df.withColumn("test", F.explode(F.array_compact(F.array(*out)))) if out else df.withColumn("test", F.lit(None).cast("int")).limit(0)


def training_rows(df: DataFrame, bounds: DataFrame, time: str, purge_ns: int, embargo_ns: int) -> DataFrame:
    """Rows by the folds (``test``) they may train: not their own, before its start less the purge, or after its end plus the embargo."""
    return _by_test(df, bounds, time, purge_ns, embargo_ns, True)


def barred_rows(df: DataFrame, bounds: DataFrame, time: str, purge_ns: int, embargo_ns: int) -> DataFrame:
    """Rows of other folds by the folds that purge and embargo bar them from training."""
    return _by_test(df, bounds, time, purge_ns, embargo_ns, False)


# ---- linear models ------------------------------------------------------------------------------------------------


def gram(df: DataFrame, x: list[str], y: str, by: str) -> dict:
    """Raw moments by group: ``{group: (n, mean-free sums)}`` as one symmetric matrix over (1, x, y); missing x count as 0, rows without y are left out."""
    return grams(df.where(F.col(y).isNotNull() & ~F.isnan(y)), x, [y], by)[y]


def grams(df: DataFrame, x: list[str], ys: list[str], by: str) -> dict[str, dict]:
    """``gram`` of several targets in one pass, each over the rows that have it."""
    names, p = [*x, *ys], len(x) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            g = b.column("_g").to_numpy(zero_copy_only=False)
            cols = {c: b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names}
            m = np.column_stack([np.ones(b.num_rows), *[np.nan_to_num(cols[c]) for c in x]])
            for k, y in enumerate(ys):
                has = ~np.isnan(cols[y])
                for v in np.unique(g[has]):
                    part = np.column_stack([m, cols[y]])[has & (g == v)]
                    sums[k, int(v)] = sums.get((k, int(v)), 0) + part.T @ part
        at, groups = zip(*sums) if sums else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(groups, pa.int64()), pa.array([s.ravel() for s in sums.values()], pa.list_(pa.float64()))], names=["_y", "_g", "m"])

    rows = df.select(F.col(by).cast("bigint").alias("_g"), *[F.col(c).cast("double").alias(c) for c in names])
    parts = rows.mapInArrow(run, "_y bigint, _g bigint, m array<double>").select("_y", "_g", F.posexplode("m").alias("at", "v"))
    whole = parts.groupBy("_y", "_g", "at").agg(F.sum("v").alias("v")).groupBy("_y", "_g").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("m"))
    out: dict[str, dict] = {y: {} for y in ys}
    for r in whole.collect():  # one row a target and group
        out[ys[r["_y"]]][r["_g"]] = np.array([e["v"] for e in r["m"]]).reshape(p, p)
    return out


@dataclass
class Linear:
    """Weights (intercept first) over standardised columns, with their moments; ``covariance`` starts the online update."""

    features: list[str]
    weights: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    covariance: np.ndarray | None = None
    target: str = ""
    stats: dict = field(default_factory=dict)

    def score(self, df: DataFrame) -> Column:
        """One linear expression over the columns ``df`` has; missing columns and values add nothing."""
        out = F.lit(float(self.weights[0]))
        for c, w, m, v in zip(self.features, self.weights[1:], self.mean, self.var):
            if c in df.columns:
                z = (F.col(c) - F.lit(float(m))) / F.lit(float(np.sqrt(v + 1e-8)))
                out = out + F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0)) * F.lit(float(w))
        return out

    def predict(self, row: dict[str, float]) -> float:
        """The score of one observation; missing and NaN values add nothing."""
        z = ((row.get(c, np.nan) - m) / np.sqrt(v + 1e-8) for c, m, v in zip(self.features, self.mean, self.var))
        return float(self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], z) if x == x))

    def summary(self) -> dict:
        """Target, size, statistics and the ten heaviest inputs."""
        return {"target": self.target, "n_features": len(self.features), **self.stats, "importance": self.importance()[:10]}

    def importance(self) -> list[tuple[str, float]]:
        """Inputs by the size of their weight."""
        return sorted(zip(self.features, np.abs(self.weights[1:]).tolist()), key=lambda x: -x[1])

    def to_json(self, label: str) -> str:
        return json.dumps({"label": label, "features": self.features, "weights": self.weights.tolist(), "mean": self.mean.tolist(), "var": self.var.tolist(), "n_features": len(self.features), "target": self.target, "oof_stats": self.stats})


def solve(m: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge weights over standardised columns with a free intercept, the means and the variances, from raw moments."""
    n = m[0, 0]
    mean = m[0, 1:-1] / n
    cov = m[1:-1, 1:-1] / n - np.outer(mean, mean)
    var = np.maximum(np.diag(cov), 0)
    sd = np.sqrt(var) + 1e-8
    ybar = m[0, -1] / n
    z = cov * n / np.outer(sd, sd)
    zy = (m[1:-1, -1] - mean * ybar * n) / sd
    w = np.linalg.solve(z + alpha * np.eye(len(mean)), zy)
    return np.concatenate([[ybar], w]), mean, var


def loss(m: np.ndarray, w: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[float, float, float]:
    """Rows, squared error and total squares about the mean of a fitted model over the rows behind raw moments."""
    sd = np.sqrt(var) + 1e-8
    beta = w[1:] / sd
    full = np.concatenate([[w[0] - beta @ mean], beta, [-1.0]])
    return m[0, 0], max(float(full @ m @ full), 0.0), float(m[-1, -1] - m[0, -1] ** 2 / m[0, 0])


def ridge_cv(df: DataFrame, x: list[str], y: str, order: list[str], purge_ms: int, embargo_ms: int, k: int = 5, alphas: tuple[float, ...] = ALPHAS) -> Linear:
    """Ridge with the penalty of the best out-of-fold R2 (the first of equal ones) over purged and embargoed folds.

    One pass sums each fold, one the few rows that purge and embargo bar from training: a fold's training moments are all
    sums but its own, less those. They serve all penalties. ``order`` has the time first, then what tells equal times apart. A fold with fewer than 100 training or 10 test rows is passed over.
    """
    return _ridges(df, x, {y: (y, purge_ms, embargo_ms)}, order, k, alphas)[y]


def ridge_horizons(df: DataFrame, x: list[str], order: list[str], prefix: str = "fwd_return_", k: int = 5, alphas: tuple[float, ...] = ALPHAS) -> dict[str, Linear]:
    """``ridge_cv`` for the target, purge and embargo of each of ``HORIZONS``; one without any target value has no model.

    Folds are cut once over all rows in ``order`` (time first), whether or not they have a target, so the horizons share
    them and one pass sums the folds of all.
    """
    return _ridges(df, x, {label: (f"{prefix}{h}ms", purge, embargo) for label, (h, purge, embargo) in HORIZONS.items()}, order, k, alphas)


def _ridges(df: DataFrame, x: list[str], targets: dict[str, tuple[str, int, int]], order: list[str], k: int, alphas: tuple[float, ...]) -> dict[str, Linear]:
    rows, time = numbered(df, order), order[0]
    rows = folds(rows, rows.count(), k)
    tests, bounds = grams(rows, x, [y for y, _, _ in targets.values()], "fold"), fold_bounds(rows, time)
    out = {}
    for label, (y, purge_ms, embargo_ms) in targets.items():
        if tests[y]:
            barred = gram(barred_rows(rows, bounds, time, purge_ms * 1_000_000, embargo_ms * 1_000_000), x, y, "test")
            out[label] = _ridge(x, y, tests[y], barred, alphas)
    return out


def _ridge(x: list[str], y: str, test: dict, barred: dict, alphas: tuple[float, ...]) -> Linear:
    """The model from the moments of each fold and of the rows barred from training for it."""
    train = {f: sum((m for g, m in test.items() if g != f), np.zeros_like(test[f])) - barred.get(f, 0) for f in test}
    usable = [f for f in test if f in train and train[f][0, 0] >= 100 and test[f][0, 0] >= 10]
    best, chosen = -np.inf, alphas[0]
    pooled = sum((test[f] for f in usable), np.zeros(())) if usable else None
    for a in alphas:
        err = sum(loss(test[f], *solve(train[f], a))[1] for f in usable)
        total = loss(pooled, np.zeros(len(x) + 1), np.zeros(len(x)), np.ones(len(x)))[2] if usable else 0.0
        r2 = 1 - err / total if total > 0 else -np.inf
        if r2 > best:
            best, chosen = r2, a
    whole = sum(test.values())
    w, mean, var = solve(whole, chosen)
    rows_n, sse, _ = loss(whole, w, mean, var)
    sd = np.sqrt(var) + 1e-8
    z = np.zeros((len(x) + 1, len(x) + 1))
    z[0, 0] = rows_n
    z[1:, 1:] = (whole[1:-1, 1:-1] - rows_n * np.outer(mean, mean)) / np.outer(sd, sd) + chosen * np.eye(len(x))
    fold_stats = []
    for f in sorted(usable):
        fn, err, total = loss(test[f], *solve(train[f], chosen))
        fold_stats.append({"fold": f, "n": int(fn), "r2": 1 - err / total if total > 0 else 0.0, "rmse": float(np.sqrt(err / fn))})
    return Linear(x, w, mean, var, np.linalg.inv(z) * sse / rows_n, y, {"alpha": chosen, "r2": float(best), "n": int(rows_n), "folds": fold_stats})


def spread_regression(df: DataFrame, markout: str, tox: str, vol: str, spread: str, gex: str | None = None) -> dict[str, float]:
    """Coefficients over the columns as they are of the markout's size, cut to 0.5 to 5 ticks, on toxicity, regime, spread and toxicity times regime, and gamma if there is some.

    A weak ridge, 1e-4 a row. Rows without any of the columns are left out.
    """
    x = {"tox": F.col(tox), "vol": F.col(vol), "spread": F.col(spread), "tox_vol": F.col(tox) * F.col(vol)} | ({"gex": F.col(gex)} if gex else {})
    rows = df.select(*[c.cast("double").alias(n) for n, c in x.items()], F.abs(F.col(markout)).alias("m"), F.lit(0).alias("one"))
    for c in (*x, "m"):
        rows = rows.where(~missing(F.col(c)))
    m = gram(rows.withColumn("y", F.least(F.greatest("m", F.lit(0.5)), F.lit(5.0))), list(x), "y", "one").get(0)
    if m is None:
        return {}
    w, mean, var = solve(m, 1e-4 * m[0, 0])
    beta = w[1:] / (var**0.5 + 1e-8)
    return {"intercept": float(w[0] - beta @ mean)} | {c: float(b) for c, b in zip(x, beta)}


class RecursiveLeastSquares:
    """One observation at a time: predict, gain, update, with forgetting."""

    def __init__(self, weights: np.ndarray, covariance: np.ndarray, forget: float = 0.9999):
        self.w, self.p, self.forget = weights.astype(float).copy(), covariance.astype(float).copy(), forget

    def update(self, x: np.ndarray, y: float) -> float:
        """The error of the prediction made before the update."""
        x = np.concatenate([[1.0], x])
        err = y - float(self.w @ x)
        px = self.p @ x
        gain = px / (self.forget + float(x @ px))
        self.w += gain * err
        self.p = (self.p - np.outer(gain, px)) / self.forget
        return err


class RunningMoments:
    """Running mean and variance of some columns at once: exponential with ``decay`` below 1, else over all rows alike."""

    def __init__(self, decay: float = 1.0):
        self.decay, self.n, self.mean, self.m2 = decay, 0, 0.0, 0.0

    def update(self, x: np.ndarray | float) -> None:
        self.n += 1
        if self.decay >= 1:
            step = x - self.mean
            self.mean = self.mean + step / self.n
            self.m2 = self.m2 + step * (x - self.mean)
        elif self.n == 1:
            self.mean, self.m2 = x * 1.0, x * 0.0
        else:
            step = x - self.mean
            self.mean = self.mean + (1 - self.decay) * step
            self.m2 = self.decay * (self.m2 + (1 - self.decay) * step * step)

    @property
    def var(self) -> np.ndarray | float:
        return self.m2 / self.n if self.decay >= 1 and self.n else self.m2


def online_rmse(errors: DataFrame, key: list[str]) -> DataFrame:
    """``key, n_updates, rmse`` of one-step errors; 0 without an update."""
    return errors.groupBy(*key).agg(F.count("err").alias("n_updates"), F.coalesce(F.sqrt(F.avg(F.col("err") * F.col("err"))), F.lit(0.0)).alias("rmse"))


def online_errors(df: DataFrame, key: list[str], order: list[str], x: list[str], y: str, forget: float = 0.9999, standardise: float | None = None) -> DataFrame:
    """``key, order, err``: one-step prediction errors of an online model for each key, in order, streamed batch by batch.

    With ``standardise`` (the decay of the running moments, 1 for all values alike) each column is scaled by its moments up
    to its row, the row included.
    """
    schema = ", ".join([*[f"{c} {dict(df.dtypes)[c]}" for c in (*key, *order)], "err double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, model = None, None
        for b in batches:
            keys = list(zip(*[b.column(k).to_pylist() for k in key]))
            m = np.nan_to_num(np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in x]))
            target = b.column(y).to_numpy(zero_copy_only=False).astype(float)
            err = np.full(b.num_rows, np.nan)
            for i, k in enumerate(keys):
                if k != here:
                    here, model = k, RecursiveLeastSquares(np.zeros(len(x) + 1), np.eye(len(x) + 1) * 100.0, forget)
                    moments = RunningMoments(standardise or 1.0)
                if target[i] == target[i]:
                    if standardise is not None:
                        moments.update(m[i])
                    err[i] = model.update(m[i] if standardise is None else (m[i] - moments.mean) / np.sqrt(moments.var + 1e-8), target[i])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*key, *order)], pa.array(err, mask=np.isnan(err))], names=[*key, *order, "err"])

    rows = df.select(*key, *order, *x, y).repartition(*key).sortWithinPartitions(*key, *order)
    return rows.mapInArrow(run, schema)


# ---- calibration --------------------------------------------------------------------------------------------------


def pool(blocks: Iterator[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Blocks ``(sum of labels, n, lowest, highest score)`` in order of score, neighbours merged until their means rise.

    Means are compared by cross products, which whole-number sums keep exact. Pooling parts of a range first and their
    blocks afterwards gives the same blocks as pooling all at once.
    """
    out: list[tuple[float, float, float, float]] = []
    for y, n, lo, hi in blocks:
        while out and out[-1][0] * n >= y * out[-1][1]:
            y0, n0, lo, _ = out.pop()
            y, n = y + y0, n + n0
        out.append((y, n, lo, hi))
    return out


def isotonic(df: DataFrame, score: str, label: str) -> tuple[list[float], list[float]]:
    """Knots of the isotonic regression of a binary label on a score: pooled by distinct score first, then by neighbours that fall.

    Each range partition of the distinct scores is pooled by its task, the driver pools the blocks that remain. Blocks of a
    0/1 label have rising fractions as means, of which n rows hold some ``n ** (2 / 3)`` at most. Rows without score or label
    (null or NaN) are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("y", "n", "s", "s")]))
        names = ["y", "n", "lo", "hi"]
        if blocks := pool(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*blocks)], names=names)

    d = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y")).where(~(missing(F.col("s")) | missing(F.col("y"))))
    distinct = d.groupBy("s").agg(F.sum("y").alias("y"), F.count("*").cast("double").alias("n"))
    parts = distinct.repartitionByRange("s").sortWithinPartitions("s").mapInArrow(run, "y double, n double, lo double, hi double")
    xs, ys = [], []
    for y, n, lo, hi in pool(sorted((tuple(r) for r in parts.collect()), key=lambda r: r[2])):
        for s in dict.fromkeys((lo, hi)):
            xs.append(float(s))
            ys.append(float(min(max(y / n, 0.0), 1.0)))
    return xs, ys


def interpolate(value: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear through the knots, level beyond the ends; null stays null."""
    ax, ay = F.array(*[F.lit(float(x)) for x in xs]), F.array(*[F.lit(float(y)) for y in ys])
    below = F.size(F.filter(ax, lambda x: x <= value))
    i = F.least(F.greatest(below, F.lit(1)), F.lit(len(xs) - 1))
    x0, x1, y0, y1 = F.element_at(ax, i), F.element_at(ax, i + 1), F.element_at(ay, i), F.element_at(ay, i + 1)
    line = y0 + F.coalesce(F.when(x1 != x0, (value - x0) / (x1 - x0)), F.lit(0.0)) * (y1 - y0)
    return F.when(value.isNull(), None).when(value <= xs[0], F.lit(ys[0])).when(value >= xs[-1], F.lit(ys[-1])).otherwise(line)


def adverse_threshold(df: DataFrame, moved: str, tick: float = 0.25) -> float:
    """Half a tick, or the median size of the moves where half a tick marks fewer than 5 % or more than 95 % of them as adverse."""
    size = df.select(F.abs(F.col(moved)).alias("v"), F.lit(1).alias("one")).where(~missing(F.col("v")))
    rate = size.agg(F.avg((F.col("v") > 0.5 * tick).cast("double"))).first()[0]
    if rate is None or 0.05 <= rate <= 0.95:
        return 0.5 * tick
    return exact_percentiles(size, ["one"], "v", [0.5]).first()["q"][0] or 0.5 * tick


def adverse_label(moved: Column, threshold: float = 0.125) -> Column:
    return (F.abs(moved) > F.lit(threshold)).cast("int")


# ---- scorers and quotes -------------------------------------------------------------------------------------------


def logistic(terms: dict[str, float], bias: float = 0.0, platt: tuple[float, float] = (1.0, 0.0), boost: float = 1.15, above: float = 0.65) -> Column:
    """Probability from a linear score through a Platt scale, raised by ``boost`` where its entropy in bits passes ``above``, at most 1."""
    s = sum((F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) * w for c, w in terms.items()), F.lit(bias))
    p = 1 / (1 + F.exp(-(s * platt[0] + platt[1])))
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    h = -(q * F.log2(q) + (1 - q) * F.log2(1 - q))
    return F.least(F.when(h > above, p * boost).otherwise(p), F.lit(1.0))


def entry_probability(score: Column, low: float = -2.0, high: float = 2.0) -> Column:
    """A predicted gain in ticks as a share of the range from ``low`` to ``high``, 0 to 1."""
    return _clip((score - low) / (high - low), 0.0, 1.0)


def sigmoid(score: Column) -> Column:
    """The probability of a linear score without scale or boost."""
    return 1 / (1 + F.exp(-score))


def snapshot_probability(score: Column, calibrated: Column, long: Column) -> Column:
    """A calibrated probability, a tenth more for a long quote under buying pressure; 0 to 1."""
    return _clip(F.when(long & (score > 0), F.least(calibrated * 1.1, F.lit(1.0))).otherwise(calibrated), 0.0, 1.0)


def nearest_regime(vol: Column, spread: Column, centroids: list[tuple[float, float]]) -> Column:
    """Index of the nearest (volatility, spread) centroid, of equal ones the first."""
    far = [(vol - v) * (vol - v) + (spread - s) * (spread - s) for v, s in centroids]
    least = F.least(*far)
    out = F.lit(None).cast("int")
    for k in reversed(range(len(far))):
        out = F.when(far[k] == least, F.lit(k)).otherwise(out)
    return out


def hysteresis(df: DataFrame, group: list[str], order: list[str], raw: str, name: str = "regime", depth: int = 5, first: int = 0) -> DataFrame:
    """The regime in force: it changes to ``raw`` once the last ``depth`` rows agree, and stays until then (``first`` before)."""
    at = Window.partitionBy(*group).orderBy(*order)
    last = at.rowsBetween(-(depth - 1), 0)
    agreed = F.when((F.min(raw).over(last) == F.max(raw).over(last)) & (F.count(raw).over(last) == depth), F.col(raw))
    return df.withColumn("_agreed", agreed).withColumn(name, F.coalesce(F.last("_agreed", ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, 0)), F.lit(first))).drop("_agreed")


def _clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def quote_spread(base: Column, vol_fast: Column, vol_slow: Column, inventory: Column, tox: Column, gex: Column) -> Column:
    """Whole ticks from 1 to 8, halves to even: wider with volatility, inventory and toxicity, narrower with positive gamma."""
    ratio = _clip(vol_fast / (vol_slow + 1e-10), 0.5, 3.0)
    raw = base * ratio * (1 + 0.5 * F.abs(inventory) / 10) * (1 + 4 * F.abs(tox)) * (1 - 0.3 * _clip(gex, -1.0, 1.0))
    return _clip(F.rint(raw), 1.0, 8.0).cast("int")


def quote_skew(inventory: Column, tox: Column) -> Column:
    """Whole ticks against the inventory and the toxic side."""
    return F.rint(-F.signum(inventory) * F.least(F.abs(inventory) / 5, F.lit(2.0)) - F.signum(tox) * F.least(F.abs(tox) / 0.25, F.lit(1.5))).cast("int")


def blended_half_spread(table_hs: Column, model_hs: Column, uncertainty: Column, inventory: Column) -> dict[str, Column]:
    """Half-spread from table and regression (0.7 and 0.3), widened by uncertainty, and the bid and ask distances after the inventory skew."""
    blend = _clip((0.7 * F.coalesce(table_hs, F.lit(1.0)) + 0.3 * _clip(F.coalesce(model_hs, F.lit(1.0)), 0.5, 5.0)) * (1 + 0.1 * F.coalesce(uncertainty, F.lit(0.0))), 0.5, 5.0)
    skew = _clip(0.02 * inventory, -2.0, 2.0)
    return {"half_spread": blend, "bid_off": _clip(blend + skew, 0.5, 8.0), "ask_off": _clip(blend - skew, 0.5, 8.0)}


def vif(df: DataFrame, x: list[str]) -> pd.DataFrame:
    """``feature, vif``: diagonal of the inverse covariance (plus 1e-6) times the variance, from one Gram matrix."""
    m = gram(df.withColumns({"_one": F.lit(0), "_y": F.lit(0.0)}), x, "_y", "_one")[0]
    n = m[0, 0]
    mean = m[0, 1:-1] / n
    cov = (m[1:-1, 1:-1] - n * np.outer(mean, mean)) / (n - 1)
    return pd.DataFrame({"feature": x, "vif": np.diag(np.linalg.inv(cov + 1e-6 * np.eye(len(x)))) * np.diag(cov)})


def correlations(df: DataFrame, x: list[str], top: int = 15) -> pd.DataFrame:
    """The ``top`` pairs by size of correlation (missing as 0), with a flag above 0.7, from one Gram matrix."""
    m = gram(df.withColumns({"_one": F.lit(0), "_y": F.lit(0.0)}), x, "_y", "_one")[0]
    n = m[0, 0]
    mean = m[0, 1:-1] / n
    cov = m[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    pairs = [(x[i], x[j], cov[i, j] / sd[i] / sd[j]) for i in range(len(x)) for j in range(i + 1, len(x))]
    pairs.sort(key=lambda r: (-abs(r[2]), r[0], r[1]))
    return pd.DataFrame([(a, b, c, abs(c) > 0.7) for a, b, c in pairs[:top]], columns=["a", "b", "corr", "high"])
