"""Cross-validated, projection-weighted canonical correlation from mergeable moments.

For z = [view 1, view 2] each task adds up n, sum z and sum z z^T per group and fold. Fold moments add,
so the training covariance of any choice of folds, every trial and every regularisation come from one
pass over the rows; matrices of d x d are then solved per group in its own task.

A task holds HELD_BYTES of sums at most: beyond that it hands on what it has. Matrices travel as blocks
of rows of BLOCK_CELLS cells, and blocks are added up as vectors by the engine's own aggregate, partially
on the map side; no worker ever holds the partial sums of several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of regularisation that are tried in this order until enough succeed.
FIRST_EPSILONS = (1e-10, 1e-11, 1e-9)
NEXT_EPSILONS = (1e-8, 1e-7, 1e-6, 1e-5)
ENOUGH = 6
#: (dev, test) folds of trials; the other eight folds train. The first N_TRIALS count for which any regularisation can be fitted.
TRIALS = ((0, 1), (2, 3), (4, 5), (6, 7), (8, 9))
N_TRIALS = 3
#: Partial sums that a task holds, and cells of a matrix that travel in one row.
HELD_BYTES = 256 << 20
BLOCK_CELLS = 1 << 16
#: A direction whose held-out variance is below this part of the largest is round-off: its correlation counts as 0.
NULL_VARIANCE = 1e-10


class Moments(NamedTuple):
    n: float
    s: np.ndarray  # sums
    m: np.ndarray  # sums of products

    def __add__(self, other: Moments) -> Moments:  # type: ignore[override]
        return Moments(self.n + other.n, self.s + other.s, self.m + other.m)

    @property
    def mean(self) -> np.ndarray:
        return self.s / self.n

    @property
    def scatter(self) -> np.ndarray:
        """Sums of products about the mean."""
        return self.m - np.outer(self.s, self.s) / self.n


def moments_of(rows: np.ndarray) -> Moments:
    return Moments(float(len(rows)), rows.sum(axis=0), rows.T @ rows)


class Fit(NamedTuple):
    proj_x: np.ndarray
    proj_y: np.ndarray
    keep_x: np.ndarray
    keep_y: np.ndarray


def _inverse_root(a: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(np.linalg.pinv(a, hermitian=True))
    return (v * np.sqrt(w)) @ v.T  # a negative eigenvalue gives NaN, which fails below


def fit(train: Moments, d1: int, eps_x: float, eps_y: float) -> Fit:
    """Projections of both views; LinAlgError where the regularisation is too small."""
    if not d1 < train.n or not len(train.s) - d1 < train.n:
        raise np.linalg.LinAlgError("fewer rows than dimensions")
    c = train.scatter / (train.n - 1)
    xx, yy, xy = c[:d1, :d1], c[d1:, d1:], c[:d1, d1:]
    tx, ty = np.abs(xx).max(initial=0.0), np.abs(yy).max(initial=0.0)
    if tx <= 0 or ty <= 0:
        return Fit(np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(d1, bool), np.zeros(len(train.s) - d1, bool))
    xx, yy, xy = xx / tx, yy / ty, xy / np.sqrt(tx * ty)
    kx, ky = np.abs(np.diag(xx)) >= eps_x, np.abs(np.diag(yy)) >= eps_y
    if not kx.any() or not ky.any():
        return Fit(np.zeros((0, 0)), np.zeros((0, 0)), kx, ky)
    xx, yy, xy = xx[np.ix_(kx, kx)], yy[np.ix_(ky, ky)], xy[np.ix_(kx, ky)]
    with np.errstate(invalid="ignore"):
        rx, ry = _inverse_root(xx + eps_x * np.eye(len(xx))), _inverse_root(yy + eps_y * np.eye(len(yy)))
    inner = rx @ xy @ ry
    if not np.isfinite(inner).all():
        raise np.linalg.LinAlgError("not finite")
    u, _, vt = np.linalg.svd(inner, full_matrices=True)
    return Fit(u.T @ rx, vt @ ry, kx, ky)


def _weights(proj: np.ndarray, scatter: np.ndarray, means: np.ndarray, n: float, k: int) -> np.ndarray:
    """How much of the first k neurons each direction holds, from moments alone; normalised.

    With the projected rows D moved by the first k means m: D D^T = P C P^T + n m m^T and
    D A^T = P C[:, :k] + n m m^T; an orthonormal basis Q of D's rows is L^-1 D with L its Cholesky factor.
    """
    m = means[:k]
    gram = proj @ scatter @ proj.T + n * np.outer(m, m)
    cross = proj @ scatter[:, :k] + n * np.outer(m, m)
    weight = np.abs(np.linalg.solve(np.linalg.cholesky(gram), cross)).sum(axis=1)
    return weight / weight.sum()


def score(fitted: Fit, held: Moments, d1: int, mean_of_views: bool = False) -> float:
    """Projection-weighted correlation on held-out moments; NaN where they don't allow one."""
    px, py = fitted.proj_x, fitted.proj_y
    k = min(len(px), len(py))
    if k == 0:
        return 0.0
    if held.n < k:
        return float("nan")
    px, py = px[:k], py[:k]
    c, mean = held.scatter, held.mean
    ix, iy = np.flatnonzero(fitted.keep_x), d1 + np.flatnonzero(fitted.keep_y)
    cxx, cyy, cxy = c[np.ix_(ix, ix)], c[np.ix_(iy, iy)], c[np.ix_(ix, iy)]
    vx, vy = np.einsum("ij,jk,ik->i", px, cxx, px), np.einsum("ij,jk,ik->i", py, cyy, py)
    live = (vx > NULL_VARIANCE * max(vx.max(), 0)) & (vy > NULL_VARIANCE * max(vy.max(), 0))
    r = np.zeros(k)
    cov = np.einsum("ij,jk,ik->i", px, cxy, py)
    r[live] = cov[live] / np.sqrt(vx[live] * vy[live])
    try:
        of_x = lambda: float(_weights(px, cxx, mean[ix], held.n, k) @ r)
        of_y = lambda: float(_weights(py, cyy, mean[iy], held.n, k) @ r)
        if mean_of_views:
            return (of_x() + of_y()) / 2
        return of_x() if len(ix) < len(iy) else of_y()
    except np.linalg.LinAlgError:
        return _weights_by_rank(px, py, cxx, cyy, mean, ix, iy, held.n, k, r)


def _weights_by_rank(px, py, cxx, cyy, mean, ix, iy, n, k, r) -> float:
    """As above where the projected rows are rank deficient (a one-hot view): over the eigenbasis's live part."""
    p, c, m = (px, cxx, mean[ix][:k]) if len(ix) < len(iy) else (py, cyy, mean[iy][:k])
    gram = p @ c @ p.T + n * np.outer(m, m)
    lift = gram + np.eye(k) * 1e-12 * np.trace(gram)
    try:
        weight = np.abs(np.linalg.solve(np.linalg.cholesky(lift), p @ c[:, :k] + n * np.outer(m, m))).sum(axis=1)
    except np.linalg.LinAlgError:
        return float("nan")
    return float(weight / weight.sum() @ r)


def fold_moments(df: DataFrame, keys: list[str], view1: str = "v1", view2: str = "v2", fold: str = "fold", held_bytes: int = HELD_BYTES, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """keys, fold, d1, n, s, m: one row per group and fold, from partial sums of each task."""
    names = [*keys, fold]
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", d1 int, block int, n double, s array<double>, m array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def flush() -> Iterator[pd.DataFrame]:
            for key, (d1, x) in held.items():
                rows = max(1, block_cells // max(len(x.s), 1))
                for block, at in enumerate(range(0, max(len(x.s), 1), rows)):
                    first = block == 0
                    part = x.m[at : at + rows].ravel()
                    own = {c: pd.Series([None if pd.isna(k) else k], dtype=object) for c, k in zip(names, key, strict=True)}
                    yield pd.DataFrame(own | {"d1": d1, "block": block, "n": x.n if first else 0.0, "s": [x.s if first else np.zeros(len(x.s))], "m": [part]})

        for pdf in batches:
            for key, g in pdf.groupby(names, dropna=False):
                a, b = np.stack(g["_a"].to_list()).astype(float), np.stack(g["_b"].to_list()).astype(float)
                new = moments_of(np.hstack([a, b]))
                held[key] = (a.shape[1], held[key][1] + new if key in held else new)
                if sum(x.m.nbytes for _, x in held.values()) > held_bytes:
                    yield from flush()
                    held.clear()
        yield from flush()

    rows = df.where(F.col(view1).isNotNull() & F.col(view2).isNotNull()).select(*names, F.col(view1).cast("array<double>").alias("_a"), F.col(view2).cast("array<double>").alias("_b"))
    blocks = rows.mapInPandas(partial, schema).withColumn("_s", array_to_vector("s")).withColumn("_m", array_to_vector("m"))
    summed = blocks.groupBy(*names, "d1", "block").agg(F.sum("n").alias("n"), Summarizer.sum(F.col("_s")).alias("_s"), Summarizer.sum(F.col("_m")).alias("_m"))
    part = F.struct("block", "n", vector_to_array("_s").alias("s"), vector_to_array("_m").alias("m"))
    whole = summed.groupBy(*names, "d1").agg(F.sort_array(F.collect_list(part)).alias("b"))
    return whole.select(*names, "d1", F.get("b", F.lit(0))["n"].alias("n"), F.get("b", F.lit(0))["s"].alias("s"), F.flatten(F.transform("b", lambda x: x["m"])).alias("m"))


def _by_fold(pdf: pd.DataFrame, fold: str = "fold") -> tuple[dict[int, Moments], int]:
    out = {}
    for r in pdf.itertuples():
        s = np.asarray(r.s, float)
        out[int(getattr(r, fold))] = Moments(r.n, s, np.asarray(r.m, float).reshape(len(s), len(s)))
    return out, int(pdf["d1"].iloc[0])


def _sum(parts: list[Moments]) -> Moments:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def grid() -> list[tuple[float, float]]:
    return [*product(FIRST_EPSILONS, repeat=2), *product(NEXT_EPSILONS, repeat=2)]


def trial_scores(folds: dict[int, Moments], d1: int, trials=TRIALS, n_trials: int = N_TRIALS, mean_of_views: bool = False) -> pd.DataFrame:
    """dev and test score of each trial and each of the first ENOUGH regularisations that can be fitted.

    A trial for which none can is replaced by the next of trials.
    """
    rows, trial = [], 0
    for dev, test in trials:
        if trial == n_trials:
            break
        done = []
        train = [m for f, m in folds.items() if f not in (dev, test)]
        for at, (ex, ey) in enumerate(grid() if train and dev in folds and test in folds else ()):
            try:
                fitted = fit(_sum(train), d1, ex, ey)
                scores = score(fitted, folds[dev], d1, mean_of_views), score(fitted, folds[test], d1, mean_of_views)
            except np.linalg.LinAlgError:
                continue
            done.append((trial, dev, test, at, ex, ey, *scores))
            if len(done) == ENOUGH:
                break
        rows += done
        trial += bool(done)
    return pd.DataFrame(rows, columns=["trial", "dev_fold", "test_fold", "grid", "eps_x", "eps_y", "dev", "test"])


def cca_grid(moments: DataFrame, keys: list[str], mean_of_views: bool = False) -> DataFrame:
    """keys, trial, dev_fold, test_fold, grid, eps_x, eps_y, dev, test; mean_of_views weighs by both views and takes the mean."""
    kinds = dict(moments.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", trial int, dev_fold int, test_fold int, grid int, eps_x double, eps_y double, dev double, test double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        folds, d1 = _by_fold(pdf)
        out = trial_scores(folds, d1, mean_of_views=mean_of_views)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return moments.groupBy(*keys).applyInPandas(run, schema)


def cca_cv(moments: DataFrame, keys: list[str], mean_of_views: bool = False) -> DataFrame:
    """keys, score, n_trials: test score at the best dev score (ties: first in the grid), averaged over trials."""
    from probestack.operators.stats import best_by

    best = best_by(cca_grid(moments, keys, mean_of_views), [*keys, "trial"], "dev", ["grid"])
    return best.where("dev is not null and not isnan(dev)").groupBy(*keys).agg(F.avg("test").alias("score"), F.count("*").alias("n_trials"))


def fit_of(rows: pd.DataFrame, d1: int, d2: int) -> Fit:
    """The projections that rows (side, direction, dim, value) of cca_parameters hold."""
    sides = []
    for side, dims in (("x", d1), ("y", d2)):
        mine = rows[rows["side"] == side]
        keep = np.zeros(dims, bool)
        keep[mine["dim"].to_numpy(int)] = True
        place = np.cumsum(keep) - 1
        proj = np.zeros((int(mine["direction"].max()) + 1 if len(mine) else 0, int(keep.sum())))
        proj[mine["direction"].to_numpy(int), place[mine["dim"].to_numpy(int)]] = mine["value"]
        sides.append((proj, keep))
    return Fit(sides[0][0], sides[1][0], sides[0][1], sides[1][1])


def score_stored(parameters: DataFrame, moments: DataFrame, keys: list[str], folds: tuple[int, ...], mean_of_views: bool = False) -> DataFrame:
    """keys, score: stored projections (keys, side, direction, dim, value) scored on the rows of some folds, without training."""
    kinds = dict(moments.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", score double"

    def run(stored: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held):
            return pd.DataFrame([], columns=[*keys, "score"])
        parts, d1 = _by_fold(held)
        whole = _sum(list(parts.values()))
        value = score(fit_of(stored, d1, len(whole.s) - d1), whole, d1, mean_of_views)
        return pd.DataFrame([[*(held[k].iloc[0] for k in keys), value]], columns=[*keys, "score"])

    held = moments.where(F.col("fold").isin(*folds))
    return parameters.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, schema)


def canonical_correlations(parameters: DataFrame, moments: DataFrame, keys: list[str], folds: tuple[int, ...]) -> DataFrame:
    """keys, direction, rho: correlation of the projected views, direction by direction, over the rows of some folds."""
    kinds = dict(moments.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", direction int, rho double"

    def run(stored: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held):
            return pd.DataFrame([], columns=[*keys, "direction", "rho"])
        parts, d1 = _by_fold(held)
        whole = _sum(list(parts.values()))
        f, c = fit_of(stored, d1, len(whole.s) - d1), whole.scatter
        ix, iy = np.flatnonzero(f.keep_x), d1 + np.flatnonzero(f.keep_y)
        k = min(len(f.proj_x), len(f.proj_y))
        px, py = f.proj_x[:k], f.proj_y[:k]
        var = lambda p, i: np.einsum("ij,jk,ik->i", p, c[np.ix_(i, i)], p)
        rho = np.einsum("ij,jk,ik->i", px, c[np.ix_(ix, iy)], py) / np.sqrt(var(px, ix) * var(py, iy))
        return pd.DataFrame([[*(held[key].iloc[0] for key in keys), i, r] for i, r in enumerate(rho.tolist())], columns=[*keys, "direction", "rho"])

    held = moments.where(F.col("fold").isin(*folds))
    return parameters.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, schema)


def cca_parameters(moments: DataFrame, keys: list[str], dev: int = 0, test: int = 1, eps: tuple[float, float] = (1e-6, 1e-6)) -> DataFrame:
    """keys, side, direction, dim, value: projections fitted on all folds but dev and test, kept dimensions only."""
    kinds = dict(moments.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", side string, direction int, dim int, value double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        folds, d1 = _by_fold(pdf)
        fitted = fit(_sum([m for f, m in folds.items() if f not in (dev, test)]), d1, *eps)
        rows = [(side, i, int(j), float(p[i, at])) for side, p, keep in (("x", fitted.proj_x, fitted.keep_x), ("y", fitted.proj_y, fitted.keep_y)) for i in range(len(p)) for at, j in enumerate(np.flatnonzero(keep))]
        out = pd.DataFrame(rows, columns=["side", "direction", "dim", "value"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return moments.groupBy(*keys).applyInPandas(run, schema)


def cca_1d(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", fold: str = "fold", trials=TRIALS[:N_TRIALS]) -> DataFrame:
    """One dimension against one: sign of the training covariance times the held-out correlation, mean of trials; rows are read once."""
    from probestack.operators.stats import correlation

    wanted = []
    for dev, test in trials:
        train, held = ~F.col(fold).isin(dev, test), F.col(fold) == test
        when = lambda rows, c: F.when(rows, F.col(c))
        wanted.append(F.struct(F.covar_samp(when(train, x), when(train, y)).alias("c"), correlation(when(held, x), when(held, y)).alias("r")))
    each = df.groupBy(*keys).agg(F.array(*wanted).alias("t")).select(*keys, F.explode("t").alias("t"))
    return each.groupBy(*keys).agg(F.avg(F.signum("t.c") * F.col("t.r")).alias("score"), F.count("*").alias("n_trials"))
