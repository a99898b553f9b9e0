"""Second moments of wide tables, and the models that need nothing else.

One pass over the rows makes the Gram matrix in blocks of ``BLOCK`` columns: each task adds
up its rows with matrix products, blocks are summed in two levels (first within a share of
the tasks), so a plan has one expression whatever the number of columns.  With a fold
column every fold gets its own sums; a training set is the total less one fold.

The driver sees at most folds x p x p numbers of the models fitted here (LASSO path,
Bayesian ridge, PCA, variance inflation); :func:`corr_pairs` leaves them distributed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256
#: Shares of the tasks whose blocks are summed first.
SHARES = 32
#: Bytes of sums that a task holds before it sends them on.
HELD = 1 << 28


@dataclass(frozen=True)
class Moments:
    """Row count, sums and Gram matrix of the columns less ``shift``."""
    n: float
    total: np.ndarray
    gram: np.ndarray
    shift: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.gram + other.gram, self.shift)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.gram - other.gram, self.shift)

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.total / self.n

    @property
    def cov(self) -> np.ndarray:
        """Population covariance."""
        m = self.total / self.n
        return self.gram / self.n - np.outer(m, m)


def _blocks(rows: DataFrame, p: int, shift: np.ndarray, pairwise: bool) -> DataFrame:
    """``fold, i, j, data``: summed blocks of rows ``fold, xs`` (NaN: missing).

    ``pairwise``: four matrices a block (products, values by presence, squares by presence,
    presence by presence); otherwise the products only, the last column being 1.
    """
    cuts = [(a, min(a + BLOCK, p)) for a in range(0, p, BLOCK)]
    kinds = 4 if pairwise else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, sums = TaskContext.get().partitionId() % SHARES, {}

        def sent():
            out = []
            for fold, m in sums.items():
                for i, (a, b) in enumerate(cuts):
                    for j, (c, d) in enumerate(cuts):
                        if pairwise or i <= j:
                            out.append((fold, i, j, share, np.ascontiguousarray(m[:, a:b, c:d]).tobytes()))
            sums.clear()
            for s in range(0, len(out), 64):
                part = list(zip(*out[s:s + 64]))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x, pa.int32()) for x in part[:4]], pa.array(part[4], pa.binary())],
                    names=["fold", "i", "j", "share", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fold = np.asarray(batch.column(0))
            x = np.asarray(batch.column(1).flatten()).astype(np.float64).reshape(-1, p - (not pairwise))
            for f in np.unique(fold).tolist():
                own = x[fold == f]
                if pairwise:
                    has = ~np.isnan(own)
                    own, m = np.where(has, own - shift, 0.0), has.astype(np.float64)
                    add = np.stack([own.T @ own, own.T @ m, (own * own).T @ m, m.T @ m])
                else:
                    own = np.concatenate([own - shift, np.ones((len(own), 1))], axis=1)
                    add = (own.T @ own)[None]
                sums[f] = sums[f] + add if f in sums else add
            if len(sums) * kinds * p * p * 8 > HELD:
                yield from sent()
        yield from sent()

    def summed(key, t):
        data = sum(np.frombuffer(x, dtype=np.float64) for x in t.column("data").to_pylist())
        return pa.table({"fold": t.column("fold").slice(0, 1), "i": t.column("i").slice(0, 1), "j": t.column("j").slice(0, 1),
                         "data": pa.array([data.tobytes()], pa.binary())})

    kind = "fold int, i int, j int, data binary"
    return rows.select("fold", "xs").mapInArrow(run, "fold int, i int, j int, share int, data binary") \
        .groupBy("fold", "i", "j", "share").applyInArrow(summed, kind) \
        .groupBy("fold", "i", "j").applyInArrow(summed, kind)


def _rows(df: DataFrame, cols: Sequence[str], fold: str | None) -> tuple[DataFrame, np.ndarray]:
    at = F.col(fold).cast("int") if fold else F.lit(0)
    xs = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols])
    rows = df.select(at.alias("fold"), xs.alias("xs"))
    one = rows.first()
    # any constant near the data keeps the sums small
    shift = np.nan_to_num(np.array(one["xs"], dtype=float)) if one else np.zeros(len(cols))
    return rows, shift


def moments(df: DataFrame, cols: Sequence[str], fold: str | None = None) -> dict[int, Moments]:
    """Moments of the rows without a missing value, per fold."""
    rows, shift = _rows(df, cols, fold)
    return _collected(rows.where(~F.exists("xs", lambda x: F.isnan(x))), len(cols), shift)


def vector_moments(df: DataFrame, features: str, label: str, fold: str | None = None) -> dict[int, Moments]:
    """The same for a vector column and a label, which comes last."""
    at = F.col(fold).cast("int") if fold else F.lit(0)
    rows = df.select(at.alias("fold"), F.concat(vector_to_array(features), F.array(F.col(label).cast("double"))).alias("xs"))
    one = rows.first()
    if one is None:
        raise ValueError("no row to fit on")
    return _collected(rows, len(one["xs"]), np.array(one["xs"], dtype=float))


def _collected(rows: DataFrame, p: int, shift: np.ndarray) -> dict[int, Moments]:
    full: dict[int, np.ndarray] = {}
    size = p + 1
    for r in _blocks(rows, size, shift, False).collect():        # folds x p x p numbers
        m = full.setdefault(r["fold"], np.zeros((size, size)))
        a, c = r["i"] * BLOCK, r["j"] * BLOCK
        b, d = min(a + BLOCK, size), min(c + BLOCK, size)
        part = np.frombuffer(r["data"], dtype=np.float64).reshape(b - a, d - c)
        m[a:b, c:d] = part
        m[c:d, a:b] = part.T
    return {f: Moments(m[p, p], m[p, :p], m[:p, :p], shift) for f, m in full.items()}


def corr_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``f1, f2, r`` for all pairs ``f1 < f2`` by position over the rows that have both
    values; null if either is constant there.  Pairs come from the blocks, distributed."""
    cols = list(cols)
    rows, shift = _rows(df, cols, None)
    blocks = _blocks(rows, len(cols), shift, True)
    # the block across the diagonal holds the other side's sums
    flipped = blocks.select("fold", F.col("i").alias("j"), F.col("j").alias("i"), F.col("data").alias("mirror"))
    both = blocks.where("i <= j").join(flipped, ["fold", "i", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x, y in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "data", "mirror"))):
                a, c = i * BLOCK, j * BLOCK
                b, d = min(a + BLOCK, len(cols)), min(c + BLOCK, len(cols))
                xy, sx, sxx, n = np.frombuffer(x, dtype=np.float64).reshape(4, b - a, d - c)
                _, sy, syy, _ = np.frombuffer(y, dtype=np.float64).reshape(4, d - c, b - a).transpose(0, 2, 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cov = xy / n - sx / n * (sy / n)
                    vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
                    # what is left of a constant column is rounding
                    flat = (vx <= 1e-14 * sxx / n) | (vy <= 1e-14 * syy / n) | ~(vx > 0) | ~(vy > 0)
                    r = np.where(flat, np.nan, cov / np.sqrt(vx * vy))
                p, q = np.nonzero(np.arange(a, b)[:, None] < np.arange(c, d)[None, :])
                value = r[p, q]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cols[a + k] for k in p], pa.string()), pa.array([cols[c + k] for k in q], pa.string()),
                     pa.array(value, mask=np.isnan(value))], names=["f1", "f2", "r"])

    return both.mapInArrow(run, "f1 string, f2 string, r double")


# ------------------------------------------------------------ LASSO path

def lasso_path(m: Moments, alphas: Sequence[float], tol: float = 1e-9, max_iter: int = 1_000_000) -> np.ndarray:
    """Coefficients (alphas x features) of ``|y - Xw|^2 / 2n + alpha |w|_1``; the label is the
    last column.  Cyclic coordinate descent on the Gram matrix, each alpha from the one
    before.  Raises when ``max_iter`` sweeps do not settle."""
    c = m.cov
    gram, to_y = c[:-1, :-1], c[:-1, -1]
    w, out = np.zeros(len(to_y)), []
    scale = np.sqrt(np.maximum(np.diag(gram), 0.0))
    live = [j for j in range(len(w)) if scale[j] > 1e-12 * max(1.0, abs(m.mean[j]))]
    for alpha in alphas:
        grad = to_y - gram @ w
        for _ in range(max_iter):
            moved = 0.0
            for j in live:
                old = w[j]
                z = grad[j] + gram[j, j] * old
                new = math.copysign(max(abs(z) - alpha, 0.0), z) / gram[j, j]
                if new != old:
                    grad -= gram[:, j] * (new - old)
                    w[j] = new
                    moved = max(moved, abs(new - old) * scale[j])
            if moved <= tol * math.sqrt(max(c[-1, -1], 1e-300)):
                break
        else:
            raise RuntimeError(f"coordinate descent did not settle in {max_iter} sweeps at alpha {alpha}")
        out.append(w.copy())
    return np.array(out)


def alpha_grid(m: Moments, n_alphas: int = 100, eps: float = 1e-3) -> np.ndarray:
    """From the smallest alpha that keeps all coefficients at 0 down to ``eps`` times it."""
    top = float(np.abs(m.cov[:-1, -1]).max())
    if top <= 0:
        return np.full(n_alphas, np.finfo(float).tiny)
    return top * eps ** (np.arange(n_alphas) / max(n_alphas - 1, 1))


def mean_squared_errors(m: Moments, coef: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Of linear models (rows of ``coef``) over the rows that ``m`` sums up."""
    c, mean = m.cov, m.mean
    bias = mean[-1] - coef @ mean[:-1] - intercept
    quad = np.einsum("ij,jk,ik->i", coef, c[:-1, :-1], coef)
    return np.maximum(c[-1, -1] - 2 * coef @ c[:-1, -1] + quad, 0.0) + bias ** 2


def _intercept(m: Moments, coef: np.ndarray) -> np.ndarray:
    return m.mean[-1] - coef @ m.mean[:-1]


def cross_validated(folds: dict[int, Moments], fit) -> np.ndarray:
    """Held-out mean squared errors (folds x candidates); ``fit(moments)`` returns the
    candidates' coefficients as rows."""
    whole = _total(folds)
    out = []
    for held in folds.values():
        train = whole - held
        coef = fit(train)
        out.append(mean_squared_errors(held, coef, _intercept(train, coef)))
    return np.array(out)


def _total(folds: dict[int, Moments]) -> Moments:
    parts = list(folds.values())
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def lasso_cv(folds: dict[int, Moments], n_alphas: int = 100, eps: float = 1e-3,
             max_iter: int = 1_000_000) -> tuple[np.ndarray, float, float, list[tuple[float, int, float]]]:
    """Coefficients, intercept and alpha of the path's best point by mean held-out error,
    and ``(alpha, fold, mse)`` of the whole path.  Ties go to the larger alpha."""
    whole = _total(folds)
    alphas = alpha_grid(whole, n_alphas, eps)
    mse = cross_validated(folds, lambda m: lasso_path(m, alphas, max_iter=max_iter))
    best = int(mse.mean(axis=0).argmin())
    coef = lasso_path(whole, alphas[:best + 1], max_iter=max_iter)[-1]
    table = [(float(a), int(f), float(mse[i, k])) for i, f in enumerate(folds) for k, a in enumerate(alphas)]
    return coef, float(_intercept(whole, coef)), float(alphas[best]), table


# ------------------------------------------------------------ Bayesian ridge

def bayes_ridge(m: Moments, alpha_1: float = 1e-6, alpha_2: float = 1e-6, lambda_1: float = 1e-6,
                lambda_2: float = 1e-6, tol: float = 1e-6, max_iter: int = 10_000) -> np.ndarray:
    """Evidence-maximised ridge coefficients (MacKay 1992) with gamma priors on the noise
    (``alpha``) and weight (``lambda``) precisions.  Raises when it does not settle."""
    c = m.cov * m.n
    xx, xy, yy = c[:-1, :-1], c[:-1, -1], c[-1, -1]
    value, vector = np.linalg.eigh(xx)
    value, turned = np.clip(value, 0.0, None), vector.T @ xy
    alpha, lam = 1.0 / max(yy / m.n, 1e-12), 1.0
    for _ in range(max_iter):
        w = alpha * turned / (alpha * value + lam)
        gamma = float((alpha * value / (alpha * value + lam)).sum())
        rss = max(float(yy - 2 * w @ turned + (w * value) @ w), 0.0)
        lam_new = (gamma + 2 * lambda_1) / (float(w @ w) + 2 * lambda_2)
        alpha_new = (m.n - gamma + 2 * alpha_1) / (rss + 2 * alpha_2)
        done = abs(lam_new - lam) <= tol * lam and abs(alpha_new - alpha) <= tol * alpha
        alpha, lam = alpha_new, lam_new
        if done:
            return vector @ (alpha * turned / (alpha * value + lam))
    raise RuntimeError(f"evidence maximisation did not settle in {max_iter} rounds")


# ------------------------------------------------------------ PCA, variance inflation

@dataclass(frozen=True)
class Pca:
    """Components as rows, the first loading of largest size positive."""
    cols: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray
    whiten: bool

    def transform(self, df: DataFrame, out: str = "pc") -> DataFrame:
        """Add ``pc1, pc2, ...``; a row with a missing value gets nulls."""
        z = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(self.cols, self.mean, self.scale)]
        for k, w in enumerate(self.components):
            size = math.sqrt(self.variance[k]) if self.whiten and self.variance[k] > 0 else 1.0
            df = df.withColumn(f"{out}{k + 1}", sum((x * float(v / size) for x, v in zip(z, w)), F.lit(0.0)))
        return df


def pca(df: DataFrame, cols: Sequence[str], keep: float | int | None = None, whiten: bool = False,
        standardise: bool = False) -> Pca:
    """Principal components from one Gram pass over the complete rows.  ``keep``: a number of
    components, or the share of variance that they have to explain together (0.95); all by
    default.  Variances are sample variances."""
    m = moments(df, cols)[0]
    c = m.cov * m.n / max(m.n - 1, 1)
    scale = np.sqrt(np.diag(c)) if standardise else np.ones(len(cols))
    scale = np.where(scale > 0, scale, 1.0)
    value, vector = np.linalg.eigh(c / np.outer(scale, scale))
    value, vector = np.clip(value[::-1], 0.0, None), vector[:, ::-1].T
    lead = np.take_along_axis(vector, np.abs(vector).round(9).argmax(axis=1)[:, None], axis=1)
    vector = vector * np.where(lead < 0, -1.0, 1.0)
    ratio = value / max(value.sum(), 1e-300)
    k = len(cols)
    if isinstance(keep, float):
        k = int(np.searchsorted(np.cumsum(ratio), keep - 1e-12) + 1)
    elif keep:
        k = int(keep)
    k = min(k, len(cols))
    return Pca(tuple(cols), m.mean, scale, vector[:k], value[:k], ratio[:k], whiten)


def variance_inflation(df: DataFrame, cols: Sequence[str]) -> list[float | None]:
    """Diagonal of the inverse correlation matrix; null for a constant column, infinite
    for one that others determine."""
    c = moments(df, cols)[0].cov
    live = [i for i in range(len(cols)) if c[i, i] > 0]
    scale = np.sqrt(np.diag(c)[live])
    corr = c[np.ix_(live, live)] / np.outer(scale, scale)
    out: list[float | None] = [None] * len(cols)
    for k, i in enumerate(live):
        rest = [j for j in range(len(live)) if j != k]
        part, to = corr[np.ix_(rest, rest)], corr[rest, k]
        left = 1.0 - float(to @ np.linalg.lstsq(part, to, rcond=1e-12)[0]) if rest else 1.0
        out[i] = 1.0 / left if left > 1e-12 else math.inf
    return out
