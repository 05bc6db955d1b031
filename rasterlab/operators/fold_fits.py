"""Fits of all folds from one table of moments, and Newton steps for all of them side by side.

Rows carry ``id, y, features`` and their folds (``ml.with_folds``). One pass gives count, sums and cross products of
every (repeat, fold, class); what a fold trains on is the total of its repeat less that cell. Scaling, principal axes
and Gaussian classes follow from it without another look at the rows. The logistic takes Newton steps: each pass
over the rows adds gradient and curvature of every (method, repeat, fold) in the task, so the number of passes is that of
the steps, whatever the number of folds and methods; an L1 penalty is put on the quadratic by coordinate descent.
Every linear method ends as coefficients on the raw features, and one pass scores all held-out rows.

What is collected is ``repeats * k * classes * d^2`` moments and ``fits * p^2`` curvatures, set by the protocol and not by the
rows. Features are taken relative to one row's values, so large offsets do not cancel digits. A feature that is constant in a
training fold is left out of it. Rows with a null label or without features are an error of the caller, a training fold
with one class gives that class's share as score. Equal ids are rows each.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from rasterlab import params as P
from rasterlab.operators.ml import with_folds
from rasterlab.session import cut_lineage

SMOOTHING = 1e-9   # of the largest variance, added to every variance of the Gaussian classes
STEPS_MAX = 60
TOLERANCE = 1e-9


@dataclass(frozen=True)
class Bayes:
    """Gaussian classes with diagonal covariance."""
    threshold: float = 0.5


@dataclass(frozen=True)
class Logistic:
    """Logistic on scaled features, or on their principal axes. ``c`` is the inverse penalty against the summed loss,
    ``weights`` None, "balanced" or the weight of the positive class."""
    c: float = 1.0
    l1: bool = False
    weights: str | float | None = None
    components: int | None = None
    drop_first: bool = False
    threshold: float = 0.5


@dataclass
class Moments:
    """Of every (repeat, fold, class): n, sums and cross products of the features less ``shift``."""
    shift: np.ndarray
    n: np.ndarray
    s: np.ndarray
    c: np.ndarray

    def training(self, repeat: int, fold: int):
        """(n, s, c) by class of what the fold trains on."""
        return tuple(m[repeat].sum(axis=0) - m[repeat, fold] for m in (self.n, self.s, self.c))

    def scale(self, repeat: int, fold: int):
        """Mean, population covariance of the training rows of a fold."""
        n, s, c = (m.sum(axis=0) for m in self.training(repeat, fold))
        mean = s / n
        return mean + self.shift, c / n - np.outer(mean, mean)


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("y").cast("int").alias("y"), vector_to_array("features").alias("x"), F.col("folds").cast("array<int>").alias("folds"))


def _arrays(batch):
    n = batch.num_rows
    x, folds = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for i in (2, 3))
    return batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), x.astype(np.float64, copy=False), folds


def _summed(parts: DataFrame) -> dict:
    """(slot, n, values array) of tasks, added up by slot; there are as many rows as slots."""
    def add(pdf):
        pdf = pdf.sort_values("task")
        out = pdf.iloc[:1].copy()
        out["n"], out["v"] = pdf["n"].sum(), [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]
        return out[["slot", "n", "v"]]
    tagged = parts.withColumn("task", F.spark_partition_id())
    return {r.slot: (r.n, np.array(r.v)) for r in tagged.groupBy("slot").applyInPandas(add, "slot int, n double, v array<double>").collect()}


def _slots(n: dict, v: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slot": pa.array(list(v), pa.int32()), "n": pa.array([float(n[k]) for k in v], pa.float64()),
                                       "v": pa.array([v[k].ravel() for k in v], pa.list_(pa.float64()))})


_SLOT_DDL = "slot int, n double, v array<double>"


def moments(rows: DataFrame, repeats: int, k: int) -> Moments:
    first = rows.orderBy("id").select(vector_to_array("features").alias("x")).first()
    shift = np.array(first.x) if first else np.zeros(0)
    d = len(shift)

    def run(batches):
        n, v = {}, {}
        for b in batches:
            if not b.num_rows:
                continue
            y, x, folds = _arrays(b)
            x = np.column_stack([x - shift, np.ones(len(x))])  # the last row of the products is the sums
            for r in range(repeats):
                for f in range(k):
                    for c in (0, 1):
                        mine = x[(folds[:, r] == f) & (y == c)]
                        if len(mine):
                            slot = (r * k + f) * 2 + c
                            n[slot] = n.get(slot, 0) + len(mine)
                            v[slot] = v.get(slot, 0) + mine.T @ mine
        yield _slots(n, v)
    got = _summed(_plain(rows).mapInArrow(run, _SLOT_DDL))
    out = Moments(shift, np.zeros((repeats, k, 2)), np.zeros((repeats, k, 2, d)), np.zeros((repeats, k, 2, d, d)))
    for slot, (n, v) in got.items():
        at, m = (slot // 2 // k, slot // 2 % k, slot % 2), v.reshape(d + 1, d + 1)
        out.n[at], out.s[at], out.c[at] = n, m[-1, :-1], m[:-1, :-1]
    return out


def principal_axes(cov: np.ndarray, components: int, drop_first: bool = False) -> np.ndarray:
    """Columns: the axes of largest variance of a symmetric matrix, largest first, the largest entry of each positive."""
    value, axis = np.linalg.eigh(cov)
    axis = axis[:, np.argsort(-value, kind="stable")[:components]]
    axis = axis * np.sign(axis[np.abs(axis).argmax(axis=0), np.arange(axis.shape[1])])
    return axis[:, int(drop_first):]


def explained_shares(cov: np.ndarray) -> np.ndarray:
    value = np.sort(np.linalg.eigvalsh(cov))[::-1]
    return value / value.sum()


def _space(m: Moments, spec: Logistic, repeat: int, fold: int):
    """Mean and the matrix from centred raw features to those that are fitted."""
    mean, cov = m.scale(repeat, fold)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    n = m.training(repeat, fold)[0].sum()
    sd = sd * np.sqrt(n / max(n - 1, 1))  # sample deviation, as the scaler has it
    inv = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 1e-12 * (np.abs(mean) + 1e-300))
    t = np.diag(inv)
    if spec.components is not None:
        d = int((inv > 0).sum())
        t = t @ principal_axes(inv[:, None] * cov * inv[None], min(spec.components, d, max(1, int(n) - 1)), spec.drop_first)
    return mean, t


def _bayes(m: Moments, repeat: int, fold: int):
    """Quadratic score q: log odds = c + b.x + sum(a x^2), x less the shift."""
    n, s, c = m.training(repeat, fold)
    mean = s / n[:, None]
    var = np.einsum("cii->ci", c) / n[:, None] - mean ** 2
    total, cov = m.scale(repeat, fold)
    var = np.maximum(var, 0) + SMOOTHING * np.diag(cov).max()
    part = np.log(n / n.sum()) - 0.5 * (np.log(2 * np.pi * var) + mean ** 2 / var).sum(axis=1)
    lin, quad = mean / var, -0.5 / var
    return part[1] - part[0], lin[1] - lin[0], quad[1] - quad[0]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _loss(z, y):
    return np.logaddexp(0, z) - y * z


def _penalised_step(g, h, beta, lam, l1):
    """The minimum of the quadratic with the penalty; the last entry, the intercept, has none."""
    if not l1:
        pen = np.r_[np.full(len(beta) - 1, lam), 0.0]
        return beta - np.linalg.lstsq(h + np.diag(pen), g + pen * beta, rcond=None)[0]
    new, slope = beta.copy(), g.copy()
    for _ in range(5000):
        most = 0.0
        for j in range(len(beta)):
            if h[j, j] <= 0:
                continue
            at = new[j] - slope[j] / h[j, j]
            if j < len(beta) - 1:
                at = np.sign(at) * max(abs(at) - lam / h[j, j], 0.0)
            move = at - new[j]
            if move:
                slope += h[:, j] * move
                new[j] = at
                most = max(most, abs(move))
        if most < 1e-12:
            break
    return new


def logistic_fits(rows: DataFrame, m: Moments, specs: list[Logistic], repeats: int, k: int) -> dict:
    """(spec number, repeat, fold) to (coefficients on raw features, intercept)."""
    jobs = [(i, r, f) for i in range(len(specs)) for r in range(repeats) for f in range(k)]
    space = {j: _space(m, specs[j[0]], j[1], j[2]) for j in jobs}
    weight, out = {}, {}
    for j in jobs:
        n, w = m.training(j[1], j[2])[0], specs[j[0]].weights
        weight[j] = np.array([1.0, 1.0] if w is None else n.sum() / (2 * np.maximum(n, 1)) if w == "balanced" else [1.0, float(w)])
    beta = {j: np.zeros(space[j][1].shape[1] + 1) for j in jobs}
    held: dict = {}   # the best point so far: (value, beta)
    left = list(jobs)
    for _ in range(STEPS_MAX):
        if not left:
            break
        now = {j: (beta[j], *space[j], weight[j]) for j in left}

        def run(batches, now=now):
            n, v = {}, {}
            for b in batches:
                if not b.num_rows:
                    continue
                y, x, folds = _arrays(b)
                for slot, ((_, r, f), (at, mean, t, w)) in enumerate(now.items()):
                    mine = folds[:, r] != f
                    z = np.column_stack([(x[mine] - mean) @ t, np.ones(mine.sum())])
                    s, yy = z @ at, y[mine]
                    p, ww = _sigmoid(s), w[yy]
                    g, h = z.T @ (ww * (p - yy)), (z * (ww * p * (1 - p))[:, None]).T @ z
                    n[slot] = n.get(slot, 0.0) + float((ww * _loss(s, yy)).sum())
                    v[slot] = v.get(slot, 0.0) + np.concatenate([g, h.ravel()])
            yield _slots(n, v)
        got = _summed(_plain(rows).mapInArrow(run, _SLOT_DDL))
        rest = []
        for slot, j in enumerate(now):
            loss, v = got[slot]
            spec, p = specs[j[0]], len(beta[j])
            free, lam = beta[j][:-1], 1.0 / spec.c
            value = loss + (lam * np.abs(free).sum() if spec.l1 else 0.5 * lam * (free ** 2).sum())
            if j in held and value > held[j][0] + 1e-12 * abs(value):  # too far: half of the way
                half = (beta[j] + held[j][1]) / 2
                if np.abs(half - held[j][1]).max() < TOLERANCE:
                    out[j] = held[j][1]
                else:
                    beta[j] = half
                    rest.append(j)
                continue
            held[j] = value, beta[j]
            new = _penalised_step(v[:p], v[p:].reshape(p, p), beta[j], lam, spec.l1)
            if np.abs(new - beta[j]).max() < TOLERANCE * max(1.0, np.abs(new).max()):
                out[j] = new
            else:
                beta[j] = new
                rest.append(j)
        left = rest
    if left:
        raise ValueError(f"{len(left)} logistic fits did not converge in {STEPS_MAX} steps")
    raw = {}
    for j, b in out.items():
        mean, t = space[j]
        raw[j] = t @ b[:-1], b[-1] - mean @ (t @ b[:-1])
    return raw


def evaluate(df: DataFrame, methods: list[tuple[str, Bayes | Logistic]], repeats: int = 5, k: int = P.OUTER_SPLITS, seed: int = P.SEED,
             group: str = "id") -> DataFrame:
    """(name, repeat, fold, id, y, score, threshold) of every held-out row, as ``ml.evaluate`` gives it."""
    rows = cut_lineage(with_folds(df, seed, k, repeats, group).select("id", "y", "features", "folds"))
    m = moments(rows, repeats, k)
    specs = [s for _, s in methods if isinstance(s, Logistic)]
    lines = logistic_fits(rows, m, specs, repeats, k) if specs else {}
    models, at = [], 0
    for name, spec in methods:
        for r in range(repeats):
            for f in range(k):
                n = m.training(r, f)[0]
                if n.min() == 0:
                    fit = ("share", n[1] / n.sum() if n.sum() else 0.0)
                elif isinstance(spec, Bayes):
                    fit = ("quadratic", *_bayes(m, r, f))
                else:
                    fit = ("line", *lines[at, r, f])
                models.append((name, spec.threshold, r, f, fit))
        at += isinstance(spec, Logistic)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            y, x, folds = _arrays(b) if b.num_rows else (None, None, None)
            for name, threshold, r, f, fit in models if b.num_rows else ():
                mine = np.flatnonzero(folds[:, r] == f)
                if not len(mine):
                    continue
                z = x[mine]
                if fit[0] == "share":
                    score = np.full(len(mine), fit[1])
                elif fit[0] == "line":
                    score = _sigmoid(z @ fit[1] + fit[2])
                else:
                    z = z - m.shift
                    score = _sigmoid(fit[1] + z @ fit[2] + (z * z) @ fit[3])
                yield pa.RecordBatch.from_pydict({
                    "name": [name] * len(mine), "repeat": pa.array([r] * len(mine), pa.int32()), "fold": pa.array([f] * len(mine), pa.int32()),
                    "id": b.column(0).take(pa.array(mine)), "y": pa.array(y[mine], pa.int32()), "score": pa.array(score),
                    "threshold": pa.array([threshold] * len(mine), pa.float64())})
    return _plain(rows).mapInArrow(run, f"name string, repeat int, fold int, id {kind}, y int, score double, threshold double")


def fold_correlations(df: DataFrame, repeats: int = 5, k: int = P.OUTER_SPLITS, seed: int = P.SEED, group: str = "id") -> DataFrame:
    """(repeat, fold, i, j, corr), i <= j: correlations of the features over what each fold trains on."""
    rows = cut_lineage(with_folds(df, seed, k, repeats, group).select("id", "y", "features", "folds"))
    m = moments(rows, repeats, k)
    out = []
    for r in range(repeats):
        for f in range(k):
            _, cov = m.scale(r, f)
            sd = np.sqrt(np.diag(cov))
            corr = cov / np.outer(sd, sd)
            out += [(r, f, i, j, float(corr[i, j])) for i in range(len(sd)) for j in range(i, len(sd))]
    return df.sparkSession.createDataFrame(out, "repeat int, fold int, i int, j int, corr double")
