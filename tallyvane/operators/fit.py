"""Fitting: driver loops over one aggregate per step.

The predictions table (y int, z or p array<double>) stays distributed; a step sends back only
sums whose count depends on the number of classes, models or candidates, never on the rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions import scores as sc
from tallyvane.operators.vectors import collect_sum
from tallyvane.operators import metrics as mt

GRID_LO, GRID_HI, GRID_STEP = 0.3, 4.0, 0.05
COARSE_GRID = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0]
ASYMMETRIC_BOUNDS = [(0.5, 4.0), (0.3, 2.0), (0.3, 3.0), (1.5, 6.0), (0.3, 3.0), (0.5, 5.0), (0.3, 3.0), (2.0, 7.0)]
CLINICAL_BOUNDS = [(0.5, 5.0), (0.2, 2.0), (0.3, 3.0), (1.5, 6.0), (0.3, 3.0), (0.5, 5.0), (0.3, 3.0), (2.0, 7.0)]


def grid(lo: float, hi: float, step: float) -> list[float]:
    return [round(lo + i * step, 10) for i in range(int(round((hi - lo) / step)) + 1)]


def fold_equal(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows equal in ``cols`` as one row with their number ``n``.

    Scores that come from few inputs repeat often. The searches below and the prior EM read the table
    at each step; they take ``n`` as the number of rows a row stands for, one without such a column.
    """
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def _stood(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "n"]


# ---- temperature --------------------------------------------------------------

def temperature_grid(df: DataFrame, k: int, candidates: Sequence[float] | None = None) -> DataFrame:
    """FIT1/JN10. Mean NLL of every candidate temperature from one scan.

    Each row meets the fixed candidate list inside its own task and is summed there; what is
    shuffled is one partial sum per candidate and task.
    """
    ts = list(candidates or grid(0.5, 5.0, 0.05))
    # log-sum-exp(z/t) − z_y/t = m/t + log Σ exp((d − m)/t) with d = z − z_y and m = max d
    gap = [(F.col("z")[i] - F.array_max("z")).alias(f"_e{i}") for i in range(k)]
    flat = df.select(*gap, (F.array_max("z") - F.col("z")[F.col("y")]).alias("_m"))
    tried = flat.select("*", F.explode(F.array(*[F.lit(t) for t in [1.0] + [t for t in ts if t != 1.0]])).alias("t"))
    loss = F.col("_m") / F.col("t") + F.log(sc.fold_sum([F.exp(F.col(f"_e{i}") / F.col("t")) for i in range(k)]))
    return tried.groupBy("t").agg(F.avg(loss).alias("nll"))


def best_temperature(by_t: DataFrame) -> DataFrame:
    """FIT1. The lowest NLL; T moves off 1 only on a strict improvement."""
    return by_t.agg(
        F.min_by("t", F.struct("nll", F.when(F.col("t") == 1.0, 0).otherwise(1), "t")).alias("t"), F.min("nll").alias("nll")
    ).select(F.round("t", 2).alias("t"), "nll")


# ---- softmax fits (temperatures, Dirichlet) -------------------------------------

def _batched(df: DataFrame, shapes: dict[str, tuple[int, ...]], kernel) -> np.ndarray:
    """Sum a numpy statistic over all rows. ``kernel(*arrays)`` returns one flat vector per batch.

    Array columns travel as plain numeric columns, so Arrow hands numpy contiguous blocks. A task
    emits one vector as bytes; vectors are added in a tree and few reach the driver. Parameters
    live in the kernel, so no stage is compiled again between steps.
    """
    flat, layout, at = [], [], 0
    for name, shape in shapes.items():
        cells = [(i,) for i in range(shape[0])] if len(shape) == 1 else [(i, j) for i in range(shape[0]) for j in range(shape[1])] if shape else [()]
        for cell in cells:
            c = F.col(name)
            for i in cell:
                c = c[i]
            flat.append(c.alias(f"c{len(flat)}"))
        layout.append((at, at + len(cells), shape))
        at += len(cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                cols = [pdf[c].to_numpy() for c in pdf.columns]
                args = [np.column_stack(cols[a:b]).astype(float).reshape(len(pdf), *shape) if shape else cols[a] for a, b, shape in layout]
                part = kernel(*args)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"sums": [np.asarray(total, dtype=np.float64).tobytes()]})

    # counted once for all steps of a fit
    if "_tasks" not in df.__dict__:
        df.__dict__["_tasks"] = df.rdd.getNumPartitions()
    total = collect_sum(df.select(*flat).mapInPandas(run, "sums binary"), tasks=df.__dict__["_tasks"])
    if total is None:
        raise ValueError("nothing to fit: the table is empty")
    return total


def _newton(evaluate, x: np.ndarray, clip=None, tol: float = 1e-7, max_iter: int = 40) -> tuple[np.ndarray, float]:
    """Damped Newton on a convex objective. ``evaluate(x)`` is one job giving loss, gradient, Hessian."""
    loss, g, h = evaluate(x)
    damping = 1e-8
    for _ in range(max_iter):
        step = np.linalg.solve(h + damping * np.eye(len(x)), -g)
        trial = x + step if clip is None else clip(x + step)
        t_loss, t_g, t_h = evaluate(trial)
        if t_loss <= loss + 1e-12:
            small = np.abs(trial - x).max() < tol or loss - t_loss < 1e-9
            x, loss, g, h, damping = trial, t_loss, t_g, t_h, max(damping / 10, 1e-8)
            if small:
                return x, loss
        else:
            damping = max(damping * 10, 1e-4)
            if damping > 1e8:
                break
    if np.abs(g).max() > 1e-4:
        raise RuntimeError(f"Newton steps ended at a gradient of {np.abs(g).max():.3g}")
    return x, loss


def fit_temperature(df: DataFrame, k: int, floor: float = 0.05) -> tuple[float, float]:
    """FIT2. One temperature, clamped at 0.05: Newton on u = 1/T, in which the NLL is convex.

    Returns (T, nll).
    """
    def evaluate(u: np.ndarray):
        def kernel(z, y):
            s = z * u[0]
            s = s - s.max(axis=1, keepdims=True)
            lse = np.log(np.exp(s).sum(axis=1))
            p = np.exp(s - lse[:, None])
            rows = np.arange(len(y))
            mean = (p * z).sum(axis=1)
            return np.array([len(y), (lse - s[rows, y]).sum(), (mean - z[rows, y]).sum(), ((p * z * z).sum(axis=1) - mean**2).sum()])
        n, loss, g, h = _batched(df, {"z": (k,), "y": ()}, kernel)
        return loss / n, np.array([g / n]), np.array([[h / n]])
    u, loss = _newton(evaluate, np.ones(1), clip=lambda x: np.clip(x, 1e-3, 1.0 / floor))
    return float(1.0 / u[0]), float(loss)


def fit_class_temperatures(df: DataFrame, k: int, floor: float = 0.1) -> tuple[list[float], float]:
    """FIT3. One temperature per class, clamped at 0.1. Convex in u = 1/T, so Newton on u."""
    def evaluate(u: np.ndarray):
        def kernel(z, y):
            s = z * u
            s = s - s.max(axis=1, keepdims=True)
            lse = np.log(np.exp(s).sum(axis=1))
            p = np.exp(s - lse[:, None])
            hit = np.eye(k)[y]
            g = ((p - hit) * z).sum(axis=0)
            pz = p * z
            h = np.diag((pz * z).sum(axis=0)) - pz.T @ pz
            return np.concatenate([[len(y), (lse - s[np.arange(len(y)), y]).sum()], g, h.ravel()])
        v = _batched(df, {"z": (k,), "y": ()}, kernel)
        n = v[0]
        return v[1] / n, v[2:2 + k] / n, v[2 + k:].reshape(k, k) / n
    u, loss = _newton(evaluate, np.ones(k), clip=lambda x: np.clip(x, 1e-3, 1.0 / floor))
    return [float(1.0 / x) for x in u], float(loss)


def fit_dirichlet(df: DataFrame, k: int, l2_off: float = 0.01, l2_bias: float = 0.01) -> tuple[list[list[float]], list[float], float]:
    """FIT4. W·log_softmax(z)+b with L2 on the off-diagonal and on b, from the identity.

    Newton needs the (K²+K)² curvature sums once per step and settles in a few steps, where a
    gradient method would scan the table hundreds of times. Returns (W, b, penalised loss).
    """
    d = k + 1
    reg = np.full((k, d), l2_off)
    reg[np.arange(k), np.arange(k)] = 0.0
    reg[:, k] = l2_bias
    def evaluate(x: np.ndarray):
        wb = x.reshape(k, d)
        def kernel(z, y):
            n = len(y)
            z = z - z.max(axis=1, keepdims=True)
            f = np.hstack([z - np.log(np.exp(z).sum(axis=1, keepdims=True)), np.ones((n, 1))])
            s = f @ wb.T
            s = s - s.max(axis=1, keepdims=True)
            lse = np.log(np.exp(s).sum(axis=1))
            p = np.exp(s - lse[:, None])
            g = (p - np.eye(k)[y]).T @ f
            pf = (p[:, :, None] * f[:, None, :]).reshape(n, k * d)
            h = -(pf.T @ pf)
            for c in range(k):
                h[c * d:(c + 1) * d, c * d:(c + 1) * d] += f.T @ (p[:, c:c + 1] * f)
            return np.concatenate([[n, (lse - s[np.arange(n), y]).sum()], g.ravel(), h.ravel()])
        v = _batched(df, {"z": (k,), "y": ()}, kernel)
        n, m = v[0], k * d
        loss = v[1] / n + (reg * wb**2).sum()
        return loss, v[2:2 + m] / n + (2 * reg * wb).ravel(), v[2 + m:].reshape(m, m) / n + np.diag(2 * reg.ravel())
    start = np.hstack([np.eye(k), np.zeros((k, 1))]).ravel()
    x, loss = _newton(evaluate, start)
    wb = x.reshape(k, d)
    return wb[:, :k].tolist(), wb[:, k].tolist(), float(loss)


# ---- ensemble weights ---------------------------------------------------------

def stack_models(df: DataFrame, models: Sequence[object], k: int) -> DataFrame:
    """Long (row_id, model, y, z) to one row with ``zs`` = the models' logits in order.

    The group of a row is its models, so the pivot is a bounded aggregate.
    """
    pick = lambda m, i: F.max(F.when(F.col("model") == m, F.col("z")[i]))
    return df.groupBy("row_id").agg(
        F.first("y").alias("y"), F.array(*[F.array(*[pick(m, i) for i in range(k)]) for m in models]).alias("zs")
    )


def _simplex_quadratic(w: np.ndarray, g: np.ndarray, h: np.ndarray, steps: int = 4000) -> np.ndarray:
    """Minimiser over the simplex of the quadratic model at ``w`` (a few numbers, one per model)."""
    v = w.copy()
    rate = 1.0 / (np.abs(np.linalg.eigvalsh(h)).max() + np.abs(g).max() + 1e-12)
    for _ in range(steps):
        grad = g + h @ (v - w)
        v = v * np.exp(-rate * (grad - grad.min()))
        v = v / v.sum()
    return v


def simplex_gap(w: np.ndarray, g: np.ndarray) -> float:
    """How far a convex loss of gradient ``g`` at ``w`` can still fall over the simplex, at most."""
    return float(g @ w - g.min())


def fit_ensemble_weights(
    stacked: DataFrame, n_models: int, k: int, max_iter: int = 25, tol: float = 1e-8, unfinished: bool = False, gap: float = 1e-4,
) -> tuple[list[float], float]:
    """FIT5. Simplex weights minimising the NLL of Σ w·z, from uniform.

    The NLL is convex in w, so each step minimises its local quadratic over the simplex and halves
    the move until the loss falls: a handful of scans. Returns (weights, nll). It fails when the
    loss could still fall by more than ``gap`` at the end, unless ``unfinished`` asks for the last iterate.
    """
    def evaluate(w: np.ndarray):
        def kernel(zs, y):
            n, rows = len(y), np.arange(len(y))
            z = np.einsum("m,nmk->nk", w, zs)
            z = z - z.max(axis=1, keepdims=True)
            lse = np.log(np.exp(z).sum(axis=1))
            p = np.exp(z - lse[:, None])
            mean = np.einsum("nk,nmk->nm", p, zs)
            g = (mean - zs[rows, :, y]).sum(axis=0)
            h = np.einsum("nk,nmk,nlk->ml", p, zs, zs) - mean.T @ mean
            return np.concatenate([[n, (lse - z[rows, y]).sum()], g, h.ravel()])
        v = _batched(stacked, {"zs": (n_models, k), "y": ()}, kernel)
        return v[1] / v[0], v[2:2 + n_models] / v[0], v[2 + n_models:].reshape(n_models, n_models) / v[0]
    w = np.full(n_models, 1.0 / n_models)
    loss, g, h = evaluate(w)
    for _ in range(max_iter):
        move = _simplex_quadratic(w, g, h) - w
        share, accepted = 1.0, False
        while share > 1e-4 and not accepted:
            t_loss, t_g, t_h = evaluate(w + share * move)
            accepted = t_loss <= loss + 1e-14
            share = share if accepted else share / 2
        if not accepted:
            break
        gain, w, loss, g, h = loss - t_loss, w + share * move, t_loss, t_g, t_h
        if gain < tol:
            break
    if simplex_gap(w, g) > gap and not unfinished:
        raise RuntimeError(f"ensemble weights have not converged: the loss may still fall by {simplex_gap(w, g):.3g}")
    return [float(x) for x in w], float(loss)


def fit_ensemble_weights_f1(stacked: DataFrame, n_models: int, k: int, candidates: Sequence[Sequence[float]]) -> DataFrame:
    """FIT5, macro-F1 form: |w|/Σ|w| candidates, all judged in one scan."""
    unit = [[abs(x) / (sum(abs(v) for v in w) or 1.0) for x in w] for w in candidates]
    tried = stacked.select("y", "zs", F.posexplode(F.array(*[sc.vec(w) for w in unit])).alias("cand", "w"))
    z = F.array(*[sc.fold_sum([F.col("w")[m] * F.col("zs")[m][i] for m in range(n_models)]) for i in range(k)])
    judged = tried.select("cand", "y", sc.argmax(z).alias("pred"))
    return mt.summary(mt.confusion(judged, by=["cand"]), ["cand"]).select("cand", "macro_f1")


# ---- priors -------------------------------------------------------------------

def sld_step(probs: DataFrame, ratio: Sequence[float]) -> np.ndarray:
    """One E and M step: mean of the reweighted, renormalised probabilities."""
    ratio = np.asarray(ratio, dtype=float)
    def kernel(p, n=None):
        moved = p * ratio
        moved = moved / np.maximum(moved.sum(axis=1, keepdims=True), sc.FLOOR)
        n = np.ones(len(p)) if n is None else n.astype(float)
        return np.concatenate([[n.sum()], n @ moved])
    v = _batched(probs, {"p": (len(ratio),), **{c: () for c in _stood(probs)}}, kernel)
    return v[1:] / v[0]


def sld_prior(
    probs: DataFrame, train_prior: Sequence[float], k: int, max_iter: int = 500, tol: float = 1e-6, finalize: bool = True,
    init: str = "uniform", unfinished: bool = False,
) -> tuple[list[float], int]:
    """FIT6. EM estimate of the target prior; returns (prior, steps).

    ``finalize=False`` keeps the other historical rule: no clipping, and the iterate that met the
    tolerance is not adopted. ``init="train"`` starts from the training prior. Without reaching
    ``tol`` within ``max_iter`` steps it fails, unless ``unfinished`` asks for the last iterate.
    """
    train = np.maximum(np.asarray(train_prior, dtype=float), sc.FLOOR)
    if finalize:
        train = train / train.sum()
    if init not in ("uniform", "train"):
        raise ValueError("init is 'uniform' or 'train'")
    prior, steps = train.copy() if init == "train" else np.full(k, 1.0 / k), 0
    for steps in range(1, max_iter + 1):
        new = sld_step(probs, prior / train)
        if finalize:
            new = np.maximum(new, sc.FLOOR)
            new = new / new.sum()
        moved = np.abs(new - prior).max()
        if moved < tol and not finalize:
            break
        prior = new
        if moved < tol:
            break
    else:
        if not unfinished:
            raise RuntimeError(f"the prior has not converged in {max_iter} steps")
    return [float(x) for x in prior], steps


# ---- class scales -------------------------------------------------------------

def scale_curve(
    df: DataFrame, cls: int, scales: Column | Sequence[float], k: int, lo: float = GRID_LO, hi: float = GRID_HI,
    step: float = GRID_STEP, by: Sequence[str] = (),
) -> DataFrame:
    """FIT7. Confusion of *every* trial scale of one class from one scan: (by..., point, y, pred, n).

    With the other scales fixed a row has one rival (its best other class) and flips to ``cls`` at
    the first trial scale whose product beats it. Rows are counted by (truth, rival, flip point);
    the confusion at a trial is then a running sum over at most K²·points counts instead of a
    rescan per trial or a row x candidate product. Point −1 is the class's current scale.
    """
    points = len(grid(lo, hi, step))
    s = lambda i: sc.at(scales, i)
    scaled = F.array(*[F.col("p")[i] * s(i) if i != cls else F.lit(-1.0) for i in range(k)])
    stood = _stood(df)
    rivals = df.select(*by, *stood, "y", F.col("p")[cls].alias("_own"), s(cls).alias("_cur"), scaled.alias("_o"))
    rivals = rivals.select(*by, *stood, "y", "_own", "_cur", sc.argmax(F.col("_o")).alias("rival"), F.array_max("_o").alias("_top"))
    lost = lambda t: (F.col("_own") * t < F.col("_top")) | ((F.col("_own") * t == F.col("_top")) & (F.col("rival") < cls))
    at = lambda i: F.round(F.lit(lo) + i * F.lit(step), 10)
    # the ratio gives the flip point up to rounding; its neighbours settle it exactly
    raw = F.ceil((F.col("_top") / F.col("_own") - lo) / step)
    rivals = rivals.withColumn("_g", F.when(F.col("_own") > 0, F.least(F.greatest(raw, F.lit(0)), F.lit(points))).otherwise(
        F.when(lost(F.lit(1.0)), points).otherwise(0)).cast("int"))
    g = F.col("_g")
    flip = F.when((g > 0) & ~lost(at(g - 1)), g - 1).when(~lost(at(g)), g).otherwise(g + 1)
    counted = rivals.groupBy(*by, "y", "rival", F.least(flip, F.lit(points)).alias("flip"), lost(F.col("_cur")).alias("_now")).agg((F.sum("n") if stood else F.count("*")).alias("n"))
    spread = counted.select(*by, "y", "rival", "flip", "_now", "n", F.explode(F.sequence(F.lit(-1), F.lit(points - 1))).alias("point"))
    wins = F.when(F.col("point") < 0, ~F.col("_now")).otherwise(F.col("point") >= F.col("flip"))
    return spread.groupBy(*by, "point", "y", F.when(wins, F.lit(cls)).otherwise(F.col("rival")).alias("pred")).agg(F.sum("n").alias("n"))


def greedy_scales(
    df: DataFrame, k: int, lo: float = GRID_LO, hi: float = GRID_HI, step: float = GRID_STEP, passes: int = 3,
    by: str | None = None, groups: Sequence[object] = (None,), labels: int | None = None,
) -> dict[object, tuple[list[float], float]]:
    """FIT7/FIT8. Greedy per-class grid; with ``by`` the search runs for all groups in the same jobs.

    Returns group -> (scales, macro-F1). A trial must beat the current score strictly.
    """
    points = grid(lo, hi, step)
    keys = [by] if by else []
    state = {g: [1.0] * k for g in groups}
    score = dict.fromkeys(groups, -1.0)
    for _ in range(passes):
        improved = False
        for c in range(k):
            data, current = df, state[groups[0]]
            if by:
                table = F.create_map(*[x for g in groups for x in (F.lit(g), sc.vec(state[g]))])
                data, current = df.withColumn("_s", F.try_element_at(table, F.col(by))), F.col("_s")
            curve = scale_curve(data, c, current, k, lo, hi, step, keys)
            # points x groups rows
            rows = mt.summary(curve, keys + ["point"], labels).select(*keys, "point", "macro_f1").collect()
            for g in groups:
                mine = {r["point"]: r["macro_f1"] for r in rows if not by or r[by] == g}
                score[g] = mine.pop(-1)
                top = max(mine.values())
                if top > score[g]:
                    state[g][c] = points[min(i for i, f in mine.items() if f == top)]
                    score[g], improved = top, True
        if not improved:
            break
    return {g: (state[g], score[g]) for g in groups}


def scaled_f1(df: DataFrame, scales: dict[str, Sequence[float]], k: int, by: Sequence[str] = (), labels: int | None = None) -> DataFrame:
    """Macro-F1 of several named scale vectors in one scan."""
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), sc.vec(v).alias("s")) for n, v in scales.items()])
    judged = df.select(*by, *_stood(df), "y", "p", F.inline(variants)).select(
        *by, *_stood(df), "variant", "y", sc.argmax(F.array(*[F.col("p")[i] * F.col("s")[i] for i in range(k)])).alias("pred")
    )
    keys = [*by, "variant"]
    return mt.summary(mt.confusion(judged, by=keys, n=next(iter(_stood(df)), None)), keys, labels)


def kfold_scales(df: DataFrame, k: int, folds: int, step: float = 0.1, passes: int = 2) -> tuple[list[float], list[dict]]:
    """FIT8. Scales fitted on each fold's complement, judged on the fold, averaged.

    ``df`` carries ``fold``. All complements are searched together: a row joins every fold but its own.
    """
    fold_ids = list(range(folds))
    train = df.select("y", "p", *_stood(df), F.col("fold").alias("_own"), F.explode(F.array(*[F.lit(i) for i in fold_ids])).alias("held")).filter(F.col("held") != F.col("_own"))
    fitted = greedy_scales(train, k, step=step, passes=passes, by="held", groups=fold_ids)
    table = F.create_map(*[x for g in fold_ids for x in (F.lit(g), sc.vec(fitted[g][0]))])
    judged = df.select("fold", "y", *_stood(df), F.inline(F.array(
        F.struct(F.lit("baseline").alias("variant"), sc.argmax(F.col("p")).alias("pred")),
        F.struct(F.lit("tuned").alias("variant"), sc.argmax(F.array(*[F.col("p")[i] * F.try_element_at(table, F.col("fold"))[i] for i in range(k)])).alias("pred")),
    )))
    by = ["fold", "variant"]
    report = [r.asDict() for r in mt.summary(mt.confusion(judged, by=by, n=next(iter(_stood(df)), None)), by).select(*by, "macro_f1").collect()]
    mean = np.mean([fitted[g][0] for g in fold_ids], axis=0)
    return [float(x) for x in mean], report


def evaluate_candidates(df: DataFrame, candidates: Sequence[Sequence[float]], k: int, weights: Sequence[float] | None = None, labels: int | None = None) -> DataFrame:
    """FIT9. Objective of every candidate scale vector in one scan: (cand, objective)."""
    tried = df.select("y", "p", *_stood(df), F.posexplode(F.array(*[sc.vec(c) for c in candidates])).alias("cand", "s"))
    judged = tried.select("cand", "y", *_stood(df), sc.argmax(F.array(*[F.col("p")[i] * F.col("s")[i] for i in range(k)])).alias("pred"))
    conf = mt.confusion(judged, by=["cand"], n=next(iter(_stood(df)), None))
    if weights is None:
        return mt.summary(conf, ["cand"], labels).select("cand", F.col("macro_f1").alias("objective"))
    w = F.get(sc.vec(weights), F.col("cls"))
    return mt.class_report(conf, ["cand"]).groupBy("cand").agg((F.sum(w * F.col("f1")) / float(sum(weights))).alias("objective"))


MOST_GENERATIONS = 500


def evolve_scales(
    df: DataFrame, bounds: Sequence[tuple[float, float]], weights: Sequence[float] | None = None,
    population: int | None = None, generations: int | None = None, tol: float = 0.01, seed: int = 42, labels: int | None = None,
) -> tuple[list[float], float]:
    """FIT9. Seeded population search under per-class bounds; one job per generation.

    Thirty vectors per class by default. The search ends when the spread of the objective over
    the population is within ``tol`` of its mean, and fails after ``MOST_GENERATIONS`` without that.
    A number of ``generations`` asks for the best that so many find, converged or not.

    The all-ones vector is in the first generation when the bounds allow it, so the result is
    never worse than no scaling there.
    """
    k, rng = len(bounds), random.Random(seed)
    population = population or 30 * k
    clip = lambda v: [min(max(x, lo), hi) for x, (lo, hi) in zip(v, bounds)]
    pool = [clip([1.0] * k)] + [[rng.uniform(lo, hi) for lo, hi in bounds] for _ in range(population - 1)]
    judge = lambda vs: {r.cand: r.objective for r in evaluate_candidates(df, vs, k, weights, labels).collect()}
    got = judge(pool)
    value = [got[i] for i in range(population)]
    for _ in range(MOST_GENERATIONS if generations is None else generations):
        trial = []
        for i in range(population):
            a, b, c = rng.sample(range(population), 3)
            f = rng.uniform(0.5, 1.5)
            mutant = clip([pool[a][j] + f * (pool[b][j] - pool[c][j]) for j in range(k)])
            forced = rng.randrange(k)
            trial.append([mutant[j] if rng.random() < 0.9 or j == forced else pool[i][j] for j in range(k)])
        got = judge(trial)
        for i in range(population):
            if got[i] >= value[i]:
                pool[i], value[i] = trial[i], got[i]
        if np.std(value) <= tol * abs(np.mean(value)):
            break
    else:
        if generations is None:
            raise RuntimeError(f"the population has not converged in {MOST_GENERATIONS} generations")
    best = max(range(population), key=lambda i: value[i])
    return pool[best], value[best]


def guarded_scales(tune: DataFrame, check: DataFrame, k: int, passes: int = 3) -> dict[str, object]:
    """FIT10. Tune on one part, trust on another.

    A loss on the check part reverts to ones; a gain above .15 is suspicious and falls back to the
    best single-class move on the coarse grid; anything between keeps the tuned scales.
    """
    ones = [1.0] * k
    tuned, _ = greedy_scales(tune, k, passes=passes)[None]
    scores = {r.variant: r.macro_f1 for r in scaled_f1(check, {"base": ones, "tuned": tuned}, k).collect()}
    delta = scores["tuned"] - scores["base"]
    if delta < 0:
        return {"policy": "revert", "scales": ones, "delta": delta}
    if delta > 0.15:
        trial = [ones] + [[g if i == c else 1.0 for i in range(k)] for c in range(k) for g in COARSE_GRID]
        got = {r.cand: r.objective for r in evaluate_candidates(check, trial, k).collect()}
        best = max(got, key=lambda i: (got[i], -i))
        return {"policy": "coarse_grid", "scales": trial[best], "delta": delta}
    return {"policy": "keep_cautiously" if delta < 0.03 else "keep", "scales": tuned, "delta": delta}


def best_method(scored: DataFrame, name: str, score: str) -> DataFrame:
    """FIT11. Highest score, first name on a tie."""
    top = F.min_by(F.struct(name, score), F.struct((-F.col(score)).alias("s"), F.col(name)))
    return scored.agg(top.alias("b")).select("b.*")


# ---- safety threshold ---------------------------------------------------------

def threshold_curve(df: DataFrame, cls: int, start: float = 0.95, stop: float = 0.01, step: float = 0.005, by: Sequence[str] = ()) -> DataFrame:
    """WIN4. Recall of ``cls`` and macro-F1 when it is forced at p >= t, for every t of the grid.

    Rows are counted by (truth, prediction, first grid step that catches them); each t is then a
    running sum over those counts.
    """
    steps = int(np.ceil((start - stop) / step - 1e-9))
    ts = [round(start - i * step, 10) for i in range(steps)]
    raw = F.col("p")[cls]
    # first i with p >= start - i·step; the guess is corrected by comparing with the true grid value
    guess = F.greatest(F.lit(0), F.ceil((F.lit(start) - raw) / F.lit(step))).cast("int")
    grid_at = lambda i: F.round(F.lit(start) - i * F.lit(step), 10)
    caught = F.when((guess > 0) & (raw >= grid_at(guess - 1)), guess - 1).when(raw >= grid_at(guess), guess).otherwise(guess + 1)
    counted = df.groupBy(*by, "y", "pred", F.least(caught, F.lit(len(ts))).alias("i")).agg(F.count("*").alias("n"))
    at = counted.select(*by, "y", "pred", "i", "n", F.posexplode(F.array(*[F.lit(t) for t in ts])).alias("j", "t"))
    moved = at.groupBy(*by, "t", "y", F.when(F.col("i") <= F.col("j"), cls).otherwise(F.col("pred")).alias("pred")).agg(F.sum("n").alias("n"))
    keys = [*by, "t"]
    recall = mt.class_report(moved, keys).filter(F.col("cls") == cls).select(*keys, "recall")
    return mt.summary(moved, keys).join(recall, keys, "left").select(*keys, F.coalesce("recall", F.lit(0.0)).alias("recall"), "macro_f1")


def safety_threshold(df: DataFrame, cls: int, target: float = 0.80, floor_drop: float = 0.015, final_check: bool = False) -> DataFrame:
    """WIN4. Highest t that reaches the recall target within the allowed macro-F1 drop, else the
    highest that reaches it at all. No override when the target is already met.

    ``final_check`` (older form) discards an override that ends below the floor.
    """
    conf = mt.confusion(df)
    now = mt.class_report(conf).agg(
        F.avg("f1").alias("now_f1"), F.coalesce(F.max(F.when(F.col("cls") == cls, F.col("recall"))), F.lit(0.0)).alias("now_recall")
    )
    current = now.select(F.struct("now_f1", "now_recall")).scalar()
    curve = threshold_curve(df, cls).withColumn("_now", current)
    reaches = F.col("recall") >= target
    above = F.col("macro_f1") >= F.col("_now")["now_f1"] - floor_drop
    pick = curve.agg(
        F.max(F.when(reaches & above, F.col("t"))).alias("strict"), F.max(F.when(reaches, F.col("t"))).alias("loose"), F.first("_now").alias("_now")
    )
    met = F.col("_now")["now_recall"] >= target
    chosen = F.when(~met, F.col("strict") if final_check else F.coalesce("strict", "loose"))
    return pick.select(
        F.col("_now")["now_recall"].alias("recall_before"), F.col("_now")["now_f1"].alias("macro_f1_before"),
        chosen.alias("threshold"),
        F.when(met, "already_met").when(F.col("strict").isNotNull(), "within_floor")
        .when(F.col("loose").isNotNull() & F.lit(not final_check), "floor_relaxed").otherwise("unreachable").alias("outcome"),
    )


# ---- reports ------------------------------------------------------------------

def calibration_report(df: DataFrame, k: int, scalar: float, per_class: Sequence[float], weight, bias, bins: int = 15) -> DataFrame:
    """FIT12. NLL, ECE, MCE, Brier and accuracy of raw, global, per-class and Dirichlet scores, one scan."""
    z = F.col("z")
    variants = F.array(*[
        F.struct(F.lit(name).alias("method"), v.alias("zc")) for name, v in (
            ("raw", z), ("global", sc.temperature(z, k, scalar=scalar)),
            ("per_class", sc.temperature(z, k, per_class=per_class)), ("dirichlet", sc.dirichlet(z, weight, bias, k)),
        )
    ])
    rows = df.select("y", F.inline(variants)).select("method", "y", sc.softmax(F.col("zc"), k).alias("p"))
    rows = rows.select("method", "y", "p", F.array_max("p").alias("conf"), (sc.argmax(F.col("p")) == F.col("y")).alias("hit"))
    binned = rows.groupBy("method", sc.bin_index(F.col("conf"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"), F.avg("conf").alias("confidence"),
        F.sum(sc.nll_from_probs(F.col("p"), F.col("y"))).alias("l"),
        F.sum(sc.fold_sum([F.pow(F.col("p")[i] - F.when(F.col("y") == i, 1.0).otherwise(0.0), F.lit(2.0)) for i in range(k)])).alias("b"),
    )
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    n = F.sum("n")
    return binned.groupBy("method").agg(
        (F.sum("l") / n).alias("nll"), (F.sum("b") / n).alias("brier"), (F.sum(F.col("n") * gap) / n).alias("ece"),
        F.max(gap).alias("mce"), (F.sum(F.col("n") * F.col("accuracy")) / n).alias("accuracy"),
    )


def variant_report(scored: DataFrame, baseline: str, labels: int | None = None) -> DataFrame:
    """AGG34. Macro-F1 of each variant and its gain over the baseline. ``scored``: (variant, y, pred)."""
    got = mt.summary(mt.confusion(scored, by=["variant"]), ["variant"], labels).select("variant", "accuracy", "macro_f1")
    base = F.max(F.when(F.col("variant") == baseline, F.col("macro_f1"))).over(Window.partitionBy())  # one row per variant
    return got.withColumn("delta", F.col("macro_f1") - base)
