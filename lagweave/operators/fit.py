"""Fitting recombination models to profiles: groups side by side in NumPy, reports in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions.dual import Dual
from ..sources.scratch import stored

COLUMNS = ["group", "d_sample", "theta_pool", "phi_pool", "ratio", "fbar", "c", "d_pool", "d_clonal", "theta_s", "phi_s"]
SCHEMA = ", ".join(["group string", *[f"{c} double" for c in COLUMNS[1:]], "rho double", "chisq double", "redchi double", "aic double", "nfev long", "ndata long", "success boolean", "x array<double>", "residual array<double>"])


@dataclass(frozen=True)
class FitOptions:
    """fit_start and fit_end are inclusive. More starts than the first escape local minima.

    r1: const, exp, geom, zero, a name given to models.register_r1, or a function. method: least_squares (or leastsq)
    for trust-region steps with exact slopes, nelder for a simplex that needs none. max_nfev: evaluations of all of a
    group's searches together; a fit that reaches it is no success.
    """

    fit_start: int = 3
    fit_end: int = 300
    r1: str | Callable = "const"
    theta_init: float = 1e-5
    f_init: float = 1000.0
    phi_init: float = 5e-5
    phi_max: float = 1.0
    f_min: float = 3.0
    f_max: float = 300_000.0
    max_nfev: int = 1_000_000
    method: str = "least_squares"
    starts: int = 12


def fit_data(profile: DataFrame, o: FitOptions = FitOptions()) -> DataFrame:
    """(group, d_sample, x, y): a replicate's P2 points from fit_start to fit_end in order of distance, and its Ks."""
    point = (F.col("t") == "P2") & F.col("l").between(o.fit_start, o.fit_end)
    rows = profile.groupBy("b").agg(F.max(F.when(F.col("t") == "Ks", F.col("m"))).alias("d_sample"), F.array_sort(F.collect_list(F.when(point, F.struct("l", "m")))).alias("p"))
    each = lambda c: F.transform("p", lambda s: s[c].cast("double"))
    return rows.select(F.col("b").alias("group"), "d_sample", each("l").alias("x"), each("m").alias("y"))


def gene_fit_data(gene_rows: DataFrame, o: FitOptions = FitOptions()) -> DataFrame:
    """fit_data by gene: P2 rows beyond lag 0, and as d_sample the mean at lag 0."""
    named = gene_rows.select(F.col("gene").alias("b"), F.col("lag").alias("l"), F.col("mean").alias("m"), F.when(F.col("lag") == 0, "Ks").otherwise(F.col("type")).alias("t"))
    return fit_data(named, o)


def bounded(u: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Parameters between their bounds; near a bound u is the logarithm of the distance to it, so that a rate and a size
    of which only the product is well known lie on a straight line."""
    return low + (high - low) * (np.tanh(u / 2) + 1) / 2


def unbounded(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    share = np.clip((p - low) / (high - low), 1e-12, 1 - 1e-12)
    return np.log(share) - np.log1p(-share)


def bounded_slope(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How bounded() changes with u, where it is p."""
    return (p - low) * (high - p) / (high - low)


#: A step that lowers the cost by no more than this share of it ends a search.
TOLERANCE = 1e-8


def trusted_step(normal: np.ndarray, slope: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The steps (B, P) that lower each quadratic model slope s + s normal s / 2 most within the radius.

    With the eigenvectors of `normal` the step's length is a falling function of one damping number, found by halving.
    """
    w, v = np.linalg.eigh(normal)
    w = np.maximum(w, 0.0)
    g = np.einsum("bij,bi->bj", v, slope)
    floor = 1e-15 * w.max(axis=1) + 1e-300
    length = lambda damp: np.sqrt(((g / (w + damp[:, None])) ** 2).sum(axis=1))
    low, high = floor, np.maximum(np.abs(g).sum(axis=1) / radius, 2 * floor)
    inside = length(low) <= radius
    for _ in range(50):
        middle = np.sqrt(low * high)
        long = length(middle) > radius
        low, high = np.where(long, middle, low), np.where(long, high, middle)
    damp = np.where(inside, floor, high)
    return -np.einsum("bij,bj->bi", v, g / (w + damp[:, None]))


def trust_region(model: Callable, x: np.ndarray, y: np.ndarray, there: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray, max_nfev: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounded least squares of many problems side by side: (parameters, cost, evaluations, success), a row each.

    x, y and there (1 for a point, 0 for padding) are (B, n), start, low and high (B, P). model(x, parameters, rows)
    takes the parameters as arrays with slopes and so gives the exact Jacobian with each evaluation. Steps are taken in
    unbounded parameters within a radius that grows and shrinks with how well the quadratic model foretold the cost.
    owner tells which problems are searches of one fit: their evaluations together stay within max_nfev, beyond which
    none of them counts as a success.
    """
    n_params = start.shape[1]

    def evaluated(u: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = bounded(u, low[rows], high[rows])
        by_u = bounded_slope(p, low[rows], high[rows])
        zero, one = np.zeros((len(rows), 1)), np.ones((len(rows), 1))
        params = [Dual(p[:, k : k + 1], [one if j == k else zero for j in range(n_params)]) for k in range(n_params)]
        with np.errstate(all="ignore"):
            curve = model(x[rows], params, rows)
            r = np.where(there[rows] > 0, curve.value - y[rows], 0.0)
            slopes = [np.where(there[rows] > 0, s * np.ones_like(r), 0.0) for s in curve.slopes]
        return r, np.stack(slopes, axis=2) * by_u[:, None, :]

    every = np.arange(len(start))
    u = unbounded(start, low, high)
    r, jac = evaluated(u, every)
    cost = np.where(np.isfinite(r).all(axis=1) & np.isfinite(jac).all(axis=(1, 2)), (r * r).sum(axis=1), np.inf)
    nfev, radius, done = np.ones(len(start), np.int64), np.full(len(start), 0.5), ~np.isfinite(cost)
    spent = np.bincount(owner, nfev)
    active = every[~done & (spent[owner] < max_nfev)]
    while len(active):
        jr, rr = jac[active], r[active]
        normal, slope = np.einsum("bni,bnj->bij", jr, jr), np.einsum("bni,bn->bi", jr, rr)
        step = trusted_step(normal, slope, radius[active])
        foretold = -(2 * (slope * step).sum(axis=1) + np.einsum("bi,bij,bj->b", step, normal, step))
        trial, slopes = evaluated(u[active] + step, active)
        nfev[active] += 1
        good = np.isfinite(trial).all(axis=1) & np.isfinite(slopes).all(axis=(1, 2))
        new = np.where(good, (np.where(good[:, None], trial, 0.0) ** 2).sum(axis=1), np.inf)
        old, size = cost[active], np.sqrt((step * step).sum(axis=1))
        better = new < old
        with np.errstate(all="ignore"):
            ratio = np.where(foretold > 0, (old - new) / foretold, 0.0)
        edge = size > 0.9 * radius[active]
        radius[active] = np.where(~better | (ratio < 0.25), size / 4, np.where((ratio > 0.75) & edge, np.minimum(2 * radius[active], 3.0), radius[active]))
        little = (foretold <= TOLERANCE * old) & ~edge | better & (old - new <= TOLERANCE * old) & (ratio > 0.25)
        ended = little | (radius[active] < 1e-13) | (new == 0)
        moved = active[better]
        u[moved], cost[moved], r[moved], jac[moved] = u[moved] + step[better], new[better], trial[better], slopes[better]
        done[active[ended]] = True
        spent = np.bincount(owner, nfev)
        active = active[~ended & (spent[owner[active]] + np.bincount(owner[active], minlength=len(spent))[owner[active]] <= max_nfev)]
    return bounded(u, low, high), cost, nfev, done & np.isfinite(cost)


def simplex(residual: Callable, start: np.ndarray, low: np.ndarray, high: np.ndarray, max_nfev: int) -> tuple[np.ndarray, float, int, bool]:
    """Bounded least squares by the downhill simplex on unbounded parameters, begun anew where it has shrunk."""
    nfev = 0

    def cost(u: np.ndarray) -> float:
        nonlocal nfev
        nfev += 1
        r = residual(bounded(u, low, high))
        return float(r @ r) if np.isfinite(r).all() else math.inf

    at, last, done = unbounded(start, low, high), math.inf, False
    while not done and nfev < max_nfev:
        points = np.vstack([at, *(at + 0.1 * e for e in np.eye(len(at)))])
        costs = np.array([cost(p) for p in points])
        while nfev < max_nfev:
            order = np.argsort(costs)
            points, costs = points[order], costs[order]
            if np.abs(points[1:] - points[0]).max() < 1e-10 or costs[-1] - costs[0] <= 1e-14 * costs[0]:
                break
            middle = points[:-1].mean(axis=0)
            tries = {k: middle + k * (points[-1] - middle) for k in (-1.0, -2.0, 0.5)}
            mirrored = cost(tries[-1.0])
            if mirrored < costs[0]:
                far = cost(tries[-2.0])
                points[-1], costs[-1] = (tries[-2.0], far) if far < mirrored else (tries[-1.0], mirrored)
            elif mirrored < costs[-2]:
                points[-1], costs[-1] = tries[-1.0], mirrored
            elif (near := cost(tries[0.5])) < costs[-1]:
                points[-1], costs[-1] = tries[0.5], near
            else:
                points[1:] = points[0] + (points[1:] - points[0]) / 2
                costs[1:] = [cost(p) for p in points[1:]]
        best = int(np.argmin(costs))
        done = bool(last - costs[best] <= 1e-10 * costs[best])
        at, last = points[best], costs[best]
    return bounded(at, low, high), last, nfev, done


METHODS = ("least_squares", "leastsq", "nelder")
#: Fits that are solved side by side.
TOGETHER = 32


def starts_of(ds: float, o: FitOptions) -> list[tuple[float, float, float]]:
    """(theta, f, phi) to begin at: the options' own, and the others that `starts` asks for."""
    more = [(t, f, phi) for f in (30.0, 100.0, 300.0, 1000.0, 3000.0, 10_000.0) for phi, t in ((5e-5, 1e-5), (1e-3, ds / 2))]
    return [(o.theta_init, o.f_init, o.phi_init), *more[: max(0, o.starts)]]


def padded(rows: list, width: int, fill: float) -> np.ndarray:
    return np.array([[*r, *[fill] * (width - len(r))] for r in rows], float).reshape(len(rows), width)


def solve_many(xs: list, ys: list, dss: list[float], o: FitOptions) -> list[dict | None]:
    """Best fit of (theta_s, fbar, phi_s) of each group over its starts; None where no start gives a finite cost."""
    r1, width = M.r1_of(o.r1), max(map(len, xs), default=0)
    own = [starts_of(ds, o) for ds in dss]
    owner = np.repeat(np.arange(len(xs)), [len(s) for s in own])
    low, high = np.tile([0.0, o.f_min, 0.0], (len(owner), 1)), np.array([[dss[g], o.f_max, o.phi_max] for g in owner]).reshape(-1, 3)
    start = np.clip(np.array([p for s in own for p in s]).reshape(-1, 3), low + 1e-12 * (high - low), high - 1e-12 * (high - low))
    if o.method == "nelder":
        p, cost, nfev, ok = simplex_many(xs, ys, dss, r1, start, low, high, owner, o.max_nfev)
    else:
        x, y, there = padded(xs, width, 1.0)[owner], padded(ys, width, 0.0)[owner], padded([[1.0] * len(v) for v in xs], width, 0.0)[owner]
        ds = np.array(dss)[owner][:, None]
        model = lambda x, q, rows: M.model_curve(x, q[0], q[2], q[1], ds[rows], r1)
        p, cost, nfev, ok = trust_region(model, x, y, there, start, low, high, owner, o.max_nfev)
    out = []
    for g, (x, y, ds) in enumerate(zip(xs, ys, dss, strict=True)):
        rows = np.flatnonzero((owner == g) & np.isfinite(cost))
        best = rows[np.argmin(cost[rows])] if len(rows) else None
        out.append(None if best is None else result_of(x, y, ds, r1, p[best], float(cost[best]), int(nfev[owner == g].sum()), bool(ok[best])))
    return out


def result_of(x, y, ds: float, r1: Callable, p: np.ndarray, cost: float, nfev: int, ok: bool) -> dict:
    theta, f, phi = map(float, p)
    x, y, n = np.asarray(x, float), np.asarray(y, float), len(x)
    with np.errstate(all="ignore"):
        more = {k: float(v) for k, v in M.derived(np.float64(theta), np.float64(phi), np.float64(f), np.float64(ds)).items()}
        residual = M.model_curve(x, theta, phi, f, ds, r1) - y
    aic = n * math.log(cost / n) + 2 * 3 if cost > 0 else -math.inf
    return more | {"d_sample": ds, "theta_s": theta, "fbar": f, "phi_s": phi, "chisq": cost, "redchi": cost / (n - 3) if n > 3 else math.nan, "aic": aic, "nfev": nfev, "ndata": n, "success": ok, "x": x.tolist(), "residual": residual.tolist()}


def simplex_many(xs: list, ys: list, dss: list[float], r1: Callable, start: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray, max_nfev: int) -> tuple:
    """The simplex from every start in turn, with what its group has left of max_nfev."""
    left = dict.fromkeys(range(len(xs)), max_nfev)
    out = []
    for g, s, a, b in zip(owner.tolist(), start, low, high, strict=True):
        x, y, ds = np.asarray(xs[g], float), np.asarray(ys[g], float), dss[g]

        def residual(p: np.ndarray, x=x, y=y, ds=ds) -> np.ndarray:
            with np.errstate(all="ignore"):
                return M.model_curve(x, p[0], p[2], p[1], ds, r1) - y

        found = simplex(residual, s, a, b, left[g]) if left[g] > 0 and np.isfinite(residual(s)).all() else (s, math.inf, 0, False)
        left[g] -= found[2]
        out.append(found)
    p, cost, nfev, ok = zip(*out, strict=True) if out else ([], [], [], [])
    return np.array(p).reshape(-1, 3), np.array(cost, float), np.array(nfev, np.int64), np.array(ok, bool)


def solve(x: np.ndarray, y: np.ndarray, ds: float, o: FitOptions) -> dict | None:
    """solve_many() of one group."""
    return solve_many([x], [y], [ds], o)[0]


def usable(pdf: pd.DataFrame) -> pd.DataFrame:
    """The groups with points and a positive d_sample."""
    return pdf[[ds is not None and ds > 0 and len(x) > 0 for ds, x in zip(pdf["d_sample"], pdf["x"], strict=True)]]


def fit(data: DataFrame, o: FitOptions = FitOptions()) -> DataFrame:
    """Fit every group of fit_data(); groups without points, without Ks or that can't be fitted give no row."""
    if o.method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    o = replace(o, r1=M.r1_of(o.r1))  # the function itself goes to the tasks, which don't know this session's names

    def several(batches):
        for pdf in batches:
            pdf, out = usable(pdf), []
            for at in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[at : at + TOGETHER]
                found = solve_many([*part["x"]], [*part["y"]], [float(d) for d in part["d_sample"]], o)
                out += [{"group": g} | r for g, r in zip(part["group"], found, strict=True) if r is not None]
            names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
            yield pd.DataFrame(out, columns=names)

    return data.repartition("group").mapInPandas(several, SCHEMA)


def fit_results(fitted: DataFrame) -> DataFrame:
    """The eleven reported columns."""
    return fitted.select(*COLUMNS)


def zero_model(data: DataFrame) -> DataFrame:
    """The model without recombination, solved exactly: the points' mean, its chi-squared, AIC and parameters."""
    p = data.select("group", "d_sample", F.explode("y").alias("y")).groupBy("group", "d_sample").agg(F.count("*").alias("ndata"), F.avg("y").alias("d2"), F.var_pop("y").alias("var"))
    chisq = F.col("ndata") * F.col("var")
    theta = F.col("d_sample") / (1 - M.A * F.col("d_sample"))
    aic = F.when(F.col("var") == 0, F.lit(float("-inf"))).otherwise(F.col("ndata") * F.log(F.col("var")) + 2)
    return p.select("group", "d_sample", "ndata", "d2", chisq.alias("chisq"), (chisq / F.when(F.col("ndata") > 1, F.col("ndata") - 1)).alias("redchi"), aic.alias("aic"), theta.alias("theta_s"), M.diversity(theta).alias("d_clonal"))


def fit_zero(data: DataFrame, theta_init: float = 1e-5, steps: int = 64) -> DataFrame:
    """The model without recombination, solved step by step: group, d_sample, ndata, theta_s, nfev, chisq, redchi, aic.

    The curve 2 theta / (1 + 2 a theta) is the same at every distance, so the least squares are where it meets the
    points' mean m. Newton steps from theta_init get there from either side; each doubles the right digits, so 64 are
    enough for any m that is representable below the curve's limit 1 / a. Null where m lies at or beyond the limit; 0,
    the bound, where m is not positive. No Python runs: the steps are one expression.
    """
    p = data.filter(F.size("y") > 0).select("group", "d_sample", F.explode("y").alias("y")).groupBy("group", "d_sample").agg(F.count("*").alias("ndata"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))

    def step(at: Column, _: Column) -> Column:
        top = 1.0 + 2.0 * M.A * at["theta"]
        moved = F.greatest(F.lit(0.0), at["theta"] - (2.0 * at["theta"] / top - F.col("m")) * top * top / 2.0)
        still = F.abs(moved - at["theta"]) <= 1e-15 * at["theta"]
        return F.struct(moved.alias("theta"), (at["n"] + F.when(still, 0).otherwise(1)).alias("n"))

    begin = F.struct(F.lit(theta_init).alias("theta"), F.lit(0).alias("n"))
    solved = F.when(F.col("m") <= 0, F.struct(F.lit(0.0).alias("theta"), F.lit(0).alias("n"))).when(F.col("m") * M.A < 1, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, step))
    rows = p.withColumn("s", solved).select("group", "d_sample", "ndata", "m", "v", "s.theta", "s.n")
    curve = 2.0 * F.col("theta") / (1.0 + 2.0 * M.A * F.col("theta"))
    chisq = F.col("ndata") * (F.col("v") + (curve - F.col("m")) * (curve - F.col("m")))
    rows = rows.withColumn("chisq", chisq)
    aic = F.when(F.col("chisq") == 0, F.lit(float("-inf"))).otherwise(F.col("ndata") * F.log(F.col("chisq") / F.col("ndata")) + 2)
    return rows.select("group", "d_sample", "ndata", F.col("theta").alias("theta_s"), F.col("n").alias("nfev"), "chisq", (F.col("chisq") / F.when(F.col("ndata") > 1, F.col("ndata") - 1)).alias("redchi"), aic.alias("aic"), M.diversity(F.col("theta")).alias("d_clonal"))


def compare(data: DataFrame, fitted: DataFrame) -> DataFrame:
    """Both models of each group: model, chisq, redchi, aic, theta_s, d_clonal, and the recombination parameters."""
    own = fitted.select("group", F.lit("recombination").alias("model"), "ndata", "chisq", "redchi", "aic", "theta_s", "d_clonal", "phi_s", "fbar", "theta_pool", "phi_pool", "c", "d_pool")
    none = zero_model(data).select("group", F.lit("zero").alias("model"), "ndata", "chisq", "redchi", "aic", "theta_s", "d_clonal")
    return own.unionByName(none, allowMissingColumns=True)


def residuals(data: DataFrame, fitted: DataFrame) -> DataFrame:
    """(group, model, x, residual) of both models, one row per point; the plots' data."""
    own = fitted.select("group", F.lit("recombination").alias("model"), F.explode(F.arrays_zip("x", "residual")).alias("p")).select("group", "model", "p.x", "p.residual")
    mean = F.aggregate("y", F.lit(0.0), lambda s, v: s + v) / F.size("y")
    none = data.filter(F.size("y") > 0).select("group", F.lit("zero").alias("model"), F.explode(F.arrays_zip("x", F.transform("y", lambda v: mean - v).alias("residual"))).alias("p")).select("group", "model", "p.x", "p.residual")
    return own.union(none)


def report(results: DataFrame, params: list[str] | None = None) -> DataFrame:
    """(param, value, mean, std, size, median, lower, upper): the value of `all` and statistics of the bootstraps."""
    params = params or COLUMNS[1:7]
    long = results.select("group", F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).alias("v")) for p in params])).alias("r")).select("group", "r.*")
    boot = F.when(F.col("group") != "all", F.col("v"))
    q = F.percentile(boot, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    rows = long.groupBy("param").agg(F.max(F.when(F.col("group") == "all", F.col("v"))).alias("value"), F.avg(boot).alias("mean"), F.stddev_pop(boot).alias("std"), F.count(boot).alias("size"), q.alias("q"))
    return rows.select("param", "value", "mean", "std", "size", F.col("q")[1].alias("median"), F.col("q")[0].alias("lower"), F.col("q")[2].alias("upper"))


def auto_bins(n: int, low: float, high: float, lower: float, upper: float) -> int:
    """How many bins of equal width w: w is 2 iqr / n^(1/3), but at least range / (2 sqrt n), and at most range / (log2 n + 1)."""
    if n == 0 or high <= low:
        return 1
    by_quartile = max(2 * (upper - lower) / n ** (1 / 3), (high - low) / math.sqrt(n) / 2)
    return max(1, math.ceil((high - low) / min(by_quartile, (high - low) / (math.log2(n) + 1))))


def histogram(results: DataFrame, param: str, bins: int | str = 20) -> DataFrame:
    """(bin, low, high, n) of a parameter over the bootstraps, in bins of equal width; empty bins have no row.

    bins 'auto' takes the width from the number, the range and the quartiles, all from one pass over the values.
    """
    boots = results.filter("group <> 'all'").select(F.col(param).alias("v")).filter("v is not null and not isnan(v)")
    boots = stored(boots, "histogram-values")  # read for the range and again for the bins, but made once
    quartiles = F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))) if bins == "auto" else F.lit(None)
    n, low, high, q = boots.agg(F.count("v"), F.min("v"), F.max("v"), quartiles).first()
    if low is None:
        return boots.select(F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("n")).limit(0)
    bins = auto_bins(n, low, high, *q) if bins == "auto" else bins
    width = (high - low) / bins or 1.0
    k = F.floor((F.col("v") - low) / width)
    edge = lambda i: low + i * width
    k = k + F.when(F.col("v") < edge(k), -1).when(F.col("v") >= edge(k + 1), 1).otherwise(0)  # what division rounds, the edges decide
    k = F.least(F.lit(bins - 1), k).cast("int")
    return boots.groupBy(k.alias("bin")).agg(F.count("*").alias("n")).select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "n")


def fit_alternative(data: DataFrame, theta_pool_init: float = 0.05, phi_pool_init: float = 1e-3, max_nfev: int = 1_000_000) -> DataFrame:
    """Fit the model of coalescent classes: group, theta_s, phi_s, f, theta_p, phi_p, chisq."""
    names = ["group", "theta_s", "phi_s", "theta_p", "phi_p", "f", "chisq"]

    def several(batches):
        for pdf in batches:
            pdf, out = usable(pdf), []
            for at in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[at : at + TOGETHER]
                dss, owner = part["d_sample"].to_numpy(float), np.repeat(np.arange(len(part)), 2)
                ds, width = dss[owner][:, None], max(map(len, part["x"]))
                x, y, there = (padded([*v], width, fill)[owner] for v, fill in ((part["x"], 1.0), (part["y"], 0.0), ([[1.0] * len(v) for v in part["x"]], 0.0)))
                low, high = np.zeros((len(owner), 5)), np.array([[d, 1.0, 10.0, 10.0, 300_000.0] for d in ds[:, 0]])
                low[:, 4] = 3.0
                start = np.array([[d / 2, 1e-4, theta_pool_init, phi_pool_init, f] for d in dss for f in (100.0, 1000.0)])
                model = lambda x, q, rows, ds=ds: M.coalescent_curve(x, *q, ds[rows])
                p, cost, _, _ = trust_region(model, x, y, there, start, low, high, owner, max_nfev)
                for g, name in enumerate(part["group"]):
                    best = 2 * g + int(np.argmin(cost[2 * g : 2 * g + 2]))
                    if np.isfinite(cost[best]):
                        out.append((name, *p[best].tolist(), float(cost[best])))
            yield pd.DataFrame(out, columns=names)

    return data.repartition("group").mapInPandas(several, "group string, theta_s double, phi_s double, theta_p double, phi_p double, f double, chisq double")
