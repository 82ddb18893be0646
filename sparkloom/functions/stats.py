"""Distributions, peak shapes, calibration curves and fits per group, in numpy."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.columns import names
from sparkloom.session import shuffle_partitions


def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _erf(x):
    return np.vectorize(math.erf, otypes=[float])(x)


# --- log densities -----------------------------------------------------------------------------------------------

def normal_logpdf(x, mu, sigma):
    return -0.5 * ((x - mu) / sigma) ** 2 - np.log(sigma) - 0.5 * math.log(2 * math.pi)


def normal_cdf(x, mu, sigma):
    return 0.5 * (1 + _erf((np.asarray(x) - mu) / (sigma * math.sqrt(2))))


def student_t_logpdf(x, df, mu, sigma):
    z = (x - mu) / sigma
    return _lgamma((df + 1) / 2) - _lgamma(df / 2) - 0.5 * np.log(df * math.pi) - np.log(sigma) - (df + 1) / 2 * np.log1p(z * z / df)


def generalized_normal_logpdf(x, mu, alpha, beta):
    return np.log(beta) - np.log(2 * alpha) - _lgamma(1 / np.asarray(beta, float)) - (np.abs(x - mu) / alpha) ** beta


def beta_logpdf(x, a, b):
    return (a - 1) * np.log(x) + (b - 1) * np.log1p(-np.asarray(x, float)) + _lgamma(np.add(a, b)) - _lgamma(a) - _lgamma(b)


def gamma_logpdf(x, shape, rate):
    return shape * np.log(rate) + (shape - 1) * np.log(x) - rate * x - _lgamma(shape)


def lognormal_logpdf(x, mu, sigma):
    return normal_logpdf(np.log(x), mu, sigma) - np.log(x)


def lognormal_cdf(x, mu, sigma):
    return normal_cdf(np.log(x), mu, sigma)


def poisson_logpmf(k, lam):
    return k * np.log(lam) - lam - _lgamma(np.add(k, 1.0))


def multinomial_logpmf(x, p):
    x, p = np.asarray(x, float), np.asarray(p, float)
    return float(_lgamma(x.sum() + 1) - _lgamma(x + 1).sum() + np.where(x > 0, x * np.log(np.where(p > 0, p, 1)), 0).sum()) if not np.any((p <= 0) & (x > 0)) else -math.inf


def dirichlet_logpdf(p, a):
    p, a = np.asarray(p, float), np.asarray(a, float)
    return float(_lgamma(a.sum()) - _lgamma(a).sum() + ((a - 1) * np.log(p)).sum())


def dirichlet_multinomial_logpmf(x, a):
    x, a = np.asarray(x, float), np.asarray(a, float)
    n, s = x.sum(), a.sum()
    return float(_lgamma(n + 1) + _lgamma(s) - _lgamma(n + s) + (_lgamma(x + a) - _lgamma(a) - _lgamma(x + 1)).sum())


DENSITIES: dict[str, Callable] = {
    "normal": normal_logpdf, "student_t": student_t_logpdf, "generalized_normal": generalized_normal_logpdf, "beta": beta_logpdf, "gamma": gamma_logpdf, "lognormal": lognormal_logpdf, "poisson": poisson_logpmf,
}
ARRAY_DENSITIES: dict[str, Callable] = {"multinomial": multinomial_logpmf, "dirichlet": dirichlet_logpdf, "dirichlet_multinomial": dirichlet_multinomial_logpmf}


def log_density(name: str, value: str | Column, *params: Column | float) -> Column:
    """Log density of each value; for densities over arrays, value and parameter are array columns."""
    cols = [F.col(value) if isinstance(value, str) else value] + [p if isinstance(p, Column) else F.lit(float(p)) for p in params]
    if name in ARRAY_DENSITIES:
        one = ARRAY_DENSITIES[name]

        @F.pandas_udf("double")
        def arrays(x: pd.Series, a: pd.Series) -> pd.Series:
            return pd.Series([one(u, v) if u is not None and v is not None else None for u, v in zip(x, a)], dtype=float)

        return arrays(*cols)
    density = DENSITIES[name]

    @F.pandas_udf("double")
    def run(*s: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(density(*[x.to_numpy(float) for x in s]))

    return run(*cols)


def normal_log_density(value: Column, mu: Column, sigma: Column) -> Column:
    """Normal log density within the JVM."""
    return -0.5 * F.pow((value - mu) / sigma, F.lit(2)) - F.ln(sigma) - F.lit(0.5 * math.log(2 * math.pi))


# --- shapes ------------------------------------------------------------------------------------------------------

def gaussian_peak(t, area, mu, sigma):
    z = np.asarray((np.asarray(t) - mu) / sigma)  # an array of its own: the steps need no others
    np.square(z, out=z)
    np.exp(np.multiply(z, -0.5, out=z), out=z)
    return area / (sigma * math.sqrt(2 * math.pi)) * z


def erfcx(x):
    """exp(x^2) * erfc(x), without overflow for large x."""
    x = np.asarray(x, float)
    near = np.exp(np.minimum(x, 5) ** 2) * (1 - _erf(np.minimum(x, 5)))
    y = np.where(x > 5, x, 5.0)
    far = 1 / (y * math.sqrt(math.pi)) * (1 - 1 / (2 * y**2) + 3 / (4 * y**4) - 15 / (8 * y**6))
    return np.where(x > 5, far, near)


def emg_peak(t, area, mu, sigma, tau):
    """Gaussian convolved with a falling exponential of time constant tau."""
    d = np.asarray(t, float) - mu
    arg = (sigma / tau - d / sigma) / math.sqrt(2)
    low = np.exp(-0.5 * (d / sigma) ** 2) * erfcx(np.maximum(arg, -5))
    tail = 2 * np.exp(np.minimum(0.5 * (sigma / tau) ** 2 - d / tau, 700))
    return area / (2 * tau) * np.where(arg > -5, low, tail)


def hyper_emg_peak(t, area, mu, sigma, tau_left, tau_right, share):
    """Mixture of a left-tailed and a right-tailed peak; ``share`` belongs to the left."""
    return share * emg_peak(2 * mu - np.asarray(t, float), area, mu, sigma, tau_left) + (1 - share) * emg_peak(t, area, mu, sigma, tau_right)


def sigmoidal(x, bottom, top, x50, slope):
    return bottom + (top - bottom) / (1 + np.exp(-slope * (np.asarray(x, float) - x50)))


def hill_curve(x, bottom, top, ec50, n):
    x = np.asarray(x, float)
    return bottom + (top - bottom) * x**n / (ec50**n + x**n)


def log_linear(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Slope and intercept of y on ln x per group, as one aggregation in the JVM."""
    return df.where(F.col(x) > 0).groupBy(*names(keys)).agg(F.regr_slope(F.col(y), F.ln(x)).alias("slope"), F.regr_intercept(F.col(y), F.ln(x)).alias("intercept"))


CURVES: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "gaussian": (gaussian_peak, ("area", "mu", "sigma")),
    "emg": (emg_peak, ("area", "mu", "sigma", "tau")),
    "hyper_emg": (hyper_emg_peak, ("area", "mu", "sigma", "tau_left", "tau_right", "share")),
    "sigmoidal": (sigmoidal, ("bottom", "top", "x50", "slope")),
    "hill": (hill_curve, ("bottom", "top", "ec50", "n")),
}


# --- optimisers --------------------------------------------------------------------------------------------------

def _trials(rng, population: int, dims: int, crossover: float):
    """Random numbers of one trial after another: the member, the three others it is made of, what it takes from them, new places."""
    while True:
        for i in range(population):
            others = rng.choice(np.delete(np.arange(population), i), 3, replace=False)
            taken = (rng.random(dims) < crossover) | (np.arange(dims) == rng.integers(dims))
            yield i, others, taken, rng.random(dims)


def differential_evolution(f, bounds, *, seed: int = 0, generations: int = 150, population: int = 24, f_scale: float = 0.7, crossover: float = 0.9, tol: float = 1e-10):
    """Best point and value within bounds, by rand/1/bin with a fixed seed."""
    points, values = evolve_groups(lambda p, _: np.array([f(p[:, 0])]), 1, bounds, seed=seed, generations=generations, population=population, f_scale=f_scale, crossover=crossover, tol=tol)
    return points[0], float(values[0])


def evolve_groups(f, n: int, bounds, *, seed: int = 0, generations: int = 150, population: int = 24, f_scale: float = 0.7, crossover: float = 0.9, tol: float = 1e-10):
    """Best points (n x parameters) and values of n functions, each by rand/1/bin with the same random numbers, a trial of all at once.

    ``f(points, at)``: values of the functions ``at`` at points (parameters x functions). A function is left when its own members agree.
    """
    rng = np.random.default_rng(seed)
    low, high = np.array(bounds, float).T
    dims, at = len(low), np.arange(n)
    best, value = np.empty((n, dims)), np.empty(n)
    pop = np.repeat((low + rng.random((population, dims)) * (high - low))[:, :, None], n, axis=2)
    cost = np.array([f(p, at) for p in pop])
    low, high = low[:, None], high[:, None]
    trials = _trials(rng, population, dims, crossover)
    for left in reversed(range(generations)):
        for i, (a, b, c), taken, fresh in itertools.islice(trials, population):
            trial = np.where(taken[:, None], pop[a] + f_scale * (pop[b] - pop[c]), pop[i])
            trial = np.where((trial < low) | (trial > high), low + fresh[:, None] * (high - low), trial)
            v = f(trial, at)
            better = v <= cost[i]
            pop[i], cost[i] = np.where(better, trial, pop[i]), np.where(better, v, cost[i])
        over = (np.ptp(cost, axis=0) < tol * (1 + np.abs(cost.min(axis=0)))) | (left == 0)
        if over.any():
            which, rest = np.flatnonzero(over), np.flatnonzero(~over)
            k = cost[:, which].argmin(axis=0)
            best[at[which]], value[at[which]] = pop[k, :, which], cost[k, which]
            at, pop, cost = at[rest], pop.take(rest, axis=2), cost.take(rest, axis=1)
        if not len(at):
            break
    return best, value


def gradient(f, x, h: float = 1e-6):
    x = np.asarray(x, float)
    step = h * np.maximum(1, np.abs(x))
    return np.array([(f(x + move) - f(x - move)) / (2 * s) for move, s in zip(np.diag(step), step)])


def hessian(f, x, h: float = 1e-4):
    x = np.asarray(x, float)
    step, eye = h * np.maximum(1, np.abs(x)), np.eye(len(x))
    out = np.empty((len(x), len(x)))
    for i in range(len(x)):
        for j in range(len(x)):
            a, b = eye[i] * step[i], eye[j] * step[j]
            out[i, j] = (f(x + a + b) - f(x + a - b) - f(x - a + b) + f(x - a - b)) / (4 * step[i] * step[j])
    return (out + out.T) / 2


def adam(f, start, bounds, *, rate: float = 0.05, steps: int = 500):
    low, high = np.array(bounds, float).T
    x, m, v = np.array(start, float), 0.0, 0.0
    for t in range(1, steps + 1):
        g = gradient(f, x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = np.clip(x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), low, high)
    return x, float(f(x))


def lbfgs(f, start, bounds, *, memory: int = 8, steps: int = 200, tol: float = 1e-9):
    """Limited-memory quasi-Newton steps, cut back to the bounds, with backtracking."""
    low, high = np.array(bounds, float).T
    x, fx, pairs = np.clip(np.array(start, float), low, high), None, []
    fx, g = f(x), gradient(f, x)
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            alphas.append((s @ q) / (y @ s))
            q -= alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        step = 1.0
        while True:
            new = np.clip(x - step * q, low, high)
            value = f(new)
            if value <= fx - 1e-4 * (g @ (x - new)) or step < 1e-12:
                break
            step /= 2
        if abs(fx - value) < tol * (1 + abs(fx)):
            return (new, float(value)) if value < fx else (x, float(fx))
        g_new = gradient(f, new)
        s, y = new - x, g_new - g
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y)]
        x, fx, g = new, value, g_new
    return x, float(fx)


OPTIMIZERS = {"de": None, "adam": adam, "lbfgs": lbfgs}


def minimize(f, bounds, *, optimizer: str = "de", seed: int = 0, polish: bool = True):
    """Minimum within bounds: a global search polished by quasi-Newton steps, or a local one from the middle."""
    if optimizer == "de":
        x, v = differential_evolution(f, bounds, seed=seed)
        if polish:
            y, w = lbfgs(f, x, bounds)
            x, v = (y, w) if w < v else (x, v)
        return x, v
    return OPTIMIZERS[optimizer](f, np.array(bounds, float).mean(axis=1), bounds)


# --- fits per group ----------------------------------------------------------------------------------------------

#: Values of the traces that are fitted at once.
_FITTED = 1 << 16


def _packed(traces: list[tuple[np.ndarray, np.ndarray]]):
    """Traces in packs of similar length: their numbers, points x traces of t and v, the shortest length and which points after it are none."""
    order = sorted(range(len(traces)), key=lambda i: len(traces[i][0]))
    while order:
        size = max(1, _FITTED // max(1, len(traces[order[-1]][0])))
        pack, order = order[-size:], order[:-size]
        shortest, longest = len(traces[pack[0]][0]), len(traces[pack[-1]][0])
        t, v = np.empty((len(pack), longest)), np.empty((len(pack), longest))
        for row, i in enumerate(pack):
            for to, x in zip((t[row], v[row]), traces[i]):
                to[: len(x)], to[len(x) :] = x, x[-1]
        t, v = t.T.copy(), v.T.copy()
        yield pack, t, v, shortest, np.arange(shortest, longest)[:, None] >= np.array([len(traces[i][0]) for i in pack])


def fit_traces(traces: list[tuple[np.ndarray, np.ndarray]], curve: str, limits: list[tuple[float, float]], *, optimizer: str = "de", seed: int = 0) -> list[tuple[np.ndarray, float]]:
    """Least-squares parameters and the sum of squares of each trace (t, v); what a trace gets doesn't depend on the others.

    The global search runs over many traces at once, local steps trace by trace.
    """
    shape, out = CURVES[curve][0], [None] * len(traces)

    def loss_of(t, v):
        def loss(p):
            with np.errstate(all="ignore"):
                d = ((shape(t, *p) - v) ** 2).sum()
            return float(d) if np.isfinite(d) else 1e300

        return loss

    if optimizer != "de":
        return [minimize(loss_of(*x), limits, optimizer=optimizer) for x in traces]
    for pack, t, v, shortest, none in _packed(traces):
        held: list = [None]

        def losses(p, at, t=t, v=v, shortest=shortest, none=none, held=held):
            if held[0] is None or len(held[0]) != len(at):  # traces are only ever left
                two = np.repeat(at, 2) if len(at) == 1 else at  # a column on its own would be added up in another order
                held[:] = [at, *[a.take(two, axis=1) for a in (t, v, none)]]
            with np.errstate(all="ignore"):
                d = shape(held[1], *p)
                d -= held[2]
                d *= d
                np.copyto(d[shortest:], 0.0, where=held[3])
                d = np.add.reduce(d, axis=0)
            return np.where(np.isfinite(d), d, 1e300)[: len(at)]

        for i, x, value in zip(pack, *evolve_groups(losses, len(pack), limits, seed=seed)):
            y, w = lbfgs(loss_of(*traces[i]), x, limits)
            out[i] = (y, w) if w < value else (x, float(value))
    return out


def fit_groups(df: DataFrame, keys, x: str, y: str, curve: str, bounds: dict[str, tuple[float, float]], *, optimizer: str = "de", seed: int = 0) -> DataFrame:
    """Least-squares fit of a curve to each group: keys, a column per parameter, ``sse``, ``n``. A group is one trace.

    Points count in order of x and y; null and infinite ones don't. Groups with fewer points than parameters get nulls.
    """
    keys = names(keys)
    _, params = CURVES[curve]
    limits = [bounds[p] for p in params]

    @F.pandas_udf(", ".join(f"{p} double" for p in params) + ", sse double, n long")
    def fit(ts: pd.Series, vs: pd.Series) -> pd.DataFrame:
        traces = []
        for t, v in zip(ts, vs):
            t, v = np.asarray(t, float), np.asarray(v, float)
            ok = np.isfinite(t) & np.isfinite(v)
            traces.append((t[ok], v[ok]))
        enough = [i for i, (t, _) in enumerate(traces) if len(t) >= len(params)]
        found = np.full((len(traces), len(params) + 1), np.nan)
        for i, (p, sse) in zip(enough, fit_traces([traces[i] for i in enough], curve, limits, optimizer=optimizer, seed=seed)):
            found[i] = [*p, sse]
        out = pd.DataFrame(found, columns=[*params, "sse"])
        out["n"] = [len(t) for t, _ in traces]
        return out

    # few rows make many fits: AQE would put all of them into one task
    points = df.select(*keys, F.struct(F.col(x).cast("double").alias("t"), F.col(y).cast("double").alias("v")).alias("_p")).repartition(shuffle_partitions(df.sparkSession), *keys)
    traces = points.groupBy(*keys).agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    return traces.select(*keys, fit(F.col("_p")["t"], F.col("_p")["v"]).alias("_f")).select(*keys, "_f.*")


def credible_interval(df: DataFrame, keys, value: str, level: float = 0.95) -> DataFrame:
    """Equal-tailed interval per group: ``lo``, ``hi``."""
    a = (1 - level) / 2
    p = F.percentile(value, F.array(F.lit(a), F.lit(1 - a)))
    return df.groupBy(*names(keys)).agg(p.alias("p")).select(*names(keys), F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def laplace_covariance(negative_log_posterior, at) -> np.ndarray:
    """Inverse Hessian at the best point."""
    return np.linalg.inv(hessian(negative_log_posterior, at))


def profile_interval(loss, best, index: int, bounds, *, level: float = 0.95, grid: int = 41) -> tuple[float, float]:
    """Values of one parameter whose best attainable loss is within the chi-square limit of the optimum."""
    limit = {0.68: 0.9889, 0.9: 2.7055, 0.95: 3.8415, 0.99: 6.6349}[level] / 2
    low, high = bounds[index]
    rest = [b for i, b in enumerate(bounds) if i != index]
    start, floor, inside = np.delete(np.asarray(best, float), index), loss(np.asarray(best, float)), []
    for v in np.linspace(low, high, grid):
        value = lbfgs(lambda p, v=v: loss(np.insert(p, index, v)), start, rest)[1] if rest else loss(np.array([v]))
        if value - floor <= limit:
            inside.append(v)
    return (float(min(inside)), float(max(inside))) if inside else (float(best[index]), float(best[index]))


@dataclass
class GaussianGuide:
    """Independent normals that approximate a posterior."""

    mean: np.ndarray
    log_scale: np.ndarray


def elbo(negative_log_posterior, guide: GaussianGuide, *, samples: int = 64, seed: int = 0) -> float:
    """Monte-Carlo evidence bound with a fixed seed."""
    z = np.random.default_rng(seed).standard_normal((samples, len(guide.mean)))
    energy = np.mean([negative_log_posterior(guide.mean + np.exp(guide.log_scale) * k) for k in z])
    return float(-energy + guide.log_scale.sum() + 0.5 * len(guide.mean) * (1 + math.log(2 * math.pi)))


def fit_guide(negative_log_posterior, start, *, samples: int = 32, seed: int = 0, steps: int = 400) -> GaussianGuide:
    """Mean-field guide with the best bound, by Adam on common random numbers."""
    n = len(start)
    loss = lambda p: -elbo(negative_log_posterior, GaussianGuide(p[:n], p[n:]), samples=samples, seed=seed)
    p, _ = adam(loss, np.concatenate([start, np.full(n, -1.0)]), [(-1e9, 1e9)] * n + [(-12, 6)] * n, steps=steps)
    return GaussianGuide(p[:n], p[n:])


def parameter_tiers(shared: DataFrame, own: DataFrame, entity: str) -> DataFrame:
    """Parameters per entity: its own value where it has one, else the shared. ``shared``: name, value; ``own``: entity, name, value."""
    every = own.select(entity).distinct().join(F.broadcast(shared))  # shared parameters are a short list by nature
    mine = own.select(entity, "name", F.col("value").alias("_own"))
    both = every.join(mine, [entity, "name"], "full")
    return both.select(entity, "name", F.coalesce("_own", "value").alias("value"))


# --- ion counting ------------------------------------------------------------------------------------------------

def accumulated_count(intensity: Column, injection_s: Column, gain: Column, floor: float = 0.0) -> Column:
    """Ions that an intensity stands for."""
    return F.greatest(intensity * injection_s / gain, F.lit(floor))


def channel_loglik(observed, predicted, gain, count_floor: float = 1.0, df: float = 5.0):
    """Student-t log likelihood of intensities whose spread follows from counting."""
    n = np.maximum(np.asarray(predicted, float) / gain, count_floor)
    return student_t_logpdf(np.asarray(observed, float), df, np.asarray(predicted, float), gain * np.sqrt(n))


def mz_error_loglik(error_ppm, centre_ppm, scale, count, power: float = 0.5, df: float = 4.0, floor: float = 1.0):
    """Student-t log likelihood of m/z errors, narrower for larger counts."""
    return student_t_logpdf(np.asarray(error_ppm, float), df, centre_ppm, scale / np.maximum(count, floor) ** power)


def censored_loglik(predicted_count, floor_count: float):
    """Log probability that a count stays under the detection floor."""
    lam, k = np.maximum(np.asarray(predicted_count, float), 1e-12), np.arange(int(math.floor(floor_count)) + 1)
    return np.log(np.maximum(np.exp(poisson_logpmf(k[None, :].astype(float), np.atleast_1d(lam)[:, None])).sum(axis=1), 1e-300))


def responsibilities(predicted: DataFrame, cell, progenitor: str, intensity: str, *, floor: float = 0.0) -> DataFrame:
    """Share of each progenitor in each cell's predicted intensity; shares under ``floor`` are left out."""
    cell = names(cell)
    whole = predicted.groupBy(*cell).agg(F.sum(intensity).alias("_w"))
    out = predicted.join(whole, cell).withColumn("weight", F.coalesce(F.try_divide(F.col(intensity), F.col("_w")), F.lit(0.0))).drop("_w")
    return out.where(F.col("weight") >= floor)


def residual(observed: DataFrame, predicted: DataFrame, cell, intensity: str = "intensity") -> DataFrame:
    """Observed minus summed predicted intensity per cell."""
    cell = names(cell)
    p = predicted.groupBy(*cell).agg(F.sum(intensity).alias("_p"))
    return observed.join(p, cell, "left").withColumn("residual", F.col(intensity) - F.coalesce("_p", F.lit(0.0))).drop("_p")


def trace_grid(trace: DataFrame, scan: str, channel: str, intensity: str, channels: list[str]) -> DataFrame:
    """Scan x channel grid, 0 where nothing was seen."""
    cells = [F.coalesce(F.max(F.when(F.col(channel) == c, F.col(intensity))), F.lit(0.0)).alias(c) for c in channels]
    return trace.groupBy(scan).agg(*cells)


def estimate_counts(cells: DataFrame, target: str, *, seed: int = 0) -> DataFrame:
    """Ion count of each target from its cells (scan, shape, share, intensity, injection_s, gain): the most likely total, with an interval.

    A cell expects n * shape * share ions; the likelihood is Poisson in accumulated counts. A group is one target.
    """

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        expected = (part["shape"] * part["share"]).to_numpy(float)
        seen = (part["intensity"] * part["injection_s"] / part["gain"]).to_numpy(float)
        whole, total = expected.sum(), max(seen.sum(), 0.0)
        n = total / whole if whole > 0 else None
        sd = math.sqrt(total) / whole if whole > 0 else None
        return pd.DataFrame([[part[target].iloc[0], n, max(n - 1.96 * sd, 0.0) if n is not None else None, n + 1.96 * sd if n is not None else None]], columns=[target, "n", "lo", "hi"])

    kind = cells.schema[target].dataType.simpleString()
    return cells.select(target, "shape", "share", "intensity", "injection_s", "gain").groupBy(target).applyInPandas(fit, f"`{target}` {kind}, n double, lo double, hi double")
