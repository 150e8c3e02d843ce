"""Per-series kernels in numpy: optimisers, forecasts, decomposition, multivariate models."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


# ---- optimisers ----


def golden(f, low: float, high: float, tolerance: float = 1e-6) -> float:
    """The minimum of a unimodal function by golden sections."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    return (a + b) / 2


def nelder_mead(f, start, bounds=None, steps: int = 500, size: float = 0.1) -> np.ndarray:
    """A minimum near ``start`` by a simplex, kept inside bounds."""
    clip = (lambda x: np.clip(x, *np.array(bounds).T)) if bounds else (lambda x: x)
    points = [clip(np.array(start, float))]
    for i in range(len(start)):
        p = np.array(start, float)
        p[i] += size if p[i] == 0 or bounds else 0.1 * abs(p[i]) + size
        points.append(clip(p))
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < 1e-10 * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        tried = clip(centre + (centre - points[-1]))
        value = f(tried)
        if value < values[0]:
            further = clip(centre + 2 * (centre - points[-1]))
            if (fv := f(further)) < value:
                tried, value = further, fv
        elif value >= values[-2]:
            inner = clip(centre + 0.5 * (points[-1] - centre))
            if (iv := f(inner)) < values[-1]:
                tried, value = inner, iv
            else:
                points = [points[0], *(clip(points[0] + 0.5 * (p - points[0])) for p in points[1:])]
                values = [values[0], *map(f, points[1:])]
                continue
        points[-1], values[-1] = tried, value
    return points[int(np.argmin(values))]


# ---- forecasts ----


@dataclass
class Forecast:
    """Points with 95 % bounds and what was fitted."""

    mean: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    parameters: dict


def _bounded(mean: np.ndarray, sigma: float, spread: np.ndarray, parameters: dict) -> Forecast:
    half = 1.959963984540054 * sigma * np.sqrt(spread)
    return Forecast(mean, mean - half, mean + half, parameters)


def _ses_errors(y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    level, errors = y[0], np.empty(len(y) - 1)
    for i, v in enumerate(y[1:]):
        errors[i] = v - level
        level += alpha * errors[i]
    return errors, level


def ses(y: np.ndarray, horizon: int) -> Forecast:
    """Simple exponential smoothing from the first value; a flat forecast."""
    if len(y) < 2:
        raise ValueError("two values are needed")
    alpha = golden(lambda a: float(np.mean(_ses_errors(y, a)[0] ** 2)), 0.01, 0.99)
    errors, level = _ses_errors(y, alpha)
    sigma = math.sqrt(float(np.sum(errors**2)) / max(1, len(errors) - 1))
    h = np.arange(horizon)
    return _bounded(np.full(horizon, level), sigma, 1 + h * alpha**2, {"model": "ses", "alpha": alpha})


def holt(y: np.ndarray, horizon: int, damped: bool = False) -> Forecast:
    """Linear trend; a damped one is multiplied by phi each step."""

    def run(p):
        alpha, beta, phi = p[0], p[1], p[2] if damped else 1.0
        level, trend, errors = y[0], y[1] - y[0], np.empty(len(y) - 1)
        for i, v in enumerate(y[1:]):
            guess = level + phi * trend
            errors[i] = v - guess
            new = guess + alpha * errors[i]
            trend = phi * trend + beta * ((new - level) - phi * trend)
            level = new
        return errors, level, trend

    if len(y) < 3:
        raise ValueError("three values are needed")
    bounds = [(0.01, 0.99), (0.001, 0.99)] + ([(0.8, 1.0)] if damped else [])
    best = nelder_mead(lambda p: float(np.mean(run(p)[0] ** 2)), [0.5, 0.1, 0.95][: len(bounds)], bounds)
    errors, level, trend = run(best)
    phi = best[2] if damped else 1.0
    growth = np.cumsum(phi ** np.arange(1, horizon + 1))
    psi = best[0] * (1 + best[1] * growth)
    sigma = math.sqrt(float(np.sum(errors**2)) / max(1, len(errors) - 2))
    spread = 1 + np.concatenate([[0], np.cumsum(psi**2)[:-1]])
    return _bounded(level + growth * trend, sigma, spread, {"model": "holt", "alpha": best[0], "beta": best[1], "phi": phi})


def holt_winters(y: np.ndarray, horizon: int, period: int | None = None, multiplicative: bool = False) -> Forecast:
    """Additive or multiplicative seasons; a short series is given a trend alone."""
    m = period or detect_period(y) or 1
    if m < 2 or len(y) < 2 * m:
        return holt(y, horizon)
    level0, trend0 = float(np.mean(y[:m])), float(np.mean((y[m : 2 * m] - y[:m]) / m))
    season0 = y[:m] / level0 if multiplicative else y[:m] - level0

    def run(p):
        alpha, beta, gamma = p
        level, trend, season, errors = level0, trend0, season0.copy(), np.empty(len(y))
        for i, v in enumerate(y):
            s = season[i % m]
            guess = (level + trend) * s if multiplicative else level + trend + s
            errors[i] = v - guess
            bare = (v / s if abs(s) > 1e-12 else v) if multiplicative else v - s
            new = alpha * bare + (1 - alpha) * (level + trend)
            trend = beta * (new - level) + (1 - beta) * trend
            level = new
            own = (v / new if abs(new) > 1e-12 else 1.0) if multiplicative else v - new
            season[i % m] = gamma * own + (1 - gamma) * s
        return errors, level, trend, season

    best = nelder_mead(lambda p: float(np.mean(run(p)[0] ** 2)), (0.3, 0.05, 0.1), [(0.01, 0.99), (0.001, 0.99), (0.01, 0.99)])
    errors, level, trend, season = run(best)
    h = np.arange(1, horizon + 1)
    s = season[(len(y) % m + h - 1) % m]
    mean = (level + h * trend) * s if multiplicative else level + h * trend + s
    sigma = math.sqrt(float(np.sum(errors**2)) / max(1, len(y) - (m + 3)))
    return _bounded(mean, sigma, 1 + (h - 1) * best[0] ** 2, {"model": "holt_winters", "alpha": best[0], "beta": best[1], "gamma": best[2], "period": m})


def linear(y: np.ndarray, horizon: int) -> Forecast:
    """Least squares on the row number."""
    n, x = len(y), np.arange(len(y), dtype=float)
    if n < 3:
        raise ValueError("three values are needed")
    sxx = float(np.sum((x - x.mean()) ** 2))
    slope = float(np.sum((x - x.mean()) * (y - y.mean()))) / sxx
    intercept = y.mean() - slope * x.mean()
    errors = y - intercept - slope * x
    ahead = np.arange(n, n + horizon)
    sigma = math.sqrt(float(np.sum(errors**2)) / (n - 2))
    total = float(np.sum((y - y.mean()) ** 2))
    return _bounded(intercept + slope * ahead, sigma, 1 + 1 / n + (ahead - x.mean()) ** 2 / sxx, {"model": "linear", "slope": slope, "intercept": intercept, "r2": 1 - float(np.sum(errors**2)) / total if total else 1.0})


def _stationary(raw: np.ndarray) -> np.ndarray:
    """Coefficients inside the region of stability from any numbers, by partial autocorrelations."""
    out = np.zeros(0)
    for r in np.tanh(raw):
        out = np.concatenate([out - r * out[::-1], [r]])
    return out


def _polynomial(own: np.ndarray, seasonal: np.ndarray, m: int) -> np.ndarray:
    """Lags' coefficients of (1 - own)(1 - seasonal)."""
    a, b = np.concatenate([[1], -own]), np.zeros(len(seasonal) * m + 1)
    b[0], b[m::m] = 1, -seasonal
    return -np.convolve(a, b)[1:]


def arima(y: np.ndarray, horizon: int, order=(1, 1, 1), seasonal=(0, 0, 0), period: int = 1) -> Forecast:
    """(Seasonal) ARIMA by conditional sums of squares."""
    (p, d, q), (sp, sd, sq) = order, seasonal
    x, tails = np.array(y, float), []
    for lag in [1] * d + [period] * sd:
        tails.append((lag, x[-lag:].copy()))
        x = x[lag:] - x[:-lag]
    mean = float(x.mean()) if d + sd == 0 else 0.0
    x = x - mean
    if len(x) < max(p + sp * period, q + sq * period) + 3:
        raise ValueError("the series is too short for this order")

    def unpack(v):
        cut = np.cumsum([p, sp, q, sq])
        a, sa, b, sb = np.split(v, cut[:-1])
        return _polynomial(_stationary(a), _stationary(sa), period), -_polynomial(-_stationary(b) * -1, -_stationary(sb) * -1, period)

    def residuals(v):
        ar, ma = unpack(v)
        known = np.convolve(x, np.concatenate([[1], -ar]), "valid")
        lags = [(k, c) for k, c in enumerate(ma.tolist(), 1) if c]
        if not lags:
            return known
        e = [0.0] * len(ma)
        for value in known.tolist():
            for k, c in lags:
                value -= c * e[-k]
            e.append(value)
        return np.array(e[len(ma) :])

    n = p + sp + q + sq
    best = nelder_mead(lambda v: float(np.mean(residuals(v) ** 2)), np.zeros(n), steps=200 * max(1, n)) if n else np.zeros(0)
    ar, ma = unpack(best)
    e = residuals(best)
    sigma2 = float(np.mean(e**2))
    known, shocks, out = list(x), list(e), []
    for _ in range(horizon):
        value = sum(c * known[-i] for i, c in enumerate(ar, 1)) + sum(c * shocks[-i] for i, c in enumerate(ma, 1) if i <= len(shocks))
        known.append(value), shocks.append(0.0), out.append(value + mean)
    forecast = np.array(out)
    for lag, tail in reversed(tails):
        seen = list(tail)
        for v in forecast:
            seen.append(v + seen[-lag])
        forecast = np.array(seen[len(tail) :])
    psi = np.zeros(horizon)
    full = np.concatenate([[1], -ar])
    for lag, _ in tails:
        step = np.zeros(lag + 1)
        step[0], step[lag] = 1, -1
        full = np.convolve(full, step)
    for i in range(horizon):
        psi[i] = (1.0 if i == 0 else (ma[i - 1] if i - 1 < len(ma) else 0.0)) - sum(full[j] * psi[i - j] for j in range(1, min(i, len(full) - 1) + 1))
    k = n + 1
    aicc = len(e) * math.log(max(sigma2, 1e-300)) + 2 * k + 2 * k * (k + 1) / max(1, len(e) - k - 1)
    return _bounded(forecast, math.sqrt(sigma2), np.cumsum(psi**2), {"model": "arima", "order": tuple(order), "seasonal": tuple(seasonal), "ar": ar.tolist(), "ma": ma.tolist(), "sigma2": sigma2, "aicc": aicc})


def kpss(y: np.ndarray) -> float:
    """The statistic of level stationarity."""
    e = y - y.mean()
    n, lags = len(y), int(4 * (len(y) / 100) ** 0.25)
    s = float(e @ e) / n
    for k in range(1, lags + 1):
        s += 2 * (1 - k / (lags + 1)) * float(e[k:] @ e[:-k]) / n
    return float(np.sum(np.cumsum(e) ** 2)) / (n * n * max(s, 1e-300))


def auto_arima(y: np.ndarray, horizon: int, most: int = 2) -> Forecast:
    """Differences until KPSS accepts (5 %), then orders by AICc."""
    if len(y) < 30:
        raise ValueError("thirty values are needed")
    d, x = 0, y
    while d < 2 and kpss(x) > 0.463:
        d, x = d + 1, np.diff(x)
    fits = [arima(y, horizon, (p, d, q)) for p in range(most + 1) for q in range(most + 1)]
    return min(fits, key=lambda f: f.parameters["aicc"])


MODELS = {"ses": ses, "holt": holt, "damped_holt": lambda y, h, **options: holt(y, h, True, **options), "holt_winters": holt_winters, "linear": linear, "arima": arima, "auto_arima": auto_arima}


def seasonal_difference(y: np.ndarray, period: int, strong: float = 0.64) -> int:
    """1 where the seasonal part of a decomposition is strong beside what remains, else 0."""
    _, seasonal, rest = stl(y, period)
    whole = float(np.var(seasonal + rest))
    return int(whole > 0 and 1 - float(np.var(rest)) / whole > strong)


def candidates(y: np.ndarray, first: int, period: int | None) -> dict[str, tuple[str, dict]]:
    """Label to (model, options) of what a series is long enough for; ``first``: the shortest training window, in which the ARIMA order is searched."""
    made: dict[str, tuple[str, dict]] = {"ses": ("ses", {})}
    if len(y) >= 10:
        made |= {name: (name, {}) for name in ("holt", "damped_holt", "linear")}
    if first >= 30:
        p, d, q = auto_arima(y[:first], 1).parameters["order"]
        made[f"arima({p},{d},{q})"] = ("arima", {"order": (p, d, q)})
        if period:
            sd = seasonal_difference(y, period)
            for sp, sq in ((1, 0), (0, 1)):
                if first >= max(p, q) + period + 2 * (d + sd * period) + 10:
                    made[f"arima({p},{d},{q})({sp},{sd},{sq})[{period}]"] = ("arima", {"order": (p, d, q), "seasonal": (sp, sd, sq), "period": period})
    if period and first >= 2 * period:
        made[f"holt_winters[{period}]"] = ("holt_winters", {"period": period})
        if (y > 0).all():
            made[f"multiplicative holt_winters[{period}]"] = ("holt_winters", {"period": period, "multiplicative": True})
    return made


def cross_validate(y: np.ndarray, model: str, horizon: int, folds: int = 3, sliding: int | None = None, first: int = 4, **options) -> float:
    """Mean RMSE over the last rolling origins, with expanding or sliding training of at least ``first`` values."""
    errors = []
    for i in range(folds, 0, -1):
        cut = len(y) - i * horizon
        if cut < first:
            continue
        train = y[max(0, cut - sliding) : cut] if sliding else y[:cut]
        errors.append(math.sqrt(float(np.mean((MODELS[model](train, horizon, **options).mean - y[cut : cut + horizon]) ** 2))))
    return float(np.mean(errors)) if errors else math.inf


def auto_forecast(y: np.ndarray, horizon: int, folds: int = 3, max_period: int = 288) -> Forecast:
    """The candidate of the smallest rolling-origin RMSE, fitted to the whole series."""
    if len(y) < 8:
        raise ValueError("eight values are needed")
    ahead = max(1, min(horizon, len(y) // 5))
    first = min(max(len(y) - ahead * folds, len(y) // 2), len(y) - ahead)
    tried = candidates(y, first, detect_period(y, max_period))
    scores = {}
    for label, (model, options) in tried.items():
        try:
            scores[label] = cross_validate(y, model, ahead, folds, first=first, **options)
        except ValueError:
            continue
    scores = {label: score for label, score in scores.items() if math.isfinite(score)}
    if not scores:
        raise ValueError("no model could be scored")
    best = min(scores, key=scores.get)
    model, options = tried[best]
    found = MODELS[model](y, horizon, **options)
    found.parameters |= {"selected": model, "label": best, "scores": scores}
    return found


def _walk_forward(y: np.ndarray, model: str, horizon: int, window: int) -> list[np.ndarray]:
    """Absolute errors at each horizon from every origin after the window.

    Simple smoothing is fitted on the window and then updated value by value; other models are fitted anew at every origin.
    """
    n = len(y)
    if model == "ses":
        alpha = ses(y[:window], 1).parameters["alpha"]
        levels = np.empty(n - window)
        level = _ses_errors(y[:window], alpha)[1]
        for i in range(window, n):
            levels[i - window] = level
            level += alpha * (y[i] - level)
        return [np.abs(y[window + h :] - levels[: max(0, n - window - h)]) for h in range(horizon)]
    errors: list[list[float]] = [[] for _ in range(horizon)]
    for cut in range(window, n):
        ahead = MODELS[model](y[:cut], horizon).mean
        for h in range(min(horizon, n - cut)):
            errors[h].append(abs(y[cut + h] - ahead[h]))
    return [np.array(e) for e in errors]


def conformal(y: np.ndarray, horizon: int, level: float = 0.9, model: str = "ses", window: int | None = None) -> Forecast:
    """Bounds by quantiles of absolute out-of-sample errors at each horizon, with the rank correction.

    Errors are of all origins after the window, half of the series (two or three values at least) unless it is given.
    """
    window = window or max(2 if model == "ses" else 3, len(y) // 2)
    if len(y) <= window:
        raise ValueError("a value after the window is needed")
    errors = _walk_forward(y, model, horizon, window)
    found, half = MODELS[model](y, horizon), np.zeros(horizon)
    for h in range(horizon):
        e = np.sort(errors[h])
        half[h] = e[min(len(e), math.ceil((len(e) + 1) * level)) - 1] if len(e) else half[h - 1]
    half = np.maximum.accumulate(half)
    return Forecast(found.mean, found.mean - half, found.mean + half, found.parameters | {"level": level})


# ---- diagnostics ----


def mase(actual: np.ndarray, forecast: np.ndarray, training: np.ndarray) -> float:
    return float(np.mean(np.abs(actual - forecast)) / max(np.mean(np.abs(np.diff(training))), 1e-300))


def acf(y: np.ndarray, lags: int) -> np.ndarray:
    e = y - y.mean()
    c = float(e @ e)
    return np.array([1.0] + [float(e[k:] @ e[:-k]) / c if c > 0 else 0.0 for k in range(1, lags + 1)])


def ljung_box(residuals: np.ndarray, lags: int) -> float:
    n, r = len(residuals), acf(residuals, lags)[1:]
    return float(n * (n + 2) * np.sum(r**2 / (n - np.arange(1, lags + 1))))


# ---- decomposition ----


def detect_period(y: np.ndarray, most: int | None = None) -> int | None:
    """The lag, up to ``most``, of the highest local maximum above 0.3 of the detrended autocorrelation; ties to the shorter."""
    if len(y) < 8:
        return None
    x = np.arange(len(y))
    slope, intercept = np.polyfit(x, y, 1)
    r = acf(y - slope * x - intercept, min(len(y) // 2, (most or len(y)) + 1))
    peaks = [k for k in range(2, len(r) - 1) if r[k] > 0.3 and r[k] >= r[k - 1] and r[k] >= r[k + 1]]
    return min(peaks, key=lambda k: (-round(r[k], 9), k)) if peaks else None


def loess(y: np.ndarray, span: int, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Local lines with tricube weights over the nearest ``span`` places."""
    n, out = len(y), np.empty(len(at))
    w0 = np.ones(n) if weights is None else weights
    q = min(span, n)
    for i, x in enumerate(at):
        low = int(min(max(0, math.floor(x) - q // 2), n - q))
        places = np.arange(low, low + q)
        far = np.abs(places - x)
        reach = max(far.max(), 1e-9) * (span / q if span > n else 1)
        w = (1 - np.clip(far / (reach * 1.0001), 0, 1) ** 3) ** 3 * w0[places]
        total = w.sum()
        if total <= 0:
            out[i] = y[places].mean()
            continue
        centre = (w * places).sum() / total
        mean = (w * y[places]).sum() / total
        sxx = (w * (places - centre) ** 2).sum()
        out[i] = mean + ((w * (places - centre) * (y[places] - mean)).sum() / sxx * (x - centre) if sxx > 1e-12 else 0.0)
    return out


def stl(y: np.ndarray, period: int, robust: bool = False, seasonal_span: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and remainder by repeated loess; robust weights in outer rounds if wanted."""
    n = len(y)
    if period < 2 or n < 2 * period:
        raise ValueError("two full periods of at least two are needed")
    odd = lambda v: int(math.ceil(v)) | 1
    trend_span, low_span = odd(1.5 * period / (1 - 1.5 / seasonal_span)), odd(period)
    trend, seasonal, weights = np.zeros(n), np.zeros(n), np.ones(n)
    for outer in range(11 if robust else 1):
        for _ in range(2):
            bare, cycle = y - trend, np.zeros(n + 2 * period)
            for k in range(period):
                sub, w = bare[k::period], weights[k::period]
                cycle[k::period] = loess(sub, seasonal_span, np.arange(-1, len(sub) + 1), w)[: len(cycle[k::period])]
            mean = lambda v, m: np.convolve(v, np.ones(m) / m, "valid")
            low = loess(mean(mean(mean(cycle, period), period), 3), low_span, np.arange(n))
            seasonal = cycle[period : period + n] - low
            trend = loess(y - seasonal, trend_span, np.arange(n), weights)
        if robust and outer < 10:
            r = np.abs(y - trend - seasonal)
            u = r / max(6 * float(np.median(r)), 1e-12)
            weights = np.where(u < 1, (1 - np.minimum(u, 1) ** 2) ** 2, 0.0)
    return trend, seasonal, y - trend - seasonal


# ---- multivariate ----


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    _, codes, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[codes]


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    d = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / d if d > 0 else math.nan


def spearman(a: np.ndarray, b: np.ndarray) -> float:
    ok = ~(np.isnan(a) | np.isnan(b))
    return pearson(ranks(a[ok]), ranks(b[ok]))


def kendall(a: np.ndarray, b: np.ndarray) -> float:
    """tau-b: concordance with ties taken out, by counting inversions in n log n."""
    order = np.lexsort((b, a))
    a, b = a[order], np.unique(b[order], return_inverse=True)[1]
    tree, inversions = np.zeros(b.max() + 2, np.int64), 0
    for seen, v in enumerate(b):
        i, below = v + 1, 0
        while i:
            below += tree[i]
            i -= i & -i
        inversions += seen - below
        i = v + 1
        while i < len(tree):
            tree[i] += 1
            i += i & -i
    tied = lambda *c: sum(int(k) * (int(k) - 1) // 2 for k in np.unique(np.stack(c), axis=1, return_counts=True)[1])
    n = len(a) * (len(a) - 1) // 2
    ta, tb, both = tied(a), tied(b), tied(a, b)
    return (n - ta - tb + both - 2 * inversions) / math.sqrt((n - ta) * (n - tb)) if (n - ta) * (n - tb) else math.nan


def mahalanobis(x: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    e = x - x.mean(axis=0)
    cov = np.atleast_2d(np.cov(x, rowvar=False)) + ridge * np.eye(x.shape[1])
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", e @ np.linalg.inv(cov), e), 0))


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> np.ndarray:
    """2 ** (-mean path / expected path) of random splitting trees; near 1 is isolated."""
    rng, n = np.random.default_rng(seed), len(x)
    size = min(sample, n)
    expected = lambda k: 0.0 if k < 2 else 2 * (math.log(k - 1) + 0.5772156649015329) - 2 * (k - 1) / k
    depth = np.zeros(n)

    def walk(own: np.ndarray, all_rows: np.ndarray, level: int) -> None:
        if level >= math.ceil(math.log2(max(size, 2))) or len(own) < 2 or not len(all_rows):
            depth[all_rows] += level + expected(len(own))
            return
        f = int(rng.integers(x.shape[1]))
        low, high = x[own, f].min(), x[own, f].max()
        if low == high:
            depth[all_rows] += level + expected(len(own))
            return
        cut = rng.uniform(low, high)
        for side in (x[:, f] < cut, x[:, f] >= cut):
            walk(own[side[own]], all_rows[side[all_rows]], level + 1)

    for _ in range(trees):
        walk(rng.choice(n, size, replace=False), np.arange(n), 0)
    return 2.0 ** (-depth / trees / max(expected(size), 1e-9))


def pca_error(x: np.ndarray, share: float = 0.95) -> np.ndarray:
    """Reconstruction error from the components that explain ``share`` of the variance."""
    e = x - x.mean(axis=0)
    _, s, v = np.linalg.svd(e, full_matrices=False)
    k = int(np.searchsorted(np.cumsum(s**2) / max(float(np.sum(s**2)), 1e-300), share)) + 1
    return np.linalg.norm(e - e @ v[:k].T @ v[:k], axis=1)


def var_model(x: np.ndarray, lags: int, horizon: int) -> np.ndarray:
    """Vector autoregression by least squares; refused where its largest root is above 1.05."""
    n, k = x.shape
    rows = np.hstack([np.ones((n - lags, 1)), *(x[lags - i : n - i] for i in range(1, lags + 1))])
    b = np.linalg.lstsq(rows, x[lags:], rcond=None)[0]
    companion = np.zeros((k * lags, k * lags))
    companion[:k] = b[1:].T
    companion[k:, :-k] = np.eye(k * (lags - 1)) if lags > 1 else companion[k:, :-k]
    if np.abs(np.linalg.eigvals(companion)).max() > 1.05:
        raise ValueError("the model is not stable")
    seen = list(x[-lags:])
    for _ in range(horizon):
        seen.append(b[0] + sum(b[1 + i * k : 1 + (i + 1) * k].T @ seen[-1 - i] for i in range(lags)))
    return np.array(seen[lags:])


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    value = 1.0
    for m in range(200, 0, -1):  # evaluated from the inside
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + even / (1 + odd / value)
    first = -(a + b) * x / (a + 1)
    return front / (1 + first / value)


def granger(cause: np.ndarray, effect: np.ndarray, lags: int) -> tuple[float, float]:
    """F statistic and p-value of the cause's lags in a regression of the effect."""
    n = len(effect)
    y = effect[lags:]
    own = np.column_stack([np.ones(n - lags), *(effect[lags - i : n - i] for i in range(1, lags + 1))])
    both = np.column_stack([own, *(cause[lags - i : n - i] for i in range(1, lags + 1))])
    rss = [float(np.sum((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2)) for a in (own, both)]
    dof = len(y) - both.shape[1]
    f = (rss[0] - rss[1]) / lags / max(rss[1] / dof, 1e-300)
    return f, 1 - _beta_tail(lags / 2, dof / 2, lags * f / (lags * f + dof))


def benjamini_hochberg(p: np.ndarray) -> np.ndarray:
    order = np.argsort(p)
    raised = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(raised, 1)
    return out


def adwin(values: np.ndarray, delta: float = 0.002) -> list[int]:
    """Places after which an adaptive window dropped its older part."""
    start, drops = 0, []
    for end in range(2, len(values) + 1):
        window = values[start:end]
        n = len(window)
        if n < 10 or n % 4:
            continue
        sums, spread = np.cumsum(window), window.var()
        cuts = np.arange(5, n - 4)
        gap = np.abs(sums[cuts - 1] / cuts - (sums[-1] - sums[cuts - 1]) / (n - cuts))
        m = 1 / (1 / cuts + 1 / (n - cuts))
        log = math.log(2 * math.log(max(n, 3)) / delta)
        over = cuts[gap > np.sqrt(2 / m * spread * log) + 2 / (3 * m) * log]
        if len(over):
            start += int(over[-1])
            drops.append(end - 1)
    return drops
