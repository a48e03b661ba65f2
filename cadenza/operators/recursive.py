"""Models that recurse over a series: Croston SBA, TSB, Theta, ETS, ARIMA, CES.

A completed panel is rectangular, so whole series arrive as matrices (series, periods) in Arrow batches. Croston and TSB run
over all series, and when tuned over all weights, in one loop over the periods; the other
families run series by series. Parameters are chosen on the first window's history and only re-run on longer
histories. Theta, ETS, ARIMA and CES are documented small families; they claim no parity with any library's automatic choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import QUANTILES
from ..plans.spec import PanelSpec
from ..plans.windows import Windows

Z = NormalDist()
#: The weights among which CROSTON and TSB are tuned.
CROSTON_GRID = np.round(np.arange(0.05, 0.3001, 0.01), 10)
TSB_GRID = np.round(np.arange(0.02, 0.5001, 0.01), 10)
#: Cells (series, weights, periods) of one matrix of levels, and rows that become one matrix of series.
CELLS, ROWS = 8_000_000, 200_000


def smooth(x: np.ndarray, alpha: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Exponential smoothing from the first value: (fitted: level before each value, the first undefined; forecast), per alpha."""
    alpha = np.atleast_1d(np.asarray(alpha, float))
    level = np.full(len(alpha), float(x[0]))
    fitted = np.full((len(alpha), len(x)), np.nan)
    for t in range(1, len(x)):
        fitted[:, t] = level
        level = alpha * x[t] + (1 - alpha) * level
    return fitted, level


# ---------------------------------------------------------------- intermittent demand
def demand_levels(y: np.ndarray, size_alpha: np.ndarray, gap_alpha: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Smoothed sizes and gaps of positive demand after each period, and whether there was any: (series, weights, periods), (series, periods).

    ``y``: (series, periods); weights: (series or 1, weights). The first demand starts both levels; its gap counts from before the first period.
    """
    n, periods = y.shape
    k = max(size_alpha.shape[1], gap_alpha.shape[1] if gap_alpha is not None else 1)
    sizes, gaps, known = np.zeros((n, k, periods)), None if gap_alpha is None else np.zeros((n, k, periods)), np.zeros((n, periods), bool)
    size, gap, last, seen = np.zeros((n, k)), np.zeros((n, k)), np.full(n, -1), np.zeros(n, bool)
    for t in range(periods):
        at = np.flatnonzero(y[:, t] > 0)
        if len(at):
            old = seen[at][:, None]
            a = np.broadcast_to(size_alpha, (n, k))[at]
            size[at] = np.where(old, a * y[at, t][:, None] + (1 - a) * size[at], y[at, t][:, None])
            if gaps is not None:
                b, own = np.broadcast_to(gap_alpha, (n, k))[at], (t - last[at]).astype(float)[:, None]
                gap[at] = np.where(old, b * own + (1 - b) * gap[at], own)
            last[at], seen[at] = t, True
        sizes[:, :, t], known[:, t] = size, seen
        if gaps is not None:
            gaps[:, :, t] = gap
    return sizes, gaps, known


def chance_levels(y: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Smoothed chance of demand after each period, from the first period on: (series, weights, periods)."""
    x = (y != 0).astype(float)
    out = np.empty((len(y), alpha.shape[1], y.shape[1]))
    level = np.broadcast_to(x[:, :1], out.shape[:2]).copy()
    out[:, :, 0] = level
    for t in range(1, y.shape[1]):
        level = alpha * x[:, t][:, None] + (1 - alpha) * level
        out[:, :, t] = level
    return out


def _best_pair(one: np.ndarray, other: np.ndarray, factor: float, y: np.ndarray, known: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """(series, 2): the weights with the least mean of (factor * one * other - y)^2 over known periods, from three sums of products; first of ties."""
    one, other, y = factor * np.where(known[:, None, :], one, 0), np.where(known[:, None, :], other, 0), np.where(known, y, 0)
    turned = other.transpose(0, 2, 1)
    error = (one * one) @ (turned * turned) - 2 * (one * y[:, None, :]) @ turned + (y * y).sum(1)[:, None, None]
    error = np.round(error / np.maximum(known.sum(1), 1)[:, None, None], 6)  # ties aren't decided by rounding errors
    best = error.reshape(len(y), -1).argmin(1)
    best[~known.any(1)] = 0
    return np.stack((grid[best // len(grid)], grid[best % len(grid)]), axis=1)


def _slices(n: int, periods: int, weights: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, periods * weights))
    return (slice(at, at + step) for at in range(0, n, step))


def tune_croston(y: np.ndarray) -> np.ndarray:
    """(series, 2): weights of size and gap. Fitted values are those known before a period."""
    out = []
    for part in _slices(*y.shape, len(CROSTON_GRID)):
        sizes, gaps, known = demand_levels(y[part], CROSTON_GRID[None, :], CROSTON_GRID[None, :])
        before = known[:, :-1]
        out.append(_best_pair(sizes[:, :, :-1], 1 / np.where(gaps[:, :, :-1] > 0, gaps[:, :, :-1], 1), 0.95, y[part][:, 1:], before, CROSTON_GRID))
    return np.concatenate(out) if out else np.zeros((0, 2))


def tune_tsb(y: np.ndarray) -> np.ndarray:
    """(series, 2): weights of size and chance."""
    out = []
    for part in _slices(*y.shape, len(TSB_GRID)):
        sizes, _, known = demand_levels(y[part], TSB_GRID[None, :], None)
        chances = chance_levels(y[part], TSB_GRID[None, :])
        out.append(_best_pair(sizes[:, :, :-1], chances[:, :, :-1], 1.0, y[part][:, 1:], known[:, :-1], TSB_GRID))
    return np.concatenate(out) if out else np.zeros((0, 2))


def croston(y: np.ndarray, params: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(series, cutoffs): 0.95 * smoothed size / smoothed gap; without demand so far 0.95 * the last value. Smoothing to a cutoff is a prefix of smoothing to the end."""
    sizes, gaps, known = demand_levels(y, params[:, :1], params[:, 1:])
    at = cuts - 1
    s, g = sizes[:, 0, at], gaps[:, 0, at]
    return 0.95 * np.where(known[:, at], s / np.where(g > 0, g, 1), y[:, at])


def tsb(y: np.ndarray, params: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(series, cutoffs) each: smoothed chance, smoothed size, sigma of the residuals; the forecast is chance * size, zero without demand so far."""
    sizes, _, known = demand_levels(y, params[:, :1], None)
    chance, size = chance_levels(y, params[:, 1:])[:, 0], sizes[:, 0]
    squares = np.zeros(y.shape)
    squares[:, 1:] = np.where(known[:, :-1], (chance[:, :-1] * size[:, :-1] - y[:, 1:]) ** 2, 0)
    at = cuts - 1
    some = known[:, at]
    return np.where(some, chance[:, at], 0.0), np.where(some, size[:, at], 0.0), np.where(some, np.sqrt(np.cumsum(squares, axis=1)[:, at] / cuts), 0.0)


def tsb_quantile(q: float, chance: float, size: float, sigma: float) -> float:
    """Quantile of: with the chance, max(0, size + N(0, sigma)), else 0 (closed form)."""
    if chance <= 0:
        return 0.0
    if sigma <= 0:
        return 0.0 if q <= 1 - chance else max(0.0, size)
    if q <= 1 - chance + chance * Z.cdf(-size / sigma):
        return 0.0
    return max(0.0, size + sigma * Z.inv_cdf(min(max((q - 1 + chance) / chance, 1e-12), 1 - 1e-12)))


# ---------------------------------------------------------------- other families
def _seasonal_index(y: np.ndarray, season: int) -> np.ndarray:
    """Additive seasonal means around a centred moving average; zeros with under two seasons."""
    if season < 2 or len(y) < 2 * season:
        return np.zeros(max(season, 1))
    kernel = np.ones(season) / season if season % 2 else np.concatenate(([0.5], np.ones(season - 1), [0.5])) / season
    trend = np.convolve(y, kernel, "valid")
    lead = (len(y) - len(trend)) // 2
    rest, phase = y[lead : lead + len(trend)] - trend, (np.arange(len(trend)) + lead) % season
    index = np.array([rest[phase == k].mean() if (phase == k).any() else 0.0 for k in range(season)])
    return index - index.mean()


class Theta:
    """Seasonally adjusted; half the drift of the trend line added to simple smoothing (theta = 2)."""

    def fit(self, y: np.ndarray, season: int):
        x = y - np.resize(_seasonal_index(y, season), len(y))
        grid = np.arange(0.05, 1.0, 0.05)
        e = np.nanmean((smooth(x, grid)[0] - x)[:, 1:] ** 2, 1) if len(x) > 1 else np.zeros(len(grid))
        return season, float(grid[int(e.argmin())])

    def forecast(self, y: np.ndarray, params, h: int) -> tuple[np.ndarray, np.ndarray]:
        season, alpha = params
        index = _seasonal_index(y, season)
        x, n = y - np.resize(index, len(y)), len(y)
        t = np.arange(n)
        slope = float(((t - t.mean()) * (x - x.mean())).sum() / max(((t - t.mean()) ** 2).sum(), 1e-12)) if n > 1 else 0.0
        fitted, level = smooth(x, alpha)
        sigma = float(np.sqrt(np.nanmean((x - fitted[0])[1:] ** 2))) if n > 1 else 0.0
        drift = slope / 2 * (np.arange(h) + (1 - (1 - alpha) ** n) / alpha)
        return level[0] + drift + index[(n + np.arange(h)) % len(index)], sigma * np.sqrt(1 + np.arange(h) * alpha**2)


class ETS:
    """Additive family: level, with or without damped trend and seasonality, chosen by AICc on a small grid."""

    def _run(self, y: np.ndarray, season: int, a, b, g, phi, trend: bool, seasonal: bool, h: int):
        a, b, g, phi = np.broadcast_arrays(*map(np.atleast_1d, (a, b, g, phi)))
        index = _seasonal_index(y, season) if seasonal else np.zeros(1)
        m, k = len(index), len(a)
        s = np.repeat(index[:, None], k, 1).astype(float)
        start = y[: max(2, min(len(y), 2 * m))] - np.resize(index, max(2, min(len(y), 2 * m)))[: len(y[: max(2, min(len(y), 2 * m))])]
        level = np.full(k, start.mean())
        slope = np.full(k, (start[-1] - start[0]) / max(len(start) - 1, 1) if trend else 0.0)
        total = np.zeros(k)
        for t, x in enumerate(y):
            p = t % m
            ahead = level + (phi * slope if trend else 0)
            e = x - ahead - s[p]
            total += e * e
            level = ahead + a * e
            if trend:
                slope = phi * slope + b * e
            if seasonal:
                s[p] += g * e
        out = np.empty((k, h))
        damp = np.zeros(k)
        for i in range(h):
            damp = damp + phi ** (i + 1)
            out[:, i] = level + (damp * slope if trend else 0) + s[(len(y) + i) % m]
        return total, out

    def fit(self, y: np.ndarray, season: int):
        best = (np.inf, None)
        alphas, small = np.array([0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9]), np.array([0.01, 0.05, 0.15])
        for trend in (False, True):
            for seasonal in (False, True) if season > 1 and len(y) >= 2 * season else (False,):
                mesh = np.array(np.meshgrid(alphas, small if trend else [0.0], small if seasonal else [0.0], [0.9, 0.98] if trend else [1.0])).reshape(4, -1)
                total, _ = self._run(y, season, *mesh, trend, seasonal, 1)
                k = 2 + 2 * trend + (season if seasonal else 0)
                score = len(y) * np.log(np.maximum(total, 1e-12) / len(y)) + 2 * k + 2 * k * (k + 1) / max(len(y) - k - 1, 1)
                i = int(score.argmin())
                if score[i] < best[0]:
                    best = (float(score[i]), (season, *mesh[:, i].tolist(), trend, seasonal))
        return best[1]

    def forecast(self, y, params, h):
        season, a, b, g, phi, trend, seasonal = params
        total, out = self._run(y, season, a, b, g, phi, trend, seasonal, h)
        return out[0], np.sqrt(total[0] / len(y)) * np.sqrt(1 + np.arange(h) * a * a)


class ARIMA:
    """AR(p) on d differences, after one seasonal difference or none; least squares, chosen by AICc."""

    @staticmethod
    def _difference(y, d, season):
        x = y[season:] - y[:-season] if season else y
        return np.diff(x, d) if d else x

    def _solve(self, x, p):
        rows = np.column_stack([np.ones(len(x) - p), *(x[p - k - 1 : len(x) - k - 1] for k in range(p))])
        beta, *_ = np.linalg.lstsq(rows, x[p:], rcond=None)
        return beta, x[p:] - rows @ beta

    def fit(self, y, season):
        best = (np.inf, (0, 0, 0))
        for s in (0, season) if season > 1 and len(y) > 2 * season + 10 else (0,):
            for d in (0, 1):
                x = self._difference(y, d, s)
                for p in range(4):
                    if len(x) < 2 * p + 5:
                        continue
                    _, e = self._solve(x, p)
                    n, k = len(e), p + 2
                    # comparable per observation although differences shorten the series
                    score = np.log(max(float(e @ e) / n, 1e-12)) + (2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)) / n
                    if score < best[0] - 1e-9:
                        best = (score, (p, d, s))
        return best[1]

    def forecast(self, y, params, h):
        p, d, s = params
        x = self._difference(y, d, s)
        if len(x) <= p + 1:
            return np.full(h, y[-1]), np.zeros(h)
        beta, e = self._solve(x, p)
        path = list(x)
        for _ in range(h):
            path.append(beta[0] + sum(beta[k + 1] * path[-k - 1] for k in range(p)))
        ahead = np.array(path[len(x) :])
        if d:
            base = y[-1] - (y[-1 - s] if s else 0)
            ahead = base + np.cumsum(ahead)
        if s:
            longer = list(y)
            for i in range(h):
                longer.append(ahead[i] + longer[len(y) + i - s])
            ahead = np.array(longer[len(y) :])
        sigma = float(np.sqrt(e @ e / max(len(e) - p - 1, 1)))
        return ahead, sigma * np.sqrt(1 + np.arange(h) * (1.0 if d else min(1.0, float(np.sum(beta[1:] ** 2)))))


class CES:
    """Complex exponential smoothing without seasonality, on seasonally adjusted values; the two parts of the weight from a grid."""

    def _run(self, x, a, b, h):
        total = np.zeros(a.shape)
        l, c = np.full(a.shape, x[: max(1, len(x) // 4)].mean()), np.zeros(a.shape)
        for v in x:
            e = v - l
            total += e * e
            l, c = l - (1 - b) * c + (a - b) * e, (1 - a) * c + (a + b) * e
            c = np.clip(c, -1e9, 1e9)
            l = np.clip(l, -1e12, 1e12)
        out = np.empty((len(a), h))
        for i in range(h):
            out[:, i] = l
            l, c = l - (1 - b) * c, (1 - a) * c
        return total, out

    def fit(self, y, season):
        x = y - np.resize(_seasonal_index(y, season), len(y))
        a, b = (m.ravel() for m in np.meshgrid(np.arange(0.1, 1.91, 0.1), np.arange(0.8, 1.21, 0.1)))
        total, out = self._run(x, a, b, 1)
        total = np.where(np.isfinite(total) & (np.abs(out[:, 0]) < 1e6 * (1 + np.abs(x).max())), total, np.inf)
        i = int(total.argmin())
        return season, float(a[i]), float(b[i])

    def forecast(self, y, params, h):
        season, a, b = params
        index = _seasonal_index(y, season)
        total, out = self._run(y - np.resize(index, len(y)), np.array([a]), np.array([b]), h)
        return out[0] + index[(len(y) + np.arange(h)) % len(index)], np.sqrt(total[0] / len(y)) * np.sqrt(1 + np.arange(h) * 0.1)


FAMILIES = {"THETA": Theta, "ETS": ETS, "ARIMA": ARIMA, "CES": CES}
RECURSIVE = ("CROSTON", "TSB", *FAMILIES)


# ---------------------------------------------------------------- execution
def forecast_matrix(y: np.ndarray, cuts: np.ndarray, horizon: int, season: int, model: str, quantiles: tuple[float, ...] = (), fixed: tuple[float, float] | None = None) -> dict[float | None, np.ndarray]:
    """Values (series, cutoffs, steps) of a model by quantile, the point under None; ``y`` is (series, periods), cutoffs count periods."""
    shape = (len(y), len(cuts), horizon)
    every = lambda x: np.broadcast_to(np.asarray(x)[:, :, None], shape)
    if model in ("CROSTON", "TSB"):
        given = None if fixed is None else np.broadcast_to(np.array(fixed, float), (len(y), 2))
        if model == "CROSTON":
            return {None: every(croston(y, tune_croston(y[:, : cuts[0]]) if given is None else given, cuts))}
        parts = tsb(y, tune_tsb(y[:, : cuts[0]]) if given is None else given, cuts)
        found = {None: every(parts[0] * parts[1])}
        return found | {q: every(np.array([tsb_quantile(q, *x) for x in zip(*(p.ravel().tolist() for p in parts), strict=True)]).reshape(shape[:2])) for q in quantiles}
    if model not in FAMILIES:
        raise ValueError(f"unknown model {model!r}")
    family, mean, sigma = FAMILIES[model](), np.empty(shape), np.empty(shape)
    for k, row in enumerate(y):
        params = family.fit(row[: cuts[0]], season)
        for c, cut in enumerate(cuts.tolist()):
            mean[k, c], sigma[k, c] = family.forecast(row[:cut], params, horizon)
    return {None: mean} | {q: mean + Z.inv_cdf(q) * sigma for q in quantiles}


def _whole_series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole series, from rows in order of series and period."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            heads = np.flatnonzero(table["t"].to_numpy() == 1)
            if len(heads) > 1:  # the last one may go on
                yield table.slice(0, heads[-1])
                held = table.slice(heads[-1]).to_batches()
                rows = sum(b.num_rows for b in held)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def recursive(panel: DataFrame, spec: PanelSpec, windows: Windows, season: int, model: str, quantiles: tuple[float, ...] = (), fixed: tuple[float, float] | None = None) -> DataFrame:
    """Long forecasts of a completed panel by one of RECURSIVE; ``fixed`` weights skip the tuning of CROSTON and TSB.

    The panel is dealt by series; a task holds the matrix of some series, not one group at a time. CROSTON has points only.
    """
    if model not in RECURSIVE:
        raise ValueError(f"unknown model {model!r}")
    h, step = windows.horizon, windows.step
    rows = panel.select(F.col(spec.id).alias("id"), F.col(spec.time).alias("ds"), "t", F.col(spec.target).cast("double").alias("y"), windows.first(F.col("periods")).alias("first"), windows.last(F.col("periods")).alias("last"))
    layout = f"id {dict(rows.dtypes)['id']}, ds date, ct int, step int, y double, q double, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_series(batches):
            t = table["t"].to_numpy()
            n = int((t == 1).sum())
            periods = len(t) // max(n, 1)
            if not n or not np.array_equal(t, np.tile(np.arange(1, periods + 1), n)):
                raise ValueError("the panel isn't complete")
            first, last = (table[c][0].as_py() for c in ("first", "last"))
            cuts = np.array([c for c in range(first, last + 1, step) if c >= 1], np.int64)
            if not len(cuts):
                continue
            y = table["y"].to_numpy().reshape(n, periods)
            found = forecast_matrix(y, cuts, h, season, model, quantiles, fixed)
            inner = (cuts[:, None] + np.arange(h)).ravel()  # position of each forecast row
            at = (np.arange(n)[:, None] * periods + inner).ravel()
            ids, ds, truth = table["id"].combine_chunks().take(pa.array(at)), table["ds"].combine_chunks().take(pa.array(at)), y.ravel()[at]
            ct, steps = np.tile(np.repeat(cuts, h), n).astype(np.int32), np.tile(np.arange(1, h + 1), n * len(cuts)).astype(np.int32)
            for q, values in found.items():
                quantile = pa.array(np.full(len(at), np.nan if q is None else q))
                yield pa.RecordBatch.from_arrays([ids, ds, pa.array(ct), pa.array(steps), pa.array(truth), quantile, pa.array(np.ascontiguousarray(values).ravel())], ["id", "ds", "ct", "step", "y", "q", "value"])

    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartition(parts, "id").sortWithinPartitions("id", "t").mapInArrow(run, layout)
    return out.select("id", "ds", "ct", "step", "y", F.lit(model).alias("model"), F.when(~F.isnan("q"), F.col("q")).alias("q"), "value")
