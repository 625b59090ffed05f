"""Series as arrays: differencing, long autoregression and refined moving-average models, many series at a time.

A series has a row per period, so its array is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from incidentkit.operators import least_squares as ls

#: Steps of the refinement at most, and halvings of a step.
STEPS, HALVINGS = 40, 12


def differenced(y: np.ndarray, polynomial: np.ndarray) -> np.ndarray:
    """Values after differencing; as many fewer as the polynomial has lags."""
    m = len(polynomial) - 1
    if len(y) <= m:
        return np.empty(0)
    return sum(c * y[m - lag : len(y) - lag] for lag, c in enumerate(polynomial) if c)


def lagged(w: np.ndarray, lags: Sequence[int], start: int) -> np.ndarray:
    """Rows t = start .. of the lagged values; start is at least the largest lag."""
    rows = max(0, len(w) - start)
    return np.stack([w[start - k : start - k + rows] for k in lags], axis=1) if lags else np.empty((rows, 0))


def long_residuals(w: np.ndarray, lags: int) -> np.ndarray:
    """What an autoregression of ``lags`` lags leaves of w; the first ``lags`` places are not a number."""
    out = np.full(len(w), np.nan)
    if len(w) <= lags:
        return out
    x = lagged(w, range(1, lags + 1), lags)
    good = np.isfinite(x).all(axis=1) & np.isfinite(w[lags:])
    design = np.column_stack([w[lags:], x])[good]
    if not len(design):
        return out
    beta, _, _ = ls.solve((design.T @ design)[None], 0, range(1, lags + 1), minimum_norm=True)
    out[lags:] = w[lags:] - x @ beta[0]
    return out


def gram(w: np.ndarray, ar: Sequence[int], ma: Sequence[int], long: int) -> np.ndarray:
    """Products of [w, one, lags of w, lags of the innovations], summed over the rows that have them all."""
    e = long_residuals(w, long) if ma else w
    start = max([0, *ar, *ma])
    rows = max(0, len(w) - start)
    design = np.column_stack([w[start : start + rows], np.ones(rows), lagged(w, ar, start), lagged(e, ma, start)])
    design = design[np.isfinite(design).all(axis=1)]
    return design.T @ design


def _recursion(w: np.ndarray, size: np.ndarray, ar: Sequence[int], ma: Sequence[int], constant: bool, beta: np.ndarray, slopes: bool):
    """Innovations of rows of values (left-aligned, ``size`` long) and, if asked, their derivatives by the coefficients."""
    n, T = w.shape
    start = max([0, *ar])
    k = beta.shape[1]
    c0 = 1 if constant else 0
    phi, theta = beta[:, c0 : c0 + len(ar)], beta[:, c0 + len(ar) :]
    e = np.zeros((n, T))
    de = np.zeros((n, T, k)) if slopes else None
    with np.errstate(over="ignore", invalid="ignore"):
        for t in range(start, T):
            live = t < size
            value = w[:, t] - (beta[:, 0] if constant else 0.0)
            for i, lag in enumerate(ar):
                value = value - phi[:, i] * w[:, t - lag]
            for j, lag in enumerate(ma):
                if t >= lag:
                    value = value - theta[:, j] * e[:, t - lag]
            e[:, t] = np.where(live, value, 0.0)
            if not slopes:
                continue
            d = np.zeros((n, k))
            if constant:
                d[:, 0] = -1.0
            for i, lag in enumerate(ar):
                d[:, c0 + i] = -w[:, t - lag]
            for j, lag in enumerate(ma):
                if t >= lag:
                    d[:, c0 + len(ar) + j] = -e[:, t - lag]
                    d -= theta[:, j : j + 1] * de[:, t - lag]
            de[:, t] = np.where(live[:, None], d, 0.0)
    return e, de


def _invertible(theta: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    """Moves the roots of moving-average parts whose innovations would grow inside the unit circle."""
    out = theta.copy()
    for i in range(len(out) if lags else 0):
        poly = np.zeros(max(lags) + 1)
        poly[0] = 1.0
        poly[list(lags)] = out[i]
        if not np.isfinite(poly).all() or np.abs(poly).max() > 1e12:
            out[i] = 0.0
            continue
        size = np.abs(np.roots(poly)).max(initial=0.0)
        if size >= 0.999:
            out[i] *= (0.95 / size) ** np.array(lags)
    return out


def refined(w: np.ndarray, size: np.ndarray, ar: Sequence[int], ma: Sequence[int], constant: bool, beta: np.ndarray):
    """(coefficients, sum of squares, innovations) by Gauss-Newton on the innovations, stacked over series.

    Starts from ``beta`` and only takes steps that lessen a series' own sum of
    squares, so no series ends worse than it started. Rows without finite
    coefficients stay as they are.
    """
    beta = beta.copy()
    c0 = (1 if constant else 0) + len(ar)
    good = np.isfinite(beta).all(axis=1)
    beta[good, c0:] = _invertible(beta[good, c0:], ma)
    where = np.flatnonzero(good)
    w, size, b = np.nan_to_num(w[where]), size[where], beta[where]
    cost = lambda e: np.where((np.abs(e) < 1e100).all(axis=1), (np.where(np.abs(e) < 1e100, e, 0.0) ** 2).sum(axis=1), np.inf)
    e, de = _recursion(w, size, ar, ma, constant, b, True)
    best = cost(e)
    open_rows = np.isfinite(best)
    for _ in range(STEPS):
        at = np.flatnonzero(open_rows)
        if not len(at):
            break
        e, de = _recursion(w[at], size[at], ar, ma, constant, b[at], True)
        a = np.einsum("ntk,ntl->nkl", de, de)
        g = np.einsum("ntk,nt->nk", de, e)
        scale = np.sqrt(np.maximum(np.einsum("nkk->nk", a), 1e-300))
        unit = a / scale[:, :, None] / scale[:, None, :] + 1e-9 * np.eye(a.shape[1])
        fine = np.isfinite(unit).all(axis=(1, 2)) & np.isfinite(g).all(axis=1)
        step = np.zeros_like(g)
        if fine.any():
            step[fine] = -np.linalg.solve(unit[fine], (g / scale)[fine][:, :, None])[:, :, 0] / scale[fine]
        taken = np.zeros(len(at), bool)
        factor = 1.0
        for _ in range(HALVINGS):
            rest = np.flatnonzero(~taken & fine)
            if not len(rest):
                break
            trial = b[at[rest]] + factor * step[rest]
            trial[:, c0:] = np.where((_invertible(trial[:, c0:], ma) == trial[:, c0:]).all(axis=1, keepdims=True), trial[:, c0:], np.nan)
            safe = np.isfinite(trial).all(axis=1)
            value = np.full(len(rest), np.inf)
            if safe.any():
                value[safe] = cost(_recursion(w[at[rest[safe]]], size[at[rest[safe]]], ar, ma, constant, trial[safe], False)[0])
            better = value < best[at[rest]] * (1 - 1e-12)
            b[at[rest[better]]] = trial[better]
            gain = np.zeros(len(rest))
            gain[better] = 1 - value[better] / best[at[rest[better]]]
            best[at[rest[better]]] = value[better]
            taken[rest[better]] = True
            # Hardly any gain ends a series.
            open_rows[at[rest[better & (gain < 1e-10)]]] = False
            factor /= 2
        open_rows[at[~taken]] = False
    e, _ = _recursion(w, size, ar, ma, constant, b, False)
    beta[where] = b
    sums = np.full(len(beta), np.nan)
    sums[where] = cost(e)
    shocks = np.zeros((len(beta), w.shape[1] if len(where) else 0))
    if len(where):
        shocks[where] = e
    return beta, sums, shocks
