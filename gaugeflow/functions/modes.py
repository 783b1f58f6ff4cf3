"""Empirical mode decomposition of many series at once, in numpy.

All rows of a matrix are sifted together: extrema come from one comparison, the spline systems of all
rows (padded to the longest) are eliminated side by side. So a task decomposes the noisy copies of
several windows in one go instead of one spline at a time.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

# Fixed values of the method.
FLAT = 1e-8  # a series with a smaller standard deviation is constant
ENTROPY_MOST = 3.0  # sample entropy without matches
NORMAL, CONSTANT, NO_MODES, FEW, CAPPED = 0, 1, 2, 3, 5


def peaks(y: np.ndarray) -> np.ndarray:
    """Which values are above both neighbours; the ends never are."""
    found = np.zeros(y.shape, bool)
    found[:, 1:-1] = (y[:, 1:-1] > y[:, :-2]) & (y[:, 1:-1] > y[:, 2:])
    return found


def _knots(y: np.ndarray, top: np.ndarray, edge: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded knots ``x, v`` of each row's upper envelope, their number and how many lie left of 0.

    ``anchor`` adds the two ends; ``mirror`` instead reflects the two outermost peaks at either end, where there are two.
    """
    n_rows, length = y.shape
    flip = top.sum(1) >= 2 if edge == "mirror" else np.zeros(n_rows, bool)
    used = top.copy()
    used[~flip, 0] = used[~flip, -1] = True
    row, col = np.nonzero(used)
    inner = used.sum(1)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(inner) - inner, inner)
    left = np.where(flip, 2, 0)
    count = inner + 2 * left
    x = np.broadcast_to(3.0 * length + np.arange(count.max()), (n_rows, count.max())).copy()  # padding keeps steps positive
    v = np.zeros(x.shape)
    x[row, rank + left[row]], v[row, rank + left[row]] = col, y[row, col]
    r = np.flatnonzero(flip)
    for k in (0, 1) if len(r) else ():
        x[r, 1 - k], v[r, 1 - k] = -x[r, 2 + k], v[r, 2 + k]
        last = count[r] - 3 - k
        x[r, last + 1 + 2 * k], v[r, last + 1 + 2 * k] = 2 * (length - 1) - x[r, last], v[r, last]
    return x, v, count, left


def _curvatures(x: np.ndarray, v: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the cubic spline whose third derivative is continuous at the second and
    the last but one knot; three knots give a parabola. Every row has at least three."""
    most = x.shape[1]
    m = np.zeros(x.shape)
    h = np.diff(x, axis=1)
    slope = np.diff(v, axis=1) / h
    at = np.arange(1, most - 1)
    inside = at[None, :] < count[:, None] - 1
    low, up = np.where(inside, h[:, :-1], 0.0), np.where(inside, h[:, 1:], 0.0)
    mid, rhs = np.where(inside, 2 * (low + up), 1.0), np.where(inside, 6 * np.diff(slope, axis=1), 0.0)
    big = np.flatnonzero(count >= 4)
    a, b = h[big, 0], h[big, 1]
    mid[big, 0] += a * (a + b) / b
    up[big, 0] -= a * a / b
    e = count[big] - 3  # the last inner knot's place among the equations
    a, b = h[big, e + 1], h[big, e]
    mid[big, e] += a * (a + b) / b
    low[big, e] -= a * a / b
    up[big, e] = 0.0
    low[:, :1] = 0.0
    small = np.flatnonzero(count == 3)
    mid[small, 0] += low[small, 0] + h[small, 0] + up[small, 0]
    up[small, 0] = 0.0
    for k in range(1, most - 2):  # elimination
        f = low[:, k] / mid[:, k - 1]
        mid[:, k] -= f * up[:, k - 1]
        rhs[:, k] -= f * rhs[:, k - 1]
    for k in range(most - 3, -1, -1):
        m[:, k + 1] = (rhs[:, k] - up[:, k] * m[:, k + 2]) / mid[:, k]
    m[big, 0] = ((h[big, 0] + h[big, 1]) * m[big, 1] - h[big, 0] * m[big, 2]) / h[big, 1]
    z = count[big] - 1
    m[big, z] = ((h[big, z - 1] + h[big, z - 2]) * m[big, z - 1] - h[big, z - 1] * m[big, z - 2]) / h[big, z - 2]
    m[small, 0] = m[small, 2] = m[small, 1]
    return m


def envelopes(y: np.ndarray, top: np.ndarray, edge: str = "anchor") -> np.ndarray:
    """The cubic spline through each row's peaks, at every place."""
    x, v, count, left = _knots(y, top, edge)
    m = _curvatures(x, v, count)
    place = np.arange(y.shape[1], dtype=float)
    inner = top.copy()
    inner[left == 0, 0] = True
    segment = np.minimum(np.cumsum(inner, axis=1) - 1 + left[:, None], count[:, None] - 2)

    def pick(z: np.ndarray, step: int) -> np.ndarray:
        return np.take_along_axis(z, segment + step, axis=1)

    h = pick(x, 1) - pick(x, 0)
    a = (pick(x, 1) - place) / h
    b = 1 - a
    return a * pick(v, 0) + b * pick(v, 1) + ((a**3 - a) * pick(m, 0) + (b**3 - b) * pick(m, 1)) * h * h / 6


def first_modes(series: np.ndarray, sifts: int = 8, edge: str = "anchor") -> np.ndarray:
    """The fastest mode of every row: ``sifts`` times less the mean of the two envelopes, while a row has both."""
    out = np.array(series, float)
    open_ = np.arange(len(out))
    for _ in range(sifts):
        y = out[open_]
        high, low = peaks(y), peaks(-y)
        both = high.any(1) & low.any(1)
        open_, y, high, low = open_[both], y[both], high[both], low[both]
        if not len(open_):
            break
        bounds = envelopes(np.vstack([y, -y]), np.vstack([high, low]), edge)
        out[open_] = y - (bounds[: len(y)] - bounds[len(y) :]) / 2
    return out


def _still_wavy(rest: np.ndarray) -> np.ndarray:
    return peaks(rest).sum(1) + peaks(-rest).sum(1) >= 3


def modes(series: np.ndarray, most: int = 9, sifts: int = 8, edge: str = "anchor") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``found`` (row, mode, place), each row's number of modes, and what is left; modes and rest sum to the row."""
    rest = np.array(series, float)
    found, count = np.zeros((len(rest), most, rest.shape[1])), np.zeros(len(rest), int)
    open_ = np.arange(len(rest))
    for k in range(most):
        if not len(open_):
            break
        found[open_, k] = first_modes(rest[open_], sifts, edge)
        rest[open_] -= found[open_, k]
        count[open_] += 1
        open_ = open_[_still_wavy(rest[open_])]
    return found, count, rest


@functools.lru_cache(maxsize=2)
def noise_bank(trials: int, length: int, most: int, seed: int, edge: str) -> tuple[np.ndarray, np.ndarray]:
    """White noise and its modes, scaled to deviation 1; a mode that a trial lacks is NaN. The same in every task."""
    noise = np.random.default_rng(seed).standard_normal((trials, length))
    found, count, _ = modes(noise, most + 2, edge=edge)
    deviation = found.std(2, keepdims=True)
    lacks = (np.arange(most + 2)[None, :] >= count[:, None])[:, :, None] | (deviation < FLAT)
    return noise, np.where(lacks, np.nan, found / np.where(lacks, 1.0, deviation))


def noise_assisted_modes(series: np.ndarray, trials: int = 100, noise: float = 0.2, most: int = 9, sifts: int = 8, seed: int = 1234, edge: str = "anchor") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Complete ensemble decomposition with adaptive noise (Torres et al., 2011); returns as ``modes`` does.

    A mode is the mean, over the trials, of the fastest modes of what is left plus scaled noise: raw noise
    for the first, the noise's own mode before for later ones. Constant rows have no modes.
    """
    rest = np.array(series, float)
    found, count = np.zeros((len(rest), most, rest.shape[1])), np.zeros(len(rest), int)
    raw, bank = noise_bank(trials, rest.shape[1], most, seed, edge)
    whole = rest.std(1)
    open_ = np.flatnonzero(whole >= FLAT)
    for k in range(most):
        if not len(open_):
            break
        added = raw if k == 0 else bank[~np.isnan(bank[:, k - 1, 0]), k - 1]
        if not len(added):
            break
        spread = rest[open_].std(1)
        scale = noise * np.where(spread == 0, whole[open_], spread)
        noisy = rest[open_, None, :] + scale[:, None, None] * added[None]
        fast = first_modes(noisy.reshape(-1, rest.shape[1]), sifts, edge)
        found[open_, k] = fast.reshape(noisy.shape).mean(1)
        rest[open_] -= found[open_, k]
        count[open_] += 1
        open_ = open_[_still_wavy(rest[open_])]
    return found, count, rest


def sample_entropy(x: np.ndarray, m: int = 2, tolerance: float = 0.2) -> float:
    """-ln(A / B): B counts ordered pairs of the n - m + 1 runs of m values that differ by at most ``tolerance``
    deviations everywhere, A those of m + 1. Without pairs, and at most, 3; constant or short series give 0."""
    spread = x.std()
    if spread < FLAT or len(x) <= m + 1:
        return 0.0
    close = np.abs(x[:, None] - x[None, :]) <= tolerance * spread
    runs = close
    for k in range(1, m):
        runs = runs[:-1, :-1] & close[k:, k:]
    longer = runs[:-1, :-1] & close[m:, m:]
    b, a = int(runs.sum()) - len(runs), int(longer.sum()) - len(longer)
    return float(min(np.log(b / a), ENTROPY_MOST)) if a and b else ENTROPY_MOST


def bands(values: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k consecutive ranges [first, end) with the least sum of squared deviations; at most ten values, so all are tried."""
    n = len(values)
    cuts = [(0, *c, n) for c in combinations(range(1, n), k - 1)]
    cost = lambda c: round(sum(float(np.var(values[a:b]) * (b - a)) for a, b in zip(c, c[1:], strict=False)), 12)
    best = min(cuts, key=lambda c: (cost(c), c[::-1]))
    return list(zip(best, best[1:], strict=False))


def grouped_modes(x: np.ndarray, found: np.ndarray, rest: np.ndarray, k: int = 3, m: int = 2, tolerance: float = 0.2) -> tuple[np.ndarray, np.ndarray, int]:
    """k groups of neighbouring modes by entropy, fastest first, their entropies, and the code of an unusual window.

    What is left counts as the slowest mode; fewer modes than k are filled up with zeros in front.
    """
    if x.std() < FLAT:
        return np.vstack([np.zeros((k - 1, len(x))), x[None]]), np.zeros(k), CONSTANT
    parts = np.vstack([found, rest[None]])
    entropies = np.array([sample_entropy(p, m, tolerance) for p in parts])
    if len(parts) < k:
        groups, code = np.vstack([np.zeros((k - len(parts), len(x))), parts]), FEW
    else:
        groups = np.array([parts[a:b].sum(0) for a, b in bands(entropies, k)])
        code = CAPPED if (entropies >= ENTROPY_MOST).any() else NORMAL if len(found) else NO_MODES
    return groups, np.array([sample_entropy(g, m, tolerance) for g in groups]), code
