"""Global alignment kernel of a few arrays, of any lengths: a small helper of the searches that keep their population on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def sigma(arrays: Sequence[np.ndarray], draws: int = 1_000, seed: int = 1337) -> float:
    """A width for the kernel: median distance of drawn values times the root of the median length (1 if all values are equal)."""
    values = np.concatenate(list(arrays))
    rng = np.random.default_rng(seed)
    gaps = np.abs(rng.choice(values, draws) - rng.choice(values, draws))
    return float(np.median(gaps) * np.sqrt(np.median([len(x) for x in arrays]))) or 1.0


def log_kernel(x: np.ndarray, y: np.ndarray, width: float) -> float:
    """Logarithm of the sum, over all alignments, of products of local kernels e / (2 - e), e = exp(-(a - b)^2 / (2 width^2))."""
    local = -((x[:, None] - y[None, :]) ** 2) / (2 * width * width)
    local = local - np.log(2 - np.exp(local))
    before = np.full(len(y) + 1, -np.inf)
    before[0] = 0
    for row in local:
        now = np.full(len(y) + 1, -np.inf)
        for j, e in enumerate(row):
            now[j + 1] = e + np.logaddexp(np.logaddexp(before[j], before[j + 1]), now[j])
        before = now
    return float(before[-1])


def similarities(xs: Sequence[np.ndarray], ys: Sequence[np.ndarray], width: float) -> np.ndarray:
    """Kernel of each of xs with each of ys, scaled so that equal arrays have 1."""
    own_x, own_y = ([log_kernel(v, v, width) for v in vs] for vs in (xs, ys))
    return np.array([[np.exp(log_kernel(x, y, width) - (a + b) / 2) for y, b in zip(ys, own_y, strict=True)] for x, a in zip(xs, own_x, strict=True)])


def barycenter(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Point-wise mean; past the end of the shorter, the longer's values."""
    out = (x if len(x) >= len(y) else y).astype(np.float64)
    n = min(len(x), len(y))
    out[:n] = (x[:n] + y[:n]) / 2
    return out


def blended(one: list[np.ndarray], two: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each array of both sets by its barycenter with the most similar, but not equal, array of the other set; without one it stays."""
    s = similarities(one, two, sigma([*one, *two]))
    s = np.where(s >= 1 - 1e-12, -1, s)
    pick = lambda own, other, scores: [barycenter(x, other[int(r.argmax())]) if r.max() >= 0 else x for x, r in zip(own, scores, strict=True)]
    return pick(one, two, s), pick(two, one, s.T)
