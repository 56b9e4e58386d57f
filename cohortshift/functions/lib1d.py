"""Numerical kernels on one-dimensional samples, in numpy."""

from __future__ import annotations

import numpy as np

from ..config import CONFIG


def digamma(x):
    """psi(x) for positive x: recurrence up to 6, then the asymptotic series."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out = out - np.where(low, 1 / np.where(low, x, 1), 0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Mann-Whitney AUC with ties at one half; 0.5 without both labels."""
    _, place, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[place]
    n1 = int((y == 1).sum())
    n0 = len(y) - n1
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else 0.5


class Tree:
    """A Gini tree on one variable: sorted cuts and the share of label 1 in each piece."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int, weight: np.ndarray | None = None, least: int = 1):
        values, place = np.unique(x, return_inverse=True)
        w = np.ones(len(y)) if weight is None else weight
        n = np.concatenate([[0], np.cumsum(np.bincount(place, w))])
        ones = np.concatenate([[0], np.cumsum(np.bincount(place, w * y))])
        rows = np.concatenate([[0], np.cumsum(np.bincount(place))])
        self.cuts, self.share = [], []

        def grow(a, b, left):
            total, pos = n[b] - n[a], ones[b] - ones[a]
            if left and b - a > 1 and 0 < pos < total:
                k = np.arange(a + 1, b)
                nl, pl = n[k] - n[a], ones[k] - ones[a]
                nr, pr = total - nl, pos - pl
                impurity = 2 * (pl * (nl - pl) / nl + pr * (nr - pr) / nr)
                impurity[(rows[k] - rows[a] < least) | (rows[b] - rows[k] < least)] = np.inf
                best = int(np.argmin(impurity))
                if impurity[best] < 2 * pos * (total - pos) / total - 1e-12:
                    grow(a, k[best], left - 1)
                    self.cuts.append((values[k[best] - 1] + values[k[best]]) / 2)
                    grow(k[best], b, left - 1)
                    return
            self.share.append(pos / total)

        grow(0, len(values), depth)
        self.cuts, self.share = np.array(self.cuts), np.array(self.share)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.share[np.searchsorted(self.cuts, x, side="left")]


def _stack(a, b):
    return np.concatenate([a, b]), np.concatenate([np.zeros(len(a)), np.ones(len(b))])


def c2st_folds(a: np.ndarray, b: np.ndarray, rng, folds: int = CONFIG.c2st_folds, depth: int = CONFIG.c2st_depth) -> list[float]:
    """AUC of a tree that tells the samples apart, in stratified folds."""
    if min(len(a), len(b)) < CONFIG.min_slice:
        return [0.5]
    x, y = _stack(a, b)
    fold = np.empty(len(y), int)
    for label in (0, 1):
        rows = np.flatnonzero(y == label)
        fold[rng.permutation(rows)] = np.arange(len(rows)) % folds
    return [auc(y[fold == k], Tree(x[fold != k], y[fold != k], depth).predict(x[fold == k])) for k in range(folds)]


def c2st_once(a, b, rng, depth: int = CONFIG.c2st_depth) -> float:
    """The same with a single 70/30 split, for nulls."""
    if min(len(a), len(b)) < CONFIG.min_slice:
        return 0.5
    x, y = _stack(a, b)
    # a row trains if its uniform number is among the smallest 70 %
    u = rng.random(len(y))
    train = u < np.partition(u, int(0.7 * len(u)))[int(0.7 * len(u))]
    # a side of a single label tells nothing
    if any(np.ptp(y[side]) == 0 for side in (train, ~train)):
        return 0.5
    return auc(y[~train], Tree(x[train], y[train], depth).predict(x[~train]))


def interval(scores: list[float], t: float) -> tuple[float, float, float]:
    """Mean and confidence bounds of fold scores, within [0, 1]."""
    s = np.array(scores)
    half = t * s.std(ddof=1) / np.sqrt(len(s)) if len(s) > 1 else 0.0
    return float(s.mean()), max(0.0, float(s.mean() - half)), min(1.0, float(s.mean() + half))


def ranks01(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled ordinal ranks in [0, 1]; ties by position, a first."""
    pooled = np.concatenate([a, b])
    r = np.empty(len(pooled))
    r[np.argsort(pooled, kind="stable")] = np.arange(len(pooled)) / max(len(pooled) - 1, 1)
    return r[: len(a)], r[len(a) :]


def _gaps(a, b):
    """|F - G| between neighbouring points of the pooled sample, and their distances."""
    pooled = np.sort(np.concatenate([a, b]))
    f, g = (np.searchsorted(np.sort(s), pooled[:-1], side="right") / len(s) for s in (a, b))
    return f - g, np.diff(pooled)


def wasserstein_qn(a, b, rng=None) -> float:
    if not len(a) or not len(b):
        return 0.0
    gap, step = _gaps(*ranks01(a, b))
    return float((np.abs(gap) * step).sum())


def energy(a, b, rng=None) -> float:
    """2 sum (F - G)^2 dx on pooled ranks: the V-statistic without pairs."""
    if min(len(a), len(b)) < 2:
        return 0.0
    gap, step = _gaps(*ranks01(a, b))
    return float(2 * (gap * gap * step).sum())


def ks(a, b, rng=None) -> float:
    if min(len(a), len(b)) < 2:
        return 0.0
    v = np.unique(np.concatenate([a, b]))
    return float(np.abs(np.searchsorted(np.sort(a), v, side="right") / len(a) - np.searchsorted(np.sort(b), v, side="right") / len(b)).max())


def anderson_darling(a, b, rng=None) -> float:
    """Standardised k-sample statistic with midranks (Scholz and Stephens 1987) for two samples."""
    if min(len(a), len(b)) < 2:
        return 0.0
    pooled = np.sort(np.concatenate([a, b]))
    z, n = np.unique(pooled), len(pooled)
    if len(z) < 2:
        return 0.0
    left, right = np.searchsorted(pooled, z, "left"), np.searchsorted(pooled, z, "right")
    lj = right - left
    bj = left + lj / 2
    total = 0.0
    for s in (np.sort(a), np.sort(b)):
        fij = np.searchsorted(s, z, "right") - np.searchsorted(s, z, "left")
        mij = np.searchsorted(s, z, "right") - fij / 2
        total += (lj / n * (n * mij - bj * len(s)) ** 2 / (bj * (n - bj) - n * lj / 4)).sum() / len(s)
    stat = total * (n - 1) / n
    k, h = 2, (1 / len(a) + 1 / len(b))
    hs = (1 / np.arange(1, n)).sum()
    inner = np.cumsum(1 / np.arange(n - 1, 1, -1))
    g = (inner / np.arange(2, n)).sum()
    c1 = (4 * g - 6) * (k - 1) + (10 - 6 * g) * h
    c2 = (2 * g - 4) * k**2 + 8 * hs * k + (2 * g - 14 * hs - 4) * h - 8 * hs + 4 * g - 6
    c3 = (6 * hs + 2 * g - 2) * k**2 + (4 * hs - 4 * g + 6) * k + (2 * hs - 6) * h + 4 * hs
    c4 = (2 * hs + 6) * k**2 - 4 * hs * k
    var = (c1 * n**3 + c2 * n**2 + c3 * n + c4) / ((n - 1.0) * (n - 2.0) * (n - 3.0))
    return float((stat - (k - 1)) / np.sqrt(var))


def _median_gap(sorted_x: np.ndarray) -> float:
    """The median positive distance within a sorted sample, by bisection on how many pairs lie within a distance."""
    n, at = len(sorted_x), np.arange(len(sorted_x))
    within = lambda d: int((np.searchsorted(sorted_x, sorted_x + d, "right") - at - 1).sum())
    equal, pairs = within(0.0), n * (n - 1) // 2
    if pairs == equal:
        return 1.0
    lo, hi, wanted = 0.0, float(sorted_x[-1] - sorted_x[0]), equal + (pairs - equal + 1) // 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if within(mid) >= wanted else (mid, hi)
    return hi


def mmd(a, b, rng=None, block: int = 512) -> float:
    """Unbiased squared MMD (Gretton et al. 2012, eq. 3), Gaussian kernel of median width; at least 0.

    A quadratic form over the pooled sample: each pair has the weight of its two sides, a point has no pair with
    itself. Kernel rows are made block by block.
    """
    m, n = len(a), len(b)
    if min(m, n) < 2:
        return 0.0
    x, y = _stack(a, b)
    order = np.argsort(x, kind="stable")
    x, side = x[order], y[order].astype(int)
    scaled = x / (_median_gap(x) * np.sqrt(2))
    of_side = np.eye(2)[side]
    weight = np.array([[1 / (m * (m - 1)), -1 / (m * n)], [-1 / (m * n), 1 / (n * (n - 1))]])
    total = 0.0
    for i in range(0, len(x), block):
        rows = slice(i, i + block)
        near = np.exp(-np.square(np.subtract.outer(scaled[rows], scaled))) @ of_side
        near[np.arange(len(near)), side[rows]] -= 1.0
        total += (weight[side[rows]] * near).sum()
    return max(0.0, float(total))


def jensen_shannon(a, b, rng=None, top: int = CONFIG.js_top) -> float:
    """Jensen-Shannon distance of the most frequent values and the rest."""
    if not len(a) or not len(b):
        return 0.0
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    counts = np.stack([np.bincount(place[: len(a)], minlength=len(values)), np.bincount(place[len(a) :], minlength=len(values))]).astype(float)
    order = np.argsort(-counts.sum(0), kind="stable")
    p = np.concatenate([counts[:, order[:top]], counts[:, order[top:]].sum(1, keepdims=True)], 1)
    p /= p.sum(1, keepdims=True)
    m = p.mean(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.sqrt(max(0.0, np.where(p > 0, p * np.log(p / m), 0).sum() / 2)))


METRICS = {"wasserstein_qn": wasserstein_qn, "energy_distance": energy, "ks_statistic": ks, "anderson_darling": anderson_darling, "mmd": mmd, "jensen_shannon": jensen_shannon}
#: Resplits of each metric's null.
RESPLITS = {"wasserstein_qn": 50, "energy_distance": 15, "ks_statistic": 30, "anderson_darling": 30, "mmd": 15, "jensen_shannon": 30, "c2st": 20}


def permutation_null(a, b, metric, resplits: int, rng, percentile: float = CONFIG.null_percentile, least: int = CONFIG.min_null) -> float | None:
    """The percentile of the metric under random re-splits of the pooled sample; None for samples under `least`."""
    sizes = len(a), len(b)
    if min(sizes) < least:
        return None
    # each row of the matrix says which pooled rows one re-split gives to a
    x, y = _stack(a, b)
    to_a = rng.permuted(np.broadcast_to(y == 0, (resplits, len(y))), axis=1)
    return float(np.percentile([metric(x[own], x[~own], rng) for own in to_a], percentile))


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 0) -> float:
    """Nearest-neighbour mutual information of a continuous with a discrete variable (Ross 2014), in nats, at least 0."""
    rng = np.random.default_rng(seed)
    x = x / (x.std() or 1.0)
    x = x + 1e-10 * max(1.0, np.abs(x).mean()) * rng.standard_normal(len(x))
    whole, parts = np.sort(x), []
    for label in np.unique(y):
        s = np.sort(x[y == label])
        if len(s) < 2:
            continue
        kk = min(k, len(s) - 1)
        padded = np.concatenate([np.full(kk, -np.inf), s, np.full(kk, np.inf)])
        # the kk-th neighbour of a sorted point is an end of one of the windows of kk + 1 points that hold it
        r = np.min([np.maximum(s - padded[j : j + len(s)], padded[j + kk : j + kk + len(s)] - s) for j in range(kk + 1)], axis=0)
        # strictly within the neighbour's distance, by more than rounding
        r = np.maximum(0, r - np.maximum(1e-9 * r, 4 * np.spacing(np.abs(s) + r)))
        m = np.searchsorted(whole, s + r, "right") - np.searchsorted(whole, s - r, "left")
        parts.append((len(s), digamma(kk), digamma(len(s)), digamma(np.maximum(m, 1)).mean()))
    n = sum(p[0] for p in parts)
    if not n:
        return 0.0
    mean = lambda i: sum(p[0] * p[i] for p in parts) / n
    return float(max(0.0, digamma(n) + mean(1) - mean(2) - mean(3)))


def _gaps_to_hull(x, f, high, stops):
    """The largest high - minorant of the points (x, f) up to each of the ascending stops; one pass for all."""
    keep, out, at = [], [], 0
    xs, fs = x.tolist(), f.tolist()
    for stop in stops:
        for i in range(at, stop + 1):
            while len(keep) > 1 and (fs[keep[-1]] - fs[keep[-2]]) * (xs[i] - xs[keep[-2]]) >= (fs[i] - fs[keep[-2]]) * (xs[keep[-1]] - xs[keep[-2]]):
                keep.pop()
            keep.append(i)
        at = stop + 1
        out.append((high[:at] - np.interp(x[:at], x[keep], f[keep])).max())
    return np.array(out)


def dip(x: np.ndarray, modes: int = 24) -> float:
    """Distance of the empirical distribution to the nearest unimodal one, over a grid of candidate modes."""
    v, n = np.unique(x, return_counts=True)
    if len(v) < 3:
        return 0.0
    top = np.cumsum(n) / len(x)
    low = top - n / len(x)
    m = np.unique(np.linspace(1, len(v) - 2, modes).astype(int))
    left = _gaps_to_hull(v, low, top, m)
    # the majorant from m on is the minorant of the mirrored points
    right = _gaps_to_hull(-v[::-1], -top[::-1], -low[::-1], len(v) - 1 - m[::-1])[::-1]
    return float(min(1.0, np.maximum(left, right).min()) / 2)


def spread_ties(x: np.ndarray) -> np.ndarray:
    """Equal values dealt evenly between the midpoints to their neighbours, so that steps of a grid are no modes."""
    v, n = np.unique(x, return_counts=True)
    if len(v) < 2 or len(v) == len(x):
        return x
    half = np.diff(v) / 2
    lo, hi = v - np.concatenate([half[:1], half]), v + np.concatenate([half, half[-1:]])
    place = (np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + 0.5) / np.repeat(n, n)
    return np.where(np.repeat(n, n) > 1, np.repeat(lo, n) + place * np.repeat(hi - lo, n), np.repeat(v, n))


def dip_p(x: np.ndarray, rng, draws: int = 40) -> float:
    """The share of uniform samples of the same size with a larger dip."""
    own = dip(spread_ties(x))
    return float(np.mean([dip(rng.random(len(x))) >= own for _ in range(draws)]))


def mixture(x: np.ndarray, k: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means, deviations and log-likelihood of a normal mixture, by EM from quantiles."""
    mu, sd, w = np.quantile(x, (np.arange(k) + 0.5) / k), np.full(k, x.std() / k + 1e-9), np.full(k, 1 / k)
    last, least = -np.inf, 1e-6 * max(x.std(), 1e-12)
    for _ in range(rounds):
        log = np.log(w + 1e-300) - np.log(sd) - 0.5 * ((x[:, None] - mu) / sd) ** 2 - 0.9189385332046727
        top = log.max(1, keepdims=True)
        like = top[:, 0] + np.log(np.exp(log - top).sum(1))
        r = np.exp(log - like[:, None])
        n = r.sum(0) + 1e-12
        w, mu = n / len(x), (r * x[:, None]).sum(0) / n
        sd = np.maximum(np.sqrt((r * (x[:, None] - mu) ** 2).sum(0) / n), least)
        if like.sum() - last < 1e-6 * len(x):
            break
        last = like.sum()
    return w, mu, sd, float(like.sum())


def fit_modes(x: np.ndarray, rng, kmax: int = CONFIG.max_modes, least: float = CONFIG.mode_mass) -> list[tuple[float, float, float]]:
    """(centre, spread, mass) of the modes: one unless the dip test rejects, else the mixture of the lowest BIC."""
    if len(x) < 100 or dip_p(x, rng) > CONFIG.dip_p:
        return [(float(np.median(x)), float(x.std()), 1.0)] if len(x) else []
    fits = [mixture(x, k) for k in range(1, kmax + 1)]
    w, mu, sd, _ = min(fits, key=lambda f: (3 * len(f[0]) - 1) * np.log(len(x)) - 2 * f[3])
    keep = np.flatnonzero(w >= least)
    keep = keep[np.argsort(mu[keep])]
    return [(float(mu[i]), float(sd[i]), float(w[i] / w[keep].sum())) for i in keep]


def kde(x: np.ndarray, points: int = 220) -> tuple[np.ndarray, np.ndarray]:
    """A Gaussian density curve with Scott's width, scaled to a maximum of 1."""
    width = max(x.std() * len(x) ** -0.2, 1e-9)
    at = np.linspace(x.min(), x.max(), points)
    y = np.exp(-0.5 * ((at[:, None] - x[None, :]) / width) ** 2).sum(1)
    return at, y / y.max()


def signed_rank_p(d: np.ndarray) -> tuple[float, float]:
    """Wilcoxon's signed-rank statistic and its two-sided p: exact up to 25 untied differences, else normal."""
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    _, place, size = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - (size - 1) / 2)[place]
    w = min(rank[d > 0].sum(), rank[d < 0].sum())
    if n <= 25 and (size == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(w), float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - (size**3 - size).sum() / 48
    z = abs(w - mean) / np.sqrt(var) if var > 0 else 0.0
    from math import erfc

    return float(w), float(erfc(z / np.sqrt(2)))
