"""Brute-force numpy reference for the texture families on small patches.

Written straight from the published definitions, pixel by pixel, so it shares
no code path with the Spark implementation.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.spacing(1))
OFFSETS = [(1, 0), (1, 1), (0, 1), (1, -1)]  # (dx, dy)
NEIGH8 = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]


def levels(v: np.ndarray, roi: np.ndarray, bw: int = 25) -> np.ndarray:
    g = np.zeros_like(v)
    g[roi] = np.floor(v[roi] / bw) - np.floor(v[roi].min() / bw) + 1
    return g


def firstorder(v: np.ndarray, roi: np.ndarray, g: np.ndarray) -> dict:
    x = v[roi].astype(float)
    n = len(x)
    mean = x.mean()
    m2 = ((x - mean) ** 2).mean()
    m3 = ((x - mean) ** 3).mean()
    m4 = ((x - mean) ** 4).mean()
    p10, p25, p50, p75, p90 = np.percentile(x, [10, 25, 50, 75, 90])
    r = x[(x >= p10) & (x <= p90)]
    _, cnt = np.unique(g[roi], return_counts=True)
    p = cnt / n
    return {
        "Energy": (x ** 2).sum(), "TotalEnergy": (x ** 2).sum(), "Entropy": -(p * np.log2(p + EPS)).sum(),
        "Minimum": x.min(), "10Percentile": p10, "90Percentile": p90, "Maximum": x.max(), "Mean": mean,
        "Median": p50, "InterquartileRange": p75 - p25, "Range": x.max() - x.min(),
        "MeanAbsoluteDeviation": np.abs(x - mean).mean(), "RobustMeanAbsoluteDeviation": np.abs(r - r.mean()).mean(),
        "RootMeanSquared": math.sqrt((x ** 2).sum() / n), "Skewness": 0.0 if m2 == 0 else m3 / m2 ** 1.5,
        "Kurtosis": 0.0 if m2 == 0 else m4 / m2 ** 2, "Variance": m2, "Uniformity": (p ** 2).sum(),
    }


def _inside(roi, x, y):
    return 0 <= y < roi.shape[0] and 0 <= x < roi.shape[1] and roi[y, x]


def glcm(roi: np.ndarray, g: np.ndarray) -> dict:
    ng = int(g[roi].max())
    per = []
    for dx, dy in OFFSETS:
        P = np.zeros((ng + 1, ng + 1))
        for y, x in zip(*np.nonzero(roi)):
            if _inside(roi, x + dx, y + dy):
                a, b = g[y, x], g[y + dy, x + dx]
                P[a, b] += 1
                P[b, a] += 1
        if P.sum() == 0:
            continue
        p = P / P.sum()
        idx = np.arange(ng + 1)
        i, j = np.meshgrid(idx, idx, indexing="ij")
        px = p.sum(1)
        mu = (idx * px).sum()
        ss = (p * (i - mu) ** 2).sum()
        hx = -(px * np.log2(px + EPS)).sum()
        hxy = -(p * np.log2(p + EPS)).sum()
        hxy1 = -(p * np.log2(np.outer(px, px) + EPS)).sum()
        pd_ = np.array([p[np.abs(i - j) == k].sum() for k in range(ng + 1)])
        ps = np.array([p[(i + j) == k].sum() for k in range(2 * ng + 1)])
        k = np.arange(ng + 1)
        ks = np.arange(2 * ng + 1)
        da = (k * pd_).sum()
        keep = px > 0
        pk = p[np.ix_(keep, keep)]
        pxk = px[keep]
        q = (pk / pxk[:, None]) @ (pk / pxk[None, :]).T
        ev = np.sort(np.real(np.linalg.eigvals(q)))[::-1]
        f = {
            "Autocorrelation": (p * i * j).sum(), "JointAverage": mu,
            "ClusterProminence": (p * (i + j - 2 * mu) ** 4).sum(), "ClusterShade": (p * (i + j - 2 * mu) ** 3).sum(),
            "ClusterTendency": (p * (i + j - 2 * mu) ** 2).sum(), "Contrast": (p * (i - j) ** 2).sum(),
            "Correlation": 1.0 if ss == 0 else ((p * i * j).sum() - mu * mu) / ss,
            "DifferenceAverage": da, "DifferenceEntropy": -(pd_ * np.log2(pd_ + EPS)).sum(),
            "DifferenceVariance": ((k - da) ** 2 * pd_).sum(), "JointEnergy": (p ** 2).sum(), "JointEntropy": hxy,
            "Imc1": 0.0 if hx == 0 else (hxy - hxy1) / hx,
            "Imc2": math.sqrt(max(1 - math.exp(-2 * (2 * hx - hxy)), 0.0)),
            "Idm": (pd_ / (1 + k ** 2)).sum(), "Idmn": (pd_ / (1 + k ** 2 / ng ** 2)).sum(),
            "Id": (pd_ / (1 + k)).sum(), "Idn": (pd_ / (1 + k / ng)).sum(),
            "InverseVariance": (pd_[1:] / k[1:] ** 2).sum(), "MaximumProbability": p.max(),
            "SumAverage": (ks * ps).sum(), "SumEntropy": -(ps * np.log2(ps + EPS)).sum(), "SumSquares": ss,
            "MCC": 1.0 if len(ev) < 2 else math.sqrt(max(ev[1], 0.0)),
        }
        per.append(f)
    return {k2: float(np.mean([f[k2] for f in per])) for k2 in per[0]}


def _size_feats(P: dict, n_pixels: int | None, names: dict) -> dict:
    items = [(i, j, c) for (i, j), c in P.items()]
    i = np.array([a for a, _, _ in items], float)
    j = np.array([b for _, b, _ in items], float)
    c = np.array([x for _, _, x in items], float)
    N = c.sum()
    p = c / N
    rows = {}
    cols = {}
    for a, b, x in items:
        rows[a] = rows.get(a, 0) + x
        cols[b] = cols.get(b, 0) + x
    mi, mj = (p * i).sum(), (p * j).sum()
    g = {
        "short": (c / j ** 2).sum() / N, "long": (c * j ** 2).sum() / N,
        "gln": sum(v ** 2 for v in rows.values()) / N, "glnn": sum(v ** 2 for v in rows.values()) / N ** 2,
        "sln": sum(v ** 2 for v in cols.values()) / N, "slnn": sum(v ** 2 for v in cols.values()) / N ** 2,
        "pct": N / n_pixels if n_pixels else None, "glv": (p * (i - mi) ** 2).sum(), "sv": (p * (j - mj) ** 2).sum(),
        "ent": -(p * np.log2(p + EPS)).sum(), "low": (c / i ** 2).sum() / N, "high": (c * i ** 2).sum() / N,
        "sl": (c / (i ** 2 * j ** 2)).sum() / N, "sh": (c * i ** 2 / j ** 2).sum() / N,
        "ll": (c * j ** 2 / i ** 2).sum() / N, "lh": (c * i ** 2 * j ** 2).sum() / N,
    }
    return {n: g[k] for k, n in names.items()}


def glrlm(roi: np.ndarray, g: np.ndarray, names: dict) -> dict:
    n = int(roi.sum())
    per = []
    for dx, dy in OFFSETS:
        P: dict = {}
        for y, x in zip(*np.nonzero(roi)):
            # start of a run: previous pixel along the direction absent or different
            if _inside(roi, x - dx, y - dy) and g[y - dy, x - dx] == g[y, x]:
                continue
            length = 1
            while _inside(roi, x + dx * length, y + dy * length) and g[y + dy * length, x + dx * length] == g[y, x]:
                length += 1
            P[(int(g[y, x]), length)] = P.get((int(g[y, x]), length), 0) + 1
        per.append(_size_feats(P, n, names))
    return {k: float(np.mean([f[k] for f in per])) for k in per[0]}


def glszm(roi: np.ndarray, g: np.ndarray, names: dict) -> dict:
    seen = np.zeros_like(roi, dtype=bool)
    P: dict = {}
    for y0, x0 in zip(*np.nonzero(roi)):
        if seen[y0, x0]:
            continue
        stack = [(y0, x0)]
        seen[y0, x0] = True
        size = 0
        while stack:
            y, x = stack.pop()
            size += 1
            for dx, dy in NEIGH8:
                if _inside(roi, x + dx, y + dy) and not seen[y + dy, x + dx] and g[y + dy, x + dx] == g[y0, x0]:
                    seen[y + dy, x + dx] = True
                    stack.append((y + dy, x + dx))
        key = (int(g[y0, x0]), size)
        P[key] = P.get(key, 0) + 1
    return _size_feats(P, int(roi.sum()), names)


def gldm(roi: np.ndarray, g: np.ndarray, names: dict) -> dict:
    P: dict = {}
    for y, x in zip(*np.nonzero(roi)):
        d = 1 + sum(1 for dx, dy in NEIGH8 if _inside(roi, x + dx, y + dy) and g[y + dy, x + dx] == g[y, x])
        P[(int(g[y, x]), d)] = P.get((int(g[y, x]), d), 0) + 1
    return _size_feats(P, None, names)


def ngtdm(roi: np.ndarray, g: np.ndarray) -> dict:
    s: dict = {}
    n: dict = {}
    for y, x in zip(*np.nonzero(roi)):
        nbs = [g[y + dy, x + dx] for dx, dy in NEIGH8 if _inside(roi, x + dx, y + dy)]
        if not nbs:
            continue
        lv = int(g[y, x])
        n[lv] = n.get(lv, 0) + 1
        s[lv] = s.get(lv, 0.0) + abs(lv - np.mean(nbs))
    lv = np.array(sorted(n), float)
    nn = np.array([n[k] for k in sorted(n)], float)
    ss = np.array([s[k] for k in sorted(n)], float)
    nvp = nn.sum()
    p = nn / nvp
    ngp = len(lv)
    ps = (p * ss).sum()
    ii, jj = np.meshgrid(lv, lv, indexing="ij")
    pi, pj = np.meshgrid(p, p, indexing="ij")
    si, sj = np.meshgrid(ss, ss, indexing="ij")
    absdiff = np.abs(ii * pi - jj * pj).sum()
    return {
        "Coarseness": 1e6 if ps == 0 else 1 / ps,
        "Contrast": 0.0 if ngp <= 1 else (pi * pj * (ii - jj) ** 2).sum() / (ngp * (ngp - 1)) * ss.sum() / nvp,
        "Busyness": 0.0 if ngp <= 1 or absdiff == 0 else ps / absdiff,
        "Complexity": (np.abs(ii - jj) * (pi * si + pj * sj) / (pi + pj)).sum() / nvp,
        "Strength": 0.0 if ss.sum() == 0 else ((pi + pj) * (ii - jj) ** 2).sum() / ss.sum(),
    }


def shape_axes(roi: np.ndarray) -> dict:
    ys, xs = np.nonzero(roi)
    cov = np.cov(np.stack([xs, ys]).astype(float), bias=True)
    ev = np.sort(np.linalg.eigvalsh(cov))[::-1]
    return {"PixelSurface": float(len(xs)), "MajorAxisLength": 4 * math.sqrt(ev[0]),
            "MinorAxisLength": 4 * math.sqrt(max(ev[1], 0)),
            "Elongation": 0.0 if ev[0] == 0 else math.sqrt(max(ev[1], 0) / ev[0])}
