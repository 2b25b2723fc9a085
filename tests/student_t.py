"""Two-sided Student-t tail in numpy, an independent check of the library's column expression."""

import numpy as np


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray, iters: int = 300) -> np.ndarray:
    """Continued fraction for the regularized incomplete beta (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1.0) < 3e-16):
            break
    return h


def betainc_reg(a, b, x) -> np.ndarray:
    """Regularized incomplete beta I_x(a, b) for arrays."""
    from math import lgamma

    a = np.asarray(a, dtype=float)
    b = np.asarray(b, dtype=float)
    x = np.asarray(x, dtype=float)
    out = np.full(np.broadcast(a, b, x).shape, np.nan)
    a, b, x = np.broadcast_arrays(a, b, x)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        am, bm, xm = a[mid], b[mid], x[mid]
        lg = np.array([lgamma(p + q) - lgamma(p) - lgamma(q) for p, q in zip(am, bm)])
        front = np.exp(lg + am * np.log(xm) + bm * np.log1p(-xm))
        direct = xm < (am + 1.0) / (am + bm + 2.0)
        res = np.empty_like(xm)
        if direct.any():
            res[direct] = front[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
        flip = ~direct
        if flip.any():
            res[flip] = 1.0 - front[flip] * _betacf(bm[flip], am[flip], 1.0 - xm[flip]) / bm[flip]
        out[mid] = res
    return out


def t_two_sided_p(t, df) -> np.ndarray:
    """Two-sided p of Student's t: I_{df/(df+t^2)}(df/2, 1/2)."""
    t = np.asarray(t, dtype=float)
    df = np.asarray(df, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = df / (df + t * t)
    p = betainc_reg(df / 2.0, 0.5, x)
    p = np.where(np.isinf(t) & (df > 0), 0.0, p)
    return p
