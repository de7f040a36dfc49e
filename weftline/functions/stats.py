"""Tails of distributions that Spark has no function for, as Arrow UDFs over columns; numpy does the work."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _doubles(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=float), pa.float64(), from_pandas=True)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Γ for x > 0: Stirling's series from 20 on, shifted up to there below."""
    x = np.asarray(x, float)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(20):
        low = y < 20
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def support(fl: int, fr: int, n: int, tilt: float = 0.0) -> tuple[int, int]:
    """Counts of both that weigh anything, given margins: a run of some standard deviations about the mode, whatever the margins'
    size. ``tilt`` is a log odds ratio."""
    low, high = max(0, fl + fr - n), min(fl, fr)
    odds = math.exp(tilt)
    # the mode solves (fl - k)(fr - k) odds = k (n - fl - fr + k)
    a, b, c = odds - 1, -((fl + fr) * odds + n - fl - fr), odds * fl * fr
    mode = c / -b if abs(a) < 1e-12 else 2 * c / (-b + math.sqrt(max(b * b - 4 * a * c, 0.0)))
    mode = min(max(mode, low), high)
    spread = 1 / math.sqrt(sum(1 / max(x, 0.5) for x in (mode, fl - mode, fr - mode, n - fl - fr + mode)))
    reach = int(12 * spread) + 60
    return max(low, int(mode) - reach), min(high, int(mode) + reach)


def _weights(k: np.ndarray, fl: int, fr: int, n: int) -> np.ndarray:
    """Log probabilities of counts of both, given margins, but for a constant."""
    return -log_gamma(np.concatenate([k + 1, fl - k + 1, fr - k + 1, n - fl - fr + k + 1])).reshape(4, -1).sum(0)


def _logs(k: np.ndarray, fl: int, fr: int, n: int) -> np.ndarray:
    top = log_gamma(np.array([fl + 1.0, n - fl + 1, fr + 1, n - fr + 1, n + 1]))
    return _weights(k, fl, fr, n) + top[:4].sum() - top[4]


def fisher_tail(a: int, fl: int, fr: int, n: int, tail: str) -> float:
    """Exact p. Terms are taken from the count seen outwards, or about the mode, so memory doesn't follow the margins. Beyond some
    twelve deviations (p under 1e-30) a two-sided p is that of the nearer tail."""
    low, high = max(0, fl + fr - n), min(fl, fr)
    first, last = support(fl, fr, n)
    reach = last - first + 1
    if tail == "greater":
        k = np.arange(max(a, first), min(high, max(a, last) + reach) + 1, dtype=float) if a > first else np.arange(first, last + 1, dtype=float)
        return min(1.0, float(np.exp(_logs(k, fl, fr, n)).sum()))
    if tail == "less":
        k = np.arange(max(low, min(a, first) - reach), min(a, last) + 1, dtype=float) if a < last else np.arange(first, last + 1, dtype=float)
        return min(1.0, float(np.exp(_logs(k, fl, fr, n)).sum()))
    k = np.arange(first, last + 1, dtype=float)
    logs, seen = _logs(k, fl, fr, n), float(_logs(np.array([float(a)]), fl, fr, n)[0])
    total = float(np.exp(logs[logs <= seen + 1e-7]).sum())
    if a < first or a > last:  # far out: only terms beyond the count seen are as small
        k = np.arange(max(low, a - reach), a + 1, dtype=float) if a < first else np.arange(a, min(high, a + reach) + 1, dtype=float)
        total = float(np.exp(_logs(k, fl, fr, n)).sum())
    return min(1.0, total)


def fisher_p(tail: str = "two-sided"):
    """A Column function (a, fl, fr, n) -> exact p; null counts give null. Equal tables are computed once in a batch."""

    def of(a: pa.Array, fl: pa.Array, fr: pa.Array, n: pa.Array) -> pa.Array:
        rows = list(zip(a.to_pylist(), fl.to_pylist(), fr.to_pylist(), n.to_pylist(), strict=True))
        found = {r: None if None in r else fisher_tail(*r, tail) for r in set(rows)}
        return pa.array([found[r] for r in rows], pa.float64())

    return F.arrow_udf(of, "double")


@F.arrow_udf(DoubleType())
def erfc(x: pa.Array) -> pa.Array:
    return _doubles([math.erfc(v) for v in _numbers(x).tolist()])


def _regularized_gamma_upper(s: float, x: float) -> float:
    """Q(s, x) by series below s + 1 and by a continued fraction above."""
    if not x > 0:
        return 1.0 if x == 0 else math.nan
    scale = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - s, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - s)
        b += 2
        d = 1 / (an * d + b if an * d + b else 1e-300)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


@F.arrow_udf(DoubleType())
def chi2_sf(x: pa.Array, df: pa.Array) -> pa.Array:
    return pa.array([None if v is None or k is None else _regularized_gamma_upper(k / 2, v / 2) for v, k in zip(x.to_pylist(), df.to_pylist(), strict=True)], pa.float64())


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + up * d)
        c = 1 + up / c
        h *= d * c
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + down * d)
        c = 1 + down / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


@F.arrow_udf(DoubleType())
def t_two_sided(t: pa.Array, df: pa.Array) -> pa.Array:
    return pa.array([None if v is None or k is None else beta_share(k / (k + v * v), k / 2, 0.5) for v, k in zip(t.to_pylist(), df.to_pylist(), strict=True)], pa.float64())


def correlation(x: str, y: str):
    """Pearson correlation as an aggregate; null where a side has no spread."""
    one, two = (F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c)) for c in (x, y))
    return F.try_divide(F.covar_pop(one, two), F.stddev_pop(one) * F.stddev_pop(two))


def correlation_p(r, n):
    """Two-sided p of a Pearson correlation of n pairs by Student's t; null below three pairs, 0 where |r| is 1."""
    left = F.greatest(1 - r * r, F.lit(0.0))
    df = F.when(n > 2, (n - 2).cast("double"))
    return F.when((left == 0) & df.isNotNull(), 0.0).otherwise(t_two_sided(F.when(left > 0, r * F.sqrt(df / left)), df))


@F.arrow_udf(DoubleType())
def kolmogorov_p(d: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
    """Asymptotic two-sample p of a distance."""
    size = np.sqrt(_numbers(n) * _numbers(m) / (_numbers(n) + _numbers(m)))
    x = np.maximum((size + 0.12 + 0.11 / size) * _numbers(d), 1e-3)
    k = np.arange(1, 101)[:, None]
    p = 2 * (np.where(k % 2, 1.0, -1.0) * np.exp(-2 * k**2 * x**2)).sum(0)
    return _doubles(np.where(x < 0.2, 1.0, np.clip(p, 0, 1)))


def beta_quantile(q: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_share(mid, a, b) < q else (low, mid)
    return (low + high) / 2


@F.arrow_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def clopper_pearson(count: pa.Array, n: pa.Array) -> pa.Array:
    """Exact 95 % interval of a share."""
    out = []
    for k, t in zip(count.to_pylist(), n.to_pylist(), strict=True):
        out.append(None if k is None or not t else {"low": beta_quantile(0.025, k, t - k + 1) if k else 0.0, "high": beta_quantile(0.975, k + 1, t - k) if k < t else 1.0})
    return pa.array(out, pa.struct([("low", pa.float64()), ("high", pa.float64())]))


def tilted_odds(x: int, l: int, r: int, t: int) -> float:
    """Log odds ratio whose noncentral hypergeometric mean is x; ±20 at the ends of the range. Newton's steps, at most 2 long."""
    low, high = max(0, l + r - t), min(l, r)
    if x in (low, high):
        return 0.0 if low == high else -20.0 if x == low else 20.0
    tilt = math.log((x + 0.5) * (t - l - r + x + 0.5) / ((l - x + 0.5) * (r - x + 0.5)))
    for _ in range(100):
        first, last = support(l, r, t, tilt)
        k = np.arange(first, last + 1, dtype=float)
        w = _weights(k, l, r, t) + tilt * k
        w = np.exp(w - w.max())
        w /= w.sum()
        mean = (k * w).sum()
        step = (mean - x) / max(((k - mean) ** 2 * w).sum(), 1e-9)
        tilt = min(20.0, max(-20.0, tilt - min(2.0, max(-2.0, step))))
        if abs(step) < 1e-11:
            break
    return tilt


@F.arrow_udf(DoubleType())
def log_odds_mle(a: pa.Array, fl: pa.Array, fr: pa.Array, n: pa.Array) -> pa.Array:
    """Maximum likelihood log odds of 2x2 tables; null counts give null. Equal tables are computed once in a batch."""
    rows = list(zip(a.to_pylist(), fl.to_pylist(), fr.to_pylist(), n.to_pylist(), strict=True))
    found = {r: None if None in r else tilted_odds(*r) for r in set(rows)}
    return pa.array([found[r] for r in rows], pa.float64())
