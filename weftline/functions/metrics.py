"""Association metrics of item pairs, as columns over 2x2 counts.

Every builder takes its parameters and gives a Column over ``a b c d fl fr n``: units with both items, only the left, only the
right, neither, the left's and the right's totals, all units. What is divided by zero is zero. ``idf_*`` metrics also read the
columns that :func:`weftline.operators.contingency.with_item_weights` adds.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

class Counts(NamedTuple):
    a: Column
    b: Column
    c: Column
    d: Column
    fl: Column
    fr: Column
    n: Column


class Weights(NamedTuple):
    """Of a pair's items: wl, wr robust; il, ir smooth inverse frequency; gl, gr the domain factor."""

    wl: Column
    wr: Column
    il: Column
    ir: Column
    gl: Column
    gr: Column


def counts() -> Counts:
    return Counts(*(F.col(x).cast("double") for x in Counts._fields))


def weights_of() -> Weights:
    return Weights(*(F.col(x) for x in Weights._fields))


def ratio(x: Column, y: Column) -> Column:
    return F.when(y != 0, x / y).otherwise(F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def blend(x: Column, y: Column, alpha: float) -> Column:
    """x^alpha * y^(1 - alpha)."""
    return F.pow(x, F.lit(alpha)) * F.pow(y, F.lit(1 - alpha))


def jaccard() -> Column:
    k = counts()
    return ratio(k.a, k.a + k.b + k.c)


def dice() -> Column:
    k = counts()
    return ratio(2 * k.a, 2 * k.a + k.b + k.c)


def overlap() -> Column:
    k = counts()
    return ratio(k.a, F.least(k.fl, k.fr))


def cosine() -> Column:
    k = counts()
    return ratio(k.a, F.sqrt(k.fl * k.fr))


def conditional_fraction() -> Column:
    k = counts()
    return ratio(k.a, F.greatest(k.fl, k.fr))


def lift() -> Column:
    k = counts()
    return ratio(k.n * k.a, k.fl * k.fr)


def tversky(alpha: float = 0.5, beta: float = 0.5) -> Column:
    k = counts()
    return ratio(k.a, k.a + alpha * k.b + beta * k.c)


def cfws(alpha: float = 0.5) -> Column:
    return blend(jaccard(), conditional_fraction(), alpha)


def cfws_cosine(alpha: float = 0.5) -> Column:
    return blend(jaccard(), cosine(), alpha)


def jensen_shannon() -> Column:
    """1 - sqrt(JS / ln 2) of the items' uniform profiles over their units, from counts alone."""
    k = counts()
    p, q = ratio(k.a, k.fl), ratio(k.a, k.fr)
    both = k.fl + k.fr
    js = 0.5 * (p * F.log(2 * k.fr / both) + (1 - p) * log(2) + q * F.log(2 * k.fl / both) + (1 - q) * log(2))
    js = F.when((k.fl == 0) & (k.fr == 0), 0.0).when((k.fl == 0) | (k.fr == 0), 0.5 * log(2)).otherwise(F.greatest(F.lit(0.0), js))
    return 1 - F.sqrt(js / log(2))


def phi() -> Column:
    k = counts()
    return ratio(k.a * k.d - k.b * k.c, F.sqrt(k.fl * k.fr * (k.b + k.d) * (k.c + k.d)))


def pmi(eps: float = 0.5) -> Column:
    k = counts()
    size = k.n + 4 * eps
    return F.log(F.greatest(F.lit(1e-15), ((k.a + eps) / size) / (((k.fl + eps) / size) * ((k.fr + eps) / size))))


def npmi(eps: float = 0.5) -> Column:
    k = counts()
    base = -F.log((k.a + eps) / (k.n + 4 * eps))
    return F.when(base == 0, 1.0).otherwise(clip(pmi(eps) / base, -1.0, 1.0))


def npmi01(eps: float = 0.5) -> Column:
    return (npmi(eps) + 1) / 2


def _cells(eps: float) -> list[tuple[Column, Column]]:
    """Smoothed joint probability and product of its margins, of the four cells."""
    k = counts()
    size = k.n + 4 * eps
    p = [(x + eps) / size for x in (k.a, k.b, k.c, k.d)]
    left, right = p[0] + p[1], p[0] + p[2]
    return list(zip(p, (left * right, left * (1 - right), (1 - left) * right, (1 - left) * (1 - right)), strict=True))


def mutual_information(eps: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), sum((p * F.log(p / q) for p, q in _cells(eps)), F.lit(0.0)))


def _binary_entropy(f: Column, eps: float) -> Column:
    k = counts()
    p = (f + eps) / (k.n + 2 * eps)
    return -(p * F.log(p) + (1 - p) * F.log(1 - p))


def nmi(eps: float = 0.5) -> Column:
    k = counts()
    return ratio(mutual_information(eps), F.sqrt(_binary_entropy(k.fl, eps) * _binary_entropy(k.fr, eps)))


def yules_q(eps: float = 0.5) -> Column:
    k = counts()
    up = (k.a + eps) * (k.d + 3 * eps)
    return ratio(up - k.b * k.c, up + k.b * k.c)


def yules_y(eps: float = 0.5) -> Column:
    """1 where b*c = 0: the odds ratio is infinite there."""
    k = counts()
    root = F.sqrt((k.a + eps) * (k.d + 3 * eps) / (k.b * k.c))
    return F.when(k.b * k.c == 0, 1.0).otherwise(clip((root - 1) / (root + 1), -1.0, 1.0))


def scaled_lift_raw() -> Column:
    return F.log1p(lift())


#: Metrics of counts alone.
METRICS: dict[str, Callable[..., Column]] = {
    "jaccard": jaccard, "dice": dice, "overlap": overlap, "cosine": cosine, "conditional_fraction": conditional_fraction, "lift": lift,
    "tversky": tversky, "cfws": cfws, "cfws_cosine": cfws_cosine, "jensen_shannon": jensen_shannon, "phi": phi, "pmi": pmi, "npmi": npmi,
    "npmi01": npmi01, "mutual_information": mutual_information, "nmi": nmi, "yules_q": yules_q, "yules_y": yules_y,
}

def npmi_smoothed(s: float = 0.5) -> Column:
    """NPMI01 with margins and joint smoothed alike."""
    k = counts()
    size = k.n + 2 * s
    joint = (k.a + s) / size
    value = F.log(joint / (((k.fl + s) / size) * ((k.fr + s) / size))) / -F.log(joint)
    return (clip(value, -1.0, 1.0) + 1) / 2


def npmi_idf(alpha: float = 0.5, cosine_form: bool = False, assoc: Column | None = None, smoothing: float = 0.5) -> Column:
    """Association times mean inverse frequency, blended with a conditional fraction."""
    k = counts()
    w = weights_of()
    shared = (npmi_smoothed(smoothing) if assoc is None else assoc) * (w.il + w.ir) / 2
    left, right = k.fl * w.il, k.fr * w.ir
    x = ratio(shared, F.sqrt(left * right)) if cosine_form else ratio(shared, left + right - shared)
    y = ratio(shared, F.greatest(left, right))
    eps = 1e-10
    return clip(F.exp(alpha * F.log(F.greatest(x, F.lit(0.0)) + eps) + (1 - alpha) * F.log(F.greatest(y, F.lit(0.0)) + eps)), 0.0, 1.0)


def idf_base(alpha: float = 0.5, cosine_form: bool = False) -> Column:
    k = counts()
    w = weights_of()
    shared, left, right = k.a * F.least(w.wl, w.wr), k.fl * w.wl, k.fr * w.wr
    x = cosine() if cosine_form else ratio(shared, left + right - shared)
    return blend(x, ratio(shared, F.greatest(left, right)), alpha)


def domain(base: Column, effect: str | None = None, power: float = 0.35) -> Column:
    """None, ``stretch`` or ``multiply`` by the items' domain factors."""
    w = weights_of()
    theta = F.pow((w.gl + w.gr) / 2, F.lit(power))
    if effect == "stretch":
        return 1 - F.pow(1 - base, F.greatest(theta, F.lit(1.0)))
    if effect == "multiply":
        return F.least(F.lit(1.0), base * theta)
    return base


def ppmi_weight(gamma: float = 2.0, cap: float = 10.0, min_support: int = 5) -> Column:
    k = counts()
    p = F.log(F.greatest(k.a / k.n, F.lit(1e-9)) / (F.greatest(k.fl / k.n, F.lit(1e-9)) * F.greatest(k.fr / k.n, F.lit(1e-9))))
    value = 1 / (1 + F.exp(-gamma * F.least(F.lit(cap), F.greatest(F.lit(0.0), p))))
    return F.when(k.a < min_support, 0.0).otherwise(value)


def idf_cfws(alpha: float = 0.5, cosine_form: bool = False, effect: str | None = None, ppmi_eta: float = 0.0) -> Column:
    base = domain(idf_base(alpha, cosine_form), effect)
    if ppmi_eta:
        base = blend(base, ppmi_weight(), 1 - ppmi_eta)
    return clip(base, 0.0, 1.0)


def _idf_mean_base(alpha: float) -> Column:
    k = counts()
    w = weights_of()
    shared, left, right = k.a * (w.il + w.ir) / 2, k.fl * w.il, k.fr * w.ir
    return blend(ratio(shared, left + right - shared), ratio(shared, F.greatest(left, right)), alpha)


def support_gate(mode: str = "cap", t: float = 5.0, rate: float = 12.0) -> Column:
    k = counts()
    return F.least(F.lit(1.0), k.a / t) if mode == "cap" else 1 - F.exp(-rate * k.a / k.n)


def _combined(x: Column, y: Column, weights: tuple[float, float], how: str) -> Column:
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("weights must add up to one")
    if how == "add":
        return weights[0] * x + weights[1] * y
    return F.pow(clip(x, 1e-12, 1.0), F.lit(weights[0])) * F.pow(clip(y, 1e-12, 1.0), F.lit(weights[1]))


def act_composite(weights: tuple[float, float] = (0.5, 0.5), alpha: float = 0.5, eps: float = 0.5, how: str = "geo", gate: str = "cap") -> Column:
    return _combined(_idf_mean_base(alpha), npmi01(eps), weights, how) * support_gate(gate)


def act_jensen(weights: tuple[float, float] = (0.5, 0.5), alpha: float = 0.5, eps: float = 0.5, how: str = "geo", gate: str = "cap") -> Column:
    js = sum((0.5 * (p * F.log(2 * p / (p + q)) + q * F.log(2 * q / (p + q))) for p, q in _cells(eps)), F.lit(0.0))
    return _combined(_idf_mean_base(alpha), 1 - js / log(2), weights, how) * support_gate(gate)


def distance(similarity: Column, digits: int | None = None) -> Column:
    out = 1 - similarity
    return out if digits is None else F.round(out, digits)
