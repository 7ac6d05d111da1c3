"""Exact certificates for near-zero distances.

Two windows W = a*Q + b with a > 0 have z-normalised distance 0, and only
those.  Rounding hides which windows are exact copies, so suspects (a few) are
decided with rational arithmetic on the binary64 values themselves.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np


def dyadic(x: float) -> tuple[int, int]:
    """(odd or zero integer, exponent of two) with x = integer * 2**exponent."""
    n, d = float(x).as_integer_ratio()
    e = -(d.bit_length() - 1)
    while n and n % 2 == 0:
        n //= 2
        e += 1
    return n, e if n else 0


def dyadic_difference(x: float, y: float) -> tuple[int, int]:
    """x - y exactly, in the same form."""
    f = Fraction(x) - Fraction(y)
    n, e = f.numerator, -(f.denominator.bit_length() - 1)
    while n and n % 2 == 0:
        n //= 2
        e += 1
    return n, e if n else 0


def is_translation(q: np.ndarray, w: np.ndarray) -> bool:
    """True if w - q is one exact number."""
    b = Fraction(float(w[0])) - Fraction(float(q[0]))
    return all(Fraction(float(y)) - Fraction(float(x)) == b for x, y in zip(q, w))


def is_positive_affine(q: np.ndarray, w: np.ndarray) -> bool:
    """True if w = a*q + b exactly for some a > 0; q must not be constant."""
    fq, fw = [Fraction(float(x)) for x in q], [Fraction(float(x)) for x in w]
    k = next((i for i in range(1, len(fq)) if fq[i] != fq[0]), None)
    if k is None:
        return False
    dq, dw = fq[k] - fq[0], fw[k] - fw[0]
    if dw == 0 or (dw > 0) != (dq > 0):
        return False
    return all((y - fw[0]) * dq == (x - fq[0]) * dw for x, y in zip(fq, fw))


def exact_distance(q: np.ndarray, w: np.ndarray, digits: int = 60) -> float:
    """Z-normalised distance of two non-constant windows in decimal arithmetic of ``digits`` places."""
    m = len(q)
    with localcontext() as ctx:
        ctx.prec = digits
        x, y = [Decimal(float(v)) for v in q], [Decimal(float(v)) for v in w]

        def normal(v):
            mean = sum(v) / m
            c = [a - mean for a in v]
            s = (sum(a * a for a in c) / m).sqrt()
            return [a / s for a in c]

        return float(sum((a - b) ** 2 for a, b in zip(normal(x), normal(y))).sqrt())


def refine_near_zero(q: np.ndarray, windows: np.ndarray, d: np.ndarray, constant: np.ndarray, below: float = 1e-6) -> np.ndarray:
    """Distances with every suspect below ``below`` decided exactly: 0 for an affine copy, its true value otherwise."""
    out = d.copy()
    if q.min() == q.max():
        return out
    for k in np.flatnonzero((d < below) & ~constant):
        if is_positive_affine(q, windows[k]):
            out[k] = 0.0
        elif windows[k].min() != windows[k].max():
            span = max(abs(dyadic(v)[1]) for v in np.concatenate([q, windows[k]])) // 3
            out[k] = exact_distance(q, windows[k], digits=max(60, 2 * span + 40))
    return out
