"""Distance expressions over window arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
SNAP = 1e-14


def centred(w: Column, m: int) -> Column:
    mean = F.aggregate(w, F.lit(0.0), lambda a, x: a + x) / F.lit(float(m))
    return F.transform(F.array(F.struct(mean.alias("mu"), w.alias("w"))), lambda s: F.transform(s["w"], lambda x: x - s["mu"]))[0]


def znormalised(w: Column, m: int) -> Column:
    """(w - mean) / population deviation; zeros for a flat window."""
    c = centred(w, m)
    return F.transform(
        F.array(c),
        lambda d: F.transform(
            F.array(F.struct(d.alias("d"), F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x) / F.lit(float(m))).alias("s"))),
            lambda t: F.transform(t["d"], lambda x: F.when(t["s"] > 0, x / F.when(t["s"] > 0, t["s"])).otherwise(F.lit(0.0))),
        )[0],
    )[0]


def squared(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def znorm_squared(za: Column, zb: Column, const_a: Column, const_b: Column, finite_a: Column, finite_b: Column, m: int, snap: bool = True) -> Column:
    """Squared z-normalised distance with the rules for missing and constant windows."""
    d2 = squared(za, zb)
    if snap:
        d2 = F.transform(F.array(d2), lambda x: F.when(x < SNAP, F.lit(0.0)).otherwise(x))[0]
    return (
        F.when(~finite_a | ~finite_b, F.lit(INF))
        .when(const_a & const_b, F.lit(0.0))
        .when(const_a | const_b, F.lit(float(m)))
        .otherwise(d2)
    )


def raw_squared(wa: Column, wb: Column, finite_a: Column, finite_b: Column) -> Column:
    return F.when(~finite_a | ~finite_b, F.lit(INF)).otherwise(squared(wa, wb))


def tie_key(i: Column, j: Column, self_join: bool) -> Column:
    """Order of equal distances: nearest in time, then left; in an AB-join the lower index."""
    return F.when(j > i, F.abs(j - i) * 2 + 1).otherwise(F.abs(j - i) * 2) if self_join else j
