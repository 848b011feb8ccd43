"""The error function for x >= 0 as one SQL expression.

Rational Chebyshev approximations of W. J. Cody (Math. Comp. 1969); Spark and DuckDB both
lack ``erf``, and the text runs unchanged in either, inside whole-stage codegen in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cody's published coefficients.
A = (3.16112374387056560, 113.864154151050156, 377.485237685302021, 3209.37758913846947, 0.185777706184603153)
B = (23.6012909523441209, 244.024637934444173, 1282.61652607737228, 2844.23683343917062)
C = (0.564188496988670089, 8.88314979438837594, 66.1191906371416295, 298.635138197400131, 881.952221241769090,
     1712.04761263407058, 2051.07837782607147, 1230.33935479799725, 2.15311535474403846e-8)
D = (15.7449261107098347, 117.693950891312499, 537.181101862009858, 1621.38957456669019, 3290.79923573345963,
     4362.61909014324716, 3439.36767414372164, 1230.33935480374942)
P = (0.305326634961232344, 0.360344899949804439, 0.125781726111229246, 0.0160837851487422766,
     0.000658749161529837803, 0.0163153871373020978)
Q = (2.56852019228982242, 1.87295284992346725, 0.527905102951428412, 0.0605183413124413191, 0.00233520497626869185)
INV_SQRT_PI = 0.56418958354775628695


def _lit(x: float) -> str:
    """With an exponent, so that neither engine reads a DECIMAL."""
    return f"{x:.17e}"


def _ratio(first: float, top: tuple[float, ...], bottom: tuple[float, ...], v: str) -> str:
    """(((first*v + t0)*v + t1)*v ... + tn) / (((v + b0)*v + b1)*v ... + bn)."""
    num, den = f"({_lit(first)} * {v})", v
    for t in top[:-1]:
        num = f"(({num} + {_lit(t)}) * {v})"
    for b in bottom[:-1]:
        den = f"(({den} + {_lit(b)}) * {v})"
    return f"(({num} + {_lit(top[-1])}) / ({den} + {_lit(bottom[-1])}))"


def erf_sql(y: str) -> str:
    """SQL text of erf(y) for y >= 0; NaN stays NaN. ``y`` is repeated: pass a column."""
    small = _ratio(A[4], A[:4], B, f"({y} * {y})")
    middle = _ratio(C[8], C[:8], D, y)
    inv = f"(1e0 / ({y} * {y}))"
    tail = f"({_lit(INV_SQRT_PI)} - {inv} * {_ratio(P[5], P[:5], Q, inv)})"
    return (
        f"CASE WHEN isnan({y}) THEN {y} WHEN {y} <= 4.6875e-1 THEN {y} * {small} "
        f"WHEN {y} <= 4e0 THEN 1e0 - {middle} * exp(-({y} * {y})) "
        f"WHEN {y} < 6e0 THEN 1e0 - exp(-({y} * {y})) / {y} * {tail} ELSE 1e0 END"
    )


def erf_column(name: str) -> Column:
    """erf of the non-negative column ``name``."""
    return F.expr(erf_sql(name))
