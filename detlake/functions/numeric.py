"""Numeric column expressions without a built-in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Published coefficients of Acklam's rational approximation of the
# inverse normal distribution function (relative error below 1.15e-9).
PROBIT_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
PROBIT_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01, 1.0]
PROBIT_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
PROBIT_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00, 1.0]
PROBIT_TAIL = 0.02425


def _poly(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def probit(p: Column) -> Column:
    """Inverse of the standard normal distribution function, NULL outside (0, 1)."""
    def tail(q: Column) -> Column:
        u = F.sqrt(-2.0 * F.log(q))
        return _poly(u, PROBIT_C) / _poly(u, PROBIT_D)

    c = p - 0.5
    r = c * c
    middle = _poly(r, PROBIT_A) * c / _poly(r, PROBIT_B)
    return (
        F.when((p <= 0) | (p >= 1), None)
        .when(p < PROBIT_TAIL, tail(p))
        .when(p > 1 - PROBIT_TAIL, -tail(1 - p))
        .otherwise(middle)
    )


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, NULL for an empty whole."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def md5_int(*parts: Column | str) -> Column:
    """First 32 bits of the md5 of the comma-joined parts, as a long.

    Engines, runs and retries all agree on it, unlike a random generator.
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(",", *[c.cast("string") for c in cols])
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("long")


def nan_to_null(col: Column) -> Column:
    return F.when(F.isnan(col), None).otherwise(col)


def is_finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))
