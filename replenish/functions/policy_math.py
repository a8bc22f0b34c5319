"""Stocking-policy formulas as native Column expressions (D4-D6, F13s).

All of these stay inside whole-stage codegen; none is a Python UDF.
Division goes through ``try_divide`` so a zero divisor yields NULL instead of
an ANSI ``DIVIDE_BY_ZERO`` error.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import HOLDING_RATE, ORDER_COST, PERIODS_PER_YEAR, Z_95


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def eoq(demand, unit_cost, holding_rate=HOLDING_RATE, order_cost=ORDER_COST, periods=PERIODS_PER_YEAR) -> Column:
    """Economic order quantity: sqrt(2 · annual demand · order cost / (unit cost · rate))."""
    annual = _c(demand) * F.lit(periods)
    return F.sqrt(F.try_divide(F.lit(2) * annual * _c(order_cost), _c(unit_cost) * _c(holding_rate)))


def safety_stock(demand_std, lead_time_avg, service_level=0.95) -> Column:
    """z(service level) · σ(demand) · sqrt(mean lead time)."""
    return z_score(service_level) * _c(demand_std) * F.sqrt(_c(lead_time_avg))


def reorder_point(demand_avg, lead_time_avg, safety) -> Column:
    return _c(demand_avg) * _c(lead_time_avg) + _c(safety)


def z_score(service_level) -> Column:
    """Standard-normal quantile of a service level.

    A constant level becomes a literal (0.95 is pinned to the value in
    ``config.Z_95``); a Column of levels is evaluated per row with the
    rational approximation below.
    """
    if isinstance(service_level, (int, float)):
        p = float(service_level)
        if p == 0.95:
            return F.lit(Z_95)
        return F.lit(NormalDist().inv_cdf(p))
    return inverse_normal(_c(service_level))


# Coefficients of the published 16-digit rational
# approximation to the normal quantile (Wichura, Applied Statistics 37(3),
# algorithm AS 241, "PPND16"), lowest power first.
_CENTRAL_NUM = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
_CENTRAL_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
_NEAR_NUM = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
_NEAR_DEN = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
_FAR_NUM = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
_FAR_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)


def _poly(coefs, x: Column) -> Column:
    """Horner evaluation, coefficients lowest power first."""
    acc = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        acc = acc * x + F.lit(c)
    return acc


def inverse_normal(p: Column) -> Column:
    """Normal quantile of a probability column; NULL outside (0, 1)."""
    q = p - F.lit(0.5)
    r_central = F.lit(0.180625) - q * q
    central = q * _poly(_CENTRAL_NUM, r_central) / _poly(_CENTRAL_DEN, r_central)
    tail_p = F.when(q < 0, p).otherwise(F.lit(1.0) - p)
    r = F.sqrt(-F.log(tail_p))
    near = _poly(_NEAR_NUM, r - F.lit(1.6)) / _poly(_NEAR_DEN, r - F.lit(1.6))
    far = _poly(_FAR_NUM, r - F.lit(5.0)) / _poly(_FAR_DEN, r - F.lit(5.0))
    tail = F.when(r <= 5.0, near).otherwise(far)
    tail = F.when(q < 0, -tail).otherwise(tail)
    value = F.when(F.abs(q) <= 0.425, central).otherwise(tail)
    return F.when((p > 0) & (p < 1), value)
