"""What-if overlay on a weekly demand table.

The reference generates synthetic demand from a base level shaped by a
category seasonality, a linear trend, a demand shock starting at week 60
and a lead-time disruption. Here the same shapes are applied to an existing
demand table as column expressions, so a planner can ask "what if this
season/shock hit our real demand?" at any scale; no random noise is drawn.

``t`` is the week index from the first week of the data, ``n`` the number of
weeks in the calendar, ``u = t - shock_start`` (effects are zero before).

    demand'    = max(0, demand * (1 + seasonal(t) + trend * t / n + shock(u)))
    lead_time' = max(1, lead_time * (1 + disruption(u)))

Categories are mapped to one of the five named profiles; a category without
a profile gets no seasonal or shock effect.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values, as formulas (t = week index, u = t - 60 for t >= 60):
#   seasonal  Electronics 0.3*sin(2*pi*(t-45)/52)
#             Clothing    0.2*sin(4*pi*t/52) + 0.1*sin(2*pi*t/52)
#             Food        0.15*sin(2*pi*t/52) + 0.15*sin(2*pi*(t-26)/52)
#             Home Goods  0.25*sin(2*pi*(t-13)/52)
#             Health      0.3*cos(2*pi*t/52)
#   shock     Electronics 0.5*exp(-0.05*(u-15)^2)
#             Clothing    -0.4*exp(-0.05*u) + 0.2*exp(-0.05*(u-40)^2)
#             Food        0.8*exp(-0.1*u) + 0.2
#             Home Goods  0.6*exp(-0.03*(u-25)^2)
#             Health      0.7*(1-exp(-0.1*u))
#   lead-time disruption  0.5*(1-exp(-0.05*u))
# The tables below hold the same numbers as parameters of the columns.
#
# Seasonal terms per profile as
# (amplitude, cycles per 52 weeks, phase in weeks, "sin" | "cos"):
#   term = amplitude * f(2*pi*cycles*(t - phase)/52)
SEASONAL_TERMS = {
    "Electronics": ((0.3, 1, 45, "sin"),),
    "Clothing": ((0.2, 2, 0, "sin"), (0.1, 1, 0, "sin")),
    "Food": ((0.15, 1, 0, "sin"), (0.15, 1, 26, "sin")),
    "Home Goods": ((0.25, 1, 13, "sin"),),
    "Health": ((0.3, 1, 0, "cos"),),
}

# Shock terms per profile, u = weeks since the shock started:
#   ("gauss", a, r, c): a*exp(-r*(u-c)^2)   ("decay", a, r): a*exp(-r*u)
#   ("rise", a, r): a*(1-exp(-r*u))          ("const", a): a
SHOCK_TERMS = {
    "Electronics": (("gauss", 0.5, 0.05, 15),),
    "Clothing": (("decay", -0.4, 0.05), ("gauss", 0.2, 0.05, 40)),
    "Food": (("decay", 0.8, 0.1), ("const", 0.2)),
    "Home Goods": (("gauss", 0.6, 0.03, 25),),
    "Health": (("rise", 0.7, 0.1),),
}

# Shock start week 60; lead-time disruption 0.5*(1-exp(-0.05*u));
# floors 0 (demand) and 1 week (lead time).
SHOCK_START = 60
DISRUPTION = ("rise", 0.5, 0.05)
PERIOD_WEEKS = 52

# Demo assignment of the test tables' part types to the five profiles
# (in sorted order, wrapping round); any mapping can be passed instead.
DEFAULT_PROFILES = MappingProxyType(
    {
        "ECONOMY": "Electronics",
        "LARGE": "Clothing",
        "MEDIUM": "Food",
        "PROMO": "Home Goods",
        "SMALL": "Health",
        "STANDARD": "Electronics",
    }
)


@dataclass(frozen=True)
class Scenario:
    profiles: Mapping[str, str] = field(default_factory=lambda: DEFAULT_PROFILES)
    shock_start: int = SHOCK_START
    # Trend slope per product over the whole calendar; the reference draws it
    # uniformly from [-0.1, 0.2) — the midpoint is the deterministic default.
    trend: float = 0.05


def _seasonal(t: Column, terms) -> Column:
    acc = F.lit(0.0)
    for amp, cycles, phase, fn in terms:
        arg = F.lit(2 * math.pi * cycles) * (t - F.lit(float(phase))) / F.lit(float(PERIOD_WEEKS))
        acc = acc + F.lit(amp) * (F.sin(arg) if fn == "sin" else F.cos(arg))
    return acc


def _shock_term(u: Column, term) -> Column:
    kind, a = term[0], term[1]
    if kind == "gauss":
        r, c = term[2], term[3]
        return F.lit(a) * F.exp(F.lit(-r) * (u - F.lit(float(c))) * (u - F.lit(float(c))))
    if kind == "decay":
        return F.lit(a) * F.exp(F.lit(-term[2]) * u)
    if kind == "rise":
        return F.lit(a) * (F.lit(1.0) - F.exp(F.lit(-term[2]) * u))
    return F.lit(float(a))


def _shock(u: Column, terms) -> Column:
    acc = F.lit(0.0)
    for term in terms:
        acc = acc + _shock_term(u, term)
    return acc


def _by_profile(category: Column, profiles: Mapping[str, str], build) -> Column:
    expr = None
    for cat, prof in profiles.items():
        branch = build(prof)
        expr = F.when(category == F.lit(cat), branch) if expr is None else expr.when(category == F.lit(cat), branch)
    return F.lit(0.0) if expr is None else expr.otherwise(F.lit(0.0))


def scenario_columns(t: Column, n: Column, scenario: Scenario = Scenario(), slope: Column | None = None) -> dict[str, Column]:
    """Effect columns for week index ``t`` (double) in a calendar of ``n`` weeks."""
    cat = F.col("category")
    u = t - F.lit(float(scenario.shock_start))
    after = t >= F.lit(float(scenario.shock_start))
    seasonal = _by_profile(cat, scenario.profiles, lambda p: _seasonal(t, SEASONAL_TERMS[p]))
    shock = F.when(after, _by_profile(cat, scenario.profiles, lambda p: _shock(u, SHOCK_TERMS[p]))).otherwise(0.0)
    disruption = F.when(after, _shock_term(u, DISRUPTION)).otherwise(0.0)
    trend = (F.lit(scenario.trend) if slope is None else slope) * t / n
    return {
        "seasonal_effect": seasonal,
        "trend_effect": trend,
        "shock_effect": shock,
        "lead_time_disruption": disruption,
    }


# Scenarios as data: one row a scenario, and one a scenario and category with its terms.

SCENARIO_SCHEMA = "scenario string, shock_start double, trend double"
TERM_SCHEMA = (
    "scenario string, category string, "
    "seasonal array<struct<amplitude: double, angle: double, phase: double, fn: string>>, "
    "shock array<struct<kind: string, a: double, r: double, c: double>>"
)


def scenario_tables(spark: SparkSession, scenarios: Mapping[str, Scenario]) -> tuple[DataFrame, DataFrame]:
    """(scenarios, terms): the given scenarios as the two parameter tables that ``apply_scenarios`` reads."""
    heads = [(name, float(s.shock_start), float(s.trend)) for name, s in scenarios.items()]
    terms = []
    for name, s in scenarios.items():
        for category, profile in s.profiles.items():
            seasonal = [(float(a), 2 * math.pi * cycles, float(phase), fn) for a, cycles, phase, fn in SEASONAL_TERMS[profile]]
            shock = [(x[0], *(float(v) for v in x[1:]), *(None,) * (4 - len(x))) for x in SHOCK_TERMS[profile]]
            terms.append((name, category, seasonal, shock))
    return spark.createDataFrame(heads, SCENARIO_SCHEMA), spark.createDataFrame(terms, TERM_SCHEMA)


def term_columns(t: Column, n: Column) -> dict[str, Column]:
    """The effect columns folded from the terms on the row; no terms, no effect."""
    start = F.col("shock_start")
    u, after = t - start, t >= start

    def wave(total: Column, s: Column) -> Column:
        arg = s["angle"] * (t - s["phase"]) / F.lit(float(PERIOD_WEEKS))
        return total + s["amplitude"] * F.when(s["fn"] == "sin", F.sin(arg)).otherwise(F.cos(arg))

    def bump(total: Column, s: Column) -> Column:
        gone = u - s["c"]
        return total + F.when(s["kind"] == "gauss", s["a"] * F.exp(-s["r"] * gone * gone)).when(
            s["kind"] == "decay", s["a"] * F.exp(-s["r"] * u)
        ).when(s["kind"] == "rise", s["a"] * (F.lit(1.0) - F.exp(-s["r"] * u))).otherwise(s["a"])

    fold = lambda c, f: F.coalesce(F.aggregate(c, F.lit(0.0), f), F.lit(0.0))
    return {
        "seasonal_effect": fold("seasonal", wave),
        "trend_effect": F.col("trend") * t / n,
        "shock_effect": F.when(after, fold("shock", bump)).otherwise(0.0),
        "lead_time_disruption": F.when(after, _shock_term(u, DISRUPTION)).otherwise(0.0),
    }
