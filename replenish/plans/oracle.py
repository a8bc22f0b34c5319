"""Independent SQL oracle for the registered queries (DuckDB dialect).

Written from the formulas, not generated from the Spark plans: each query
re-derives demand, parameters, plans and settlement from the raw views
``lineitem``, ``orders`` and ``part``. Constants come from ``config`` so the
two sides cannot drift apart. Every literal is cast to DOUBLE (a bare
``0.25`` is DECIMAL in SQL), and rounding happens only in the final
projection, exactly where the Spark queries round.
"""

from __future__ import annotations

from ..config import DEFAULT, PlanConfig


def _d(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _ts(s: str) -> str:
    return f"TIMESTAMP '{s}'"


# The scenario formulas, written out by hand: t is the week index, u = t - 60 weeks
# since the shock; the part types stand for the five profiles as the queries assign them.
SCENARIO_SQL = {
    "seasonal_effect": """CASE category
    WHEN 'ECONOMY' THEN 0.3e0 * sin(2e0 * pi() * (t - 45e0) / 52e0)
    WHEN 'STANDARD' THEN 0.3e0 * sin(2e0 * pi() * (t - 45e0) / 52e0)
    WHEN 'LARGE' THEN 0.2e0 * sin(4e0 * pi() * t / 52e0) + 0.1e0 * sin(2e0 * pi() * t / 52e0)
    WHEN 'MEDIUM' THEN 0.15e0 * sin(2e0 * pi() * t / 52e0) + 0.15e0 * sin(2e0 * pi() * (t - 26e0) / 52e0)
    WHEN 'PROMO' THEN 0.25e0 * sin(2e0 * pi() * (t - 13e0) / 52e0)
    WHEN 'SMALL' THEN 0.3e0 * cos(2e0 * pi() * t / 52e0)
    ELSE 0e0 END""",
    "trend_effect": "0.05e0 * t / n",
    "shock_effect": """CASE WHEN t < 60e0 THEN 0e0 ELSE CASE category
    WHEN 'ECONOMY' THEN 0.5e0 * exp(-0.05e0 * (t - 60e0 - 15e0) * (t - 60e0 - 15e0))
    WHEN 'STANDARD' THEN 0.5e0 * exp(-0.05e0 * (t - 60e0 - 15e0) * (t - 60e0 - 15e0))
    WHEN 'LARGE' THEN -0.4e0 * exp(-0.05e0 * (t - 60e0)) + 0.2e0 * exp(-0.05e0 * (t - 60e0 - 40e0) * (t - 60e0 - 40e0))
    WHEN 'MEDIUM' THEN 0.8e0 * exp(-0.1e0 * (t - 60e0)) + 0.2e0
    WHEN 'PROMO' THEN 0.6e0 * exp(-0.03e0 * (t - 60e0 - 25e0) * (t - 60e0 - 25e0))
    WHEN 'SMALL' THEN 0.7e0 * (1e0 - exp(-0.1e0 * (t - 60e0)))
    ELSE 0e0 END END""",
    "lead_time_disruption": "CASE WHEN t < 60e0 THEN 0e0 ELSE 0.5e0 * (1e0 - exp(-0.05e0 * (t - 60e0))) END",
}


def _scenario_sql(start: float, trend: float) -> dict[str, str]:
    """The formulas with another start of the shock and another trend."""
    out = {k: v.replace("60e0", f"{start!r}e0") for k, v in SCENARIO_SQL.items()}
    return out | {"trend_effect": f"{trend!r}e0 * t / n"}


def _horner(coefs, x: str) -> str:
    out = f"{coefs[-1]!r}::DOUBLE"
    for c in reversed(coefs[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _quantile_sql(p: str) -> str:
    """The normal quantile by the published approximation (its coefficients are fixed values of ``policy_math``)."""
    from ..functions import policy_math as pm

    r = f"sqrt(-ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    mid = f"(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))"
    near, far = f"({r} - 1.6::DOUBLE)", f"({r} - 5.0::DOUBLE)"
    tail = (
        f"CASE WHEN {r} <= 5 THEN {_horner(pm._NEAR_NUM, near)} / {_horner(pm._NEAR_DEN, near)} "
        f"ELSE {_horner(pm._FAR_NUM, far)} / {_horner(pm._FAR_DEN, far)} END"
    )
    central = f"({p} - 0.5) * {_horner(pm._CENTRAL_NUM, mid)} / {_horner(pm._CENTRAL_DEN, mid)}"
    return (
        f"CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN abs({p} - 0.5) <= 0.425 THEN {central} "
        f"WHEN {p} < 0.5 THEN -({tail}) ELSE {tail} END END"
    )


def _buffer_case(cfg: PlanConfig, col: str = "category") -> str:
    if not cfg.buffers:
        return "CAST(NULL AS DOUBLE)"
    whens = " ".join(f"WHEN '{k}' THEN {_d(v)}" for k, v in cfg.buffers.items())
    return f"(CASE {col} {whens} END)"


def base_ctes(cfg: PlanConfig = DEFAULT) -> dict[str, str]:
    """Named CTE bodies; ``with_(names)`` assembles the ones a query needs."""
    train, test = _ts(cfg.train_cutoff), _ts(cfg.test_cutoff)
    from statistics import NormalDist

    from ..config import Z_95

    z = _d(Z_95 if cfg.service_level == 0.95 else NormalDist().inv_cdf(cfg.service_level))
    lag_w = "OVER (PARTITION BY product_id ORDER BY date)"
    ctes = {
        "d_lines": f"""
  SELECT l.l_partkey AS product_id,
         date_trunc('week', l.l_shipdate) AS date,
         l.l_quantity,
         CAST((((date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) % 49) + 49) % 49) AS DOUBLE)
           / {_d(8)} AS gap_weeks
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
        "d_weekly": """
  SELECT product_id, date, SUM(l_quantity) AS demand, MAX(gap_weeks) AS gap_weeks
  FROM d_lines GROUP BY product_id, date""",
        "demand": f"""
  SELECT w.product_id, p.p_type AS category, CAST(w.date AS TIMESTAMP) AS date, w.demand,
         GREATEST({_d(1)}, w.gap_weeks) AS lead_time
  FROM d_weekly w JOIN part p ON w.product_id = p.p_partkey""",
        "items": f"""
  SELECT p_partkey AS product_id, p_type AS category, CAST(p_retailprice AS DOUBLE) AS unit_cost,
         {_d(1.5)} + CAST(((p_partkey % 36) + 36) % 36 AS DOUBLE) / {_d(10)} AS stockout_cost_multiplier
  FROM part""",
        "train": f"SELECT * FROM demand WHERE date < {train}",
        "test": f"SELECT * FROM demand WHERE date >= {train} AND date < {test}",
        "hist": f"SELECT * FROM demand WHERE date < {test}",
        "scen_t": f"""
  SELECT *, CAST(date_diff('day', DATE '{cfg.calendar_start}', CAST(date AS DATE)) // 7 AS DOUBLE) AS t,
         CAST(date_diff('day', DATE '{cfg.calendar_start}', DATE '{cfg.calendar_end}') // 7 + 1 AS DOUBLE) AS n
  FROM demand""",
        "scen": f"""
  SELECT *, GREATEST({_d(0)}, demand * ({_d(1)} + seasonal_effect + trend_effect + shock_effect)) AS scenario_demand,
         GREATEST({_d(1)}, lead_time * ({_d(1)} + lead_time_disruption)) AS scenario_lead_time
  FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in SCENARIO_SQL.items())} FROM scen_t)""",
        "spine": f"""
  SELECT product_id, category, CAST(d AS TIMESTAMP) AS date FROM (
    SELECT p_partkey AS product_id, p_type AS category,
           unnest(generate_series({_ts(cfg.calendar_start)}, {_ts(cfg.calendar_end)}, INTERVAL 7 DAY)) AS d
    FROM part)""",
        "stats": """
  SELECT product_id, AVG(demand) AS demand_avg, STDDEV_SAMP(demand) AS demand_std,
         AVG(lead_time) AS lead_time_avg, STDDEV_SAMP(lead_time) AS lead_time_std
  FROM train GROUP BY product_id""",
        "params": f"""
  SELECT s.product_id, s.demand_avg, s.demand_std, s.lead_time_avg, s.lead_time_std,
         i.category, i.unit_cost, i.stockout_cost_multiplier,
         SQRT((2 * (s.demand_avg * {cfg.periods_per_year}) * {_d(cfg.order_cost)})
              / NULLIF(i.unit_cost * {_d(cfg.holding_rate)}, 0)) AS eoq,
         {z} * s.demand_std * SQRT(s.lead_time_avg) AS safety_stock,
         s.demand_avg * s.lead_time_avg + {z} * s.demand_std * SQRT(s.lead_time_avg) AS reorder_point
  FROM stats s JOIN items i ON s.product_id = i.product_id""",
        "hist_feat": f"""
  SELECT date, product_id, category, demand, lead_time,
         CAST(weekofyear(date) AS INTEGER) AS weekofyear,
         CAST(month(date) AS INTEGER) AS month,
         CAST(dayofweek(date) + 1 AS INTEGER) AS dayofweek,
         LAG(demand, 1) {lag_w} AS lag_demand,
         LAG(demand, 2) {lag_w} AS lag_demand_2,
         LAG(demand, 3) {lag_w} AS lag_demand_3,
         AVG(demand) OVER (PARTITION BY product_id ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
           AS demand_ma_4
  FROM hist""",
        "baseline": f"""
  SELECT t.date, t.product_id, t.category, p.demand_avg AS forecast_demand, t.demand AS actual_demand,
         t.lead_time, p.safety_stock, p.reorder_point,
         CASE WHEN p.demand_avg * t.lead_time + p.safety_stock > 0 THEN p.eoq ELSE {_d(0)} END AS order_quantity,
         p.demand_avg * t.lead_time + p.safety_stock AS required_inventory,
         p.unit_cost, p.stockout_cost_multiplier
  FROM test t JOIN params p ON t.product_id = p.product_id""",
        "ctx_rows": f"""
  SELECT f.date, f.product_id, f.category, f.demand AS actual_demand, f.lead_time,
         COALESCE(f.demand_ma_4, p.demand_avg) AS forecast_demand,
         p.demand_avg, p.eoq, p.safety_stock AS base_safety_stock, p.lead_time_avg,
         p.unit_cost, p.stockout_cost_multiplier
  FROM hist_feat f JOIN params p ON f.product_id = p.product_id
  WHERE f.date >= {train}""",
        "ctx_calc": f"""
  SELECT *,
         forecast_demand * ({_d(1)} + {_buffer_case(cfg)}) * lead_time
           + base_safety_stock * CASE WHEN lead_time > lead_time_avg THEN {_d(cfg.adaptive_factor)}
                                      ELSE {_d(1)} END AS c_required,
         base_safety_stock * CASE WHEN lead_time > lead_time_avg THEN {_d(cfg.adaptive_factor)}
                                  ELSE {_d(1)} END AS c_safety
  FROM ctx_rows""",
        "ctx_plan": f"""
  SELECT date, product_id, category, forecast_demand, actual_demand, lead_time,
         c_safety AS safety_stock,
         CASE WHEN c_required > 0 THEN c_required ELSE {_d(0)} END AS order_quantity,
         c_required AS required_inventory, unit_cost, stockout_cost_multiplier
  FROM ctx_calc""",
        "plans": f"""
  SELECT 'Traditional' AS policy, date, product_id, category, actual_demand, lead_time,
         unit_cost, stockout_cost_multiplier,
         demand_avg AS forecast_demand, base_safety_stock AS safety_stock,
         CASE WHEN demand_avg * lead_time + base_safety_stock > 0 THEN eoq ELSE {_d(0)} END AS order_quantity,
         demand_avg * lead_time + base_safety_stock AS required_inventory
  FROM ctx_calc
  UNION ALL
  SELECT 'Context Aware' AS policy, date, product_id, category, actual_demand, lead_time,
         unit_cost, stockout_cost_multiplier,
         forecast_demand, c_safety AS safety_stock,
         CASE WHEN c_required > 0 THEN c_required ELSE {_d(0)} END AS order_quantity,
         c_required AS required_inventory
  FROM ctx_calc""",
    }
    for name, src in (("sim_base", "baseline"), ("sim_ctx", "ctx_plan"), ("settled", "plans")):
        ctes[name + "_a"] = f"""
  SELECT *,
         CASE WHEN safety_stock IS NOT NULL AND actual_demand IS NOT NULL
              THEN LEAST(safety_stock, actual_demand) END AS fulfilled_demand,
         CASE WHEN safety_stock IS NOT NULL AND actual_demand IS NOT NULL
              THEN GREATEST({_d(0)}, safety_stock - actual_demand) END AS ending_inventory,
         CASE WHEN order_quantity > 0 THEN {_d(cfg.order_cost)} ELSE {_d(0)} END AS order_cost
  FROM {src}"""
        ctes[name + "_b"] = f"""
  SELECT *,
         CASE WHEN fulfilled_demand IS NOT NULL THEN GREATEST({_d(0)}, actual_demand - fulfilled_demand) END
           AS stockout,
         ending_inventory * (unit_cost * {_d(cfg.holding_rate)} / {_d(cfg.periods_per_year)}) AS holding_cost,
         CASE WHEN fulfilled_demand IS NOT NULL THEN
              CASE WHEN actual_demand > 0 THEN fulfilled_demand / actual_demand ELSE {_d(1)} END END
           AS service_level
  FROM {name}_a"""
        ctes[name] = f"""
  SELECT *, stockout * unit_cost * stockout_cost_multiplier AS stockout_cost,
         holding_cost + stockout * unit_cost * stockout_cost_multiplier + order_cost AS total_cost
  FROM {name}_b"""
    return ctes


# Which CTEs each named CTE reads (assembled in this order).
_DEPS = {
    "d_weekly": ["d_lines"],
    "demand": ["d_weekly"],
    "train": ["demand"],
    "test": ["demand"],
    "hist": ["demand"],
    "scen_t": ["demand"],
    "scen": ["scen_t"],
    "stats": ["train"],
    "params": ["stats", "items"],
    "hist_feat": ["hist"],
    "baseline": ["test", "params"],
    "ctx_rows": ["hist_feat", "params"],
    "ctx_calc": ["ctx_rows"],
    "ctx_plan": ["ctx_calc"],
    "plans": ["ctx_calc"],
}
for _n, _src in (("sim_base", "baseline"), ("sim_ctx", "ctx_plan"), ("settled", "plans")):
    _DEPS[_n + "_a"] = [_src]
    _DEPS[_n + "_b"] = [_n + "_a"]
    _DEPS[_n] = [_n + "_b"]


def with_(*names: str, cfg: PlanConfig = DEFAULT) -> str:
    ctes = base_ctes(cfg)
    order: list[str] = []

    def visit(n):
        for dep in _DEPS.get(n, []):
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]}\n)" for n in order) + "\n"


def _r(col: str, digits: int = 6, alias: str | None = None) -> str:
    # "+ 0.0" turns a rounded -0.0 into 0.0, as the Spark side does.
    return f"(ROUND({col}, {digits}) + {_d(0)}) AS {alias or col}"


SETTLE_SELECT = (
    "date, product_id, category, " + ", ".join(
        _r(c) for c in ("actual_demand", "ending_inventory", "fulfilled_demand", "stockout", "holding_cost",
                        "stockout_cost", "order_cost", "total_cost", "service_level")
    )
)

KPI_SELECT = ", ".join(
    [
        _r("SUM(holding_cost)", 2, "total_holding_cost"),
        _r("SUM(stockout_cost)", 2, "total_stockout_cost"),
        _r("SUM(order_cost)", 2, "total_order_cost"),
        _r("SUM(total_cost)", 2, "total_cost"),
        _r("AVG(service_level)", 6, "avg_service_level"),
        _r("CAST(SUM(CASE WHEN stockout > 0 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*)", 6, "stockout_frequency"),
        _r("AVG(ending_inventory)", 6, "avg_inventory"),
    ]
)

FEATURE_SELECT = (
    "date, product_id, category, demand, lead_time, weekofyear, month, dayofweek, "
    "lag_demand, lag_demand_2, lag_demand_3, ROUND(demand_ma_4, 6) AS demand_ma_4, "
    "CASE WHEN (((product_id * 7919 + CAST(date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) AS BIGINT) * 104729)"
    " % 1000) + 1000) % 1000 < 100 THEN 1 ELSE 0 END AS promo_flag, "
    "CASE WHEN month IN (11, 12) THEN 1 ELSE 0 END AS holiday_flag"
)


_NOT_NULL = " AND ".join(
    f"{c} IS NOT NULL"
    for c in ("product_id", "date", "category", "demand", "lead_time", "lag_demand", "lag_demand_2", "lag_demand_3", "demand_ma_4")
)


def _metric_rows(src: str, rows, money=()) -> str:
    parts = []
    for label, m, kind in rows:
        digits = 2 if m in money else 6
        t, c = f"t_{m}", f"c_{m}"
        gain = f"({c} - {t}) * 100.0" if kind == "points" else f"(1.0 - {c} / NULLIF({t}, 0)) * 100.0"
        parts.append(
            f"SELECT '{label}' AS Metric, ROUND({t}, {digits}) AS Traditional, ROUND({c}, {digits}) AS Context_Aware, "
            f"ROUND({gain}, 6) AS Improvement_Percent FROM {src}"
        )
    return "\nUNION ALL\n".join(parts)


def _pivot(metrics) -> str:
    out = []
    for m in metrics:
        out.append(f"MAX(CASE WHEN policy = 'Traditional' THEN {m} END) AS t_{m}")
        out.append(f"MAX(CASE WHEN policy = 'Context Aware' THEN {m} END) AS c_{m}")
    return ", ".join(out)


def oracle_sql(cfg: PlanConfig = DEFAULT) -> dict[str, str]:
    w = lambda *n: with_(*n, cfg=cfg)
    train, test = _ts(cfg.train_cutoff), _ts(cfg.test_cutoff)
    kpi_raw = (
        "SELECT policy, SUM(total_cost) AS total_cost, AVG(service_level) AS avg_service_level, "
        "CAST(SUM(CASE WHEN stockout > 0 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS stockout_frequency, "
        "AVG(ending_inventory) AS avg_inventory FROM settled GROUP BY policy"
    )
    acc_raw = (
        "SELECT policy, AVG(ABS(forecast_demand - actual_demand)) AS MAE, "
        "SQRT(AVG((forecast_demand - actual_demand) * (forecast_demand - actual_demand))) AS RMSE, "
        "AVG(CASE WHEN actual_demand <> 0 THEN ABS(forecast_demand - actual_demand) / actual_demand "
        "ELSE 0.0 END) AS MAPE FROM plans GROUP BY policy"
    )
    cat_raw = (
        "SELECT category, "
        "AVG(CASE WHEN policy = 'Traditional' THEN service_level END) AS t_sl, "
        "AVG(CASE WHEN policy = 'Context Aware' THEN service_level END) AS c_sl, "
        "SUM(CASE WHEN policy = 'Traditional' THEN total_cost END) AS t_cost, "
        "SUM(CASE WHEN policy = 'Context Aware' THEN total_cost END) AS c_cost "
        "FROM settled GROUP BY category "
        "HAVING COUNT(CASE WHEN policy = 'Traditional' THEN 1 END) > 0 "
        "AND COUNT(CASE WHEN policy = 'Context Aware' THEN 1 END) > 0"
    )
    v8_raw = (
        "SELECT SUM(stockout) AS Stockouts, AVG(ending_inventory) AS Inventory, date, policy AS Simulation "
        "FROM settled GROUP BY date, policy"
    )
    v9_raw = (
        "SELECT d.date AS Date, d.product_id AS Product, d.category AS Category, d.demand AS Demand, "
        "c.forecast_demand AS Context_Aware_Forecast, c.demand_avg AS Traditional_Forecast "
        "FROM demand d LEFT JOIN ctx_rows c ON d.date = c.date AND d.product_id = c.product_id"
    )
    return {
        "weekly_demand": w("demand") + "SELECT product_id, category, date, demand, lead_time FROM demand",
        "calendar_spine": w("spine") + "SELECT product_id, category, date FROM spine",
        "scenario_demand": w("scen")
        + "SELECT product_id, category, date, demand, "
        + ", ".join(_r(c) for c in ("seasonal_effect", "trend_effect", "shock_effect", "scenario_demand"))
        + " FROM scen",
        "scenario_lead_time": w("scen")
        + "SELECT product_id, date, lead_time, "
        + ", ".join(_r(c) for c in ("lead_time_disruption", "scenario_lead_time"))
        + " FROM scen",
        "scenario_comparison": w("scen_t")
        + " UNION ALL ".join(
            f"SELECT '{name}' AS scenario, product_id, date, {_r('seasonal_effect')}, {_r('trend_effect')}, {_r('shock_effect')}, "
            f"ROUND(GREATEST({_d(0)}, demand * ({_d(1)} + seasonal_effect + trend_effect + shock_effect)), 6) + 0.0 AS scenario_demand, "
            f"ROUND(GREATEST({_d(1)}, lead_time * ({_d(1)} + lead_time_disruption)), 6) + 0.0 AS scenario_lead_time "
            f"FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _scenario_sql(start, trend).items())} FROM scen_t)"
            for name, start, trend in (("given", 60, 0.05), ("late_shock", 100, 0.05), ("steep_trend", 60, 0.15))
        ),
        "contract_report": w("demand", "items")
        + f"""SELECT rule, n_products, n_breaks FROM (
  SELECT 'null_key' AS rule, count(DISTINCT product_id) AS n_products, count(*) AS n_breaks, min(product_id) AS example
    FROM demand WHERE product_id IS NULL OR date IS NULL
  UNION ALL SELECT 'duplicate_week', count(DISTINCT product_id), CAST(coalesce(sum(n - 1), 0) AS BIGINT), min(product_id)
    FROM (SELECT product_id, date, count(*) AS n FROM demand GROUP BY ALL) WHERE n > 1
  UNION ALL SELECT 'several_categories', count(*), CAST(coalesce(sum(n - 1), 0) AS BIGINT), min(product_id)
    FROM (SELECT product_id, count(DISTINCT category) AS n FROM demand GROUP BY ALL) WHERE n > 1
  UNION ALL SELECT 'off_calendar', count(DISTINCT product_id), count(*), min(product_id) FROM demand
    WHERE date < DATE '{cfg.calendar_start}' OR date > DATE '{cfg.test_cutoff}' OR dayofweek(date) <> 1
  UNION ALL SELECT 'negative_demand', count(DISTINCT product_id), count(*), min(product_id) FROM demand WHERE demand < 0
  UNION ALL SELECT 'item_missing', count(DISTINCT product_id), count(*), min(product_id) FROM demand
    WHERE product_id NOT IN (SELECT product_id FROM items)
  UNION ALL SELECT 'duplicate_item', count(*), CAST(coalesce(sum(n - 1), 0) AS BIGINT), min(product_id)
    FROM (SELECT product_id, count(*) AS n FROM items GROUP BY ALL) WHERE n > 1)""",
        "buffer_coverage": w("demand")
        + f"""SELECT category, category <> 'STANDARD' AS matched,
  CASE WHEN category = 'STANDARD' THEN {_d(0.12)} ELSE {_buffer_case(cfg)} END AS buffer,
  count(*) AS n_rows, count(DISTINCT product_id) AS n_products FROM demand GROUP BY category""",
        "context_plan_buffers": with_("ctx_plan", cfg=cfg.with_(buffers=dict(cfg.buffers) | {"STANDARD": 0.12}))
        + "SELECT date, product_id, category, "
        + ", ".join(_r(c) for c in ("forecast_demand", "actual_demand", "lead_time", "safety_stock", "order_quantity", "required_inventory"))
        + " FROM ctx_plan",
        "service_level_policies": w("stats", "items")
        + f"""SELECT product_id, service_level, ROUND(z, 6) + 0.0 AS z,
  ROUND(z * demand_std * sqrt(lead_time_avg), 6) + 0.0 AS safety_stock,
  ROUND(demand_avg * lead_time_avg + z * demand_std * sqrt(lead_time_avg), 6) + 0.0 AS reorder_point
FROM (SELECT s.*, l.service_level, {_quantile_sql('l.service_level')} AS z
  FROM stats s JOIN (SELECT product_id, unnest([0.55, 0.75, 0.9, 0.95, 0.99, 0.999, 0.9999, 0.02, 0.0001, 0.0, 1.0, NULL]::DOUBLE[]) AS service_level
    FROM items) l ON l.product_id = s.product_id)""",
        "refreshed_stats": w("stats")
        + "SELECT product_id, "
        + ", ".join(_r(c) for c in ("demand_avg", "demand_std", "lead_time_avg", "lead_time_std"))
        + " FROM stats",
        "stored_weeks": w("test") + "SELECT product_id, date, demand, lead_time FROM test",
        "densified_demand": w("spine", "demand")
        + "SELECT s.product_id, s.category, s.date, COALESCE(d.demand, CAST(0 AS DOUBLE)) AS demand, d.lead_time, "
        "d.demand IS NOT NULL AS observed FROM spine s LEFT JOIN demand d "
        "ON s.product_id = d.product_id AND s.date = d.date",
        "item_info": w("items") + "SELECT * FROM items",
        "demand_profile": w("demand")
        + "SELECT COUNT(*) AS n_rows, MIN(date) AS min_date, MAX(date) AS max_date, "
        "COUNT(DISTINCT product_id) AS n_products, COUNT(DISTINCT category) AS n_categories FROM demand",
        "split_profile": w("demand")
        + f"SELECT split, COUNT(*) AS n_rows, MIN(date) AS min_date, MAX(date) AS max_date FROM ("
        f"SELECT CASE WHEN date < {train} THEN 'train' WHEN date < {test} THEN 'test' END AS split, date "
        "FROM demand) WHERE split IS NOT NULL GROUP BY split",
        "training_set": w("train") + "SELECT product_id, category, date, demand, lead_time FROM train",
        "testing_set": w("test") + "SELECT product_id, category, date, demand, lead_time FROM test",
        "policy_params": w("params")
        + "SELECT product_id, "
        + ", ".join(
            _r(c)
            for c in ("demand_avg", "demand_std", "lead_time_avg", "lead_time_std")
        )
        + ", category, "
        + ", ".join(_r(c) for c in ("unit_cost", "stockout_cost_multiplier", "eoq", "safety_stock", "reorder_point"))
        + " FROM params",
        "baseline_plan": w("baseline")
        + "SELECT date, product_id, category, "
        + ", ".join(
            _r(c)
            for c in ("forecast_demand", "actual_demand", "lead_time", "safety_stock", "reorder_point",
                      "order_quantity", "required_inventory")
        )
        + " FROM baseline",
        "calendar_features": w("demand")
        + "SELECT product_id, date, CAST(weekofyear(date) AS INTEGER) AS weekofyear, "
        "CAST(month(date) AS INTEGER) AS month, CAST(dayofweek(date) + 1 AS INTEGER) AS dayofweek FROM demand",
        "signals": w("demand")
        + "SELECT product_id, date, CAST(month(date) AS INTEGER) AS month, "
        "CASE WHEN (((product_id * 7919 + CAST(date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) AS BIGINT)"
        " * 104729) % 1000) + 1000) % 1000 < 100 THEN 1 ELSE 0 END AS promo_flag, "
        "CASE WHEN month(date) IN (11, 12) THEN 1 ELSE 0 END AS holiday_flag FROM demand",
        "lag_features": w("hist_feat")
        + f"SELECT product_id, date, demand, lag_demand, lag_demand_2, lag_demand_3 FROM hist_feat WHERE date < {train}",
        "moving_average": w("hist_feat")
        + f"SELECT product_id, date, demand, ROUND(demand_ma_4, 6) AS demand_ma_4 FROM hist_feat WHERE date < {train}",
        "training_matrix": w("hist_feat")
        + f"SELECT {FEATURE_SELECT} FROM hist_feat WHERE date < {train} "
        f"AND {_NOT_NULL}",
        "model_inputs": w("hist_feat")
        + "SELECT category, COUNT(*) AS n_rows, " + _r("SUM(demand)", 6, "sum_demand") + ", "
        + ", ".join(_r(f"{g.upper()}(CAST({c} AS DOUBLE))", 6, f"{g}_{c}") for c in cfg.features for g in ("min", "max"))
        + f" FROM (SELECT {FEATURE_SELECT.replace('ROUND(demand_ma_4, 6) AS ', '')} FROM hist_feat WHERE date < {train}) "
        + f"WHERE {_NOT_NULL} GROUP BY category",
        "assembled_features": w("hist_feat")
        + "SELECT product_id, date, " + ", ".join(_r(f"CAST({c} AS DOUBLE)", 6, f"x_{c}") for c in cfg.features)
        + f" FROM (SELECT {FEATURE_SELECT.replace('ROUND(demand_ma_4, 6) AS ', '')} FROM hist_feat WHERE date < {train}) "
        + f"WHERE {_NOT_NULL}",
        "forecast_coverage": w("test", "train")
        + "SELECT category, COUNT(*) AS n_test, COUNT(CASE WHEN category IN (SELECT category FROM train) THEN 1 END) "
        "AS n_forecast FROM test GROUP BY category",
        "test_features_actuals": w("test")
        + "SELECT date, product_id, category, demand, lead_time, CAST(weekofyear(date) AS INTEGER) AS weekofyear, "
        "CAST(month(date) AS INTEGER) AS month, CAST(dayofweek(date) + 1 AS INTEGER) AS dayofweek, "
        "demand AS lag_demand, demand AS lag_demand_2, demand AS lag_demand_3, ROUND(demand, 6) AS demand_ma_4, "
        "CASE WHEN (((product_id * 7919 + CAST(date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) AS BIGINT)"
        " * 104729) % 1000) + 1000) % 1000 < 100 THEN 1 ELSE 0 END AS promo_flag, "
        "CASE WHEN month(date) IN (11, 12) THEN 1 ELSE 0 END AS holiday_flag FROM test",
        "test_features_carry": w("hist_feat") + f"SELECT {FEATURE_SELECT} FROM hist_feat WHERE date >= {train}",
        "context_plan": w("ctx_plan")
        + "SELECT date, product_id, category, "
        + ", ".join(
            _r(c)
            for c in ("forecast_demand", "actual_demand", "lead_time", "safety_stock", "order_quantity",
                      "required_inventory")
        )
        + " FROM ctx_plan",
        "settle_baseline": w("sim_base") + f"SELECT {SETTLE_SELECT} FROM sim_base",
        "settle_context": w("sim_ctx") + f"SELECT {SETTLE_SELECT} FROM sim_ctx",
        "kpi_baseline": w("sim_base") + f"SELECT {KPI_SELECT} FROM sim_base",
        "kpi_overall": w("settled") + f"SELECT policy, {KPI_SELECT} FROM settled GROUP BY policy",
        "plan_comparison": w("settled")
        + f", k AS ({kpi_raw}), wd AS (SELECT "
        + _pivot(["total_cost", "avg_service_level", "stockout_frequency", "avg_inventory"])
        + " FROM k)\n"
        + _metric_rows(
            "wd",
            (
                ("Total Cost", "total_cost", "percent"),
                ("Service Level", "avg_service_level", "points"),
                ("Stockout Frequency", "stockout_frequency", "percent"),
                ("Avg Inventory", "avg_inventory", "percent"),
            ),
            money=("total_cost",),
        ),
        "category_comparison": w("settled")
        + f", cc AS ({cat_raw}) SELECT category, ROUND(t_sl, 6) AS Traditional_Service_Level, "
        "ROUND(c_sl, 6) AS Context_Aware_Service_Level, ROUND((c_sl - t_sl) * 100.0, 6) AS Service_Level_Improvement, "
        "ROUND(t_cost, 2) AS Traditional_Cost, ROUND(c_cost, 2) AS Context_Aware_Cost, "
        "ROUND((1.0 - c_cost / NULLIF(t_cost, 0)) * 100.0, 6) AS Cost_Reduction FROM cc",
        "forecast_accuracy": w("plans")
        + f", a AS ({acc_raw}), wd AS (SELECT "
        + _pivot(["MAE", "RMSE", "MAPE"])
        + " FROM a)\n"
        + _metric_rows("wd", (("MAE", "MAE", "percent"), ("RMSE", "RMSE", "percent"), ("MAPE", "MAPE", "percent"))),
        "product_comparison": w("settled")
        + ", pc AS (SELECT product_id, "
        "SUM(CASE WHEN policy = 'Traditional' THEN total_cost END) AS traditional_cost, "
        "SUM(CASE WHEN policy = 'Context Aware' THEN total_cost END) AS context_cost FROM settled "
        "GROUP BY product_id HAVING COUNT(CASE WHEN policy = 'Traditional' THEN 1 END) > 0 "
        "AND COUNT(CASE WHEN policy = 'Context Aware' THEN 1 END) > 0) "
        "SELECT product_id, ROUND(traditional_cost, 2) AS traditional_cost, ROUND(context_cost, 2) AS context_cost, "
        "category, ROUND(traditional_cost - context_cost, 2) AS cost_saving, "
        "ROUND((traditional_cost - context_cost) / NULLIF(traditional_cost, 0) * 100.0, 6) AS saving_percentage "
        "FROM pc JOIN (SELECT p_partkey AS product_id, p_type AS category FROM part) USING (product_id) ORDER BY traditional_cost - context_cost DESC NULLS LAST, product_id ASC LIMIT 10",
        "stockouts_inventory_over_time": w("settled")
        + f"SELECT ROUND(Stockouts, 6) AS Stockouts, ROUND(Inventory, 6) AS Inventory, date, Simulation FROM ({v8_raw})",
        "forecast_comparison": w("demand", "ctx_rows")
        + f"SELECT Date, Product, Category, Demand, ROUND(Context_Aware_Forecast, 6) AS Context_Aware_Forecast, "
        f"ROUND(Traditional_Forecast, 6) AS Traditional_Forecast FROM ({v9_raw})",
        "service_level_by_category": w("settled")
        + f", cc AS ({cat_raw}) SELECT category, ROUND(SUM(c_sl), 6) AS sum_context_aware_service_level, "
        "ROUND(SUM(t_sl), 6) AS sum_traditional_service_level FROM cc GROUP BY category",
        "cost_by_category": w("settled")
        + f", cc AS ({cat_raw}) SELECT category, ROUND(SUM(c_cost), 2) AS sum_context_aware_cost, "
        "ROUND(SUM(t_cost), 2) AS sum_traditional_cost FROM cc GROUP BY category",
        "weekly_inventory": w("settled")
        + f"SELECT date_trunc('week', date) AS week, Simulation, ROUND(SUM(Inventory), 6) AS sum_inventory "
        f"FROM ({v8_raw}) GROUP BY 1, 2",
        "weekly_stockouts": w("settled")
        + f"SELECT date_trunc('week', date) AS week, Simulation, ROUND(SUM(Stockouts), 6) AS sum_stockouts "
        f"FROM ({v8_raw}) GROUP BY 1, 2",
        "weekly_demand_vs_forecast": w("demand", "ctx_rows")
        + f"SELECT date_trunc('week', Date) AS week, ROUND(SUM(Demand), 2) AS sum_demand, "
        f"ROUND(SUM(Context_Aware_Forecast), 2) AS sum_context_aware_forecast, "
        f"ROUND(SUM(Traditional_Forecast), 2) AS sum_traditional_forecast FROM ({v9_raw}) GROUP BY 1",
    }
