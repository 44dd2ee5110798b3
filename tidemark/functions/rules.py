"""Column-level rules shared by the layer jobs: CASE classifications, time
differences and guarded arithmetic. All are built-in Catalyst expressions, so
they stay inside whole-stage codegen (no Python UDFs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(as_of) -> Column:
    """The fixed ``as_of`` instant (datetime, or date at midnight) as TIMESTAMP_NTZ."""
    fmt = "%Y-%m-%d %H:%M:%S" if hasattr(as_of, "hour") else "%Y-%m-%d 00:00:00"
    return F.lit(as_of.strftime(fmt)).cast("timestamp_ntz")


# ---------------------------------------------------------------- arithmetic

def r6(c: str | Column) -> Column:
    """Round a floating aggregate to 6 places so results do not depend on the
    order in which partitions were summed."""
    return F.round(col(c), 6)


def avg_exact(c: str | Column) -> Column:
    """Mean of a DECIMAL column as DOUBLE: exact decimal sum divided by count.

    Independent of summation order (unlike a double running mean)."""
    c = col(c)
    return F.sum(c).cast("double") / F.count(c)


def avg_round(c: str | Column, in_scale: int, out_scale: int) -> Column:
    """ROUND(AVG(x), out_scale) for a measure with ``in_scale`` decimals, averaged
    exactly in DECIMAL (HALF_UP on the exact mean, as a numeric column would),
    returned as DOUBLE. Avoids rounding ties flipping with summation order."""
    d = col(c).cast(f"decimal(18,{in_scale})")
    return F.round(F.sum(d) / F.count(d), out_scale).cast("double")


def dround(c: str | Column, out_scale: int, in_scale: int = 6) -> Column:
    """ROUND of a value that has at most ``in_scale`` decimals, done in DECIMAL
    (exact HALF_UP) and returned as DOUBLE — a double product such as
    131.9 × 0.95 is 125.30499… and would round the wrong way."""
    return F.round(col(c).cast(f"decimal(28,{in_scale})"), out_scale).cast("double")


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL (the reference divides unguarded)."""
    return F.try_divide(a, b)


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Whole elapsed minutes, as TIMESTAMPDIFF(MINUTE, start, end)."""
    return F.timestamp_diff("MINUTE", col(start), col(end))


def hours_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("HOUR", col(start), col(end))


def count_if(cond: Column) -> Column:
    """COUNT(CASE WHEN cond THEN 1 END)."""
    return F.count(F.when(cond, F.lit(1)))


def sum_if(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) — 0 (not NULL) on empty groups with rows."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


# ------------------------------------------------------------ order domain

def segment_type(total_amount: Column, high: float = 500, medium: float = 100) -> Column:
    return (F.when(total_amount >= high, "high_value")
            .when(total_amount >= medium, "medium_value")
            .otherwise("low_value"))


def churn_alert(last_order_days: Column) -> Column:
    # Fixed labels: churn risk / needs attention / normal.
    return (F.when(last_order_days > 30, "流失风险")
            .when(last_order_days > 7, "需要关注")
            .otherwise("正常"))


# ------------------------------------------------------------- grid domain

def frequency_stability(freq: Column) -> Column:
    return (F.when(freq.between(49.9, 50.1), "STABLE")
            .when(freq.between(49.8, 50.2), "ACCEPTABLE")
            .otherwise("UNSTABLE"))


def voltage_quality(grid_kv: Column, device_v: Column) -> Column:
    return (F.when((grid_kv > 750) & (device_v > 240), "EXCELLENT")
            .when((grid_kv > 600) & (device_v > 230), "GOOD")
            .when(device_v > 220, "ACCEPTABLE")
            .otherwise("POOR"))


def device_health_score(efficiency: Column, temperature: Column, status: Column) -> Column:
    bonus = F.when(status == "ACTIVE", F.lit(0.3)).otherwise(F.lit(0.1))
    return (efficiency * 0.4 + (F.lit(250) - temperature) * 0.003 + bonus) * 100


def grid_efficiency(supply: Column, demand: Column, efficiency: Column) -> Column:
    return safe_div(supply, demand) * efficiency * 100


def risk_level(emergency: Column, temperature: Column, efficiency: Column, balance: Column) -> Column:
    return (F.when((emergency == "CRITICAL") | (temperature > 75), "HIGH_RISK")
            .when((emergency == "HIGH") | (efficiency < 0.85), "MEDIUM_RISK")
            .when(balance != "BALANCED", "LOW_RISK")
            .otherwise("NORMAL"))


def operational_status(freq: Column, efficiency: Column) -> Column:
    return (F.when(freq.between(49.9, 50.1) & (efficiency > 0.95), "OPTIMAL")
            .when(freq.between(49.8, 50.2) & (efficiency > 0.90), "GOOD")
            .when(efficiency > 0.85, "ACCEPTABLE")
            .otherwise("NEEDS_ATTENTION"))


def dashboard_status(op_status: Column, risk: Column) -> Column:
    return (F.when(op_status == "OPTIMAL", "NORMAL")
            .when(op_status == "GOOD", "NORMAL")
            .when(op_status == "ACCEPTABLE", "WARNING")
            .when(op_status == "NEEDS_ATTENTION", "CRITICAL")
            .when(risk == "HIGH_RISK", "CRITICAL")
            .when(risk == "MEDIUM_RISK", "WARNING")
            .otherwise("MAINTENANCE"))


def temperature_from_health(health: Column) -> Column:
    return (F.when(health > 90, F.lit(25.0) + (F.lit(100) - health) * 2)
            .when(health > 80, F.lit(35.0) + (F.lit(90) - health) * 3)
            .when(health > 70, F.lit(45.0) + (F.lit(80) - health) * 4)
            .otherwise(F.lit(65.0) + (F.lit(70) - health) * 2))


def region_temperature_band(avg_health: Column) -> Column:
    return (F.when(avg_health > 90, F.lit(30.0)).when(avg_health > 80, F.lit(40.0))
            .when(avg_health > 70, F.lit(50.0)).otherwise(F.lit(60.0)))


def maintenance_to_status(ms: Column) -> Column:
    """Source maintenance_status → device status (NORMAL/WARNING/MAINTENANCE/CRITICAL)."""
    return (F.when(ms == "NORMAL", "NORMAL").when(ms == "WARNING", "WARNING")
            .when(ms == "MAINTENANCE", "MAINTENANCE").otherwise("CRITICAL"))


def maintenance_to_active(ms: Column) -> Column:
    """maintenance_status → ACTIVE / MAINTENANCE / INACTIVE (device dimension conform)."""
    return (F.when(ms.isin("NORMAL", "WARNING"), "ACTIVE")
            .when(ms == "MAINTENANCE", "MAINTENANCE").otherwise("INACTIVE"))


def region_prefix(c: Column) -> Column:
    """First two characters (character-based, CJK safe)."""
    return F.substring(c, 1, 2)


# City prefix → grid company, with the fallback label.
CITY_TO_GRID = [
    ("北京", "华北电网"),
    ("上海", "华东电网"),
    ("广州", "华南电网"),
    ("成都", "西南电网"),
    ("西安", "西北电网"),
    ("大连", "东北电网"),
]
OTHER_GRID = "其他电网"


def city_to_grid(prefix: Column) -> Column:
    expr = None
    for city, grid in CITY_TO_GRID:
        expr = F.when(prefix == city, grid) if expr is None else expr.when(prefix == city, grid)
    return expr.otherwise(OTHER_GRID)


def reliability_rating(avg_eff: Column) -> Column:
    return (F.when(avg_eff > 0.95, "A+").when(avg_eff > 0.90, "A")
            .when(avg_eff > 0.85, "B+").otherwise("B"))


# Fixed report texts (risk, trend, advice) of the regional report.
RISK_MEDIUM = "MEDIUM_运行异常较多，优化调度"
RISK_HIGH = "HIGH_设备故障较多，紧急维护"
RISK_LOW = "LOW_运行正常，保持现状"
TREND_STABLE = "STABLE_运行稳定"
TREND_IMPROVING = "IMPROVING_效率持续提升"
TREND_DECLINING = "DECLINING_效率下降"
ADVICE_COOLING = "建议优化设备散热系统，降低运行温度"
ADVICE_REPAIR = "建议紧急维护故障设备，避免连锁反应"
ADVICE_KEEP = "建议继续保持当前运行策略，定期优化调度算法"
REPORT_TYPE = "智能电网综合运行报表"


def performance_trend(avg_eff: Column) -> Column:
    return (F.when(avg_eff > 0.94, TREND_STABLE).when(avg_eff > 0.88, TREND_IMPROVING)
            .otherwise(TREND_DECLINING))


def risk_assessment(avg_temp: Column, n_critical: Column | None = None) -> Column:
    e = F.when(avg_temp > 65, RISK_MEDIUM)
    if n_critical is not None:
        e = e.when(n_critical > 3, RISK_HIGH)
    return e.otherwise(RISK_LOW)


def advice(avg_temp: Column, n_critical: Column | None = None) -> Column:
    e = F.when(avg_temp > 65, ADVICE_COOLING)
    if n_critical is not None:
        e = e.when(n_critical > 3, ADVICE_REPAIR)
    return e.otherwise(ADVICE_KEEP)


def efficiency_grade(eff: Column) -> Column:
    # Fixed labels: excellent / good / needs improvement.
    return F.when(eff >= 0.95, "优秀").when(eff >= 0.90, "良好").otherwise("需改进")


def voltage_rule(v: Column) -> Column:
    # Fixed labels: normal / abnormal.
    return F.when(v.between(200, 240), "正常").otherwise("异常")


def frequency_rule(f: Column) -> Column:
    return F.when(f.between(49.5, 50.5), "正常").otherwise("异常")
