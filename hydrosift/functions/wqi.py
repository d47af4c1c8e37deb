"""Water-quality index and rule columns as native Column expressions.

All of these stay inside whole-stage codegen: no Python UDF is involved.

Missing values: a NULL index gives a NULL class / risk / alert by default
(``null_mode="null"``).  ``null_mode="fallback"`` reproduces the study, where
a missing index compares false everywhere and lands in the last branch.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrosift.sources.lookups import BIS_LIMITS, NSF_PARAMS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _mapped(params: Mapping, table: Mapping, missing: str) -> list[tuple]:
    """(column, its table entry) of the parameters to use; one without a column
    is an error unless ``missing`` is "skip"."""
    absent = [p for p in table if p not in params]
    if absent and missing != "skip":
        raise ValueError(f"no column for {', '.join(absent)}; pass missing='skip' to leave them out")
    return [(_c(params[p]).cast("double"), p, entry) for p, entry in table.items() if p in params]


def _weighted_mean(terms: list[tuple[Column, Column, float]]) -> Column:
    """Mean of the sub-indices by weight over the inputs that are not NULL; NULL
    when all are.  The input is tested, so a sub-index is computed once."""
    total = reduce(lambda x, y: x + y, [F.coalesce(q * F.lit(w), F.lit(0.0)) for _, q, w in terms], F.lit(0.0))
    weight = reduce(lambda x, y: x + y, [F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, _, w in terms], F.lit(0.0))
    return F.when(weight > 0, total / weight)


def bis_wqi(params: Mapping[str, str | Column], limits: Mapping = BIS_LIMITS, missing: str = "raise") -> Column:
    """Weighted mean of sub-indices over the parameters present in the row.

    ``params`` maps a limit name to its column.  Weight ``1/limit`` (a range
    uses its high end); sub-index ``value/limit*100``, for pH
    ``|v-7|/1.5*100``.  NULL when no parameter is present.
    """
    def term(v: Column, name: str, limit) -> tuple[Column, Column, float]:
        high = limit[1] if isinstance(limit, tuple) else limit
        return v, (F.abs(v - 7.0) / (8.5 - 7.0) * 100 if name == "ph" else v / high * 100), 1 / high
    return _weighted_mean([term(*m) for m in _mapped(params, limits, missing)])


def nsf_wqi(params: Mapping[str, str | Column], table: Mapping = NSF_PARAMS, missing: str = "raise") -> Column:
    """NSF-style surface-water index (C2): sub-index 100 at or below the ideal,
    else ``max(0, 100*(std-v)/(std-ideal))``; weighted mean over present values."""
    def term(v: Column, name: str, entry: tuple) -> tuple[Column, Column, float]:
        ideal, limit, weight = entry
        falling = F.greatest(F.lit(0.0), 100 * (F.lit(limit) - v) / (limit - ideal))
        return v, F.when(v <= ideal, F.lit(100.0)).when(v.isNotNull(), falling), weight
    return _weighted_mean([term(*m) for m in _mapped(params, table, missing)])


def _bands(x: Column, branches, last, null_mode: str) -> Column:
    expr = None
    if null_mode == "null":
        expr = F.when(x.isNull(), F.lit(None).cast("string"))
    for cond, label in branches:
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(last)


def wqi_class_gw(wqi, null_mode: str = "null") -> Column:
    """Ground-water class, higher is worse."""
    x = _c(wqi)
    return _bands(x, [(x <= 50, "Excellent"), (x <= 100, "Good"), (x <= 200, "Poor"),
                      (x <= 300, "Very Poor")], "Unsuitable", null_mode)


def wqi_class_gw4(wqi, null_mode: str = "null") -> Column:
    """Four-band ground-water class used for plotting (C4)."""
    x = _c(wqi)
    return _bands(x, [(x <= 50, "Excellent"), (x <= 100, "Good"), (x <= 200, "Poor")],
                  "Very Poor", null_mode)


def wqi_class_sw(wqi, null_mode: str = "null") -> Column:
    """Surface-water class, higher is better."""
    x = _c(wqi)
    return _bands(x, [(x >= 90, "Excellent"), (x >= 70, "Good"), (x >= 50, "Medium"),
                      (x >= 25, "Poor")], "Very Poor", null_mode)


def priority_gw(wqi) -> Column:
    """Exposure placeholder priority."""
    return _c(wqi) * 1.0


def priority_sw(wqi, exposure=1) -> Column:
    """(100 - wqi) * exposure."""
    return (100 - _c(wqi)) * (exposure if isinstance(exposure, Column) else F.lit(exposure))


def hotspot(wqi) -> Column:
    """Surface-water hotspot flag."""
    return _c(wqi) < 50


def risk_gw(wqi, null_mode: str = "null") -> Column:
    x = _c(wqi)
    return _bands(x, [(x > 300, "High"), (x > 150, "Moderate")], "Low", null_mode)


def risk_sw(wqi, null_mode: str = "null") -> Column:
    x = _c(wqi)
    return _bands(x, [(x < 25, "High"), (x < 50, "Moderate")], "Low", null_mode)


def alert_gw(wqi, null_mode: str = "null") -> Column:
    """wqi > 200 (C11); fallback mode turns a missing index into False."""
    x = _c(wqi)
    return x > 200 if null_mode == "null" else F.coalesce(x > 200, F.lit(False))


def alert_sw(wqi, null_mode: str = "null") -> Column:
    x = _c(wqi)
    return _bands(x, [(x < 25, "CRITICAL"), (x < 50, "WARNING")], "NORMAL", null_mode)


def mcc_norm(v) -> Column:
    """Map an MCC onto [0, 1] for the radar comparison (C14)."""
    return F.greatest(F.lit(0.0), (_c(v) + 0.21) / 1.21)
