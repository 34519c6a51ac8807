"""Deterministic plant formulas used by the KPI operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["clamp", "wrap_deg", "ang_diff_deg", "yaw_derate", "power_curve", "reactive_kvar",
           "current_a", "poi_flows", "grid_event_label", "energy_event_label", "top_defect",
           "out_of_control", "severity", "operating_state", "solar_expected"]


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def clamp(x, lo, hi) -> Column:
    """Bound a value; NULL stays NULL."""
    x = _c(x)
    return F.when(x.isNull(), x).otherwise(F.greatest(_c(lo), F.least(x, _c(hi))))


def wrap_deg(d) -> Column:
    """Angle into [0, 360)."""
    return F.pmod(_c(d), F.lit(360.0))


def ang_diff_deg(a, b) -> Column:
    """Signed difference a-b in [-180, 180)."""
    return F.pmod(_c(a) - _c(b) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def yaw_derate(err_deg, exponent: float = 1.7) -> Column:
    """``max(0, cos(err))**exponent``."""
    return F.pow(F.greatest(F.lit(0.0), F.cos(F.radians(_c(err_deg)))), F.lit(exponent))


def power_curve(v, rated_kw, cut_in, rated_v, cut_out) -> Column:
    """Cubic wind power curve: 0 below cut-in or from cut-out, rated from rated speed."""
    v, rated_kw, cut_in, rated_v, cut_out = map(_c, (v, rated_kw, cut_in, rated_v, cut_out))
    x = (v - cut_in) / F.greatest(F.lit(0.1), rated_v - cut_in)
    return (F.when((v < cut_in) | (v >= cut_out), F.lit(0.0))
            .when(v >= rated_v, rated_kw.cast("double"))
            .otherwise(rated_kw * F.pow(x, F.lit(3.0))))


def reactive_kvar(p_kw, pf) -> Column:
    """``p·tan(acos(pf))``."""
    return _c(p_kw) * F.tan(F.acos(_c(pf)))


def current_a(p_kw, v_ll, pf) -> Column:
    """``p·1000/(√3·V·max(0.1, pf))``, 0 when p ≤ 0."""
    p = _c(p_kw)
    return F.when(p <= 0, F.lit(0.0)).otherwise(
        p * 1000.0 / (F.lit(math.sqrt(3.0)) * _c(v_ll) * F.greatest(F.lit(0.1), _c(pf))))


def poi_flows(net_kw, target_kw, curtail_pct, breaker_closed) -> dict[str, Column]:
    """Export / import / net at the grid meter (P20); both 0 when the breaker is open."""
    net = _c(net_kw)
    allowed = _c(target_kw) * (F.lit(1.0) - _c(curtail_pct) / 100.0)
    closed = F.coalesce(_c(breaker_closed), F.lit(True))
    export = F.when(closed, F.greatest(F.lit(0.0), F.least(net, allowed))).otherwise(F.lit(0.0))
    imp = F.when(closed, F.greatest(F.lit(0.0), -net)).otherwise(F.lit(0.0))
    return {"export_kw": export, "import_kw": imp, "poi_net_kw": export - imp}


def grid_event_label(freq_event, volt_sag, constraint) -> Column:
    """FREQ_EVENT > VOLT_SAG > CONSTRAINT > '' (P21)."""
    return (F.when(_c(freq_event), F.lit("FREQ_EVENT")).when(_c(volt_sag), F.lit("VOLT_SAG"))
            .when(_c(constraint), F.lit("CONSTRAINT")).otherwise(F.lit("")))


def energy_event_label(spike, constraint) -> Column:
    """ENERGY_SPIKE > CONSTRAINT > '' (P21)."""
    return (F.when(_c(spike), F.lit("ENERGY_SPIKE")).when(_c(constraint), F.lit("CONSTRAINT"))
            .otherwise(F.lit("")))


def top_defect(rules: list[tuple[Column, str]], default: str = "NONE") -> Column:
    """First matching defect rule in the given order."""
    out = None
    for cond, label in rules:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def out_of_control(cpk, deviation, cpk_min: float = 1.0, dev_max: float = 35.0) -> Column:
    """Out of control when Cpk < 1 or |deviation| > 35."""
    return (_c(cpk) < cpk_min) | (F.abs(_c(deviation)) > dev_max)


def ooc_reason(cpk, deviation, cpk_min: float = 1.0, dev_max: float = 35.0) -> Column:
    """Why a process is out of control, '' when it is not; a low Cpk comes first."""
    return (F.when(_c(cpk) < cpk_min, F.lit("Low Cpk"))
            .when(F.abs(_c(deviation)) > dev_max, F.lit("Kiln deviation")).otherwise(F.lit("")))


# The order, limits and names of the defect rules.
DEFECT_KILN, DEFECT_MOISTURE, DEFECT_WEAR = 25.0, 1.2, 0.7
DEFECT_NAMES = ("Warp/crack (sinter profile)", "Lamination (moisture)",
                "Chipping (press handling)", "Surface finish (tool wear)")


def press_defect(kiln_dev, moisture, press_alarm, tool_wear) -> Column:
    """The ordered defect rules of a press line: kiln deviation, moisture, press alarm, tool wear
    (P22)."""
    conds = [F.abs(_c(kiln_dev)) > DEFECT_KILN, _c(moisture) > DEFECT_MOISTURE,
             F.coalesce(_c(press_alarm), F.lit(False)), _c(tool_wear) > DEFECT_WEAR]
    return top_defect(list(zip(conds, DEFECT_NAMES)), "None")


def smoke_assist(flare, limit: float = 4.0) -> Column:
    """Steam assist is on while the flare is above its limit."""
    return F.coalesce(_c(flare) > limit, F.lit(False))


def severity(metric, warn, crit) -> Column:
    """'CRITICAL' from crit, 'WARNING' from warn, else 'ok' (P23)."""
    m = _c(metric)
    return (F.when(m >= _c(crit), F.lit("CRITICAL")).when(m >= _c(warn), F.lit("WARNING"))
            .otherwise(F.lit("ok")))


def operating_state(available, p_kw) -> Column:
    """2 running, 3 out of service, 0 idle."""
    return (F.when(~_c(available), F.lit(3)).when(_c(p_kw) > 0, F.lit(2)).otherwise(F.lit(0)))


def solar_expected(irr, temp_c, cap_kw) -> Column:
    """cap · clamp(irr/1000, 0, 1.15) · clamp(1 − 0.004·max(0, T−25), 0.8, 1.05) (P25)."""
    derate = clamp(F.lit(1.0) - F.greatest(F.lit(0.0), _c(temp_c) - 25.0) * 0.004, 0.8, 1.05)
    return _c(cap_kw) * clamp(_c(irr) / 1000.0, 0.0, 1.15) * derate
