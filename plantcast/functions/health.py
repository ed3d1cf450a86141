"""Machine health scores as column expressions; usable in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantcast.config import PlanConfig
from plantcast.functions.values import literal, number_sql


def clamp(c: str) -> str:
    return f"least(greatest({c}, 0.0D), 1.0D)"


def penalty(c: str, base: float, worst: float) -> str:
    """0 up to ``base``, 1 from ``worst`` on, linear between; no penalty on an empty range."""
    if worst <= base:
        return "0.0D"
    return clamp(f"({c} - {literal(base)}) / {literal(worst - base)}")


def continuous_score(cfg: PlanConfig) -> Column:
    """Score of cleaned ``temperature``, ``vibration`` and ``rpm``."""
    heat = penalty("temperature", cfg.temp_base, cfg.temp_worst)
    shake = penalty("vibration", cfg.vib_base, cfg.vib_worst)
    speed = clamp(f"abs(rpm - {literal(cfg.rpm_target)}) / {literal(cfg.rpm_tolerance)}")
    return F.expr(
        clamp(
            f"1.0D - {heat} * {literal(cfg.temp_weight)} - {shake} * {literal(cfg.vib_weight)} "
            f"- {speed} * {literal(cfg.rpm_weight)}"
        )
    )


def step_score(cfg: PlanConfig) -> Column:
    """Fixed cost per passed limit, never below the floor; a missing value costs nothing."""

    def cost(c: str, limit: float, cost: float) -> str:
        return f"CASE WHEN {number_sql(c)} > {literal(limit)} THEN {literal(cost)} ELSE 0.0D END"

    heat = cost("temperature", cfg.step_temp_limit, cfg.step_temp_cost)
    shake = cost("vibration", cfg.step_vib_limit, cfg.step_vib_cost)
    return F.expr(f"greatest(1.0D - {heat} - {shake}, {literal(cfg.step_floor)})")


def blended_capacity(mean: str, worst: str, cfg: PlanConfig) -> str:
    """Capacity factor; full capacity when there is no reading.

    The default goes in before the clamp, because ``greatest`` would skip a null.
    """
    blend = f"{mean} * {literal(cfg.mean_weight)} + {worst} * {literal(cfg.worst_weight)}"
    return clamp(f"coalesce({blend}, 1.0D)")
