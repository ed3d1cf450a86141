"""Manufacturing planning on Spark: forecast, capacity, materials and purchase proposals."""

from plantcast.config import PlanConfig
from plantcast.plans.backward import BackwardPlan
from plantcast.plans.forward import ForwardPlan
from plantcast.sources.tables import Sources

__all__ = ["BackwardPlan", "ForwardPlan", "PlanConfig", "Sources"]
