"""Plan with demand and executable output side by side and orders scheduled back from need."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from plantcast.config import PlanConfig
from plantcast.operators import checks, demand, forecast, inventory, materials, summary, telemetry
from plantcast.sources.store import staged
from plantcast.sources.tables import Sources


class BackwardPlan:
    """Every table of the plan as a lazy DataFrame; only what is used is built."""

    REPORTS = (
        "snapshot",
        "capacity_plan",
        "demand_compare",
        "mrp_plan",
        "part_risk_summary",
        "po_summary",
        "machine_health",
        "machine_series",
    )

    def __init__(self, sources: Sources, cfg: PlanConfig) -> None:
        self.sources = sources
        self.cfg = cfg

    def stage(self, folder: str) -> None:
        """Write the tables that several outputs share, and go on from the written ones."""
        for name in ("products", "part_demand", "mrp_plan", "part_outlook"):
            self.__dict__[name] = staged(getattr(self, name), f"{folder}/{name}")

    # What readings do not change: a plan for the same day can go on from another one's.
    FROZEN = ("demand_arrays", "bom_demand", "stock", "incoming_arrays")

    def freeze(self, folder: str) -> dict[str, DataFrame]:
        """Write the tables that no reading changes."""
        return {name: staged(getattr(self, name), f"{folder}/{name}") for name in self.FROZEN}

    def use(self, frozen: dict[str, DataFrame]) -> None:
        """Go on from frozen tables instead of orders, bills, stock and purchases."""
        self.__dict__.update(frozen)

    def require_inputs(self, products: DataFrame) -> None:
        """Raise ``MissingInput`` if a written table of products, or another needed one, is empty."""
        checks.require_rows(products, self.cfg, self.sources.parts)

    # Telemetry and capacity

    @cached_property
    def recent_readings(self) -> DataFrame:
        return telemetry.recent_readings(self.sources.machine_data, self.cfg)

    @cached_property
    def reading_health(self) -> DataFrame:
        return telemetry.reading_health(self.recent_readings, self.cfg)

    @cached_property
    def machine_health(self) -> DataFrame:
        return telemetry.machine_health(self.reading_health)

    @cached_property
    def capacity_factor(self) -> DataFrame:
        return telemetry.capacity_factor(self.machine_health, self.cfg)

    @cached_property
    def machine_series(self) -> DataFrame:
        return telemetry.machine_series(self.reading_health)

    # Demand

    @cached_property
    def order_lines(self) -> DataFrame:
        return demand.window_lines(self.sources, self.cfg)

    @cached_property
    def order_history(self) -> DataFrame:
        return demand.order_history(self.order_lines)

    @cached_property
    def complete_history(self) -> DataFrame:
        return demand.complete_history(self.order_history, self.cfg)

    @cached_property
    def profile(self) -> DataFrame:
        return demand.demand_profile(self.order_lines, self.cfg)

    @cached_property
    def forecast(self) -> DataFrame:
        return forecast.forecast(self.profile, self.cfg)

    @cached_property
    def demand_arrays(self) -> DataFrame:
        return forecast.forecast_arrays(self.profile, self.cfg)

    @cached_property
    def products(self) -> DataFrame:
        return forecast.with_capacity(self.demand_arrays, self.capacity_factor)

    @cached_property
    def capacity_plan(self) -> DataFrame:
        return forecast.capacity_plan(self.products, self.cfg)

    @cached_property
    def day_totals(self) -> DataFrame:
        return forecast.day_totals(self.products, self.cfg)

    @cached_property
    def demand_compare(self) -> DataFrame:
        return forecast.demand_compare(self.day_totals, self.cfg)

    # Parts

    @cached_property
    def bom(self) -> DataFrame:
        return materials.bom(self.sources.bom_header, self.sources.bom_detail)

    @cached_property
    def stock(self) -> DataFrame:
        return materials.stock(self.sources.parts)

    @cached_property
    def incoming_by_day(self) -> DataFrame:
        return materials.incoming_by_day(self.sources.purchase)

    @cached_property
    def bom_explosion(self) -> DataFrame:
        return materials.bom_explosion(self.products, self.bom, self.cfg)

    @cached_property
    def bom_demand(self) -> DataFrame:
        """Bill lines with the demand of their product."""
        return materials.product_lines(self.demand_arrays, self.bom)

    @cached_property
    def part_demand(self) -> DataFrame:
        if "bom_demand" in self.__dict__:  # frozen: the capacity meets every bill line, nothing is joined
            return materials.part_sums(forecast.with_capacity(self.bom_demand, self.capacity_factor), self.cfg)
        return materials.part_demand(self.products, self.bom, self.cfg)

    @cached_property
    def daily_part_demand(self) -> DataFrame:
        return materials.daily_part_demand(self.part_demand, self.cfg)

    @cached_property
    def incoming_arrays(self) -> DataFrame:
        return materials.incoming_arrays(self.sources.purchase, self.cfg)

    @cached_property
    def stock_days(self) -> DataFrame:
        return inventory.stock_days(self.stock, self.part_demand, self.incoming_arrays, self.cfg)

    @cached_property
    def sim_grid(self) -> DataFrame:
        return inventory.sim_grid(self.stock_days, self.cfg)

    @cached_property
    def inventory_projection(self) -> DataFrame:
        return inventory.inventory_projection(self.sim_grid)

    @cached_property
    def mrp_plan(self) -> DataFrame:
        return inventory.mrp_plan(self.inventory_projection, self.cfg)

    # Summaries

    @cached_property
    def part_outlook(self) -> DataFrame:
        return summary.part_outlook(self.mrp_plan)

    @cached_property
    def part_risk_summary(self) -> DataFrame:
        return summary.part_risk_summary(self.part_outlook)

    @cached_property
    def risk_parts(self) -> DataFrame:
        return summary.risk_parts(self.part_outlook, self.cfg)

    @cached_property
    def po_summary(self) -> DataFrame:
        return summary.po_summary(self.part_outlook)

    @cached_property
    def po_chart(self) -> DataFrame:
        return summary.po_chart(self.po_summary, self.cfg)

    @cached_property
    def po_table(self) -> DataFrame:
        return summary.po_table(self.po_summary, self.cfg)

    @cached_property
    def outlook_counts(self) -> DataFrame:
        return summary.outlook_counts(self.part_outlook)

    @cached_property
    def need_totals(self) -> DataFrame:
        return summary.need_totals(self.part_demand, self.cfg)

    @cached_property
    def kpis(self) -> DataFrame:
        return summary.kpis(self.capacity_factor, self.day_totals, self.outlook_counts)

    @cached_property
    def plan_totals(self) -> DataFrame:
        return summary.plan_totals(self.need_totals, self.outlook_counts, self.cfg)

    @cached_property
    def snapshot(self) -> DataFrame:
        return summary.snapshot(
            self.capacity_factor, self.day_totals, self.need_totals, self.outlook_counts, self.part_outlook, self.cfg
        )

    @cached_property
    def input_checks(self) -> DataFrame:
        return checks.input_checks(self.order_history, self.cfg, parts=self.sources.parts)

    @cached_property
    def source_profile(self) -> DataFrame:
        return checks.source_profile(
            {
                "bom": (self.bom, None),
                "parts": (self.sources.parts, None),
                "incoming": (self.incoming_by_day, "eta_date"),
                "readings": (self.recent_readings, "created_at"),
                "order_history": (self.order_history, "order_date"),
                "order_history_today": (demand.history_today(self.order_history, self.cfg), "order_date"),
                "forecast": (self.forecast, "forecast_date"),
                "bom_explosion": (self.bom_explosion, "forecast_date"),
                "daily_part_demand": (self.daily_part_demand, "forecast_date"),
                "mrp_plan": (self.mrp_plan, "forecast_date"),
                "po_summary": (self.po_summary, "first_shortage_date"),
            }
        )
