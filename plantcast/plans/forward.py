"""Plan with demand cut to capacity and orders that arrive a lead time after they are placed."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from plantcast.config import PlanConfig
from plantcast.operators import checks, demand, forecast, inventory, labels, materials, summary, telemetry
from plantcast.sources.store import staged
from plantcast.sources.tables import Sources


class ForwardPlan:
    """Every table of the plan as a lazy DataFrame; only what is used is built."""

    REPORTS = ("snapshot", "capacity_plan", "demand_compare", "mrp_plan", "po_summary", "latest_series")

    def __init__(self, sources: Sources, cfg: PlanConfig) -> None:
        self.sources = sources
        self.cfg = cfg

    def stage(self, folder: str) -> None:
        """Write the tables that several outputs share, and go on from the written ones."""
        for name in ("products", "mrp_plan", "part_outlook"):
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
        checks.require_rows(products, self.cfg)

    @cached_property
    def latest_readings(self) -> DataFrame:
        return telemetry.latest_readings(self.sources.machine_data, self.cfg, self.sources.reading_days)

    @cached_property
    def reading_health(self) -> DataFrame:
        return telemetry.reading_health_step(self.latest_readings, self.cfg)

    @cached_property
    def capacity_factor(self) -> DataFrame:
        return telemetry.capacity_factor_step(self.reading_health)

    @cached_property
    def latest_series(self) -> DataFrame:
        return telemetry.latest_series(self.latest_readings)

    @cached_property
    def order_history(self) -> DataFrame:
        lines = demand.window_lines(self.sources, self.cfg)
        return demand.order_history(lines)

    @cached_property
    def profile(self) -> DataFrame:
        return demand.sparse_profile(self.order_history)

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
        return forecast.capacity_plan_adjusted(self.products, self.cfg)

    @cached_property
    def day_totals(self) -> DataFrame:
        return forecast.day_totals(self.products, self.cfg)

    @cached_property
    def demand_compare(self) -> DataFrame:
        return forecast.demand_compare_adjusted(self.day_totals, self.cfg)

    @cached_property
    def bom(self) -> DataFrame:
        return materials.bom(self.sources.bom_header, self.sources.bom_detail)

    @cached_property
    def bom_demand(self) -> DataFrame:
        """Bill lines with the demand of their product."""
        return materials.product_lines(self.demand_arrays, self.bom)

    @cached_property
    def part_demand(self) -> DataFrame:
        """Parts for the adjusted demand, which takes the place of the demand."""
        if "bom_demand" in self.__dict__:  # frozen: the capacity meets every bill line, nothing is joined
            lines = forecast.with_capacity(self.bom_demand, self.capacity_factor)
            return materials.part_sums(lines.withColumn("demand", lines["output"]), self.cfg)
        adjusted = self.products.withColumn("demand", self.products["output"])
        return materials.part_demand(adjusted, self.bom, self.cfg)

    @cached_property
    def daily_part_demand(self) -> DataFrame:
        return materials.daily_part_demand(self.part_demand, self.cfg).drop("planned_output_part_demand")

    @cached_property
    def stock(self) -> DataFrame:
        return materials.stock(self.sources.parts)

    @cached_property
    def incoming_arrays(self) -> DataFrame:
        return materials.incoming_arrays(self.sources.purchase, self.cfg)

    @cached_property
    def stock_days(self) -> DataFrame:
        return inventory.stock_days(self.stock, self.part_demand, self.incoming_arrays, self.cfg)

    @cached_property
    def mrp_plan(self) -> DataFrame:
        return inventory.mrp_feedback(self.stock_days, self.cfg)

    def labelled_plan(self, lang: str = "zh") -> DataFrame:
        return labels.labelled(self.mrp_plan, lang)

    @cached_property
    def part_outlook(self) -> DataFrame:
        return summary.part_outlook_feedback(self.mrp_plan)

    @cached_property
    def risk_parts(self) -> DataFrame:
        return summary.risk_parts_feedback(self.part_outlook, self.cfg)

    @cached_property
    def po_summary(self) -> DataFrame:
        return summary.po_summary_feedback(self.part_outlook)

    @cached_property
    def po_chart(self) -> DataFrame:
        return summary.po_chart(self.po_summary, self.cfg)

    @cached_property
    def po_table(self) -> DataFrame:
        return summary.po_table_feedback(self.po_summary, self.cfg)

    @cached_property
    def outlook_counts(self) -> DataFrame:
        return summary.outlook_counts_feedback(self.part_outlook)

    @cached_property
    def kpis(self) -> DataFrame:
        return summary.kpis_feedback(self.capacity_factor, self.day_totals, self.outlook_counts)

    @cached_property
    def plan_totals(self) -> DataFrame:
        return summary.plan_totals_feedback(self.outlook_counts, self.cfg)

    @cached_property
    def snapshot(self) -> DataFrame:
        return summary.snapshot_feedback(
            self.capacity_factor, self.day_totals, self.outlook_counts, self.part_outlook, self.cfg
        )

    @cached_property
    def input_checks(self) -> DataFrame:
        return checks.input_checks(self.order_history, self.cfg)
