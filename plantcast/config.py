"""Planning parameters. Every operator takes its dates from here, never from the clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta


@dataclass(frozen=True)
class PlanConfig:
    """One planning run: the instant it is made for, and its parameters."""

    as_of: datetime
    telemetry_as_of: datetime | None = None

    lookback_days: int = 30
    forecast_days: int = 7
    lead_time_days: int = 3
    telemetry_hours: int = 24
    latest_readings: int = 50
    retention_minutes: int = 30
    # How long a stream waits for readings of an hour after it has ended.
    lateness_minutes: int = 30

    # Sensor level that is still fine, and level at which the penalty is full.
    temp_base: float = 75.0
    temp_worst: float = 95.0
    vib_base: float = 0.05
    vib_worst: float = 0.12
    rpm_target: float = 1500.0
    rpm_tolerance: float = 300.0
    temp_weight: float = 0.35
    vib_weight: float = 0.45
    rpm_weight: float = 0.20

    # Weight of the mean and of the worst machine in the capacity factor.
    mean_weight: float = 0.7
    worst_weight: float = 0.3

    # Step scoring: limit, and what passing it costs.
    step_temp_limit: float = 85.0
    step_temp_cost: float = 0.2
    step_vib_limit: float = 0.08
    step_vib_cost: float = 0.3
    step_floor: float = 0.5

    risk_limit: int = 20
    chart_limit: int = 10
    table_limit: int = 15

    def __post_init__(self) -> None:
        if self.lookback_days < 1 or self.forecast_days < 1:
            raise ValueError("lookback_days and forecast_days must be at least 1")
        if self.lead_time_days < 0:
            raise ValueError("lead_time_days must not be negative")

    @property
    def today(self) -> date:
        return self.as_of.date()

    @property
    def order_cutoff(self) -> datetime:
        """Orders from this instant on are read; it carries the time of day."""
        return self.as_of - timedelta(days=self.lookback_days)

    @property
    def history_start(self) -> date:
        return self.today - timedelta(days=self.lookback_days)

    @property
    def history_end(self) -> date:
        """Yesterday: the running day is incomplete and stays out of the history grid."""
        return self.today - timedelta(days=1)

    @property
    def forecast_start(self) -> date:
        return self.today + timedelta(days=1)

    @property
    def forecast_end(self) -> date:
        return self.today + timedelta(days=self.forecast_days)

    @property
    def forecast_dates(self) -> list[date]:
        return [self.forecast_start + timedelta(days=i) for i in range(self.forecast_days)]

    @property
    def telemetry_now(self) -> datetime:
        return self.telemetry_as_of or self.as_of

    @property
    def telemetry_cutoff(self) -> datetime:
        return self.telemetry_now - timedelta(hours=self.telemetry_hours)

    @property
    def retention_cutoff(self) -> datetime:
        return self.telemetry_now - timedelta(minutes=self.retention_minutes)
