"""Parameters shared by the operators, and the names of the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

# Layer of every stored table.
LAYERS = {
    "demand": "silver",
    "weather_forecast": "silver",
    "bank_holidays": "silver",
    "demand_hourly": "silver",
    "demand_blocks": "silver",
    "forecast_blocks": "silver",
    "demand_features": "gold",
}


@dataclass(frozen=True)
class PitConfig:
    """Rules that decide what was knowable when.

    ``series`` names the columns that tell one demand series from another; it
    is empty for a single national series.
    """

    # The national series' own rules.
    publication_lag_hours: int = 2
    base_temperature: float = 15.5
    local_tz: str = "Europe/London"
    holiday_division: str = "eng&wales"
    max_lead: int = 7
    anchor_days: tuple[int, ...] = (7, 14)
    series: tuple[str, ...] = ()

    @property
    def leads(self) -> range:
        return range(self.max_lead + 1)

    @property
    def anchor_columns(self) -> dict[str, int]:
        """Anchor column name -> distance in hours."""
        return {f"lag_{d}d": 24 * d for d in self.anchor_days}

    def lag_hours(self, lead: int) -> int:
        """Distance from a target to the newest demand knowable at ``lead``."""
        return 24 * lead + self.publication_lag_hours

    @property
    def grain(self) -> list[str]:
        return [*self.series, "target_ts", "lead_days"]


def table_name(table: str, layer: str | None = None) -> str:
    """Qualified name: a given layer is used verbatim, else the table's own."""
    return f"{layer or LAYERS[table]}.{table}"
