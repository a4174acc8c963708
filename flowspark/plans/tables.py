"""The tables a query reads, as one value."""

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from flowspark.operators import aggregates


@dataclass(frozen=True)
class Tables:
    countries: DataFrame
    leagues: DataFrame
    clubs: DataFrame
    players: DataFrame
    transfers: DataFrame
    player_valuations: DataFrame
    country_transfer_flows: DataFrame | None = None
    club_transfer_summaries: DataFrame | None = None

    def with_aggregates(self) -> "Tables":
        """The same tables with any missing aggregate computed on the fly."""
        own = {f.name: getattr(self, f.name) for f in fields(self)}
        if self.country_transfer_flows is None:
            own["country_transfer_flows"] = aggregates.country_flows_by_window(
                self.transfers, self.clubs
            )
        if self.club_transfer_summaries is None:
            own["club_transfer_summaries"] = aggregates.club_summaries_by_window(self.transfers)
        return Tables(**own)
