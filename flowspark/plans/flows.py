"""Country flows, net spend and the tables derived from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators import aggregates
from flowspark.operators import filters as flt
from flowspark.operators import lookups
from flowspark.operators.filters import ALL, TransferFilters
from flowspark.plans.tables import Tables

# Fixed value: a pair below this share of the largest one is a minor flow.
MINOR_FLOW_SHARE = 0.005


def country_flows(tables: Tables, filters: TransferFilters = ALL) -> DataFrame:
    """Fee sum, permanent count and loan count per pair of in-scope countries.

    Without fee, type or player filters the stored window aggregate answers;
    otherwise the transfers do.
    """
    if filters.needs_raw_transfers:
        flows = _from_transfers(tables, filters)
    else:
        flows = _from_aggregate(tables, filters)
    return lookups.with_country_names(flows, tables.countries)


def _from_aggregate(tables: Tables, filters: TransferFilters) -> DataFrame:
    flows = tables.with_aggregates().country_transfer_flows
    flows = flt.in_window_range(flows, filters)
    flows = flt.involving_countries(flows, filters.country_ids)
    return aggregates.sum_flows(_in_scope(tables, flows))


def _from_transfers(tables: Tables, filters: TransferFilters) -> DataFrame:
    transfers = flt.on_transfer_columns(tables.transfers, filters)
    transfers = lookups.with_player(transfers, tables.players, filters)
    if lookups.has_countries(transfers):
        transfers = flt.involving_countries(transfers, filters.country_ids)
        return _in_scope(tables, aggregates.country_flows_from_transfers(transfers, tables.clubs))
    clubs = lookups.scoped_clubs(tables.clubs, tables.countries)
    flows = aggregates.country_flows_from_transfers(transfers, clubs)
    return flt.involving_countries(flows, filters.country_ids)


def _in_scope(tables: Tables, flows: DataFrame) -> DataFrame:
    """Flows between in-scope countries."""
    scope = tables.countries.filter("in_scope")
    for end in ("from", "to"):
        ids = scope.select(F.col("id").alias(f"{end}_country_id"))
        flows = flows.join(ids, f"{end}_country_id", "left_semi")
    return flows


def country_net_spend(tables: Tables, filters: TransferFilters = ALL) -> DataFrame:
    """Spent, received and net spend per country over the filtered flows."""
    spend = aggregates.net_spend(country_flows(tables, filters))
    names = tables.countries.select(F.col("id").alias("country_id"), F.col("name").alias("country_name"))
    return spend.join(names, "country_id")


def _log_share(value: Column, largest: Column) -> Column:
    """log10(value) / log10(largest), 0 where the largest is at most 1."""
    one = F.lit(1.0)
    share = F.log10(F.greatest(value.cast("double"), one)) / F.log10(largest.cast("double"))
    return F.when(largest > 1, share).otherwise(0.0)


def net_pair_flows(tables: Tables, filters: TransferFilters = ALL) -> DataFrame:
    """One row per unordered country pair: who is the net spender, and how much.

    Minor pairs are left out. If no flow has a fee, pairs are measured by transfer
    count and run from the lower to the higher country id. Both countries need
    coordinates (an in-scope country row).
    """
    flows = country_flows(tables, filters)
    low, high = F.least("from_country_id", "to_country_id"), F.greatest("from_country_id", "to_country_id")
    fee = F.col("total_fee_eur")
    pairs = flows.groupBy(low.alias("low_id"), high.alias("high_id")).agg(
        F.sum(F.when(F.col("from_country_id") == low, -fee).otherwise(fee)).alias("net_fee"),
        F.sum("transfer_count").alias("total_transfers"),
        F.max(fee).alias("largest_fee"),
    )
    # One subquery over the same columns as the main query, so that Spark reuses the
    # exchange of the pairs instead of reading the flows again.
    scale = pairs.agg(
        F.struct(
            F.max("largest_fee").alias("fee"),
            F.max(F.abs("net_fee")).alias("net"),
            F.max("total_transfers").alias("transfers"),
        )
    ).scalar()
    measured = pairs.withColumn("scale", scale).withColumn("by_count", F.col("scale.fee") == 0)
    kept = measured.withColumns(
        {
            "magnitude": F.when(F.col("by_count"), F.col("total_transfers")).otherwise(F.abs("net_fee")),
            "largest": F.greatest(
                F.when(F.col("by_count"), F.col("scale.transfers")).otherwise(F.col("scale.net")), F.lit(1)
            ),
        }
    ).filter(F.col("magnitude") >= F.col("largest") * MINOR_FLOW_SHARE)
    low_spends = F.col("by_count") | (F.col("net_fee") >= 0)
    oriented = kept.select(
        F.when(low_spends, F.col("low_id")).otherwise(F.col("high_id")).alias("spender_id"),
        F.when(low_spends, F.col("high_id")).otherwise(F.col("low_id")).alias("receiver_id"),
        F.abs("net_fee").alias("net_fee_eur"),
        "total_transfers",
        "magnitude",
        _log_share(F.col("magnitude"), F.col("largest")).alias("magnitude_share"),
    )
    for end in ("spender", "receiver"):
        place = tables.countries.filter("in_scope").select(
            F.col("id").alias(f"{end}_id"),
            F.col("name").alias(f"{end}_name"),
            F.col("latitude").alias(f"{end}_latitude"),
            F.col("longitude").alias(f"{end}_longitude"),
        )
        oriented = oriented.join(place, f"{end}_id")
    return oriented


def country_node_totals(tables: Tables, filters: TransferFilters = ALL) -> DataFrame:
    """Per country: volume and count over both ends, with shares for display.

    size_share is the square root of the share of the largest node, by volume or, if
    no flow has a fee, by count. net_share is |net spend| against the largest.
    """
    nodes = aggregates.node_totals(country_flows(tables, filters))
    scale = nodes.agg(
        F.struct(
            F.max("volume").alias("volume"),
            F.max("transfer_count").alias("transfers"),
            F.max(F.abs("net_spend_eur")).alias("net"),
        )
    ).scalar()
    scaled = nodes.withColumn("scale", scale)
    # Volumes are sums of the flow fees, so none of those is above 0 if no volume is.
    by_count = F.col("scale.volume") == 0
    size = F.when(by_count, F.col("transfer_count")).otherwise(F.col("volume"))
    largest = F.when(by_count, F.col("scale.transfers")).otherwise(F.col("scale.volume"))
    return scaled.select(
        "country_id",
        "volume",
        "transfer_count",
        "net_spend_eur",
        F.sqrt(size / F.greatest(largest, F.lit(1))).alias("size_share"),
        (F.abs("net_spend_eur") / F.greatest("scale.net", F.lit(1))).alias("net_share"),
    )
