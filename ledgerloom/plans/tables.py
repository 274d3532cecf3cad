"""The model tables a report reads."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.timekeys import OWN_ZONE, ZONE, ZONE_HIGH, ZONE_LOW, zone_bounds
from ledgerloom.sources.models import read_model
from ledgerloom.sources.snapshots import current


@dataclass(frozen=True)
class StoreTables:
    """Models and lookups of one store, or of many when `scope` names their store columns."""

    orders: DataFrame
    sales: DataFrame
    transactions: DataFrame
    fulfillments: DataFrame
    google_ads: DataFrame
    tiktok_ads: DataFrame
    meta_ads: DataFrame
    schedule: DataFrame
    product_costs: DataFrame
    order_shipping: DataFrame
    shipping_entries: DataFrame
    settings: DataFrame
    scope: tuple[str, ...] = ()


def load_tables(
    spark: SparkSession,
    root: str,
    tenant: str | None = None,
    years: tuple[int, int] | None = None,
    created: tuple[str, str] | None = None,
) -> StoreTables:
    """Read the models of one store, or of all stores keyed by `tenantid`, all from one snapshot.

    `years` are those that orders, sale entries, payments and shipments are dated in. For reports by order
    date, whose entries may be dated later, `created` gives the days instead: of all years, only files with
    rows of orders created then are opened.
    """
    snapshot = current(spark, root)

    def read(table: str, year: str | None = None) -> DataFrame:
        df = read_model(spark, root, table, tenant, year, years, snapshot, created if year else None)
        return df if tenant is None else df.drop("tenantid")

    return StoreTables(
        orders=read("orders", "created_year"),
        sales=read("sales_items", "happened_year"),
        transactions=read("transactions", "transaction_year"),
        fulfillments=read("fulfillments", "fulfillment_year"),
        google_ads=read("google_ads"),
        tiktok_ads=read("tiktok_ads"),
        meta_ads=read("meta_ads"),
        schedule=read("cost_schedule"),
        product_costs=read("product_costs"),
        order_shipping=read("order_shipping"),
        shipping_entries=read("shipping_entries"),
        settings=read("settings"),
        scope=("tenantid",) if tenant is None else (),
    )


#: Tables whose rows have instants, which a report puts into local periods.
TIMED = ("orders", "sales", "transactions", "fulfillments")


def with_zones(t: StoreTables, zones: DataFrame) -> StoreTables:
    """Tables whose settings know each store's zone; `zones` has the store columns and `time_zone`."""
    settings = t.settings.drop(ZONE)
    if not t.scope:
        return replace(t, settings=settings.withColumn(ZONE, zones.agg(F.min(ZONE)).scalar()))
    one = zones.groupBy(*t.scope).agg(F.min(ZONE).alias(ZONE))
    return replace(t, settings=settings.join(one, list(t.scope), "left"))


def in_own_zones(t: StoreTables, tz: str | Column, start: str | date, end: str | date) -> StoreTables:
    """For `tz` OWN_ZONE: rows with their store's zone and the range's bounds there; else `t` as it is.

    A store without a zone, or without settings, is taken to be in UTC. There is a row for each store on
    the right of these joins, and the bounds are computed there once, not for every row of a table.
    """
    if not isinstance(tz, str) or tz != OWN_ZONE or ZONE in t.sales.columns:
        return t
    if ZONE not in t.settings.columns:
        raise ValueError("settings have no time_zone; add one with with_zones")
    utc = F.lit("UTC")
    bounds = zone_bounds(F.coalesce(F.col(ZONE), utc), start, end)
    if not t.scope:
        zone = F.coalesce(t.settings.agg(F.min(ZONE)).scalar(), utc)
        own = {name: getattr(t, name).withColumn(ZONE, zone).withColumns(bounds) for name in TIMED}
        return replace(t, **own)
    zones = t.settings.groupBy(*t.scope).agg(F.min(ZONE).alias(ZONE)).withColumns(bounds)
    unknown = {ZONE: utc, **zone_bounds(utc, start, end)}
    own = {}
    for name in TIMED:
        rows = getattr(t, name).join(zones, list(t.scope), "left")
        own[name] = rows.withColumns({c: F.coalesce(F.col(c), unknown[c]) for c in (ZONE, ZONE_LOW, ZONE_HIGH)})
    return replace(t, **own)
