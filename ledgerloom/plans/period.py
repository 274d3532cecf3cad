"""Period reports: profit and loss, social media roll-up, sales summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.sales import with_sale_fields
from ledgerloom.functions.timekeys import (
    GRAINS,
    grain_column,
    in_local_range,
    in_utc_years,
    prune_years,
    utc_years,
    with_period_keys,
)
from ledgerloom.operators.lookups import with_settings
from ledgerloom.operators.merge import merge_by_key
from ledgerloom.operators.metrics import period_metrics
from ledgerloom.operators.pricing import daily_ledger, price_lines, price_shipments
from ledgerloom.operators.rollups import (
    ad_rollup,
    cost_by_tag,
    fulfillment_rollup,
    payment_fees,
    sales_rollup,
)
from ledgerloom.plans.tables import StoreTables, in_own_zones

# Grains that only sale entries know. All other sources fall into one row without a key.
SALES_GRAINS = ("variant_id", "order_id")


def sale_lines(t: StoreTables, start: str | date, end: str | date, tz: str) -> DataFrame:
    """Sale entries of a local date range with period keys and sale fields."""
    t = in_own_zones(t, tz, start, end)
    sales = prune_years(t.sales, "happened_year", utc_years(start, end))
    kept = sales.where(in_local_range("happened_at", tz, start, end))
    return with_sale_fields(with_period_keys(kept, "happened_at", tz))


def priced_lines(t: StoreTables, lines: DataFrame, **options) -> DataFrame:
    return price_lines(
        lines,
        t.settings,
        t.order_shipping,
        t.product_costs,
        t.shipping_entries,
        t.scope,
        **options,
    )


def pricing(policy: str) -> dict[str, object]:
    """How the period P&L prices sale entries under a policy."""
    corrected = policy == "corrected"
    return {
        "swapped_cost_flags": not corrected,
        "shipping_fallback": "charge" if corrected else "none",
        "shipping_match": "exact" if corrected else "contains",
        "corrected_returns": corrected,
    }


def period_pnl(
    t: StoreTables,
    grain: str,
    start: str | date,
    end: str | date,
    tz: str = "UTC",
    policy: str = "parity",
) -> DataFrame:
    """Profit and loss per date, week, month or year, newest first.

    Payments and shipments are taken from all of the years the range touches, as shipped. Periods
    without Google rows come out as one row per source, because every source is matched on Google's
    periods. `policy="corrected"` gives one row per period, restricts payments and shipments to the
    range, books product costs as named, counts every amount, matches linked shipping by exact order
    number and treats missing sources as 0. `policy="propagate"` keeps NULL totals.

    With grain `variant_id` or `order_id` only sale entries have a key; the other sources appear as
    rows without one.

    With `tz` OWN_ZONE every store is reported in the zone its settings name. Ads and expenses are dated by
    the day already.
    """
    grain_column(grain, GRAINS + SALES_GRAINS)
    t = in_own_zones(t, tz, start, end)
    corrected = policy == "corrected"
    keys = [*t.scope, "period"]
    wide = grain in SALES_GRAINS

    def keyed(df: DataFrame) -> DataFrame:
        column = F.lit(None) if wide else F.col(grain)
        return df.withColumn("period", column.cast("string"))

    lines = sale_lines(t, start, end, tz)
    lines = lines.withColumn("period", F.col(grain).cast("string"))
    priced = priced_lines(t, lines, counted=True, **pricing(policy))
    years = utc_years(start, end)
    payments = prune_years(t.transactions, "transaction_year", years)
    shipments = t.fulfillments
    if corrected:
        payments = payments.where(in_local_range("transaction_at", tz, start, end))
        shipments = shipments.where(in_local_range("order_created_at", tz, start, end))
    else:
        payments = payments.where(in_utc_years("transaction_at", start, end))
        shipments = prune_years(shipments, "fulfillment_year", years)
        shipments = shipments.where(in_utc_years("fulfilled_at", start, end))
    payments = keyed(with_period_keys(payments, "transaction_at", tz))
    shipments = keyed(with_period_keys(shipments, "order_created_at", tz))
    sources = dated_sources(t, keyed, keys, start, end) | {
        "sales": sales_rollup(priced, keys, lines, distinct_amounts=not corrected),
        "payments": payment_fees(payments, keys),
        "shipments": fulfillment_rollup(price_shipments(shipments, t.settings, t.scope), keys),
    }
    report = period_report(t, sources, keys, policy)
    return report if wide else report.orderBy(*t.scope, F.col("period").desc())


def dated_sources(
    t: StoreTables, keyed: Callable[[DataFrame], DataFrame], keys: list[str], start: str | date, end: str | date
) -> dict[str, DataFrame]:
    """The sources that come by the day: ads and expenses."""
    days = F.col("date").between(str(start), str(end))
    return {
        "google": ad_rollup(keyed(t.google_ads.where(days)), "google", keys),
        "tiktok": ad_rollup(keyed(t.tiktok_ads.where(days)), "tiktok", keys),
        "meta": ad_rollup(keyed(t.meta_ads.where(days)), "meta", keys),
        "expenses": cost_by_tag(keyed(daily_ledger(t.schedule, start, end, t.scope)), keys),
    }


def period_report(t: StoreTables, sources: dict[str, DataFrame], keys: list[str], policy: str) -> DataFrame:
    """All metrics from the sources' aggregates per period."""
    anchor = None if policy == "corrected" else "google"
    merged = merge_by_key(sources, ["period"], anchor, t.scope)
    return period_metrics(with_settings(merged, t.settings, t.scope), keys, policy)


def social_rollup(
    google: DataFrame, tiktok: DataFrame, meta: DataFrame, grain: str, scope: Sequence[str] = ()
) -> DataFrame:
    """Ad totals per period; only Google's period is shown and a missing source gives NULL totals.

    With `scope` (store keys) there is a row per store and period.
    """
    grain_column(grain)
    sources = {
        name: ad_rollup(ads.withColumn("period", F.col(grain)), name, [*scope, "period"])
        for name, ads in (("google", google), ("tiktok", tiktok), ("meta", meta))
    }
    merged = merge_by_key(sources, ["period"], "google", scope)

    def total(kind: str):
        return F.col(f"google_{kind}") + F.col(f"meta_{kind}") + F.col(f"tiktok_{kind}")

    totals = merged.withColumns(
        {
            "period": F.when(F.col("google_spend").isNotNull(), F.col("period")),
            "ad_spend": total("spend"),
            "ad_clicks": total("clicks"),
            "ad_conversions": total("conversions"),
        }
    )
    share = F.try_divide(F.col("ad_conversions"), F.col("ad_clicks")) * F.lit(100)
    return totals.withColumn("click_to_purchase_pct", share).drop("_source")


def sales_summary(
    t: StoreTables, grain: str, start: str | date, end: str | date, tz: str = "UTC"
) -> DataFrame:
    """Sales aggregates per period without any cost lookup, with order values per customer."""
    lines = sale_lines(t, start, end, tz).withColumn("period", F.col(grain_column(grain)))
    measures = ["discounts", "gross_sales", "taxes", "total_sales", "net_sales",
                "profit_net_sales", "shipping_charges", "returns", "net_items",
                "total_discounts"]
    return sales_rollup(
        lines, [*t.scope, "period"], measures=measures, aov="per_customer"
    )

