"""Raw ad and settings tables -> typed models.

Each function keeps the `tenantid` column of a lake scan when there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.timekeys import period_columns
from ledgerloom.sources.schemas import TIER

OPEN_END = "9999-01-01"
SIMPLE_KEY = "baseCostPerOrder"
UNLIMITED_UNITS = 9999999


def _store(raw: DataFrame) -> list[str]:
    return [c for c in ("tenantid",) if c in raw.columns]


def _num(name: str) -> Column:
    return F.col(name).cast("double")


def _day_keys(day: Column) -> list[Column]:
    return [column.alias(name) for name, column in period_columns(day).items()]


def meta_ads_model(raw: DataFrame) -> DataFrame:
    day = F.col("snapshotDate").cast("date")
    lists = ["actions", "action_values", "purchase_roas", "outbound_clicks_ctr",
             "cost_per_outbound_click", "outbound_clicks"]
    return raw.select(
        *_store(raw),
        *[_num(c).alias(c) for c in ("spend", "cpc", "ctr", "cpm", "clicks")],
        *lists,
        "campaign_name",
        F.col("date_start").cast("date").alias("date_start"),
        F.col("date_stop").cast("date").alias("date_stop"),
        "account_id",
        day.alias("snapshot_date"),
        *_day_keys(day),
    )


def google_ads_model(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_store(raw),
        _num("metrics.costMicros").alias("cost_micros"),
        _num("metrics.clicks").alias("clicks"),
        _num("metrics.conversions").alias("conversions"),
        *_day_keys(F.col("snapshotDate").cast("date")),
    )


def tiktok_ads_model(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_store(raw),
        *[_num(c).alias(c) for c in ("spend", "clicks", "conversion")],
        *_day_keys(F.col("snapshotDate").cast("date")),
    )


def cost_schedule_model(raw: DataFrame) -> DataFrame:
    """Scheduled expenses; an empty or missing end date stays open until 9999-01-01."""
    end = F.coalesce(F.nullif(F.col("EndDate"), F.lit("")), F.lit(OPEN_END))
    return raw.select(
        *_store(raw),
        F.col("Id").alias("id"),
        F.col("ExpenseName").alias("expense_name"),
        F.col("Status").alias("status"),
        F.col("Category").alias("category"),
        _num("Cost").alias("cost"),
        F.col("Frequency").alias("frequency"),
        F.col("Tags").alias("tag"),
        F.col("StartDate").cast("date").alias("start_date"),
        end.cast("date").alias("end_date"),
    )


def product_costs_model(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_store(raw),
        F.col("variantId").alias("variant_id"),
        F.col("productId").alias("product_id"),
        _num("productCost").alias("product_cost"),
        _num("packingFee").alias("packing_fee"),
        "title",
        "sku",
        _num("price").alias("price"),
    )


def shipping_entries_model(raw: DataFrame) -> DataFrame:
    """Shipping cost table as rows; `position` keeps the order of the lake.

    Entries come by lake date, then by file name, then by line. The line number counts lines of a task,
    which reads a file from its start, so it orders lines within one file only.
    """
    at = [F.col(c) if c in raw.columns else F.lit("").alias(c) for c in ("date", "file")]
    line = F.monotonically_increasing_id().alias("line")
    return raw.select(
        *_store(raw),
        F.col("countryName").alias("country_name"),
        "region",
        F.col("countryCode").alias("country_code"),
        _num("shippingCost").alias("shipping_cost"),
        _num("returnShippingCost").alias("return_cost"),
        F.struct(*at, line).alias("position"),
    )


def shipping_by_country_model(entries: DataFrame) -> DataFrame:
    """The table as one list per store, for readers that want a single row.

    The reports join the rows instead. A store lists at most one entry per country and region.
    """
    fields = ["country_name", "region", "country_code", "shipping_cost", "return_cost"]
    ordered = F.array_sort(F.collect_list(F.struct("position", *fields)))
    plain = F.transform(ordered, lambda e: F.struct(*[e[name].alias(name) for name in fields]))
    return entries.groupBy(*_store(entries)).agg(plain.alias("entries"))


def order_shipping_model(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_store(raw),
        F.col("orderId").alias("order_id"),
        _num("shippingCost").alias("shipping_cost"),
    )


def default_values_model(raw: DataFrame) -> DataFrame:
    """Store settings with one list of fulfillment price tiers.

    A price object with key `baseCostPerOrder` (present, even if null) is a single tier for any
    number of units. Otherwise the value is a list of tiers with unit bounds of their own.
    """
    costs = F.col("defaultFulfillmentCosts")
    has_key = F.array_contains(F.json_object_keys(costs), SIMPLE_KEY)
    simple = F.coalesce(has_key, F.lit(False))
    one = F.from_json(
        costs,
        f"{SIMPLE_KEY} string, costPerAdditionalProduct string,"
        "packagingBaseCostPerOrder string, packagingCostPerAdditionalProduct string",
    )
    many = F.from_json(
        costs,
        "array<struct<fulFillmentBaseCostPerOrder: string,"
        "fulFillmentCostPerAdditionalProduct: string, packagingBaseCostPerOrder: string,"
        "packagingCostPerAdditionalProduct: string, minUnits: struct<id: string>,"
        "maxUnits: struct<id: string>>>",
    )

    def tier(source, base: str, more: str, low: Column, high: Column) -> Column:
        return F.struct(
            source[base].cast("double").alias("fulfillment_base"),
            source[more].cast("double").alias("fulfillment_additional"),
            source["packagingBaseCostPerOrder"].cast("double").alias("packaging_base"),
            source["packagingCostPerAdditionalProduct"].cast("double").alias("packaging_additional"),
            low.cast("int").alias("min_units"),
            high.cast("int").alias("max_units"),
        )

    single = F.array(
        tier(one, SIMPLE_KEY, "costPerAdditionalProduct", F.lit(0), F.lit(UNLIMITED_UNITS))
    )
    listed = F.transform(
        many,
        lambda x: tier(
            x,
            "fulFillmentBaseCostPerOrder",
            "fulFillmentCostPerAdditionalProduct",
            x["minUnits"]["id"],
            x["maxUnits"]["id"],
        ),
    )
    return raw.select(
        *_store(raw),
        _num("defaultGrossProfitMargin").alias("margin_pct"),
        _num("defaultShippingMargin").alias("shipping_margin"),
        _num("defaultReturnMargin").alias("return_margin"),
        F.lit(True).alias("exclude_returned_cost"),
        F.when(simple, F.lit("simplePricing")).otherwise(F.lit("variablePricing")).alias("pricing"),
        F.when(simple, single).otherwise(listed).cast(f"array<{TIER}>").alias("tiers"),
    )


def transaction_fees_model(raw: DataFrame) -> DataFrame:
    conversion = F.coalesce(F.nullif(F.col("currencyConversionFee"), F.lit("")), F.lit("0"))
    return raw.select(
        *_store(raw),
        _num("feePerc").alias("fee_pct"),
        "name",
        F.col("applyOnCountries").cast("boolean").alias("apply_on_countries"),
        _num("id").alias("id"),
        _num("fixedFee").alias("fixed_fee"),
        "countries",
        conversion.cast("double").alias("currency_conversion_fee"),
        *_day_keys(F.col("snapshotDate").cast("date")),
    )
