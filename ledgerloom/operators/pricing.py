"""Sale entries, shipments and expenses with their costs attached."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import costs as C
from ledgerloom.functions.sales import SALE_FIELDS, SHIPPING, line_is, returned, with_sale_fields
from ledgerloom.functions.numbers import exact_parts, from_parts, sums
from ledgerloom.functions.timekeys import with_day_keys
from ledgerloom.operators import lookups as L


def price_lines(
    items: DataFrame,
    settings: DataFrame,
    order_shipping: DataFrame,
    product_costs: DataFrame,
    shipping_entries: DataFrame,
    scope: Sequence[str] = (),
    swapped_cost_flags: bool = False,
    shipping_fallback: str = "none",
    shipping_match: str = "contains",
    corrected_returns: bool = False,
    counted: bool = False,
) -> DataFrame:
    """Attach all lookups to sale entries with sale fields, and decide every cost.

    `swapped_cost_flags` books the cost of returned lines as sold and the other way round, which is
    what the period P&L does; the order page books them as named. `shipping_fallback` is `none`,
    `charge` (an unknown cost is the amount charged) or `entry` (presence of a table entry decides).

    `counted` is for sums: a line isn't repeated for its linked ids but has their number (`lookups.LINKED`), and
    `shipping_cost` is what it costs where no linked cost is known; `pricing.sums_of` counts both. Its sale fields are
    taken to be those of `with_sale_fields`: they are left out of what the lookups shuffle and made again.
    """
    if counted:
        items = items.drop(*SALE_FIELDS)
    joined = L.with_settings(items, settings, scope).withColumns(L.setting_columns())
    # sale ids are long, and no two are alike
    spread = ("order_id", "total_amount", "total_tax") if counted else ("order_id", "sale_id")
    joined = L.with_product_costs(joined, product_costs, scope, spread)
    joined = L.with_region_shipping(joined, shipping_entries, scope, line_is(SHIPPING))
    # Last, since it repeats a line for every linked id: no other lookup shuffles the repeats.
    joined = L.with_order_shipping(
        joined, order_shipping, scope, shipping_match, names=items, counted=counted, spread_over=spread if counted else spread[1:]
    )
    if counted:
        joined = with_sale_fields(joined).withColumn("linked_shipping", F.lit(None).cast("double"))
    unit_cost = C.unit_product_cost(F.col("unit_price_ex_tax"))
    joined = joined.withColumn("unit_price_ex_tax", C.unit_price_ex_tax())
    joined = joined.withColumns(
        {"unit_product_cost": unit_cost, "unit_handling_fee": C.unit_handling_fee()}
    )
    if shipping_fallback == "entry":
        shipping = C.shipping_cost_by_entry()
    else:
        shipping = C.shipping_cost(C.shipping_candidates(), shipping_fallback == "charge")
    unit = F.col("unit_product_cost")
    return joined.withColumns(
        {
            "sold_product_cost": C.extended_cost(unit, of_returns=swapped_cost_flags),
            "returned_goods_cost": C.extended_cost(unit, of_returns=not swapped_cost_flags),
            "handling_fee": C.extended_cost(F.col("unit_handling_fee"), of_returns=False),
            "shipping_cost": shipping,
            "return_shipping_cost": C.return_shipping_cost(corrected_returns),
        }
    )


def sums_of(priced: DataFrame, columns: dict[str, Column]) -> list[Column]:
    """Sums by name of columns of priced lines; counted lines give what their repeats would sum to."""
    if "linked_rows" not in priced.columns:
        return sums(priced, columns)
    return [
        _shipping_sum().alias(name) if name == "shipping_cost" else column
        for name, column in zip(columns, sums(priced, columns, F.col("linked_rows")), strict=True)
    ]


def _shipping_sum() -> Column:
    """Exact sum of counted lines' shipping costs: a repeat with a linked cost has that, any other the line's own."""
    linked = line_is(SHIPPING) & ~returned() & (F.col("linked_known") > 0)
    others = F.col("linked_rows") - F.when(linked, F.col("linked_known")).otherwise(F.lit(0))
    parts = []
    for known, own in zip(("linked_whole", "linked_rest"), exact_parts(F.col("shipping_cost")), strict=True):
        summed = F.coalesce(F.col(known), F.raise_error(F.lit("a linked shipping cost is too large to be summed")).cast("long"))
        # a cost that isn't known counts for nothing
        parts.append(F.sum(F.when(linked, summed + F.coalesce(own * others, F.lit(0))).otherwise(own * others)))
    return from_parts(*parts)


def price_shipments(
    shipments: DataFrame, settings: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """Shipments with the tier their unit count falls in and the costs of that tier."""
    joined = L.with_settings(shipments, settings, scope)
    return joined.withColumns(C.fulfillment_costs(F.col("settings.tiers"))).drop("settings")


def daily_ledger(
    schedule: DataFrame, start: str | date, end: str | date, scope: Sequence[str] = ()
) -> DataFrame:
    """One row per scheduled expense and active day of [start, end], with the day's share.

    Each expense generates only its own active days, so there is no product of the schedule with the
    calendar. Unknown frequencies keep their rows with a NULL share.
    """
    first = F.greatest(F.col("start_date"), F.lit(str(start)).cast("date"))
    last = F.least(F.col("end_date"), F.lit(str(end)).cast("date"))
    usable = (
        (F.col("cost") > 0)
        & F.col("start_date").isNotNull()
        & F.col("end_date").isNotNull()
        & (first <= last)
    )
    days = schedule.where(usable).withColumn("day", F.explode(F.sequence(first, last)))
    ledger = days.withColumns(
        {
            "tag": F.coalesce("tag", F.lit("")),
            "days_in_month": C.days_in_month("day"),
            "daily_cost": C.daily_cost(F.col("day")),
        }
    )
    return with_day_keys(ledger, "day")
