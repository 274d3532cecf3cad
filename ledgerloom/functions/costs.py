"""Cost decisions of a sale entry, a fulfillment and a scheduled expense.

Inputs are the columns the lookup joins add: `margin_pct`, `default_shipping`, `default_return`
(settings), `cost_variant_id`, `variant_cost`, `packing_fee` (product costs), `linked_shipping`
(order-linked shipping) and the `region_*` / `everywhere_*` pairs (shipping table).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.lists import matching_tiers
from ledgerloom.functions.numbers import zero_if_null
from ledgerloom.functions.sales import PRODUCT, SHIPPING, ex_tax, line_is, returned
from ledgerloom.functions.timekeys import days_in_month

def _zero() -> Column:
    return F.lit(0.0)


def unit_price_ex_tax() -> Column:
    sold_product = line_is(PRODUCT) & ~returned()
    price = F.col("unit_price")
    return (
        F.when(sold_product & (F.col("total_tax") != 0), ex_tax(price))
        .when(sold_product & (F.col("total_tax") == 0), price)
        .otherwise(_zero())
    )


def unit_product_cost(price_ex_tax: Column) -> Column:
    """Known cost of the variant, else the price less the default margin, else the price."""
    margin = F.col("margin_pct")
    cost = F.col("variant_cost")
    unknown = (
        F.col("variant_id").isNull()
        | F.col("cost_variant_id").isNull()
        | cost.isNull()
        | (cost <= 0)
    )
    return (
        F.when(~line_is(PRODUCT), _zero())
        .when(unknown & margin.isNotNull(), price_ex_tax * (F.lit(1.0) - margin / F.lit(100.0)))
        .when(cost > 0, cost)
        .otherwise(price_ex_tax)
    )


def extended_cost(unit_cost: Column, of_returns: bool) -> Column:
    """Units times unit cost for returned lines only, or for all other lines only."""
    wanted = returned() if of_returns else ~returned()
    return wanted.cast("int") * F.col("quantity") * unit_cost


def unit_handling_fee() -> Column:
    return (
        F.when(~line_is(PRODUCT), _zero())
        .when(F.col("variant_id").isNull(), _zero())
        .otherwise(zero_if_null(F.col("packing_fee")))
    )


def shipping_candidates() -> Column:
    """Outbound candidates, best first, for shipping lines that are not returns."""
    return F.when(
        line_is(SHIPPING) & ~returned(),
        F.struct(
            F.col("linked_shipping").alias("linked"),
            F.col("region_shipping").alias("region"),
            F.col("everywhere_shipping").alias("everywhere"),
            F.col("default_shipping").alias("default_margin"),
            F.col("shipping_charges").alias("charged"),
        ),
    )


def return_shipping_candidates() -> Column:
    """Return candidates, best first, for shipping lines that are returns."""
    return F.when(
        line_is(SHIPPING) & returned(),
        F.struct(
            F.col("region_return").alias("region"),
            F.col("everywhere_return").alias("everywhere"),
            F.col("default_return").alias("default_margin"),
        ),
    )


def shipping_cost(candidates: Column, fallback_to_charge: bool = False) -> Column:
    """First known outbound candidate; NULL when none is known.

    With `fallback_to_charge` the amount charged to the customer stands in for an unknown cost.
    """
    order = ["linked", "region", "everywhere", "default_margin"]
    if fallback_to_charge:
        order.append("charged")
    decided = F.coalesce(*[candidates[name] for name in order])
    return F.when(~line_is(SHIPPING), _zero()).when(returned(), _zero()).otherwise(decided)


def shipping_cost_by_entry() -> Column:
    """Outbound cost where the mere presence of a table entry decides, even one without a cost."""
    return (
        F.when(~line_is(SHIPPING), _zero())
        .when(returned(), _zero())
        .when(F.col("linked_shipping").isNotNull(), F.col("linked_shipping"))
        .when(F.col("region_found"), F.col("region_shipping"))
        .when(F.col("everywhere_found"), F.col("everywhere_shipping"))
        .when(F.col("default_shipping").isNotNull(), F.col("default_shipping"))
        .otherwise(F.col("shipping_charges"))
    )


def return_shipping_cost(corrected: bool = False) -> Column:
    """Return shipping cost. The plain form is always 0; the corrected form uses the table.

    The default return amount counts only when a default shipping amount is set as well.
    """
    if not corrected:
        return _zero()
    return (
        F.when(~line_is(SHIPPING), _zero())
        .when(~returned(), _zero())
        .when(F.col("region_found"), F.col("region_return"))
        .when(F.col("everywhere_found"), F.col("everywhere_return"))
        .when(F.col("default_shipping").isNotNull(), F.col("default_return"))
        .otherwise(_zero())
    )


def return_shipping_cost_known(candidates: Column) -> Column:
    """First known return candidate, whatever entry it is from; 0 for other lines, NULL when none is known."""
    known = F.coalesce(*[candidates[name] for name in ("region", "everywhere", "default_margin")])
    return F.when(line_is(SHIPPING) & returned(), known).otherwise(_zero())


def fulfillment_costs(tiers: Column) -> dict[str, Column]:
    """Matching tiers, and packaging, fulfillment and combined cost from the first of them.

    The combined cost holds the two base costs only, without the part for additional units.
    """
    units = F.col("total_quantity")
    matching = matching_tiers(tiers, units)
    tier = F.get(matching, F.lit(0))
    pack, ship = tier["packaging_base"].cast("double"), tier["fulfillment_base"].cast("double")
    pack_more = tier["packaging_additional"].cast("double")
    ship_more = tier["fulfillment_additional"].cast("double")
    return {
        "matching_tiers": matching,
        "packaging_base": pack,
        "packaging_additional": pack_more,
        "fulfillment_base": ship,
        "fulfillment_additional": ship_more,
        "packaging_cost": pack + (units - 1) * pack_more,
        "fulfillment_only_cost": ship + (units - 1) * ship_more,
        "fulfillment_cost": pack + ship,
    }


def daily_cost(day: Column) -> Column:
    """Share of a scheduled expense that falls on one of its active days."""
    cost, often = F.col("cost"), F.col("frequency")
    return (
        F.when(often == "Monthly", cost / days_in_month(day))
        .when(often == "Weekly", cost / F.lit(7))
        .when(often == "Yearly", cost / F.lit(365))
        .when(often == "Daily", cost)
        .when((often == "Just Once") & (F.col("start_date") == day), cost)
    )


def toggled_product_cost(toggle: Column, sold: Column, returned_cost: Column) -> Column:
    """Product cost, less the cost of returned goods where the store excludes them."""
    return F.when(toggle, sold - returned_cost).otherwise(sold)


def google_spend() -> Column:
    return zero_if_null(F.col("cost_micros")) / F.lit(1000000)
