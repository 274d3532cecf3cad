"""List helpers over arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_sum(values: Column) -> Column:
    """Sum of a list of doubles. NULL entries are skipped; an empty or NULL list gives NULL."""
    kept = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda total, v: total + v))


def tax_rate_sum(tax_lines: Column) -> Column:
    """Sum of `rate` over the tax lines of a sale entry."""
    return list_sum(F.transform(tax_lines, lambda line: line["rate"].cast("double")))


def purchase_conversions(actions: Column) -> Column:
    """Sum of the values of actions of type `purchase`; NULL when there are none."""
    bought = F.filter(actions, lambda a: a["action_type"] == "purchase")
    return list_sum(F.transform(bought, lambda a: a["value"].cast("double")))


def matching_tiers(tiers: Column, units: Column) -> Column:
    """Fulfillment tiers whose unit bounds hold the quantity, in their order."""
    return F.filter(tiers, lambda t: units.between(t["min_units"], t["max_units"]))
