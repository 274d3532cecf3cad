"""Aggregations of sale entries, ads, payments, shipments and expenses by any key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.lists import purchase_conversions
from ledgerloom.functions.costs import google_spend
from ledgerloom.functions.numbers import exact_sum, ratio, sums, zero_if_null
from ledgerloom.operators.merge import merge_by_key
from ledgerloom.operators.pricing import sums_of
from ledgerloom.session import stored

# Measures that are also reported for new and for repeat customers, with the column they sum.
SEGMENTED = {
    "discounts": "discount_before_taxes",
    "gross_sales": "gross_sales",
    "total_discounts": "total_discounts",
    "total_sales": "total_sales",
    "net_sales": "net_sales",
    "profit_net_sales": "profit_net_sales",
    "shipping_charges": "shipping_charges",
    "returns": "returns",
}
# All plainly summed measures of a sale entry, with the column they sum.
SUMMED = {
    "paid": "total_amount",
    **SEGMENTED,
    "taxes": "taxes",
    "net_items": "net_items",
    "product_cost": "sold_product_cost",
    "returned_product_cost": "returned_goods_cost",
    "handling_fee": "handling_fee",
    "shipping_cost": "shipping_cost",
}
SALES_ONLY = [m for m in SUMMED if m not in
              ("product_cost", "returned_product_cost", "handling_fee", "shipping_cost")]


def is_new() -> Column:
    return F.col("customer_order_index") == 1


def is_repeat() -> Column:
    return F.col("customer_order_index") > 1


def plain_sums(items: DataFrame, keys: Sequence[str], measures: Sequence[str] | None = None):
    """Plain sums; one shuffle of partially aggregated rows."""
    names = list(SUMMED) if measures is None else list(measures)
    return items.groupBy(*keys).agg(*sums_of(items, {m: F.col(SUMMED[m]) for m in names}))


def segment_columns() -> dict[str, Column]:
    """What new and repeat totals sum as ordinary conditional sums."""
    parts = {}
    for name, column in SEGMENTED.items():
        parts[f"new_{name}"] = F.when(is_new(), F.col(column))
        parts[f"repeat_{name}"] = F.when(is_repeat(), F.col(column))
    return parts


def _segment_sums(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    return items.groupBy(*keys).agg(*sums_of(items, segment_columns()))


def distinct_totals(
    items: DataFrame, keys: Sequence[str], distinct_amounts: bool = True
) -> DataFrame:
    """Distinct customers and orders (all, new, repeat) and SUM(DISTINCT) of the segmented measures.

    Written as one GROUP BY this needs 22 distinct aggregates, and Spark would copy each row once per
    distinct expression, all columns wide. Here each line emits narrow (kind, id, amount) entries
    with a bit mask of the measures and segments they count for. Equal entries merge before the
    shuffle by OR-ing the masks, so zeros and repeated amounts travel once per key, and a large key is
    spread over tasks by its values. The second grouping only sums already merged entries.
    """
    return entry_totals(distinct_entries(items, keys, distinct_amounts), keys, distinct_amounts)


def distinct_entries(items: DataFrame, keys: Sequence[str], distinct_amounts: bool = True) -> DataFrame:
    """The merged entries of `distinct_totals`: the sets it counts and sums, as rows.

    Entries of finer keys merge to those of coarser ones (`merged_entries`), which their counts and sums
    don't.
    """
    names = list(SEGMENTED) if distinct_amounts else []
    segment = F.when(is_new(), F.lit(1)).when(is_repeat(), F.lit(2)).otherwise(F.lit(0))
    entries = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.col(column).cast("string").alias("id"),
            F.lit(None).cast("double").alias("amount"),
            (F.lit(4) + segment).cast("int").alias("mask"),
        )
        for kind, column in ((1, "customer_id"), (2, "order_id"))
    ]
    for bit, name in enumerate(names):
        shifted = F.when(is_new(), F.lit(1 << (2 * bit))).when(is_repeat(), F.lit(2 << (2 * bit)))
        entries.append(
            F.struct(
                F.lit(0).alias("kind"),
                F.lit(None).cast("string").alias("id"),
                F.col(SEGMENTED[name]).alias("amount"),
                F.coalesce(shifted, F.lit(0)).cast("int").alias("mask"),
            )
        )
    lines = items.select(*keys, F.inline(F.array(*entries)))
    counted = (F.col("kind") > 0) & F.col("id").isNotNull()
    summed = (F.col("kind") == 0) & F.col("amount").isNotNull() & (F.col("mask") > 0)
    return merged_entries(lines.where(counted | summed), keys)


def merged_entries(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    return entries.groupBy(*keys, "kind", "id", "amount").agg(F.bit_or("mask").alias("mask"))


def entry_totals(merged: DataFrame, keys: Sequence[str], distinct_amounts: bool = True) -> DataFrame:
    """Counts and sums of merged entries."""
    names = list(SEGMENTED) if distinct_amounts else []

    def has(bits: int) -> Column:
        return F.col("mask").bitwiseAND(F.lit(bits)) != 0

    parts = []
    for kind, noun in ((1, "customers"), (2, "orders")):
        for prefix, bits in (("", 4), ("new_", 1), ("repeat_", 2)):
            hit = (F.col("kind") == kind) & has(bits)
            parts.append(F.count_if(hit).alias(f"{prefix}{noun}"))
    amount = F.col("kind") == 0
    for bit, name in enumerate(names):
        for prefix, base in (("new_", 1), ("repeat_", 2)):
            hit = amount & has(base << (2 * bit))
            parts.append(exact_sum(F.when(hit, F.col("amount"))).alias(f"{prefix}{name}"))
    return merged.groupBy(*keys).agg(*parts)


def distinct_totals_direct(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`distinct_totals` as one GROUP BY with DISTINCT aggregates, to compare against.

    New and repeat are filters of the same DISTINCT, so Spark copies a row once per column, not once per
    column and segment.
    """
    segments = {"new": "customer_order_index = 1", "repeat": "customer_order_index > 1"}
    parts = []
    for column, noun in (("customer_id", "customers"), ("order_id", "orders")):
        parts.append(F.count_distinct(column).alias(noun))
        for prefix, rows in segments.items():
            parts.append(F.expr(f"count(DISTINCT {column}) FILTER (WHERE {rows}) AS {prefix}_{noun}"))
    for name, column in SEGMENTED.items():
        for prefix, rows in segments.items():
            parts.append(F.expr(f"sum(DISTINCT {column}) FILTER (WHERE {rows}) AS {prefix}_{name}"))
    return items.groupBy(*keys).agg(*parts)


def sales_rollup(
    priced: DataFrame,
    keys: Sequence[str],
    lines: DataFrame | None = None,
    measures: Sequence[str] | None = None,
    distinct_amounts: bool = True,
    aov: str = "per_order",
) -> DataFrame:
    """All sales aggregates per key.

    `priced` carries the lookup joins, with repeated or with counted lines. `lines` is the same set of sale entries before those joins:
    distinct counts and distinct sums do not depend on lookups or on their fan-out, so they are taken
    from there and the joins run for the plain sums alone. With `distinct_amounts=False` the new and
    repeat totals are ordinary conditional sums.

    `aov="per_order"` divides by the orders of the same segment. `aov="per_customer"` sums
    (gross - discounts) per line and divides every variant by all customers.
    """
    keys = list(keys)
    lines = priced if lines is None else lines
    # Stored one after the other, so that the driver plans, compiles and follows one of them at a time.
    sources = {
        "sums": stored(plain_sums(priced, keys, measures), "sales-sums"),
        "distinct": stored(distinct_totals(lines, keys, distinct_amounts), "sales-distinct"),
    }
    if not distinct_amounts:
        sources["segments"] = _segment_sums(priced, keys)
    if aov == "per_customer":
        sources["basket"] = _basket_totals(lines, keys)
    return rolled_up(sources, keys, aov)


def rolled_up(sources: dict[str, DataFrame], keys: Sequence[str], aov: str = "per_order") -> DataFrame:
    """Sums and counts per key as one row, with the ratios of them."""
    counts = [f"{p}{noun}" for noun in ("customers", "orders") for p in ("", "new_", "repeat_")]
    rolled = merge_by_key(sources, keys).fillna(0, counts)
    return with_sales_ratios(rolled, aov)


def _basket_totals(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    value = F.col("gross_sales") - F.col("total_discounts")
    everything = lines.groupBy(*keys).agg(*sums_of(lines, {"basket": value}))
    lines = lines.select(*keys, value.alias("value"), "customer_order_index")
    merged = lines.groupBy(*keys, "value").agg(
        F.max(is_new()).alias("is_new"), F.max(is_repeat()).alias("is_repeat")
    )
    baskets = {f"{p}_basket": F.when(F.col(f"is_{p}"), F.col("value")) for p in ("new", "repeat")}
    split = merged.groupBy(*keys).agg(*sums(merged, baskets))
    return merge_by_key({"all": everything, "split": split}, keys)


def with_sales_ratios(rolled: DataFrame, aov: str = "per_order") -> DataFrame:
    """Average order values, share of returns and items per order, from the rolled-up sums."""
    columns = {}
    for prefix in ("", "new_", "repeat_"):
        if aov == "per_customer":
            value = ratio(F.col(f"{prefix}basket"), F.col("customers"))
        else:
            basket = F.col(f"{prefix}gross_sales") - F.col(f"{prefix}total_discounts")
            value = ratio(basket, F.col(f"{prefix}orders"))
        columns[f"{prefix}aov"] = value
    columns["sales_returns_pct"] = ratio(F.col("returns"), F.col("total_sales"), 100.0)
    columns["items_per_order"] = ratio(F.col("net_items"), F.col("orders"))
    helpers = ["basket", "new_basket", "repeat_basket"] if aov == "per_customer" else []
    return rolled.withColumns(columns).drop(*helpers)


def ad_rollup(ads: DataFrame, source: str, keys: Sequence[str]) -> DataFrame:
    """Spend, clicks and conversions of one ad source (`google`, `tiktok` or `meta`)."""
    spend = google_spend() if source == "google" else zero_if_null(F.col("spend"))
    conversions = {
        "google": lambda: F.col("conversions"),
        "tiktok": lambda: F.col("conversion"),
        "meta": lambda: purchase_conversions(F.col("actions")),
    }[source]()
    columns = {
        f"{source}_spend": spend,
        f"{source}_clicks": zero_if_null(F.col("clicks")),
        f"{source}_conversions": zero_if_null(conversions),
    }
    return ads.groupBy(*keys).agg(*sums(ads, columns))


def fulfillment_rollup(shipments: DataFrame, keys: Sequence[str]) -> DataFrame:
    costs = ("packaging_cost", "fulfillment_only_cost", "fulfillment_cost")
    return shipments.groupBy(*keys).agg(*sums(shipments, {c: F.col(c) for c in costs}))


def payment_fees(transactions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fees of successful sales in the store's currency."""
    kept = transactions.where((F.col("kind") == "SALE") & F.col("error_code").isNull())
    return kept.groupBy(*keys).agg(*sums(kept, {"payment_fees": F.col("amount") * F.col("fx_rate")}))


def cost_by_tag(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Staff, marketing and operational expenses per key; all NULL where no share is known."""

    def tagged(tag: str) -> Column:
        return exact_sum(F.col("daily_cost") * (F.col("tag") == tag).cast("int"))

    return (
        ledger.groupBy(*keys)
        .agg(
            tagged("staff-costs").alias("staff_cost"),
            tagged("marketing-expenses").alias("marketing_cost"),
            tagged("operational-expenses").alias("operational_cost"),
        )
        .withColumn(
            "staff_and_operational_cost", F.col("staff_cost") + F.col("operational_cost")
        )
    )
