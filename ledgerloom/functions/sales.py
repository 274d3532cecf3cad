"""Row-level measures of a sale entry (one order, edit or return line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import zero_if_null

RETURN, PRODUCT, SHIPPING, GIFT_CARD = "RETURN", "PRODUCT", "SHIPPING", "GIFT_CARD"


def line_is(kind: str) -> Column:
    return F.col("line_type") == kind


def returned() -> Column:
    return F.col("action_type") == RETURN


def ex_tax(amount: Column) -> Column:
    """Amount without the tax included in it, from the sum of the line's tax rates."""
    return F.try_divide(amount, F.lit(1.0) + F.col("tax_rate_sum"))


#: What `with_sale_fields` adds.
SALE_FIELDS = (
    "shipping_discounts", "gross_sales", "product_discounts", "returns", "taxes", "shipping_charges", "net_items",
    "total_discounts", "total_sales", "net_sales", "profit_net_sales",
)


def with_sale_fields(items: DataFrame) -> DataFrame:
    """Add the sales measures; every one defaults to 0.

    Discounts of lines that are neither product nor shipping count as product discounts, and
    returns carry negative amounts in the source data.
    """
    net_of_tax = F.col("total_amount") - F.col("total_tax")
    listed = F.col("quantity") * F.col("unit_price")
    discount = F.col("discount_before_taxes")
    base = items.withColumns(
        {
            "shipping_discounts": zero_if_null(F.when(~returned() & line_is(SHIPPING), discount)),
            "gross_sales": zero_if_null(
                F.when(returned() | ~line_is(PRODUCT), F.lit(0.0))
                .when(F.col("total_tax") != 0, ex_tax(listed))
                .otherwise(listed)
            ),
            "product_discounts": zero_if_null(F.when(~returned() & ~line_is(SHIPPING), discount)),
            "returns": zero_if_null(F.when(returned() & ~line_is(SHIPPING), net_of_tax)),
            "taxes": zero_if_null(F.col("total_tax")),
            "shipping_charges": zero_if_null(F.when(line_is(SHIPPING), net_of_tax)),
            "net_items": F.coalesce(F.when(~line_is(SHIPPING), F.col("quantity")), F.lit(0)),
        }
    )
    kept = F.col("gross_sales") - F.col("product_discounts") + F.col("returns")
    return base.withColumns(
        {
            "total_discounts": F.col("shipping_discounts") + F.col("product_discounts"),
            "total_sales": kept + F.col("taxes") + F.col("shipping_charges"),
            "net_sales": kept,
            "profit_net_sales": kept + F.col("shipping_charges"),
        }
    )


def original_order_flag() -> Column:
    """1 for lines sold within 31 seconds of the order itself, except shipping, gifts and returns."""
    gap_ms = F.abs(F.expr("timestampdiff(MILLISECOND, order_created_at, happened_at)"))
    sold = ~line_is(SHIPPING) & ~returned() & ~line_is(GIFT_CARD)
    return F.when((gap_ms < 31000) & sold, F.lit(1)).otherwise(F.lit(0))


def shipping_tax() -> Column:
    return zero_if_null(F.when(line_is(SHIPPING), F.col("total_tax")))


def paid_ex_tax() -> Column:
    return F.col("total_amount") - F.col("total_tax") - F.col("discount_before_taxes")
