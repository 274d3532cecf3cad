"""Profit metrics over merged per-key aggregates.

Every formula says which input it reads. `raw(x)` is the merged aggregate and may be NULL;
`known(x)` is the same value with 0 for NULL. As shipped, most formulas read raw values and turn a
NULL result into 0, so one missing source zeroes the whole figure (no payment fees on a day means
COGS 0 on that day). Policies:

* `parity`     raw inputs, NULL results become 0
* `corrected`  missing sources count as 0
* `propagate`  raw inputs, NULL results stay NULL
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.costs import toggled_product_cost
from ledgerloom.functions.numbers import ratio, zero_if_null

POLICIES = ("parity", "corrected", "propagate")

# Aggregates the order page needs; all of them plain sums.
ORDER_PROFIT_INPUTS = [
    "paid", "discounts", "shipping_charges", "shipping_cost", "fulfillment_cost", "payment_fees",
    "handling_fee", "taxes", "profit_net_sales", "product_cost", "returned_product_cost",
]
# Aggregates shown as they are.
ORDER_SHOWN = [
    "product_cost", "returned_product_cost", "handling_fee", "fulfillment_cost",
    "shipping_charges", "new_shipping_charges", "taxes", "shipping_cost",
    "orders", "new_orders", "repeat_orders", "new_customers",
    "gross_sales", "new_gross_sales", "repeat_gross_sales",
    "discounts", "new_discounts", "repeat_discounts", "returns", "payment_fees",
    "total_sales", "new_total_sales", "repeat_total_sales",
    "net_sales", "new_net_sales", "repeat_net_sales",
    "profit_net_sales", "new_profit_net_sales", "repeat_profit_net_sales",
    "net_items", "customers", "repeat_customers",
    "aov", "new_aov", "repeat_aov", "items_per_order",
]
PERIOD_SHOWN = ORDER_SHOWN + [
    "meta_spend", "google_spend", "tiktok_spend",
    "tiktok_conversions", "meta_conversions", "google_conversions",
    "tiktok_clicks", "meta_clicks", "google_clicks",
    "marketing_cost", "operational_cost", "staff_cost", "staff_and_operational_cost",
]


class _Formulas:
    """Collects derived columns in dependency order, applying one null policy."""

    def __init__(self, df: DataFrame, policy: str, shown: list[str]):
        if policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}")
        self.policy = policy
        self.shown = shown
        self.layers: list[dict[str, Column]] = []
        self.df = df

    def raw(self, name: str) -> Column:
        column = F.col(f"raw_{name}")
        return zero_if_null(column) if self.policy == "corrected" else column

    def known(self, name: str) -> Column:
        column = F.col(f"raw_{name}")
        return column if self.policy == "propagate" else zero_if_null(column)

    def settle(self, x: Column) -> Column:
        return x if self.policy == "propagate" else zero_if_null(x)

    def div(self, a: Column, b: Column, scale: float = 1.0) -> Column:
        return self.settle(ratio(a, b, scale))

    def add(self, **columns: Column) -> None:
        """Add one layer; later layers may read its columns by name."""
        self.layers.append(columns)
        self.df = self.df.withColumns(columns)

    def names(self) -> list[str]:
        return [name for layer in self.layers for name in layer]


def _raw_inputs(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({name: f"raw_{name}" for name in names})


def _cogs_and_profit(f: _Formulas) -> None:
    raw = f.raw
    f.add(
        product_cost_after_toggle=f.settle(
            toggled_product_cost(
                F.col("settings.exclude_returned_cost"),
                raw("product_cost"),
                raw("returned_product_cost"),
            )
        )
    )
    f.add(
        cogs=f.settle(
            F.col("product_cost_after_toggle")
            + raw("handling_fee")
            + raw("payment_fees")
            + raw("fulfillment_cost")
            + raw("shipping_cost")
        )
    )
    f.add(gross_profit=f.settle(raw("profit_net_sales") - F.col("cogs")))
    f.add(gross_margin_pct=f.div(F.col("gross_profit"), raw("profit_net_sales"), 100.0))


def _per_customer(f: _Formulas) -> None:
    # As shipped, the profit of either customer group bears the whole COGS.
    raw, cogs = f.raw, F.col("cogs")
    f.add(
        new_gross_profit=f.settle(raw("new_profit_net_sales") - cogs),
        repeat_gross_profit=f.settle(raw("repeat_profit_net_sales") - cogs),
    )
    f.add(
        gross_profit_per_new_customer=f.div(F.col("new_gross_profit"), raw("new_customers")),
        gross_profit_per_repeat_customer=f.div(
            F.col("repeat_gross_profit"), raw("repeat_customers")
        ),
        break_even_roas=f.div(raw("profit_net_sales"), F.col("gross_profit")),
        # As shipped, the COGS share repeats the gross margin.
        cogs_pct=f.div(F.col("gross_profit"), raw("profit_net_sales"), 100.0),
    )


def _returns_share(f: _Formulas) -> Column:
    # The NULL-keeping form of the report divides total sales by themselves.
    top = "total_sales" if f.policy == "propagate" else "returns"
    return f.div(f.raw(top), f.raw("total_sales"), 100.0)


def order_profit(merged: DataFrame, keys: list[str], policy: str = "parity") -> DataFrame:
    """COGS and gross profit per key from plain sums only, as the order page shows them."""
    f = _Formulas(_raw_inputs(merged, ORDER_PROFIT_INPUTS), policy, ORDER_PROFIT_INPUTS)
    _cogs_and_profit(f)
    return f.df.select(*keys, *[f.known(n).alias(n) for n in ORDER_PROFIT_INPUTS], *f.names())


def order_metrics(merged: DataFrame, keys: list[str], policy: str = "parity") -> DataFrame:
    """Profit per key without ads and scheduled expenses (order page, or any other grain).

    `merged` holds the sales, payment and fulfillment aggregates per key, and `settings`.
    """
    shown = ["paid", *ORDER_SHOWN]
    f = _Formulas(_raw_inputs(merged, shown), policy, shown)
    _cogs_and_profit(f)
    _per_customer(f)
    f.add(returns_pct=_returns_share(f))
    return f.df.select(*keys, *[f.known(n).alias(n) for n in shown], *f.names())


def period_metrics(merged: DataFrame, keys: list[str], policy: str = "parity") -> DataFrame:
    """The whole period P&L per key from sales, payments, shipments, expenses and the ad sources."""
    f = _Formulas(_raw_inputs(merged, PERIOD_SHOWN), policy, PERIOD_SHOWN)
    raw, known, col = f.raw, f.known, F.col
    f.add(
        ad_spend=f.settle(known("google_spend") + known("meta_spend") + known("tiktok_spend")),
        ad_clicks=f.settle(known("google_clicks") + known("meta_clicks") + known("tiktok_clicks")),
        ad_conversions=f.settle(
            known("google_conversions") + known("meta_conversions") + known("tiktok_conversions")
        ),
    )
    _cogs_and_profit(f)
    _per_customer(f)
    net, spend = raw("profit_net_sales"), col("ad_spend")
    before_expenses = net - col("cogs") - raw("marketing_cost") - spend
    margin = f.settle(before_expenses - raw("operational_cost") - raw("staff_cost"))
    f.add(
        marketing_and_ads=f.settle(raw("marketing_cost") + spend),
        contribution_margin=margin,
        # As shipped, net profit equals the contribution margin.
        net_profit=margin,
        break_even_marketing=f.settle(
            net - col("cogs") - raw("operational_cost") - raw("staff_cost")
        ),
        click_to_purchase_pct=f.div(col("ad_conversions"), col("ad_clicks"), 100.0),
        blended_roas=f.div(col("ad_conversions"), spend),
        # As shipped, a sum despite its place among the percentages.
        staff_and_operational_total=f.settle(raw("operational_cost") + raw("staff_cost")),
        staff_cost_pct=f.div(raw("staff_cost"), net, 100.0),
        blended_cpa=f.div(spend, raw("orders")),
        cpa_ads=f.div(spend, raw("new_orders")),
        acquisition_mer_ads=f.div(raw("new_profit_net_sales"), spend),
        mer_ads=f.div(net, spend),
        new_customer_sales_ratio_ads=f.div(raw("new_total_sales"), spend),
        returns_pct=_returns_share(f),
    )
    both = col("marketing_and_ads")
    f.add(
        acquisition_mer=f.div(raw("new_profit_net_sales"), both),
        marketing_share=f.div(both, net),
        total_sales_mer=f.div(raw("total_sales"), both),
        mer=f.div(net, both),
        break_even_mer=f.div(col("gross_profit"), col("break_even_marketing")),
        net_profit_pct=f.div(col("net_profit"), net, 100.0),
        cpa=f.div(both, raw("new_orders")),
        new_customer_sales_ratio=f.div(raw("new_total_sales"), both),
        contribution_pct=f.div(col("contribution_margin"), net, 100.0),
    )
    per_new = col("gross_profit_per_new_customer")
    f.add(
        new_customer_contribution=f.settle(per_new - col("cpa")),
        new_customer_contribution_ads=f.settle(per_new - col("cpa_ads")),
    )
    return f.df.select(*keys, *[known(n).alias(n) for n in PERIOD_SHOWN], *f.names())
