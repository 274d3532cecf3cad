"""Order reports: the order page, its export and summary, filter lists, shipment export."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import exact_sum, ratio, sums
from ledgerloom.functions.sales import PRODUCT, line_is, with_sale_fields
from ledgerloom.functions.timekeys import (
    GRAINS,
    grain_column,
    in_local_range,
    in_utc_years,
    local_date,
    prune_years,
    utc_years,
    with_period_keys,
)
from ledgerloom.operators.lookups import LINKED, with_settings
from ledgerloom.operators.merge import merge_by_key
from ledgerloom.operators.metrics import ORDER_PROFIT_INPUTS, order_metrics, order_profit
from ledgerloom.operators.pricing import price_shipments
from ledgerloom.operators.rollups import (
    fulfillment_rollup,
    payment_fees,
    plain_sums,
    sales_rollup,
)
from ledgerloom.plans.period import priced_lines
from ledgerloom.plans.tables import StoreTables, in_own_zones
from ledgerloom.session import stored

PAGE_LIMIT = 2000
#: Rows that a counted line would be.
COUNT = LINKED[0]
# Parts in which the orders of one store are ranked before its page is cut.
RANK_PARTS = 32

# Output column -> order column.
ORDER_COLUMNS = {
    "date": "order_date",
    "customer": "customer_name",
    "tags": "tags",
    "payment_status": "financial_status",
    "currency_code": "presentment_currency",
    "shipping_country": "shipping_country",
    "shipping_city": "shipping_city",
    "shipping_region": "province_code",
    "customer_email": "customer_email",
    "fulfillment_status": "fulfillment_status",
    "status": "financial_status",
    "orderId": "order_name",
    "fulfillment_carrier": "first_carrier",
}
# Output column -> order total.
TOTAL_COLUMNS = {
    "paid": "paid",
    "discount": "discounts",
    "shipping_charged": "shipping_charges",
    "shipping_cost": "shipping_cost",
    "fulfillment": "fulfillment_cost",
    "transactions": "payment_fees",
    "cogs": "cogs",
    "packing_fees": "handling_fee",
    "gross_profit": "gross_profit",
    "gpmargin": "gross_margin_pct",
    "tax": "taxes",
    "productCost": "product_cost_after_toggle",
}
PAGE_COLUMNS = [
    "date", "customer", "paid", "discount", "shipping_charged", "shipping_cost", "fulfillment",
    "transactions", "cogs", "packing_fees", "gross_profit", "gpmargin", "tax", "tags",
    "payment_status", "currency_code", "shipping_country", "shipping_city", "shipping_region",
    "customer_email", "fulfillment_status", "status", "orderId", "productCost",
    "fulfillment_carrier",
]

_OPERATORS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)),
    "between": lambda c, v: c.between(*v),
    "like": lambda c, v: c.like(v),
    "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
    # Membership in a list that is stored as JSON text: tags, payment gateways.
    "has": lambda c, v: F.array_contains(F.from_json(c, "array<string>"), v),
}


def predicate(df: DataFrame, where: Sequence[tuple]) -> Column:
    """Condition over the columns of `df` from typed nodes; no SQL text.

    A node is (column, operator, value), ("all", nodes), ("any", nodes) or ("not", node). The nodes of
    `where` must all hold. No nodes hold under "all" and fail under "any".
    """
    condition = F.lit(True)
    for node in where:
        condition = condition & _condition(df, node)
    return condition


def _condition(df: DataFrame, node: tuple) -> Column:
    if len(node) == 2 and node[0] == "all":
        return predicate(df, node[1])
    if len(node) == 2 and node[0] == "any":
        condition = F.lit(False)
        for one in node[1]:
            condition = condition | _condition(df, one)
        return condition
    if len(node) == 2 and node[0] == "not":
        return ~_condition(df, node[1])
    column, operator, value = node
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}")
    if operator not in _OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    return _OPERATORS[operator](F.col(column), value)


def sort_columns(order_by: Sequence[tuple[str, str]], allowed: Sequence[str]) -> list[Column]:
    """Sort terms of (column, "asc" | "desc") pairs; NULLs come last either way."""
    terms = []
    for column, direction in order_by:
        if column not in allowed:
            raise ValueError(f"cannot sort by {column!r}")
        if direction not in ("asc", "desc"):
            raise ValueError(f"direction must be asc or desc, got {direction!r}")
        c = F.col(column)
        terms.append(c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last())
    return terms


def orders_in_range(
    t: StoreTables,
    start: str | date,
    end: str | date,
    tz: str,
    where: Sequence[tuple] = (),
) -> DataFrame:
    """Orders created in a local date range that satisfy the caller's predicates."""
    orders = prune_years(t.orders, "created_year", utc_years(start, end))
    kept = orders.where(in_local_range("order_created_at", tz, start, end))
    kept = kept.withColumn("order_date", local_date("order_created_at", tz).cast("string"))
    return kept.where(predicate(kept, where)) if where else kept


def _of_range(df: DataFrame, start, end, tz: str) -> DataFrame:
    return df.where(in_local_range("order_created_at", tz, start, end))


def _priced(t: StoreTables, start, end, tz: str, only: DataFrame | None = None) -> DataFrame:
    """Counted sale entries of orders created in the range, with costs; of the orders in `only` if given."""
    sales = _restricted(t, _of_range(t.sales, start, end, tz), only)
    return priced_lines(t, with_sale_fields(sales), counted=True)


def _restricted(t: StoreTables, df: DataFrame, only: DataFrame | None) -> DataFrame:
    return df if only is None else df.join(only, [*t.scope, "order_id"], "left_semi")


def _profit_per_order(
    t: StoreTables, priced: DataFrame, start, end, tz: str, only: DataFrame | None = None
) -> DataFrame:
    """Costs and profit per order, plus `_source` for rows that stem from one source only.

    `only` restricts payments and shipments to its orders, like the sale entries, before any shuffle.
    """
    keys = [*t.scope, "order_id"]

    def source(df: DataFrame) -> DataFrame:
        return _restricted(t, _of_range(df, start, end, tz), only)

    measures = [m for m in ORDER_PROFIT_INPUTS if m not in ("fulfillment_cost", "payment_fees")]
    sources = {
        "sales": plain_sums(priced, keys, measures),
        "payments": payment_fees(source(t.transactions), keys),
        "shipments": fulfillment_rollup(
            price_shipments(source(t.fulfillments), t.settings, t.scope), keys
        ).select(*keys, "fulfillment_cost"),
    }
    merged = merge_by_key(sources, ["order_id"], "sales", t.scope)
    return order_profit(with_settings(merged, t.settings, t.scope), [*keys, "_source"])


def order_totals(
    t: StoreTables,
    grain: str,
    start: str | date,
    end: str | date,
    tz: str = "UTC",
    by: str = "order",
    swapped_cost_flags: bool = False,
) -> DataFrame:
    """All order-level metrics per order or per local period.

    `by="order"` covers everything that belongs to orders created in the range. `by="event"` covers
    the sale entries that happened in the range, and the payments and shipments of its years.
    """
    grain_column(grain, (*GRAINS, "order_id"))
    t = in_own_zones(t, tz, start, end)
    keys = [*t.scope, "grouping"]

    def keyed(df: DataFrame, ts: str, event: str) -> DataFrame:
        if by == "order":
            kept = _of_range(df, start, end, tz)
        elif event == "happened_at":
            kept = df.where(in_local_range(event, tz, start, end))
        else:
            kept = df.where(in_utc_years(event, start, end))
        return with_period_keys(kept, ts, tz).withColumn("grouping", F.col(grain))

    if by not in ("order", "event"):
        raise ValueError("by must be 'order' or 'event'")
    lines = with_sale_fields(keyed(t.sales, "happened_at", "happened_at"))
    priced = priced_lines(t, lines, counted=True, swapped_cost_flags=swapped_cost_flags)
    sources = {
        "sales": sales_rollup(priced, keys, lines),
        "payments": payment_fees(
            keyed(t.transactions, "transaction_at", "transaction_at"), keys
        ),
        "shipments": fulfillment_rollup(
            price_shipments(
                keyed(t.fulfillments, "order_created_at", "fulfilled_at"), t.settings, t.scope
            ),
            keys,
        ),
    }
    merged = merge_by_key(sources, ["grouping"], "sales", t.scope)
    return order_metrics(with_settings(merged, t.settings, t.scope), keys)


def variant_lines(
    priced: DataFrame, scope: Sequence[str] = (), extra: Sequence[str] = ()
) -> DataFrame:
    """Product lines with their profit, one row each; counted lines are repeated unless `extra` names their number.

    As shipped, the cost is extended by the quantity before and multiplied by it once more here.
    """
    if COUNT in priced.columns and COUNT not in extra:
        priced = priced.withColumn(COUNT, F.explode(F.sequence(F.lit(1).cast("long"), F.col(COUNT))))
    kept = F.col("total_amount") - F.col("total_tax")
    profit = kept - F.col("sold_product_cost") * F.col("quantity")
    return priced.where(line_is(PRODUCT)).select(
        *scope,
        "order_id",
        F.col("variant_id").alias("id"),
        F.col("line_type").alias("lineType"),
        F.col("product_name").alias("product"),
        "quantity",
        F.col("total_amount").alias("paid"),
        F.col("sold_product_cost").alias("product_cost"),
        profit.alias("gross_profit"),
        ratio(profit, F.col("total_amount")).alias("gpm"),
        *extra,
    )


def order_variants(priced: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Variant list of every order as JSON text, in a stable order; one row for each order.

    A list is as long as its order. `variant_lines` is the same content as rows, for readers that don't
    want an order in one cell. Counted lines are sorted and made text once, and repeated as text.
    """
    if COUNT not in priced.columns:
        priced = priced.withColumn(COUNT, F.lit(1).cast("long"))
    lines = variant_lines(priced, scope, [COUNT])
    keys = [*scope, "order_id"]
    names = [c for c in lines.columns if c not in (*keys, COUNT)]

    def texts(entry: Column) -> Column:
        text = F.to_json(F.struct(*[entry[c].alias(c) for c in names]), {"ignoreNullFields": "false"})
        return F.array_repeat(text, entry[COUNT].cast("int"))

    sorted_lines = F.array_sort(F.collect_list(F.struct(*names, COUNT)))
    listed = F.array_join(F.flatten(F.transform(sorted_lines, texts)), ",")
    return lines.groupBy(*keys).agg(F.concat(F.lit("["), listed, F.lit("]")).alias("variants_json"))


def _page_rows(t: StoreTables, orders: DataFrame, totals: DataFrame) -> DataFrame:
    keys = [*t.scope, "order_id"]
    joined = orders.select(*keys, *sorted(set(ORDER_COLUMNS.values()))).join(
        totals.select(*keys, "_source", *sorted(set(TOTAL_COLUMNS.values()))), keys, "left"
    )
    shown = {**ORDER_COLUMNS, **TOTAL_COLUMNS}
    return joined.select(*keys, "_source", *[F.col(shown[c]).alias(c) for c in PAGE_COLUMNS])


def _page_order(t: StoreTables, order_by: Sequence[tuple[str, str]]) -> list[Column]:
    """The caller's sort with ties broken by order, then by the source of the row."""
    tail = [F.col(k).asc_nulls_first() for k in (*t.scope, "order_id", "_source")]
    return [*sort_columns(order_by, PAGE_COLUMNS), *tail]


def _cut(
    rows: DataFrame, ranking: Sequence[Column], limit: int, scope: Sequence[str]
) -> DataFrame:
    """First rows by rank, of every store if there are many.

    One store takes the top k of each task first. Of many stores each is ranked in parts, and then among
    the first rows of its parts, so no task ranks a whole store.
    """
    if not scope:
        return rows.orderBy(*ranking).limit(limit)
    part = F.pmod(F.xxhash64("order_id"), F.lit(RANK_PARTS))
    for keys in ([*scope, "_part"], scope):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*ranking))
        rows = rows.withColumn("_part", part).withColumn("_rank", rank)
        rows = rows.where(F.col("_rank") <= limit).drop("_rank", "_part")
    return rows


def order_page(
    t: StoreTables,
    start: str | date,
    end: str | date,
    tz: str = "UTC",
    where: Sequence[tuple] = (),
    order_by: Sequence[tuple[str, str]] = (("date", "desc"),),
    limit: int = PAGE_LIMIT,
) -> DataFrame:
    """First `limit` rows of a store by the caller's sort, with profit figures and variant lists.

    An order without sale entries shows one row per source that knows it. When every sort column is
    an order attribute, the orders that can reach the page are cut before any sale entry is read, and
    only their entries are priced. Otherwise totals of the whole range are needed to sort; the cut
    page is then stored and variants are built for its orders alone.
    """
    t = in_own_zones(t, tz, start, end)
    keys = [*t.scope, "order_id"]
    orders = orders_in_range(t, start, end, tz, where)
    ranking = _page_order(t, order_by)
    if all(column in ORDER_COLUMNS for column, _ in order_by):
        renamed = [(ORDER_COLUMNS[column], way) for column, way in order_by]
        terms = sort_columns(renamed, orders.columns)
        terms += [F.col(k).asc() for k in keys]
        orders = _cut(orders, terms, limit, t.scope)
        ids = orders.select(*keys)
        priced = _priced(t, start, end, tz, ids)
        rows = _page_rows(t, orders, _profit_per_order(t, priced, start, end, tz, ids))
        page = _cut(rows, ranking, limit, t.scope)
    else:
        totals = _profit_per_order(t, _priced(t, start, end, tz), start, end, tz)
        rows = _page_rows(t, orders, totals)
        page = stored(_cut(rows, ranking, limit, t.scope), "order-page")
        priced = _priced(t, start, end, tz, page.select(*keys))
    full = page.join(order_variants(priced, t.scope), keys, "left")
    return full.orderBy(*ranking).select(*t.scope, *PAGE_COLUMNS, "variants_json")


def order_page_export(
    t: StoreTables,
    start: str | date,
    end: str | date,
    tz: str = "UTC",
    where: Sequence[tuple] = (),
    order_by: Sequence[tuple[str, str]] = (("date", "desc"),),
) -> DataFrame:
    """Every order of the range in page form, without variants and without a limit.

    With a filter only the entries, payments and shipments of the orders that pass are priced.
    """
    t = in_own_zones(t, tz, start, end)
    orders = orders_in_range(t, start, end, tz, where)
    only = orders.select(*t.scope, "order_id") if where else None
    totals = _profit_per_order(t, _priced(t, start, end, tz, only), start, end, tz, only)
    rows = _page_rows(t, orders, totals)
    return rows.orderBy(*_page_order(t, order_by)).select(*t.scope, *PAGE_COLUMNS)


#: Measures of a grouped export that are sums of the orders' own; ratios are taken of such sums, never summed.
ADDITIVE = {name: column for name, column in TOTAL_COLUMNS.items() if name != "gpmargin"} | {"net": "profit_net_sales"}
#: Ratio in percent -> (sum above, sum below).
RATIOS = {"gpmargin": ("gross_profit", "net")}
#: Counted again in every group, since a customer of two groups is one in a coarser one.
COUNTED = {"orders": "order_id", "customers": "customer_id"}


def order_export_grouped(
    t: StoreTables,
    start: str | date,
    end: str | date,
    group_by: Sequence[str],
    tz: str = "UTC",
    where: Sequence[tuple] = (),
    order_by: Sequence[tuple[str, str]] = (),
    measures: Sequence[str] | None = None,
) -> DataFrame:
    """The export with the caller's predicate and grouping: a row per store and group.

    `group_by` takes columns of the page (`shipping_country`), of the orders (`province`) and the grains of the
    order's local day (`month`). Each measure has its rule: sums add up, ratios are taken of the group's
    sums (0 where there is nothing to divide by, as in the page), orders and customers are counted anew.
    NULL is a group of its own. Without groups there is a row for all orders of a store, if it has any.
    """
    t = in_own_zones(t, tz, start, end)
    orders = orders_in_range(t, start, end, tz, where)
    orders = with_period_keys(orders, "order_created_at", tz) if any(g in GRAINS for g in group_by) else orders
    groups = {g: g if g in GRAINS else ORDER_COLUMNS.get(g, g) for g in group_by}
    unknown = [g for g, column in groups.items() if column not in orders.columns]
    if unknown:
        raise ValueError(f"unknown order columns {unknown}")
    shown = [*COUNTED, *ADDITIVE, *RATIOS] if measures is None else list(measures)
    missing = [m for m in shown if m not in {**COUNTED, **ADDITIVE, **RATIOS}]
    if missing:
        raise ValueError(f"unknown measures {missing}")
    keys = [*t.scope, "order_id"]
    only = orders.select(*keys) if where else None
    totals = _profit_per_order(t, _priced(t, start, end, tz, only), start, end, tz, only)
    # an order that sales don't know has a row for each source; it counts once
    totals = totals.groupBy(*keys).agg(*sums(totals, {f"_{name}": F.col(c) for name, c in ADDITIVE.items()}))
    named = orders.select(
        *keys, F.col("customer_id").alias("_customer_id"), *[F.col(column).alias(f"_by_{g}") for g, column in groups.items()]
    )
    joined = named.join(totals, keys, "left")
    count = {"orders": F.col("order_id"), "customers": F.col("_customer_id")}
    summed = joined.groupBy(*t.scope, *[f"_by_{g}" for g in groups]).agg(
        *[F.coalesce(exact_sum(F.col(f"_{name}")), F.lit(0.0)).alias(name) for name in ADDITIVE],
        *[F.count_distinct(count[name]).alias(name) for name in COUNTED],
    )
    for name, (above, below) in RATIOS.items():
        summed = summed.withColumn(name, F.coalesce(ratio(F.col(above), F.col(below)) * 100, F.lit(0.0)))
    summed = summed.select(*t.scope, *[F.col(f"_by_{g}").alias(g) for g in groups], *shown)
    return summed.orderBy(*sort_columns(order_by, summed.columns)) if order_by else summed


def order_summary(
    t: StoreTables,
    start: str | date,
    end: str | date,
    by: str,
    tz: str = "UTC",
    where: Sequence[tuple] = (),
    order_by: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Order totals summed by any order column. As shipped, the margin percentages are summed too."""
    t = in_own_zones(t, tz, start, end)
    orders = orders_in_range(t, start, end, tz, where)
    if by not in orders.columns:
        raise ValueError(f"unknown order column {by!r}")
    keys = [*t.scope, "order_id"]
    only = orders.select(*keys) if where else None
    totals = _profit_per_order(t, _priced(t, start, end, tz, only), start, end, tz, only)
    joined = orders.select(*keys, F.col(by).alias("_by")).join(totals, keys, "left")
    summed = joined.groupBy(*t.scope, "_by").agg(*sums(joined, {name: F.col(c) for name, c in TOTAL_COLUMNS.items()}))
    summed = summed.withColumnRenamed("_by", by)
    if order_by:
        return summed.orderBy(*sort_columns(order_by, summed.columns))
    return summed


def order_key_summary(t: StoreTables, start: str | date, end: str | date, tz: str = "UTC"):
    """Summary by order id straight from the aggregates, including orders known to one source only."""
    t = in_own_zones(t, tz, start, end)
    totals = _profit_per_order(t, _priced(t, start, end, tz), start, end, tz)
    return totals.groupBy(*t.scope, "order_id").agg(*sums(totals, {name: F.col(c) for name, c in TOTAL_COLUMNS.items()}))


FILTER_COLUMNS = {
    "cities": "shipping_city",
    "countries": "shipping_country",
    "provinces": "province",
}
FILTER_LISTS = {"tags": "tags", "gateways": "payment_gateways"}


def _tagged_values(kind: str, column: str) -> Column:
    """Entries of a JSON text list as (kind, value) structs; no entries for NULL."""
    values = F.from_json(column, "array<string>")
    tagged = F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.coalesce(tagged, F.array().cast("array<struct<kind: string, value: string>>"))


def filter_value_rows(
    orders: DataFrame, years: tuple[int, int] | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Distinct (kind, value) pairs offered as filters; NULL is a value of its own."""
    if years is not None:
        orders = prune_years(orders, "created_year", years)
    single = [
        F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value"))
        for kind, column in FILTER_COLUMNS.items()
    ]
    listed = [_tagged_values(kind, column) for kind, column in FILTER_LISTS.items()]
    return orders.select(*scope, F.inline(F.concat(F.array(*single), *listed))).distinct()


def order_filter_values(
    orders: DataFrame, years: tuple[int, int] | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """One row of sorted JSON lists of the values orders can be filtered by, NULL last.

    As shipped, the lists come from one product of orders, tags and gateways: if any of them is
    empty, all lists are NULL. Values are made distinct before they are collected, so the size of a
    list is the number of different values, not of orders. `filter_value_rows` is the same as rows.
    """
    rows = filter_value_rows(orders, years, scope)
    kinds = [*FILTER_COLUMNS, *FILTER_LISTS]
    columns = []
    for kind in kinds:
        mine = F.col("kind") == kind
        values = F.sort_array(F.collect_list(F.when(mine, F.col("value"))))
        has_null = F.max(mine & F.col("value").isNull())
        with_null = F.when(has_null, F.array_append(values, F.lit(None))).otherwise(values)
        columns.append(F.to_json(with_null).alias(kind))
        columns.append(F.max(mine).alias(f"_any_{kind}"))
    row = rows.groupBy(*scope).agg(*columns)
    complete = F.lit(True)
    for kind in kinds:
        complete = complete & F.coalesce(F.col(f"_any_{kind}"), F.lit(False))
    return row.select(*scope, *[F.when(complete, F.col(k)).alias(k) for k in kinds])


def fulfillment_export(
    t: StoreTables,
    tz: str = "UTC",
    start: str | date | None = None,
    end: str | date | None = None,
) -> DataFrame:
    """Every shipment of the years of the range with its tiers and costs, newest order date first."""
    t = in_own_zones(t, tz, start or "1900-01-01", end or "9998-12-31")
    shipments = t.fulfillments
    if start is not None and end is not None:
        shipments = prune_years(shipments, "fulfillment_year", utc_years(start, end))
        shipments = shipments.where(in_utc_years("fulfilled_at", start, end))
    priced = price_shipments(shipments, t.settings, t.scope)
    return priced.select(
        *t.scope,
        local_date("order_created_at", tz).cast("string").alias("order_date"),
        "resource_id",
        "total_quantity",
        "order_id",
        "order_name",
        "order_created_at",
        "fulfilled_at",
        "matching_tiers",
        "packaging_base",
        "packaging_additional",
        "fulfillment_base",
        "fulfillment_additional",
        "packaging_cost",
        "fulfillment_only_cost",
        "fulfillment_cost",
    ).orderBy(F.col("order_date").desc())
