"""The registered queries as DuckDB SQL, written independently of the Spark code.

Every query starts from `BASE`, the store tables derived from the test tables. Money is rounded with
the same tolerance as `half_up`, see there.
"""

from __future__ import annotations

import re

START, END = "1994-12-01", "2002-01-31"


def local(ts: str, tz: str) -> str:
    zone = tz if tz.startswith("CASE ") else f"'{tz}'"
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE {zone})"


def within(sql: str, start: str, end: str) -> str:
    """A query over another date range than the one that holds all rows."""
    return sql.replace(START, start).replace(END, end)


def keys(t: str) -> str:
    return (
        f"strftime({t}, '%Y-%m-%d') AS date, strftime({t}, '%Y-%m') AS month, "
        f"strftime({t}, '%Y') AS year, strftime({t}, '%G-W%V') AS week"
    )


def rounded(query: str, plain: str = "", digits: int = 2) -> str:
    """Wrap a query: columns named in `plain` stay as they are, all others are rounded."""
    names = [n.strip() for n in plain.split(",") if n.strip()]
    fine = f"floor({{x}} * 1e{digits} + 0.50003e0) / 1e{digits}"
    parts = list(names)
    parts.append(fine.format(x=f"COLUMNS(* EXCLUDE ({', '.join(names)}))" if names else "COLUMNS(*)"))
    return f"{', '.join(parts)} FROM ({query}) AS q"


def every_order(sql: str) -> str:
    """A priced query with a linked cost for each order, matched once per order name."""
    link = re.search(r"LEFT JOIN fx_order_shipping ON (.+)", sql)
    same_store = " AND a.tenant_id = b.tenant_id" if "link_tenant" in link[1] else ""
    name = "a.order_name LIKE '%' || b.order_id || '%'" if "LIKE" in link[1] else "replace(a.order_name, '#', '') = b.order_id"
    held = f"""held AS (
  SELECT a.order_name AS held_name, b.order_id AS linked_order_id,
         CAST(b.o_orderkey % 23 AS DOUBLE) AS linked_shipping
  FROM fx_orders a JOIN fx_orders b ON {name}{same_store})"""
    return sql.replace(link[0], "LEFT JOIN held ON order_name = held_name").replace(BASE.strip(), f"{BASE.strip()}, {held}", 1)


BASE = """
fx_orders AS (
  SELECT o_orderkey, o_totalprice, o_orderstatus, c_mktsegment AS tenant_id,
         CAST(o_orderkey AS VARCHAR) AS order_id, '#' || o_orderkey AS order_name,
         o_orderdate + to_seconds((o_orderkey * 37) % 86400) AS order_created_at,
         CASE WHEN o_orderkey % 10 <> 9 THEN CAST(1 + o_orderkey % 3 AS INTEGER) END
           AS customer_order_index,
         CAST(o_custkey AS VARCHAR) AS customer_id, c_name AS customer_name,
         lower(c_name) || '@example.com' AS customer_email,
         n_name AS country_code, n_name AS shipping_country, 'P' || (o_custkey % 3) AS province_code,
         CASE WHEN o_custkey % 3 <> 2 THEN 'Province ' || (o_custkey % 3) END AS province,
         'City ' || (o_custkey % 40) AS shipping_city,
         1 + (o_orderkey % 5) / 10 AS fx_rate,
         '["' || o_orderpriority || '","' || c_mktsegment || '"]' AS tags,
         '["gateway-' || (o_orderkey % 4) || '"]' AS payment_gateways,
         CASE WHEN o_orderkey % 5 = 0 THEN 'EUR' ELSE 'USD' END AS presentment_currency,
         CASE o_orderstatus WHEN 'F' THEN 'PAID' ELSE 'PENDING' END AS financial_status,
         CASE o_orderstatus WHEN 'O' THEN 'UNFULFILLED' ELSE 'FULFILLED' END AS fulfillment_status,
         CASE WHEN o_orderstatus <> 'O' THEN 'Carrier ' || (o_orderkey % 3) END AS first_carrier
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
fx_line AS (
  SELECT *, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign,
         l_extendedprice * (1 - l_discount) AS kept
  FROM lineitem),
fx_sales AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sale_id,
         CASE l_linenumber WHEN 7 THEN 'SHIPPING' WHEN 6 THEN 'GIFT_CARD' ELSE 'PRODUCT' END
           AS line_type,
         CASE l_returnflag WHEN 'R' THEN 'RETURN' ELSE 'ORDER' END AS action_type,
         sign * CAST(l_quantity AS INTEGER) AS quantity,
         CASE WHEN l_partkey % 17 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS variant_id,
         'Item ' || l_partkey AS product_name,
         l_extendedprice / l_quantity AS unit_price, l_tax AS tax_rate_sum,
         l_extendedprice * l_discount AS discount_before_taxes,
         sign * kept * l_tax AS total_tax, sign * kept * (1 + l_tax) AS total_amount,
         l_shipdate + to_seconds((l_orderkey * 53 + l_linenumber * 3601) % 86400) AS happened_at,
         order_id, order_name, order_created_at, customer_order_index, customer_id, country_code,
         province_code, fx_rate, tenant_id
  FROM fx_line JOIN fx_orders ON l_orderkey = o_orderkey),
fx_transactions AS (
  SELECT order_id, order_created_at, fx_rate, tenant_id,
         order_created_at + to_seconds(o_orderkey % 90000) AS transaction_at,
         CASE WHEN o_orderkey % 4 = 3 THEN 'REFUND' ELSE 'SALE' END AS kind,
         CASE WHEN o_orderkey % 10 = 0 THEN 'CARD_DECLINED' END AS error_code,
         o_totalprice * 0.029e0 + 0.3e0 AS amount
  FROM fx_orders),
fx_fulfillments AS (
  SELECT order_id, order_name, order_created_at, tenant_id, 'F' || o_orderkey AS resource_id,
         CAST(1 + o_orderkey % 12 AS INTEGER) AS total_quantity,
         order_created_at + to_seconds(3600 + o_orderkey % 200000) AS fulfilled_at
  FROM fx_orders WHERE o_orderstatus <> 'O'),
fx_events AS (
  SELECT *, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][user_id % 5 + 1]
           AS tenant_id,
         CAST(ts AS DATE) - CASE event_type WHEN 'click' THEN 10222 ELSE 10227 END AS day
  FROM events),
fx_ad_days AS (
  SELECT *, strftime(day, '%Y-%m-%d') AS date, strftime(day, '%Y-%m') AS month,
         strftime(day, '%Y') AS year, strftime(day, '%G-W%V') AS week
  FROM fx_events),
fx_google AS (
  SELECT value * 1000000 AS cost_micros, CAST(user_id % 7 AS DOUBLE) AS clicks,
         CAST(user_id % 3 AS DOUBLE) AS conversions, date, month, year, week, tenant_id
  FROM fx_ad_days WHERE event_type = 'click'),
fx_tiktok AS (
  SELECT value AS spend, CASE WHEN user_id % 9 <> 0 THEN CAST(user_id % 7 AS DOUBLE) END AS clicks,
         CAST(user_id % 2 AS DOUBLE) AS conversion, date, month, year, week, tenant_id
  FROM fx_ad_days WHERE event_type = 'view'),
fx_meta AS (
  SELECT value AS spend, CAST(user_id % 7 AS DOUBLE) AS clicks,
         CASE WHEN event_type = 'purchase' THEN CAST(user_id % 4 AS DOUBLE) END AS bought,
         date, month, year, week, tenant_id
  FROM fx_ad_days WHERE event_type IN ('signup', 'purchase', 'error')),
fx_schedule AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, s_acctbal AS cost,
         ['Monthly', 'Weekly', 'Yearly', 'Daily', 'Just Once', 'Quarterly'][s_suppkey % 6 + 1]
           AS frequency,
         ['staff-costs', 'marketing-expenses', 'operational-expenses', NULL][s_nationkey % 4 + 1]
           AS tag,
         ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][s_suppkey % 5 + 1]
           AS tenant_id,
         DATE '1995-01-01' + CAST((s_suppkey * 97) % 2400 AS INTEGER) AS start_date,
         CASE WHEN s_suppkey % 3 = 0 THEN DATE '9999-01-01'
              ELSE DATE '1995-01-01' + CAST((s_suppkey * 97) % 2400 + (s_suppkey * 31) % 900 AS INTEGER)
         END AS end_date
  FROM supplier),
fx_product_costs AS (
  SELECT CAST(p_partkey AS VARCHAR) AS cost_variant_id,
         CASE p_partkey % 13 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE p_retailprice * 0.4e0 END
           AS variant_cost,
         CASE WHEN p_size % 4 <> 0 THEN p_size / 10 END AS packing_fee
  FROM part WHERE p_brand <> 'Brand#11'),
fx_ship AS (
  SELECT n_name AS ship_country, region, n_nationkey + extra AS ship_cost,
         (n_nationkey + extra) / 2 AS back_cost
  FROM nation JOIN region AS r ON n_regionkey = r_regionkey,
       (VALUES ('P0', 1), ('All Regions', 2)) AS v(region, extra)
  WHERE r_name <> 'AFRICA'),
fx_order_shipping AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS linked_order_id,
         CAST(o_orderkey % 23 AS DOUBLE) AS linked_shipping, tenant_id AS link_tenant
  FROM fx_orders WHERE o_totalprice >= 495000),
fx_every_order_shipping AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS linked_order_id,
         CAST(o_orderkey % 23 AS DOUBLE) AS linked_shipping
  FROM fx_orders),
fx_tiers AS (
  SELECT * FROM (VALUES (1, 2e0, 0.5e0, 1e0, 0.25e0, 0, 5), (2, 3e0, 0.4e0, 1.5e0, 0.2e0, 5, 9),
                        (3, 5e0, 0.3e0, 2e0, 0.1e0, 10, 9999999))
    AS v(tier, ship_base, ship_more, pack_base, pack_more, low, high)),
fx_shipped AS (
  SELECT f.*, pack_base AS packaging_base, pack_more AS packaging_additional,
         ship_base AS fulfillment_base, ship_more AS fulfillment_additional,
         pack_base + (total_quantity - 1) * pack_more AS packaging_cost,
         ship_base + (total_quantity - 1) * ship_more AS fulfillment_only_cost,
         pack_base + ship_base AS fulfillment_cost
  FROM fx_fulfillments f JOIN fx_tiers ON total_quantity BETWEEN low AND high
  QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY tier) = 1)
"""


def lines(tz: str, where: str = "TRUE") -> str:
    """CTE `fields`: sale entries with local keys and measures."""
    t = local("happened_at", tz)
    return f"""
fields_a AS (
  SELECT s.*, {keys(t)},
    CASE WHEN line_type = 'SHIPPING' AND action_type = 'ORDER' THEN discount_before_taxes ELSE 0 END
      AS shipping_discounts,
    CASE WHEN line_type = 'PRODUCT' AND action_type = 'ORDER'
         THEN quantity * unit_price / CASE WHEN total_tax = 0 THEN 1 ELSE 1 + tax_rate_sum END
         ELSE 0 END AS gross_sales,
    CASE WHEN line_type <> 'SHIPPING' AND action_type = 'ORDER' THEN discount_before_taxes ELSE 0 END
      AS product_discounts,
    CASE WHEN line_type <> 'SHIPPING' AND action_type = 'RETURN' THEN total_amount - total_tax
         ELSE 0 END AS returns,
    total_tax AS taxes,
    CASE WHEN line_type = 'SHIPPING' THEN total_amount - total_tax ELSE 0 END AS shipping_charges,
    CASE WHEN line_type = 'SHIPPING' THEN 0 ELSE quantity END AS net_items
  FROM fx_sales s
  WHERE strftime({t}, '%Y-%m-%d') BETWEEN '{START}' AND '{END}' AND {where}),
fields AS (
  SELECT *, shipping_discounts + product_discounts AS total_discounts,
    gross_sales - product_discounts + returns + taxes + shipping_charges AS total_sales,
    gross_sales - product_discounts + returns AS net_sales,
    gross_sales - product_discounts + returns + shipping_charges AS profit_net_sales
  FROM fields_a)"""


def priced(
    swapped: bool = False,
    contains: bool = True,
    fallback: bool = False,
    margin: str = "40e0",
    per_store: bool = False,
) -> str:
    """CTE `priced`: `fields` with every lookup and cost decision."""
    link = (
        "order_name LIKE '%' || linked_order_id || '%'"
        if contains
        else "replace(order_name, '#', '') = linked_order_id"
    )
    if per_store:
        link += " AND tenant_id = link_tenant"
    sold, back = ("RETURN", "ORDER") if swapped else ("ORDER", "RETURN")
    last = ", shipping_charges" if fallback else ""
    return f"""
priced_a AS (
  SELECT f.*, linked_order_id, linked_shipping, cost_variant_id, variant_cost, packing_fee,
         a.ship_cost AS region_shipping, a.back_cost AS region_return,
         b.ship_cost AS everywhere_shipping, b.back_cost AS everywhere_return,
         CASE WHEN line_type <> 'PRODUCT' OR action_type = 'RETURN' THEN 0
              WHEN total_tax = 0 THEN unit_price ELSE unit_price / (1 + tax_rate_sum) END
           AS unit_price_ex_tax
  FROM fields f
  LEFT JOIN fx_order_shipping ON {link}
  LEFT JOIN fx_product_costs ON variant_id = cost_variant_id
  LEFT JOIN fx_ship a ON country_code = a.ship_country AND province_code = a.region
  LEFT JOIN fx_ship b ON country_code = b.ship_country AND b.region = 'All Regions'),
priced_b AS (
  SELECT *,
    CASE WHEN line_type <> 'PRODUCT' THEN 0 WHEN variant_cost > 0 THEN variant_cost
         ELSE unit_price_ex_tax * (1 - ({margin}) / 100) END AS unit_product_cost,
    CASE WHEN line_type = 'PRODUCT' AND variant_id IS NOT NULL THEN coalesce(packing_fee, 0)
         ELSE 0 END AS unit_handling_fee
  FROM priced_a),
priced AS (
  SELECT *,
    CASE action_type WHEN '{sold}' THEN quantity * unit_product_cost ELSE 0 END
      AS sold_product_cost,
    CASE action_type WHEN '{back}' THEN quantity * unit_product_cost ELSE 0 END
      AS returned_goods_cost,
    CASE action_type WHEN 'ORDER' THEN quantity * unit_handling_fee ELSE 0 END AS handling_fee,
    CASE WHEN line_type = 'SHIPPING' AND action_type = 'ORDER'
         THEN coalesce(linked_shipping, region_shipping, everywhere_shipping, 6.5e0{last})
         ELSE 0 END AS shipping_cost
  FROM priced_b)"""


MEASURES = ["discounts", "gross_sales", "total_discounts", "total_sales", "net_sales",
            "profit_net_sales", "shipping_charges", "returns"]
SOURCE = {"discounts": "discount_before_taxes"}
COUNTS = ["orders", "new_orders", "repeat_orders", "customers", "new_customers", "repeat_customers"]


def counts_select() -> str:
    parts = []
    for noun, column in (("customers", "customer_id"), ("orders", "order_id")):
        for prefix, test in (("", "TRUE"), ("new_", "customer_order_index = 1"),
                             ("repeat_", "customer_order_index > 1")):
            parts.append(f"count(DISTINCT {column}) FILTER ({test}) AS {prefix}{noun}")
    return ", ".join(parts)


def segments_select(distinct: bool = True) -> str:
    word = "DISTINCT " if distinct else ""
    parts = []
    for m in MEASURES:
        column = SOURCE.get(m, m)
        parts.append(f"sum({word}{column}) FILTER (customer_order_index = 1) AS new_{m}")
        parts.append(f"sum({word}{column}) FILTER (customer_order_index > 1) AS repeat_{m}")
    return ", ".join(parts)


def sums_select() -> str:
    return ", ".join(f"sum({SOURCE.get(m, m)}) AS {m}" for m in MEASURES)


COSTS = """sum(taxes) AS taxes, CAST(sum(net_items) AS BIGINT) AS net_items,
  sum(sold_product_cost) AS product_cost, sum(returned_goods_cost) AS returned_product_cost,
  sum(handling_fee) AS handling_fee, sum(shipping_cost) AS shipping_cost"""
SALES_RATIOS = """
  (gross_sales - total_discounts) / nullif(orders, 0) AS aov,
  (new_gross_sales - new_total_discounts) / nullif(new_orders, 0) AS new_aov,
  (repeat_gross_sales - repeat_total_discounts) / nullif(repeat_orders, 0) AS repeat_aov,
  returns / nullif(total_sales, 0) * 100 AS sales_returns_pct,
  net_items / nullif(orders, 0) AS items_per_order"""


def sales_by(grain: str, distinct: bool = True) -> str:
    """CTE `by_sales`: all sales aggregates per `period`."""
    return f"""
by_sales_a AS (
  SELECT CAST({grain} AS VARCHAR) AS period, sum(total_amount) AS paid, {counts_select()},
         {sums_select()}, {segments_select(distinct)}, {COSTS}
  FROM priced GROUP BY ALL),
by_sales AS (SELECT *, {SALES_RATIOS} FROM by_sales_a)"""


def ads_by(grain: str) -> str:
    inside = f"WHERE date BETWEEN '{START}' AND '{END}'"
    return f"""
by_google AS (
  SELECT {grain} AS period, sum(cost_micros / 1000000) AS google_spend, sum(clicks) AS google_clicks,
         sum(conversions) AS google_conversions FROM fx_google {inside} GROUP BY ALL),
by_tiktok AS (
  SELECT {grain} AS period, sum(spend) AS tiktok_spend, sum(coalesce(clicks, 0)) AS tiktok_clicks,
         sum(conversion) AS tiktok_conversions FROM fx_tiktok {inside} GROUP BY ALL),
by_meta AS (
  SELECT {grain} AS period, sum(spend) AS meta_spend, sum(clicks) AS meta_clicks,
         sum(coalesce(bought, 0)) AS meta_conversions FROM fx_meta {inside} GROUP BY ALL)"""


def ledger() -> str:
    """CTE `ledger`: every active day of every expense with a positive cost."""
    return f"""
days AS (SELECT CAST(d AS DATE) AS day
         FROM generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY) AS g(d)),
ledger AS (
  SELECT id, coalesce(tag, '') AS tag, day, tenant_id, {keys('day')},
         day(last_day(day)) AS days_in_month,
         CASE frequency WHEN 'Monthly' THEN cost / day(last_day(day)) WHEN 'Weekly' THEN cost / 7
              WHEN 'Yearly' THEN cost / 365 WHEN 'Daily' THEN cost
              WHEN 'Just Once' THEN CASE WHEN day = start_date THEN cost END END AS daily_cost
  FROM fx_schedule JOIN days ON day BETWEEN start_date AND end_date
  WHERE cost > 0)"""


def expenses_by(grain: str) -> str:
    def tagged(tag: str) -> str:
        return f"sum(CASE tag WHEN '{tag}' THEN daily_cost ELSE daily_cost * 0 END)"

    return f"""
by_expenses AS (
  SELECT {grain} AS period, {tagged('staff-costs')} AS staff_cost,
         {tagged('marketing-expenses')} AS marketing_cost,
         {tagged('operational-expenses')} AS operational_cost,
         {tagged('staff-costs')} + {tagged('operational-expenses')} AS staff_and_operational_cost
  FROM ledger GROUP BY ALL)"""


def spanned(span: str, ts: str, day: str) -> str:
    """WHERE clause for the UTC years (`years`) or the local days (`days`) of the range, or none."""
    return {
        "": "",
        "years": f"WHERE year({ts}) BETWEEN year(DATE '{START}') AND year(DATE '{END}')",
        "days": f"WHERE strftime({day}, '%Y-%m-%d') BETWEEN '{START}' AND '{END}'",
    }[span]


def fees_by(grain: str, tz: str, span: str = "") -> str:
    day = local("transaction_at", tz)
    return f"""
paid_in AS (SELECT *, {keys(day)} FROM fx_transactions {spanned(span, 'transaction_at', day)}),
by_fees AS (
  SELECT {grain} AS period, sum(amount * fx_rate) AS payment_fees
  FROM paid_in WHERE kind = 'SALE' AND error_code IS NULL GROUP BY ALL)"""


def shipments_by(grain: str, tz: str, span: str = "") -> str:
    day = local("order_created_at", tz)
    return f"""
sent AS (SELECT *, {keys(day)} FROM fx_shipped {spanned(span, 'fulfilled_at', day)}),
by_shipments AS (
  SELECT {grain} AS period, sum(packaging_cost) AS packaging_cost,
         sum(fulfillment_only_cost) AS fulfillment_only_cost, sum(fulfillment_cost) AS fulfillment_cost
  FROM sent GROUP BY ALL)"""


SHOWN = ["product_cost", "returned_product_cost", "handling_fee", "fulfillment_cost",
         "shipping_charges", "new_shipping_charges", "taxes", "shipping_cost",
         "gross_sales", "new_gross_sales", "repeat_gross_sales",
         "discounts", "new_discounts", "repeat_discounts", "returns", "payment_fees",
         "total_sales", "new_total_sales", "repeat_total_sales",
         "net_sales", "new_net_sales", "repeat_net_sales",
         "profit_net_sales", "new_profit_net_sales", "repeat_profit_net_sales",
         "aov", "new_aov", "repeat_aov", "items_per_order"]
SHOWN_PERIOD = ["meta_spend", "google_spend", "tiktok_spend", "tiktok_conversions",
                "meta_conversions", "google_conversions", "tiktok_clicks", "meta_clicks",
                "google_clicks", "marketing_cost", "operational_cost", "staff_cost",
                "staff_and_operational_cost"]
WHOLE = ["orders", "new_orders", "repeat_orders", "new_customers", "net_items", "customers",
         "repeat_customers"]


def metric_steps(policy: str, period: bool) -> list[list[tuple[str, str]]]:
    """Metric formulas layer by layer; a layer may use the names of earlier ones.

    A name alone is the merged input, which may be NULL.
    """

    def z(x: str) -> str:
        return x if policy == "propagate" else f"coalesce({x}, 0)"

    def i(x: str) -> str:
        return f"coalesce({x}, 0)" if policy == "corrected" else x

    def per(a: str, b: str, scale: str = "") -> str:
        return z(f"({a}) / nullif({b}, 0){scale}")

    net = i("profit_net_sales")
    first = [("product_cost_after_toggle", z(f"{i('product_cost')} - {i('returned_product_cost')}"))]
    if period:
        first += [
            ("ad_spend", z(f"{z('google_spend')} + {z('meta_spend')} + {z('tiktok_spend')}")),
            ("ad_clicks", z(f"{z('google_clicks')} + {z('meta_clicks')} + {z('tiktok_clicks')}")),
            ("ad_conversions", z(f"{z('google_conversions')} + {z('meta_conversions')}"
                                 f" + {z('tiktok_conversions')}")),
        ]
    cogs = " + ".join(["product_cost_after_toggle", i("handling_fee"), i("payment_fees"),
                       i("fulfillment_cost"), i("shipping_cost")])
    steps = [first, [("cogs", z(cogs))]]
    profit = [
        ("gross_profit", z(f"{net} - cogs")),
        ("new_gross_profit", z(f"{i('new_profit_net_sales')} - cogs")),
        ("repeat_gross_profit", z(f"{i('repeat_profit_net_sales')} - cogs")),
    ]
    if period:
        costs = f"{net} - cogs - {i('marketing_cost')} - ad_spend - {i('operational_cost')}"
        profit += [
            ("marketing_and_ads", z(f"{i('marketing_cost')} + ad_spend")),
            ("contribution_margin", z(f"{costs} - {i('staff_cost')}")),
            ("net_profit", z(f"{costs} - {i('staff_cost')}")),
            ("break_even_marketing",
             z(f"{net} - cogs - {i('operational_cost')} - {i('staff_cost')}")),
        ]
    steps.append(profit)
    shared = "total_sales" if policy == "propagate" else "returns"
    ratios = [
        ("gross_margin_pct", per("gross_profit", net, " * 100")),
        ("cogs_pct", per("gross_profit", net, " * 100")),
        ("gross_profit_per_new_customer", per("new_gross_profit", i("new_customers"))),
        ("gross_profit_per_repeat_customer", per("repeat_gross_profit", i("repeat_customers"))),
        ("break_even_roas", per(net, "gross_profit")),
        ("returns_pct", per(i(shared), i("total_sales"), " * 100")),
    ]
    if period:
        ratios += [
            ("click_to_purchase_pct", per("ad_conversions", "ad_clicks", " * 100")),
            ("blended_roas", per("ad_conversions", "ad_spend")),
            ("staff_and_operational_total", z(f"{i('operational_cost')} + {i('staff_cost')}")),
            ("staff_cost_pct", per(i("staff_cost"), net, " * 100")),
            ("blended_cpa", per("ad_spend", i("orders"))),
            ("cpa_ads", per("ad_spend", i("new_orders"))),
            ("cpa", per("marketing_and_ads", i("new_orders"))),
            ("acquisition_mer", per(i("new_profit_net_sales"), "marketing_and_ads")),
            ("acquisition_mer_ads", per(i("new_profit_net_sales"), "ad_spend")),
            ("marketing_share", per("marketing_and_ads", net)),
            ("total_sales_mer", per(i("total_sales"), "marketing_and_ads")),
            ("mer", per(net, "marketing_and_ads")),
            ("mer_ads", per(net, "ad_spend")),
            ("break_even_mer", per("gross_profit", "break_even_marketing")),
            ("net_profit_pct", per("net_profit", net, " * 100")),
            ("contribution_pct", per("contribution_margin", net, " * 100")),
            ("new_customer_sales_ratio", per(i("new_total_sales"), "marketing_and_ads")),
            ("new_customer_sales_ratio_ads", per(i("new_total_sales"), "ad_spend")),
        ]
    steps.append(ratios)
    if period:
        per_new = "gross_profit_per_new_customer"
        steps.append([
            ("new_customer_contribution", z(f"{per_new} - cpa")),
            ("new_customer_contribution_ads", z(f"{per_new} - cpa_ads")),
        ])
    return steps


def metrics(source: str, key: str, policy: str, period: bool, extra: tuple[str, ...] = ()):
    """CTEs and SELECT of all metrics over the merged inputs in CTE `source`."""
    ctes, last = [], source
    for n, layer in enumerate(metric_steps(policy, period)):
        columns = ", ".join(f"{formula} AS {name}" for name, formula in layer)
        ctes.append(f"layer_{n} AS (SELECT *, {columns} FROM {last})")
        last = f"layer_{n}"
    shown = [*extra, *SHOWN, *(SHOWN_PERIOD if period else [])]

    def cover(name: str) -> str:
        return name if policy == "propagate" else f"coalesce({name}, 0) AS {name}"

    derived = [name for layer in metric_steps(policy, period) for name, _ in layer]
    final = f"SELECT {key}, {', '.join(cover(n) for n in [*shown, *WHOLE])}, {', '.join(derived)} FROM {last}"
    return ", ".join(ctes), rounded(final, ", ".join([key, *WHOLE]))


def with_base(*parts: str, final: str) -> str:
    sql = f"WITH {', '.join([BASE.strip(), *[p.strip() for p in parts if p]])} SELECT {final}"
    # sums with compensation, since Spark's side doesn't depend on the order of addition
    return re.sub(r"\bsum\(", "fsum(", sql)


def pnl(grain: str, tz: str = "UTC", policy: str = "parity", stores: bool = False) -> str:
    """The period P&L. With `stores` the period is prefixed by the store and split off at the end."""
    corrected = policy == "corrected"
    if stores:
        grain = f"tenant_id || '|' || {grain}"
    wide = grain in ("variant_id", "order_id")
    other = "CAST(NULL AS VARCHAR)" if wide else grain
    sources = ["by_google", "by_tiktok", "by_meta", "by_sales", "by_expenses", "by_fees",
               "by_shipments"]
    alias = dict(zip(sources, "gtmscfh"))
    key = "coalesce(" + ", ".join(f"{alias[s]}.period" for s in sources) + ")"
    if wide:
        key = f"{alias['by_sales']}.period"
    chain = f"by_google {alias['by_google']}"
    seen = [f"{alias['by_google']}.period"]
    for s in sources[1:]:
        left = f"coalesce({', '.join(seen)})" if corrected else seen[0]
        chain += f" FULL OUTER JOIN {s} {alias[s]} ON {left} = {alias[s]}.period"
        seen.append(f"{alias[s]}.period")
    merged = f"""
merged AS (
  SELECT {key} AS period, {', '.join(f'{alias[s]}.* EXCLUDE (period)' for s in sources)}
  FROM {chain})"""
    ctes, final = metrics("merged", "period", policy, True)
    if stores:
        final = ("split_part(period, '|', 1) AS tenant_id, split_part(period, '|', 2) AS period, "
                 f"* EXCLUDE (period) FROM (SELECT {final})")
    span = "days" if corrected else "years"
    costs = priced(not corrected, not corrected, corrected,
                   "30 + length(tenant_id)" if stores else "40e0", stores)
    return with_base(
        lines(tz), costs,
        sales_by(grain, not corrected), ads_by(other), ledger(), expenses_by(other),
        fees_by(other, tz, span), shipments_by(other, tz, span), merged, ctes, final=final,
    )


def order_profit(swapped: bool = False, stores: bool = False) -> str:
    """CTEs up to `profit`: order page figures per order; sources other than sales stand alone."""
    costs = priced(swapped, margin="30 + length(tenant_id)" if stores else "40e0", per_store=stores)
    return f"""{lines('UTC')}, {costs},
per_sales AS (
  SELECT order_id, sum(total_amount) AS paid, sum(discount_before_taxes) AS discount,
         sum(shipping_charges) AS shipping_charged, sum(shipping_cost) AS shipping_cost,
         sum(handling_fee) AS packing_fees, sum(taxes) AS tax, sum(profit_net_sales) AS net,
         sum(sold_product_cost) AS sold, sum(returned_goods_cost) AS back
  FROM priced GROUP BY order_id),
per_fees AS (
  SELECT order_id, sum(amount * fx_rate) AS fees FROM fx_transactions
  WHERE kind = 'SALE' AND error_code IS NULL GROUP BY order_id),
per_sent AS (SELECT order_id, sum(fulfillment_cost) AS sent FROM fx_shipped GROUP BY order_id),
profit_a AS (
  SELECT coalesce(s.order_id, f.order_id, h.order_id) AS order_id,
         CASE WHEN s.order_id IS NULL AND f.order_id IS NULL THEN 'shipments'
              WHEN s.order_id IS NULL THEN 'payments' END AS src, s.* EXCLUDE (order_id), fees, sent,
         coalesce(sold - back, 0) AS "productCost",
         coalesce(coalesce(sold - back, 0) + packing_fees + fees + sent + shipping_cost, 0) AS cogs
  FROM per_sales s FULL OUTER JOIN per_fees f ON s.order_id = f.order_id
  FULL OUTER JOIN per_sent h ON s.order_id = h.order_id),
profit AS (
  SELECT order_id, src, coalesce(paid, 0) AS paid, coalesce(discount, 0) AS discount,
         coalesce(shipping_charged, 0) AS shipping_charged,
         coalesce(shipping_cost, 0) AS shipping_cost, coalesce(sent, 0) AS fulfillment,
         coalesce(fees, 0) AS transactions, cogs, coalesce(packing_fees, 0) AS packing_fees,
         coalesce(net - cogs, 0) AS gross_profit,
         coalesce(coalesce(net - cogs, 0) / nullif(net, 0) * 100, 0) AS gpmargin,
         coalesce(tax, 0) AS tax, "productCost"
  FROM profit_a)"""


TOTALS = ["paid", "discount", "shipping_charged", "shipping_cost", "fulfillment", "transactions",
          "cogs", "packing_fees", "gross_profit", "gpmargin", "tax", '"productCost"']
PAGE_TEXT = ["date", "customer", "tags", "payment_status", "currency_code", "shipping_country",
             "shipping_city", "shipping_region", "customer_email", "fulfillment_status", "status",
             '"orderId"', "fulfillment_carrier"]


def page(tz: str) -> str:
    """CTE `page`: all orders of the range in page form, with their key."""
    t = local("order_created_at", tz)
    return f"""
page AS (
  SELECT o.order_id AS key, o.tenant_id, strftime({t}, '%Y-%m-%d') AS date, customer_name AS customer, tags,
         financial_status AS payment_status, presentment_currency AS currency_code,
         shipping_country, shipping_city, province_code AS shipping_region, customer_email,
         fulfillment_status, financial_status AS status, order_name AS "orderId",
         first_carrier AS fulfillment_carrier, p.* EXCLUDE (order_id)
  FROM fx_orders o LEFT JOIN profit p ON o.order_id = p.order_id
  WHERE strftime({t}, '%Y-%m-%d') BETWEEN '{START}' AND '{END}')"""


VARIANT_LINES = """
variant_lines AS (
  SELECT order_id, variant_id AS id, line_type AS "lineType", product_name AS product, quantity,
         total_amount AS paid, sold_product_cost AS product_cost,
         total_amount - total_tax - sold_product_cost * quantity AS gross_profit,
         (total_amount - total_tax - sold_product_cost * quantity) / nullif(total_amount, 0) AS gpm
  FROM priced WHERE line_type = 'PRODUCT')"""
