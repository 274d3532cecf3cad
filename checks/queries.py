"""Registered queries: every operator and report over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import oracle as Q
from checks.oracle import END, START
from checks import sample_store as fixtures
from ledgerloom.functions import sales as sale_expr
from ledgerloom.functions.costs import (
    return_shipping_candidates,
    return_shipping_cost,
    return_shipping_cost_known,
    shipping_cost,
    shipping_cost_by_entry,
    shipping_candidates,
)
from ledgerloom.functions.numbers import half_up
from ledgerloom.functions.timekeys import OWN_ZONE, in_local_range, with_day_keys, with_period_keys
from ledgerloom.operators import ingest_orders, ingest_settings
from ledgerloom.operators import lookups as L
from ledgerloom.operators import rollups as R
from ledgerloom.operators.pricing import daily_ledger, price_shipments
from ledgerloom.plans import orders as O
from ledgerloom.plans import period as P
from ledgerloom.plans.ingest import write_order_models
from ledgerloom.plans.states import day_states, pnl_from_states, read_day_states, write_day_states
from ledgerloom.plans.tables import with_zones
from checks.sample_store import SampleStore
from ledgerloom.session import configure, scratch_dir
from ledgerloom.sources.calendar import days_spanned
from ledgerloom.sources.keyindex import files_with
from ledgerloom.sources.lake import CURRENT_PARTITION, read_lake
from ledgerloom.sources.models import model_path, read_csv, read_model, write_csv, write_model
from ledgerloom.sources.repack import read_packed, repack
from ledgerloom.sources.schemas import LAKE
from ledgerloom.sources.snapshots import current, listed, read_files, schema_of

TZ = "Asia/Kolkata"
NEW_YORK = "America/New_York"
RANGE = (START, END)

Query = Callable[[SampleStore], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def shown(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round all DOUBLE columns as the oracle does."""
    return df.select(
        *[
            half_up(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def at(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def at_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


def _lines(s: SampleStore, tz: str = "UTC") -> DataFrame:
    return P.sale_lines(s.tables(), *RANGE, tz)


def _priced(s: SampleStore, tz: str = "UTC", **options) -> DataFrame:
    return P.priced_lines(s.tables(), _lines(s, tz), **options)


def _priced_shipping(s: SampleStore) -> DataFrame:
    """Shipping entries alone. Each line is priced by itself, so the others are left out before the lookups."""
    return P.priced_lines(s.tables(), _lines(s, "UTC").where(sale_expr.line_is("SHIPPING")))


# --- time and sale fields -----------------------------------------------------------------------


@query(
    "calendar",
    f"""WITH span AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi
        FROM orders),
    days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span)
    SELECT {Q.keys('day')} FROM days""",
)
def calendar_days(s):
    return days_spanned(s.table("orders"), "o_orderdate", "o_orderdate").drop("day")


@query(
    "local_period_keys",
    Q.with_base(
        f"k AS (SELECT {Q.keys(Q.local('happened_at', NEW_YORK))}, quantity FROM fx_sales)",
        final="date, week, month, year, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units "
        "FROM k GROUP BY ALL",
    ),
)
def local_period_keys(s):
    keyed = with_period_keys(s.sales(), "happened_at", NEW_YORK)
    return keyed.groupBy("date", "week", "month", "year").agg(
        F.count("*").alias("lines"), F.sum("quantity").alias("units")
    )


FIELDS = ["shipping_discounts", "gross_sales", "product_discounts", "returns", "taxes",
          "total_discounts", "shipping_charges", "total_sales", "net_sales", "profit_net_sales"]


@query(
    "sale_fields",
    Q.with_base(
        Q.lines("UTC"),
        final=Q.rounded(
            f"SELECT sale_id, date, net_items, {', '.join(FIELDS)} FROM fields",
            "sale_id, date, net_items",
            4,
        ),
    ),
)
def sale_fields(s):
    return shown(_lines(s).select("sale_id", "date", "net_items", *FIELDS), 4)


@query(
    "month_sales",
    Q.with_base(
        Q.lines(TZ),
        "m AS (SELECT month, sum(gross_sales) AS gross_sales, sum(total_discounts) AS "
        "total_discounts, sum(returns) AS returns, sum(net_sales) AS net_sales, "
        "count(DISTINCT order_id) AS orders FROM fields GROUP BY ALL)",
        final=Q.rounded(
            "SELECT *, (gross_sales - total_discounts) / orders AS aov FROM m", "month, orders"
        ),
    ),
)
def month_sales(s):
    return month_sales_rows(_lines(s, TZ))


def month_sales_rows(lines: DataFrame) -> DataFrame:
    measures = ["gross_sales", "total_discounts", "returns", "net_sales"]
    sums = R.plain_sums(lines, ["month"], measures)
    counts = R.distinct_totals(lines, ["month"], distinct_amounts=False).select("month", "orders")
    both = R.merge_by_key({"sums": sums, "counts": counts}, ["month"])
    basket = F.col("gross_sales") - F.col("total_discounts")
    return shown(both.withColumn("aov", basket / F.col("orders")))


@query(
    "original_orders",
    Q.with_base(
        Q.lines("UTC"),
        f"""flags AS (SELECT month,
          CASE WHEN abs(epoch_ms(happened_at) - epoch_ms(order_created_at)) < 31000
                AND line_type = 'PRODUCT' AND action_type = 'ORDER' THEN 1 ELSE 0 END AS original,
          CASE line_type WHEN 'SHIPPING' THEN total_tax ELSE 0 END AS shipping_tax,
          total_amount - total_tax - discount_before_taxes AS paid_ex_tax FROM fields)""",
        final=Q.rounded(
            "SELECT month, CAST(sum(original) AS BIGINT) AS originals, sum(shipping_tax) AS "
            "shipping_tax, sum(paid_ex_tax) AS paid_ex_tax FROM flags GROUP BY ALL",
            "month, originals",
        ),
    ),
)
def original_orders(s):
    flagged = _lines(s).select(
        "month",
        sale_expr.original_order_flag().alias("original"),
        sale_expr.shipping_tax().alias("shipping_tax"),
        sale_expr.paid_ex_tax().alias("paid_ex_tax"),
    )
    return shown(
        flagged.groupBy("month").agg(
            F.sum("original").alias("originals"),
            F.sum("shipping_tax").alias("shipping_tax"),
            F.sum("paid_ex_tax").alias("paid_ex_tax"),
        )
    )


# --- customer split -----------------------------------------------------------------------------


@query(
    "customer_split",
    Q.with_base(
        Q.lines(TZ), final=f"week, {Q.counts_select()} FROM fields GROUP BY ALL"
    ),
)
def customer_split(s):
    return R.distinct_totals(_lines(s, TZ), ["week"], distinct_amounts=False)


SEGMENT_COLUMNS = [f"{p}_{m}" for m in R.SEGMENTED for p in ("new", "repeat")]


@query(
    "sum_distinct_split",
    Q.with_base(
        Q.lines(TZ),
        final=Q.rounded(
            f"SELECT date, {Q.counts_select()}, {Q.segments_select()} FROM fields GROUP BY ALL",
            ", ".join(["date", *Q.COUNTS]),
        ),
    ),
)
def sum_distinct_split(s):
    return shown(R.distinct_totals(_lines(s, TZ), ["date"]))


@query("sum_distinct_direct", ORACLE["sum_distinct_split"])
def sum_distinct_direct(s):
    return shown(R.distinct_totals_direct(_lines(s, TZ), ["date"]))


@query(
    "sales_summary",
    Q.with_base(
        Q.lines(TZ),
        f"""a AS (SELECT month AS period, {Q.counts_select()}, {Q.sums_select()},
          {Q.segments_select()}, sum(taxes) AS taxes, CAST(sum(net_items) AS BIGINT) AS net_items,
          sum(gross_sales - total_discounts) AS basket,
          sum(DISTINCT gross_sales - total_discounts) FILTER (customer_order_index = 1) AS new_basket,
          sum(DISTINCT gross_sales - total_discounts) FILTER (customer_order_index > 1) AS repeat_basket
          FROM fields GROUP BY ALL)""",
        final=Q.rounded(
            "SELECT * EXCLUDE (basket, new_basket, repeat_basket), basket / customers AS aov, "
            "new_basket / customers AS new_aov, repeat_basket / customers AS repeat_aov, "
            "returns / nullif(total_sales, 0) * 100 AS sales_returns_pct, "
            "net_items / nullif(orders, 0) AS items_per_order FROM a",
            ", ".join(["period", *Q.COUNTS, "net_items"]),
        ),
    ),
)
def sales_summary(s):
    return shown(P.sales_summary(s.tables(), "month", *RANGE, TZ))


def _sales_totals(grain: str):
    @query(
        f"sales_totals_{grain}",
        Q.with_base(
            Q.lines(TZ),
            Q.priced(),
            Q.sales_by(grain),
            final=Q.rounded(
                "SELECT * FROM by_sales", ", ".join(["period", *Q.COUNTS, "net_items"])
            ),
        ),
    )
    def build(s):
        lines = _lines(s, TZ).withColumn("period", F.col(grain))
        priced = P.priced_lines(s.tables(), lines, counted=True)
        return shown(R.sales_rollup(priced, ["period"], lines))


for _grain in ("date", "week", "month", "year"):
    _sales_totals(_grain)


# --- lookups and costs --------------------------------------------------------------------------

COST_COLUMNS = ["unit_price_ex_tax", "unit_product_cost", "sold_product_cost",
                "returned_goods_cost", "handling_fee", "shipping_cost"]


@query(
    "line_costs",
    Q.with_base(
        Q.lines("UTC"),
        Q.priced(),
        final=Q.rounded(
            f"SELECT sale_id, {', '.join(COST_COLUMNS)} FROM priced", "sale_id", 4
        ),
    ),
)
def line_costs(s):
    return shown(_priced(s).select("sale_id", *COST_COLUMNS), 4)


@query(
    "unit_product_cost",
    Q.with_base(
        Q.lines("UTC"),
        Q.priced(),
        final=Q.rounded(
            "SELECT variant_id, count(*) AS lines, sum(unit_product_cost) AS unit_product_cost, "
            "sum(sold_product_cost) AS sold, sum(returned_goods_cost) AS returned, "
            "sum(handling_fee) AS handling_fee FROM priced GROUP BY ALL",
            "variant_id, lines",
        ),
    ),
)
def unit_product_cost(s):
    return shown(
        _priced(s)
        .groupBy("variant_id")
        .agg(
            F.count("*").alias("lines"),
            F.sum("unit_product_cost").alias("unit_product_cost"),
            F.sum("sold_product_cost").alias("sold"),
            F.sum("returned_goods_cost").alias("returned"),
            F.sum("handling_fee").alias("handling_fee"),
        )
    )


@query(
    "contains_ship_join",
    Q.with_base(
        final="order_name, linked_order_id, linked_shipping FROM fx_orders JOIN fx_every_order_shipping "
        "ON order_name LIKE '%' || linked_order_id || '%'"
    ),
)
def contains_ship_join(s):
    return L.order_name_matches(s.orders(), s.every_order_shipping())


@query(
    "contains_ship_join_wildcards",
    Q.with_base(
        """wild AS (SELECT o_orderkey % 23 AS linked_shipping,
          CASE WHEN o_totalprice >= 499000
               THEN substr(CAST(o_orderkey AS VARCHAR), 1, 1) || '%' || right(CAST(o_orderkey AS VARCHAR), 2)
               WHEN o_totalprice >= 498000 THEN '_' || right(CAST(o_orderkey AS VARCHAR), 3)
               ELSE CAST(o_orderkey AS VARCHAR) END AS linked_order_id
          FROM orders)""",
        final="order_name, linked_order_id, CAST(linked_shipping AS DOUBLE) AS linked_shipping "
        "FROM fx_orders JOIN wild ON order_name LIKE '%' || linked_order_id || '%'",
    ),
)
def contains_ship_join_wildcards(s):
    return L.order_name_matches(s.orders(), s.every_order_shipping(wildcards=True))


@query(
    "order_shipping_lines",
    Q.with_base(
        "held AS (SELECT order_name, linked_order_id, linked_shipping FROM fx_orders "
        "JOIN fx_every_order_shipping ON order_name LIKE '%' || linked_order_id || '%')",
        "j AS (SELECT month, linked_order_id, linked_shipping FROM (SELECT "
        f"{Q.keys('happened_at')}, order_name FROM fx_sales) LEFT JOIN held USING (order_name))",
        final="month, count(*) AS lines, count(linked_order_id) AS linked, "
        "sum(linked_shipping) AS linked_shipping FROM j GROUP BY ALL",
    ),
)
def order_shipping_lines(s):
    keyed = with_period_keys(s.sales(), "happened_at", "UTC")
    return (
        L.with_order_shipping(keyed, s.every_order_shipping())
        .groupBy("month")
        .agg(
            F.count("*").alias("lines"),
            F.count("linked_order_id").alias("linked"),
            F.sum("linked_shipping").alias("linked_shipping"),
        )
    )


REGION_SQL = Q.with_base(
    final="""o.order_id, a.ship_cost::DOUBLE AS region_shipping, a.back_cost::DOUBLE AS region_return,
      a.region IS NOT NULL AS region_found, b.ship_cost::DOUBLE AS everywhere_shipping,
      b.back_cost::DOUBLE AS everywhere_return, b.region IS NOT NULL AS everywhere_found
      FROM fx_orders o
      LEFT JOIN fx_ship a ON o.country_code = a.ship_country AND o.province_code = a.region
      LEFT JOIN fx_ship b ON o.country_code = b.ship_country AND b.region = 'All Regions'"""
)
REGION_COLUMNS = [f"{p}_{c}" for p in ("region", "everywhere") for c in ("shipping", "return", "found")]


@query("country_region_shipping", REGION_SQL)
def country_region_shipping(s):
    joined = L.with_region_shipping(s.orders(), s.shipping_entries())
    return joined.select("order_id", *REGION_COLUMNS)


@query("country_region_shipping_from_list", REGION_SQL)
def country_region_shipping_from_list(s):
    listed = ingest_settings.shipping_by_country_model(s.shipping_entries())
    joined = L.with_region_shipping_from_list(s.orders(), listed)
    return joined.select("order_id", *REGION_COLUMNS)


@query(
    "shipping_decision",
    Q.with_base(
        Q.lines("UTC"),
        Q.priced(),
        final=Q.rounded(
            """SELECT sale_id, linked_order_id, shipping_cost,
          CASE action_type WHEN 'RETURN' THEN 0 ELSE
            coalesce(linked_shipping, region_shipping, everywhere_shipping, shipping_charges) END
            AS without_default,
          CASE action_type WHEN 'RETURN' THEN 0 ELSE
            coalesce(linked_shipping, region_shipping, everywhere_shipping, 6.5e0) END AS by_entry
          FROM priced WHERE line_type = 'SHIPPING'""",
            "sale_id, linked_order_id",
            4,
        ),
    ),
)
def shipping_decision(s):
    priced = _priced_shipping(s)
    no_default = priced.withColumn("default_shipping", F.lit(None).cast("double"))
    fallback = shipping_cost(shipping_candidates(), fallback_to_charge=True)
    return shown(
        no_default.withColumn("without_default", fallback)
        .withColumn("default_shipping", F.col("settings.shipping_margin"))
        .select(
            "sale_id",
            "linked_order_id",
            "shipping_cost",
            "without_default",
            shipping_cost_by_entry().alias("by_entry"),
        ),
        4,
    )


@query(
    "return_shipping",
    Q.with_base(
        Q.lines("UTC"),
        Q.priced(),
        final=Q.rounded(
            """SELECT sale_id, linked_order_id, 0e0 AS as_shipped, CASE action_type WHEN 'RETURN' THEN
          coalesce(region_return, everywhere_return, 3e0) ELSE 0 END AS corrected,
          CASE action_type WHEN 'RETURN' THEN CASE WHEN region_return IS NOT NULL THEN region_return
          WHEN everywhere_return IS NOT NULL THEN everywhere_return ELSE 3e0 END ELSE 0 END AS by_candidates
          FROM priced WHERE line_type = 'SHIPPING'""",
            "sale_id, linked_order_id",
            4,
        ),
    ),
)
def return_shipping(s):
    priced = _priced_shipping(s)
    return shown(
        priced.select(
            "sale_id",
            "linked_order_id",
            return_shipping_cost().alias("as_shipped"),
            return_shipping_cost(corrected=True).alias("corrected"),
            return_shipping_cost_known(return_shipping_candidates()).alias("by_candidates"),
        ),
        4,
    )


NO_LINK = "LEFT JOIN (SELECT * FROM fx_order_shipping) AS unlinked ON FALSE"


def _unset(t, **settings):
    """The same tables with some settings changed, and without linked shipping costs."""
    changed = t.settings.withColumns({name: F.lit(v).cast(t.settings.schema[name].dataType) for name, v in settings.items()})
    return replace(t, settings=changed, order_shipping=t.order_shipping.limit(0))


@query(
    "line_costs_without_settings",
    Q.with_base(
        Q.lines("UTC"),
        Q.priced(margin="0e0").replace("6.5e0", "NULL").replace("LEFT JOIN fx_order_shipping ON order_name LIKE '%' || linked_order_id || '%'", NO_LINK),
        final=Q.rounded(
            "SELECT sale_id, unit_product_cost, sold_product_cost, shipping_cost, CASE line_type WHEN 'SHIPPING' THEN "
            "CASE action_type WHEN 'RETURN' THEN coalesce(region_return, everywhere_return) ELSE 0 END ELSE 0 END AS return_cost "
            "FROM priced",
            "sale_id",
            4,
        ),
    ),
)
def line_costs_without_settings(s):
    """Neither margins nor linked costs: unknown products cost their price, unknown shipping is NULL."""
    t = _unset(s.tables(), margin_pct=None, shipping_margin=None, return_margin=None)
    priced = P.priced_lines(t, P.sale_lines(t, *RANGE, "UTC"))
    known = return_shipping_cost_known(return_shipping_candidates()).alias("return_cost")
    return shown(priced.select("sale_id", "unit_product_cost", "sold_product_cost", "shipping_cost", known), 4)


TIER_COLUMNS = ["packaging_base", "packaging_additional", "fulfillment_base",
                "fulfillment_additional", "packaging_cost", "fulfillment_only_cost",
                "fulfillment_cost"]


@query(
    "fulfillment_tiers",
    Q.with_base(
        final=Q.rounded(
            f"SELECT resource_id, total_quantity, {', '.join(TIER_COLUMNS)} FROM fx_shipped",
            "resource_id, total_quantity",
            4,
        )
    ),
)
def fulfillment_tiers(s):
    priced = price_shipments(s.fulfillments(), s.settings())
    return shown(priced.select("resource_id", "total_quantity", *TIER_COLUMNS), 4)


@query(
    "fulfillment_costs_month",
    Q.with_base(Q.shipments_by("month", TZ), final=Q.rounded("SELECT * FROM by_shipments", "period")),
)
def fulfillment_costs_month(s):
    priced = price_shipments(s.fulfillments(), s.settings())
    keyed = with_period_keys(priced, "order_created_at", TZ).withColumn("period", F.col("month"))
    return shown(R.fulfillment_rollup(keyed, ["period"]))


@query(
    "payment_fees",
    Q.with_base(Q.fees_by("week", TZ), final=Q.rounded("SELECT * FROM by_fees", "period")),
)
def payment_fees(s):
    keyed = with_period_keys(s.transactions(), "transaction_at", TZ)
    return shown(R.payment_fees(keyed.withColumn("period", F.col("week")), ["period"]))


# --- ads and expenses ---------------------------------------------------------------------------


def _ads(name: str):
    @query(
        f"ad_rollup_{name}",
        Q.with_base(
            Q.ads_by("week"),
            final=Q.rounded(f"SELECT * FROM by_{name}", "period"),
        ),
    )
    def build(s):
        ads = {"google": s.google_ads, "tiktok": s.tiktok_ads, "meta": s.meta_ads}[name]()
        return shown(R.ad_rollup(ads.withColumn("period", F.col("week")), name, ["period"]))


for _name in ("google", "tiktok", "meta"):
    _ads(_name)


@query(
    "social_rollup",
    Q.with_base(
        Q.ads_by("date"),
        """chain AS (SELECT g.period, g.* EXCLUDE (period), t.* EXCLUDE (period), m.* EXCLUDE (period),
          google_spend + meta_spend + tiktok_spend AS ad_spend,
          google_clicks + meta_clicks + tiktok_clicks AS ad_clicks,
          google_conversions + meta_conversions + tiktok_conversions AS ad_conversions
          FROM by_google g FULL OUTER JOIN by_tiktok t ON g.period = t.period
          FULL OUTER JOIN by_meta m ON g.period = m.period)""",
        final=Q.rounded(
            "SELECT *, ad_conversions / nullif(ad_clicks, 0) * 100 AS click_to_purchase_pct FROM chain",
            "period",
        ),
    ),
)
def social_rollup(s):
    return shown(P.social_rollup(s.google_ads(), s.tiktok_ads(), s.meta_ads(), "date"))


@query(
    "social_rollup_week_all_stores",
    Q.with_base(
        Q.ads_by("tenant_id || '|' || week"),
        """chain AS (SELECT split_part(coalesce(g.period, t.period, m.period), '|', 1) AS tenant_id,
          split_part(g.period, '|', 2) AS period, g.* EXCLUDE (period), t.* EXCLUDE (period), m.* EXCLUDE (period),
          google_spend + meta_spend + tiktok_spend AS ad_spend,
          google_clicks + meta_clicks + tiktok_clicks AS ad_clicks,
          google_conversions + meta_conversions + tiktok_conversions AS ad_conversions
          FROM by_google g FULL OUTER JOIN by_tiktok t ON g.period = t.period
          FULL OUTER JOIN by_meta m ON g.period = m.period)""",
        final=Q.rounded(
            "SELECT *, ad_conversions / nullif(ad_clicks, 0) * 100 AS click_to_purchase_pct FROM chain",
            "tenant_id, period",
        ),
    ),
)
def social_rollup_week_all_stores(s):
    return shown(P.social_rollup(s.google_ads(), s.tiktok_ads(), s.meta_ads(), "week", ["tenant_id"]))


@query(
    "cost_ledger",
    Q.with_base(
        Q.ledger(),
        final=Q.rounded(
            "SELECT id, tag, date, CAST(days_in_month AS INTEGER) AS days_in_month, daily_cost "
            "FROM ledger",
            "id, tag, date, days_in_month",
            4,
        ),
    ),
)
def cost_ledger(s):
    rows = daily_ledger(s.schedule(), *RANGE)
    return shown(rows.select("id", "tag", "date", "days_in_month", "daily_cost"), 4)


@query(
    "cost_by_tag",
    Q.with_base(
        Q.ledger(), Q.expenses_by("week"), final=Q.rounded("SELECT * FROM by_expenses", "period")
    ),
)
def cost_by_tag(s):
    rows = daily_ledger(s.schedule(), *RANGE).withColumn("period", F.col("week"))
    return shown(R.cost_by_tag(rows, ["period"]))


# --- period P&L ---------------------------------------------------------------------------------


def _pnl(name: str, grain: str, tz: str = TZ, policy: str = "parity"):
    @query(name, Q.pnl(grain, tz, policy))
    def build(s):
        return shown(P.period_pnl(s.tables(), grain, *RANGE, tz, policy))


_pnl("pnl_day", "date", NEW_YORK)
_pnl("pnl_week", "week")
_pnl("pnl_month", "month")
_pnl("pnl_year", "year")
_pnl("pnl_day_corrected", "date", policy="corrected")
_pnl("pnl_month_corrected", "month", policy="corrected")
_pnl("pnl_day_null_propagating", "date", policy="propagate")


@query("pnl_month_all_stores", Q.pnl("month", TZ, stores=True))
def pnl_month_all_stores(s):
    return shown(P.period_pnl(fixtures.all_stores(s), "month", *RANGE, TZ))


@query("pnl_week_all_stores_corrected", Q.pnl("week", TZ, "corrected", stores=True))
def pnl_week_all_stores_corrected(s):
    rows = P.period_pnl(fixtures.all_stores(s), "week", *RANGE, TZ, "corrected")
    return shown(rows)


OWN_ZONES = "CASE tenant_id {} ELSE 'UTC' END".format(" ".join(f"WHEN '{t}' THEN '{z}'" for t, z in fixtures.ZONES.items()))


def _zoned_stores(s: SampleStore):
    return with_zones(fixtures.all_stores(s), fixtures.store_zones(s))


@query("pnl_day_all_stores_own_zones", Q.pnl("date", OWN_ZONES, stores=True))
def pnl_day_all_stores_own_zones(s):
    return shown(P.period_pnl(_zoned_stores(s), "date", *RANGE, OWN_ZONE))


def _from_states(s: SampleStore, t, grain: str, tz: str, policy: str, parts: list[tuple[str, str]]) -> DataFrame:
    """States written part by part, then merged and reported by `grain`."""
    root = scratch_dir(s.spark, "states")
    for span in parts:
        write_day_states(day_states(t, *span, tz, policy), root, *span)
    return shown(pnl_from_states(read_day_states(s.spark, root), t, grain, *RANGE, policy))


@query("pnl_month_from_states", Q.pnl("month", TZ))
def pnl_month_from_states(s):
    """The days of a part that is stored twice count once."""
    parts = [(START, "1996-05-10"), ("1996-05-11", END), ("1995-12-20", "1996-06-20")]
    return _from_states(s, s.tables(), "month", TZ, "parity", parts)


@query("pnl_week_from_states_corrected", Q.pnl("week", OWN_ZONES, "corrected", stores=True))
def pnl_week_from_states_corrected(s):
    return _from_states(s, _zoned_stores(s), "week", OWN_ZONE, "corrected", [RANGE])


@query(
    "pnl_month_returns_kept",
    Q.pnl("month", TZ).replace("coalesce(product_cost - returned_product_cost, 0)", "coalesce(product_cost, 0)"),
)
def pnl_month_returns_kept(s):
    """A store that doesn't take the cost of returned goods off."""
    t = s.tables()
    kept = replace(t, settings=t.settings.withColumn("exclude_returned_cost", F.lit(False)))
    return shown(P.period_pnl(kept, "month", *RANGE, TZ))


# Ranges that leave rows out on both sides, inside a year and over the turn of one.
INSIDE = ("1996-03-10", "1996-11-20")
TURN = ("1996-12-31", "1998-01-01")


def _pnl_within(name: str, grain: str, span: tuple[str, str], tz: str, policy: str = "parity"):
    @query(name, Q.within(Q.pnl(grain, tz, policy), *span))
    def build(s):
        return shown(P.period_pnl(s.tables(), grain, *span, tz, policy))


_pnl_within("pnl_week_inside_year", "week", INSIDE, NEW_YORK, "corrected")
_pnl_within("pnl_week_turn_of_year", "week", TURN, NEW_YORK, "corrected")


@query(
    "pnl_week_own_zones_inside_year",
    Q.within(Q.pnl("week", OWN_ZONES, "corrected", stores=True), *INSIDE),
)
def pnl_week_own_zones_inside_year(s):
    return shown(P.period_pnl(_zoned_stores(s), "week", *INSIDE, OWN_ZONE, "corrected"))


@query("cost_ledger_inside_year", Q.within(ORACLE["cost_ledger"], *INSIDE))
def cost_ledger_inside_year(s):
    rows = daily_ledger(s.schedule(), *INSIDE)
    return shown(rows.select("id", "tag", "date", "days_in_month", "daily_cost"), 4)


@query("sales_summary_turn_of_year", Q.within(ORACLE["sales_summary"], *TURN))
def sales_summary_turn_of_year(s):
    return shown(P.sales_summary(s.tables(), "month", *TURN, TZ))


_pnl("pnl_by_variant", "variant_id")
_pnl("pnl_by_order", "order_id")


# --- orders -------------------------------------------------------------------------------------

PAGE_SQL_COLUMNS = ", ".join([*Q.PAGE_TEXT, *Q.TOTALS])
VARIANT_SCHEMA = (
    "array<struct<id: string, lineType: string, product: string, quantity: int, paid: double,"
    "product_cost: double, gross_profit: double, gpm: double>>"
)


def _with_variant_check(page: DataFrame) -> DataFrame:
    """Replace the variant list by what it holds, read back from its JSON text."""
    listed = F.from_json("variants_json", VARIANT_SCHEMA)

    def total(field: str):
        return F.aggregate("_listed", F.lit(0.0), lambda a, v: a + F.coalesce(v[field].cast("double"), F.lit(0.0)))

    # a column of its own, so that the text is parsed once for all that is read of it
    return page.withColumn("_listed", listed).withColumns(
        {
            "variants": F.when(F.col("_listed").isNotNull(), F.size("_listed")),
            "variant_paid": total("paid"),
            "variant_profit": total("gross_profit"),
            "variant_gpm": total("gpm"),
        }
    ).drop("variants_json", "_listed")


def _page_sql(order_by: str) -> str:
    return Q.with_base(
        Q.order_profit(),
        Q.page("UTC"),
        Q.VARIANT_LINES,
        """listed AS (SELECT order_id, CAST(count(*) AS INTEGER) AS variants, sum(paid) AS variant_paid,
          sum(gross_profit) AS variant_profit, sum(gpm) AS variant_gpm FROM variant_lines GROUP BY ALL)""",
        f"cut AS (SELECT * FROM page ORDER BY {order_by}, key, src NULLS FIRST LIMIT 2000)",
        final=Q.rounded(
            f"SELECT {PAGE_SQL_COLUMNS}, variants, variant_paid, variant_profit, variant_gpm "
            "FROM cut LEFT JOIN listed ON key = order_id",
            ", ".join([*Q.PAGE_TEXT, "variants"])),
    )


@query("order_page", _page_sql("date DESC NULLS LAST"))
def order_page(s):
    return shown(_with_variant_check(O.order_page(s.tables(), *RANGE)))


@query("order_page_by_profit", _page_sql("gross_profit DESC NULLS LAST"))
def order_page_by_profit(s):
    tables = s.tables()
    page = O.order_page(tables, *RANGE, order_by=[("gross_profit", "desc")])
    return shown(_with_variant_check(page))


@query(
    "order_page_export",
    Q.with_base(
        Q.order_profit(),
        Q.page(TZ),
        final=Q.rounded(f"SELECT {PAGE_SQL_COLUMNS} FROM page", ", ".join(Q.PAGE_TEXT)),
    ),
)
def order_page_export(s):
    return shown(O.order_page_export(s.tables(), *RANGE, TZ))


# The range of an order report is that of its orders; their entries count whenever they happened.
_PAGE = Q.page(TZ).strip()


@query("order_page_export_inside_year", ORACLE["order_page_export"].replace(_PAGE, Q.within(_PAGE, *INSIDE)))
def order_page_export_inside_year(s):
    return shown(O.order_page_export(s.tables(), *INSIDE, TZ))


@query(
    "order_page_filtered",
    Q.with_base(
        Q.order_profit(),
        Q.page(TZ),
        final=Q.rounded(
            f"SELECT {PAGE_SQL_COLUMNS} FROM page WHERE payment_status = 'PAID' "
            "AND currency_code IN ('EUR', 'GBP') AND tags LIKE '%URGENT%'",
            ", ".join(Q.PAGE_TEXT)),
    ),
)
def order_page_filtered(s):
    where = [
        ("financial_status", "=", "PAID"),
        ("presentment_currency", "in", ["EUR", "GBP"]),
        ("tags", "like", "%URGENT%"),
    ]
    rows = O.order_page_export(s.tables(), *RANGE, TZ, where, [("paid", "asc")])
    return shown(rows)


@query(
    "order_page_any_of",
    Q.with_base(
        Q.order_profit(),
        Q.page(TZ),
        final=Q.rounded(
            f"SELECT {PAGE_SQL_COLUMNS} FROM page WHERE (payment_status = 'PAID' OR currency_code = 'EUR') "
            "AND coalesce(list_contains(from_json(tags, '[\"VARCHAR\"]'), '5-LOW'), false) "
            "AND NOT (payment_status = 'PAID' AND currency_code = 'EUR')",
            ", ".join(Q.PAGE_TEXT)),
    ),
)
def order_page_any_of(s):
    where = [
        ("any", [("financial_status", "=", "PAID"), ("presentment_currency", "=", "EUR")]),
        ("tags", "has", "5-LOW"),
        ("not", ("all", [("financial_status", "=", "PAID"), ("presentment_currency", "=", "EUR")])),
    ]
    return shown(O.order_page_export(s.tables(), *RANGE, TZ, where))


GROUPED_SQL = ", ".join(
    f"coalesce(sum(p.{c}), 0) AS {c}" for c in ("paid", "discount", "shipping_charged", "shipping_cost", "fulfillment", "transactions",
                                              "cogs", "packing_fees", "gross_profit", "tax", '"productCost"')
)


def _grouped_sql(groups: dict[str, str], where: str = "TRUE", stores: bool = False, tz: str = "UTC") -> str:
    """Sums of orders' sums, and the margin of those sums."""
    t = Q.local("order_created_at", tz)
    named = ", ".join(f"{column} AS {name}" for name, column in groups.items())
    return Q.with_base(
        Q.order_profit(stores=stores),
        "own AS (SELECT order_id, sum(paid) AS paid, sum(discount) AS discount, sum(shipping_charged) AS shipping_charged, "
        "sum(shipping_cost) AS shipping_cost, sum(fulfillment) AS fulfillment, sum(transactions) AS transactions, sum(cogs) AS cogs, "
        "sum(packing_fees) AS packing_fees, sum(gross_profit) AS gross_profit, sum(tax) AS tax, "
        'sum("productCost") AS "productCost" FROM profit GROUP BY order_id)',
        f"placed AS (SELECT *, {Q.keys(t)} FROM fx_orders)",
        f"grouped AS (SELECT {named}, count(DISTINCT o.order_id) AS orders, count(DISTINCT customer_id) AS customers, {GROUPED_SQL}, "
        "coalesce(sum(s.net), 0) AS net FROM placed o LEFT JOIN own p ON o.order_id = p.order_id "
        f"LEFT JOIN per_sales s ON o.order_id = s.order_id WHERE {where} GROUP BY ALL)",
        final=Q.rounded(
            "SELECT *, coalesce(gross_profit / nullif(net, 0) * 100, 0) AS gpmargin FROM grouped",
            ", ".join([*groups, "orders", "customers"])),
    )


@query(
    "order_export_grouped",
    _grouped_sql({"shipping_country": "shipping_country", "currency_code": "presentment_currency"}, "financial_status = 'PAID'"),
)
def order_export_grouped(s):
    where = [("financial_status", "=", "PAID")]
    rows = O.order_export_grouped(s.tables(), *RANGE, ["shipping_country", "currency_code"], where=where)
    return shown(rows)


@query(
    "order_export_grouped_all_stores",
    _grouped_sql({"tenant_id": "tenant_id", "month": "month", "province": "province"}, stores=True, tz=OWN_ZONES),
)
def order_export_grouped_all_stores(s):
    """By local month and province, every store in its own zone; orders without a province are a group."""
    rows = O.order_export_grouped(_zoned_stores(s), *RANGE, ["month", "province"], OWN_ZONE)
    return shown(rows)


def _summary_sql(by: str, extra: str = "") -> str:
    sums = ", ".join(f"sum({c}) AS {c}" for c in Q.TOTALS)
    return Q.with_base(
        Q.order_profit(),
        final=Q.rounded(
            f"SELECT o.{by}, {sums} FROM fx_orders o LEFT JOIN profit p ON o.order_id = p.order_id "
            f"{extra} GROUP BY o.{by}",
            by),
    )


@query("order_summary_country", _summary_sql("shipping_country"))
def order_summary_country(s):
    rows = O.order_summary(s.tables(), *RANGE, "shipping_country", order_by=[("paid", "desc")])
    return shown(rows)


@query(
    "order_summary_filtered",
    _summary_sql("presentment_currency", "WHERE o.financial_status = 'PAID'"),
)
def order_summary_filtered(s):
    where = [("financial_status", "=", "PAID")]
    rows = O.order_summary(s.tables(), *RANGE, "presentment_currency", where=where)
    return shown(rows)


@query(
    "order_page_all_stores",
    Q.with_base(
        Q.order_profit(stores=True),
        Q.page("UTC"),
        "cut AS (SELECT * FROM page QUALIFY row_number() OVER (PARTITION BY tenant_id "
        "ORDER BY paid DESC NULLS LAST, key, src NULLS FIRST) <= 2000)",
        final=Q.rounded(
            f"SELECT tenant_id, {PAGE_SQL_COLUMNS} FROM cut",
            ", ".join(["tenant_id", *Q.PAGE_TEXT])),
    ),
)
def order_page_all_stores(s):
    stores = fixtures.all_stores(s)
    page = O.order_page(stores, *RANGE, order_by=[("paid", "desc")])
    return shown(page.drop("variants_json"))


@query("order_summary_province", _summary_sql("province"))
def order_summary_province(s):
    return shown(O.order_summary(s.tables(), *RANGE, "province"))


@query(
    "order_key_summary",
    Q.with_base(
        Q.order_profit(),
        final=Q.rounded(
            f"SELECT order_id, {', '.join(f'sum({c}) AS {c}' for c in Q.TOTALS)} FROM profit "
            "GROUP BY order_id",
            "order_id"),
    ),
)
def order_key_summary(s):
    return shown(O.order_key_summary(s.tables(), *RANGE))


def _totals_sql(grain: str, swapped: bool) -> str:
    def keyed(table: str, ts: str) -> str:
        return f"(SELECT *, {Q.keys(Q.local(ts, TZ))} FROM {table})"

    ctes, final = Q.metrics("merged", "grouping", "parity", False, ("paid",))
    return Q.with_base(
        Q.lines(TZ),
        Q.priced(swapped),
        Q.sales_by(grain),
        f"""by_fees AS (SELECT {grain} AS period, sum(amount * fx_rate) AS payment_fees
          FROM {keyed('fx_transactions', 'transaction_at')}
          WHERE kind = 'SALE' AND error_code IS NULL GROUP BY ALL)""",
        f"""by_sent AS (SELECT {grain} AS period, sum(fulfillment_cost) AS fulfillment_cost
          FROM {keyed('fx_shipped', 'order_created_at')} GROUP BY ALL)""",
        """merged AS (SELECT coalesce(s.period, f.period, h.period) AS grouping,
          s.* EXCLUDE (period), payment_fees, fulfillment_cost
          FROM by_sales s FULL OUTER JOIN by_fees f ON s.period = f.period
          FULL OUTER JOIN by_sent h ON s.period = h.period)""",
        ctes,
        final=final,
    )


@query("order_totals_order", _totals_sql("order_id", False))
def order_totals_order(s):
    return shown(O.order_totals(s.tables(), "order_id", *RANGE, TZ))


@query("order_totals_month", _totals_sql("month", True))
def order_totals_month(s):
    rows = O.order_totals(s.tables(), "month", *RANGE, TZ, by="event", swapped_cost_flags=True)
    return shown(rows)


@query(
    "order_variant_lines",
    Q.with_base(
        Q.lines("UTC"),
        Q.priced(),
        Q.VARIANT_LINES,
        final=Q.rounded(
            "SELECT * FROM variant_lines", 'order_id, id, "lineType", product, quantity', 4
        ),
    ),
)
def order_variant_lines(s):
    return shown(O.variant_lines(_priced(s)), 4)


@query(
    "order_variants",
    Q.with_base(
        Q.lines("UTC"),
        Q.priced(),
        Q.VARIANT_LINES,
        final=Q.rounded(
            "SELECT order_id, CAST(count(*) AS INTEGER) AS variants, sum(paid) AS variant_paid, "
            "sum(gross_profit) AS variant_profit, sum(coalesce(gpm, 0)) AS variant_gpm "
            "FROM variant_lines GROUP BY ALL",
            "order_id, variants",
        ),
    ),
)
def order_variants(s):
    return shown(_with_variant_check(O.order_variants(_priced(s, counted=True))))


@query("order_variants_parsed", ORACLE["order_variant_lines"])
def order_variants_parsed(s):
    """The JSON text of every order's variants, read back and compared line by line."""
    schema = "array<struct<id: string, lineType: string, product: string, quantity: int, paid: double, product_cost: double, gross_profit: double, gpm: double>>"
    listed = O.order_variants(_priced(s, counted=True)).withColumn("lines", F.from_json("variants_json", schema, {"mode": "FAILFAST"}))
    return shown(listed.select("order_id", F.inline("lines")), 4)


@query(
    "order_filter_values",
    Q.with_base(
        "tag_rows AS (SELECT DISTINCT unnest(CAST(CAST(tags AS JSON) AS VARCHAR[])) AS v FROM fx_orders)",
        "gate_rows AS (SELECT DISTINCT unnest(CAST(CAST(payment_gateways AS JSON) AS VARCHAR[])) AS v "
        "FROM fx_orders)",
        "lists AS (SELECT "
        + ", ".join(
            f"(SELECT list(v ORDER BY v NULLS LAST) FROM (SELECT DISTINCT {c} AS v FROM fx_orders)) AS {n}"
            for n, c in O.FILTER_COLUMNS.items()
        )
        + ", (SELECT list(v ORDER BY v) FROM tag_rows) AS tags, "
        "(SELECT list(v ORDER BY v) FROM gate_rows) AS gateways)",
        final=", ".join(
            f"CAST(to_json({n}) AS VARCHAR) AS {n}" for n in [*O.FILTER_COLUMNS, *O.FILTER_LISTS]
        )
        + " FROM lists",
    ),
)
def order_filter_values(s):
    return O.order_filter_values(s.orders(), (1994, 2002))


@query(
    "fulfillment_export",
    Q.with_base(
        final=Q.rounded(
            f"""SELECT strftime({Q.local('order_created_at', TZ)}, '%Y-%m-%d') AS order_date, resource_id,
          total_quantity, order_id, order_name, {at_sql('order_created_at')}, {at_sql('fulfilled_at')},
          CAST((SELECT count(*) FROM fx_tiers WHERE total_quantity BETWEEN low AND high) AS INTEGER)
          AS matching, {', '.join(TIER_COLUMNS)} FROM fx_shipped""",
            "order_date, resource_id, total_quantity, order_id, order_name, order_created_at, "
            "fulfilled_at, matching",
            4,
        )
    ),
)
def fulfillment_export(s):
    rows = O.fulfillment_export(s.tables(), TZ, *RANGE)
    rows = rows.withColumn("matching", F.size("matching_tiers")).drop("matching_tiers")
    return shown(rows.withColumns({c: at(c) for c in ("order_created_at", "fulfilled_at")}), 4)


@query(
    "fulfillment_export_tiers",
    Q.with_base(
        final=Q.rounded(
            "SELECT resource_id, CAST(row_number() OVER (PARTITION BY resource_id ORDER BY tier) - 1 AS INTEGER) AS place, "
            "ship_base AS fulfillment_base, ship_more AS fulfillment_additional, pack_base AS packaging_base, "
            "pack_more AS packaging_additional, low AS min_units, high AS max_units "
            "FROM fx_fulfillments JOIN fx_tiers ON total_quantity BETWEEN low AND high",
            "resource_id, place, min_units, max_units",
            4,
        )
    ),
)
def fulfillment_export_tiers(s):
    """The list of matching tiers of every shipment, entry by entry."""
    rows = O.fulfillment_export(s.tables(), TZ, *RANGE).select("resource_id", F.posexplode("matching_tiers").alias("place", "tier"))
    return shown(rows.select("resource_id", "place", "tier.*"), 4)


@query(
    "filter_value_rows",
    Q.with_base(
        final="DISTINCT kind, value FROM ("
        "SELECT 'cities' AS kind, shipping_city AS value FROM fx_orders UNION ALL "
        "SELECT 'countries', shipping_country FROM fx_orders UNION ALL "
        "SELECT 'provinces', province FROM fx_orders UNION ALL "
        "SELECT 'tags', unnest(CAST(CAST(tags AS JSON) AS VARCHAR[])) FROM fx_orders UNION ALL "
        "SELECT 'gateways', unnest(CAST(CAST(payment_gateways AS JSON) AS VARCHAR[])) FROM fx_orders)"
    ),
)
def filter_value_rows(s):
    return O.filter_value_rows(s.orders())


# --- ingest -------------------------------------------------------------------------------------

ORDER_MODEL_SQL = f"""
  tenant_id AS tenantid, order_id, order_name, {at_sql('order_created_at')}, customer_order_index,
  customer_id, customer_name, split_part(customer_name, '#', 1) AS customer_first_name,
  split_part(customer_name, '#', 2) AS customer_last_name, customer_email,
  o_totalprice AS received_shop,
  CASE WHEN o_orderkey % 8 = 0 THEN 0e0 ELSE o_totalprice / 2 END AS received_presentment,
  presentment_currency, CASE WHEN o_orderkey % 8 <> 0 THEN 2e0 END AS fx_rate,
  first_carrier, '[{{"note":"none"}}]' AS refunds, payment_gateways, tags, fulfillment_status,
  financial_status, country_code, province_code, province, shipping_city, shipping_country,
  strftime(order_created_at, '%Y') AS created_year, strftime(order_created_at, '%m') AS created_month,
  strftime(order_created_at, '%d') AS created_day,
  CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END AS fulfillment_count"""


def _order_models(s: SampleStore) -> DataFrame:
    return ingest_orders.orders_model(ingest_orders.parse_orders(fixtures.order_documents(s)))


@query("ingest_orders", Q.with_base(final=f"{ORDER_MODEL_SQL} FROM fx_orders"))
def ingest_orders_model(s):
    rows = _order_models(s).withColumn("fulfillment_count", F.size("fulfillments"))
    return rows.withColumn("order_created_at", at("order_created_at")).drop(
        "date", "fulfillments", "transactions", "agreements"
    )


CARRIED_SQL = f"""order_id, order_name, {at_sql('order_created_at')},
  strftime(order_created_at, '%Y') AS created_year, strftime(order_created_at, '%m') AS created_month,
  strftime(order_created_at, '%d') AS created_day, country_code, province_code,
  customer_order_index, customer_id"""
SALE_DAY_SQL = f"""{at_sql('happened_at')}, strftime(happened_at, '%Y') AS happened_year,
  strftime(happened_at, '%m') AS happened_month, strftime(happened_at, '%d') AS happened_day,
  quarter(happened_at)::INTEGER AS happened_quarter"""


@query(
    "ingest_sales_items",
    Q.with_base(
        final=f"""tenant_id AS tenantid, {CARRIED_SQL}, {SALE_DAY_SQL}, variant_id,
          'gid/' || product_name AS product_id, product_name, line_type, action_type, sale_id, quantity,
          unit_price, discount_before_taxes, discount_before_taxes / 2 AS discount_after_taxes,
          total_tax, total_amount, CASE WHEN tax_rate_sum <> 0 THEN tax_rate_sum + 0.01e0 END
          AS tax_rate_sum, CASE WHEN tax_rate_sum <> 0 THEN 2 ELSE 0 END AS tax_lines
          FROM fx_sales
          UNION ALL SELECT tenant_id, {CARRIED_SQL}, {SALE_DAY_SQL}, NULL, NULL, NULL, 'ADJUSTMENT',
          action_type, sale_id || '-x', 0, NULL, discount_before_taxes * 0.5e0,
          discount_before_taxes / 2, total_tax * 0.5e0, total_amount * 0.5e0, NULL, NULL
          FROM fx_sales WHERE abs(quantity) > 25"""
    ),
)
def ingest_sales_items(s):
    parsed = ingest_orders.parse_orders(fixtures.sale_documents(s))
    items = ingest_orders.sales_items_model(ingest_orders.orders_model(parsed))
    return items.withColumns(
        {
            "order_created_at": at("order_created_at"),
            "happened_at": at("happened_at"),
            "tax_lines": F.when(F.col("tax_rates").isNotNull(), F.size("tax_rates")),
        }
    ).drop("tax_rates", "payment_gateways", "tags", "fx_rate")


@query(
    "ingest_transactions",
    Q.with_base(
        """fees AS (SELECT *, fx_transactions.amount AS fee, 'USD' AS fee_currency FROM fx_orders
            JOIN fx_transactions USING (order_id) WHERE o_orderkey % 7 <> 0
          UNION ALL SELECT *, 0.25e0, 'EUR' FROM fx_orders JOIN fx_transactions USING (order_id)
            WHERE o_orderkey % 7 = 1)""",
        final=f"""tenant_id AS tenantid, {CARRIED_SQL}, payment_gateways, tags,
          CASE WHEN o_orderkey % 8 <> 0 THEN 2e0 END AS fx_rate, 'T' || o_orderkey AS transaction_id,
          {at_sql('transaction_at')}, strftime(transaction_at, '%Y') AS transaction_year,
          strftime(transaction_at, '%m') AS transaction_month,
          strftime(transaction_at, '%d') AS transaction_day, error_code, kind, 'Card' AS gateway,
          fee AS amount, fee_currency AS currency_code FROM fees""",
    ),
)
def ingest_transactions(s):
    rows = ingest_orders.transactions_model(_order_models(s))
    return rows.withColumns({c: at(c) for c in ("order_created_at", "transaction_at")})


@query(
    "ingest_fulfillments",
    Q.with_base(
        "sent AS (SELECT o.*, resource_id, total_quantity, fulfilled_at FROM fx_orders o "
        "JOIN fx_fulfillments USING (order_id))",
        final=f"""tenant_id AS tenantid, {CARRIED_SQL}, payment_gateways, tags,
          CASE WHEN o_orderkey % 8 <> 0 THEN 2e0 END AS fx_rate, resource_id, total_quantity,
          strftime(fulfilled_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, {at_sql('fulfilled_at')},
          strftime(fulfilled_at, '%Y') AS fulfillment_year,
          strftime(fulfilled_at, '%m') AS fulfillment_month,
          strftime(fulfilled_at, '%d') AS fulfillment_day FROM sent""",
    ),
)
def ingest_fulfillments(s):
    rows = ingest_orders.fulfillments_model(_order_models(s))
    return rows.withColumns({c: at(c) for c in ("order_created_at", "fulfilled_at")})


def _ad_events(s: SampleStore) -> DataFrame:
    return s.table("events").select(
        "event_id",
        F.col("value").cast("string").alias("value"),
        (F.col("user_id") % 7).cast("string").alias("clicks"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        "event_type",
    )


AD_DAY_SQL = Q.keys("ts")


@query(
    "ingest_google_ads",
    f"""SELECT value AS cost_micros, CAST(user_id % 7 AS DOUBLE) AS clicks, NULL::DOUBLE AS conversions,
      {AD_DAY_SQL} FROM events""",
)
def ingest_google_ads(s):
    raw = _ad_events(s).select(
        F.from_json(
            F.to_json(F.struct(F.col("value").alias("costMicros"), "clicks")),
            "costMicros string, clicks string, conversions string",
        ).alias("metrics"),
        F.col("day").alias("snapshotDate"),
    )
    return ingest_settings.google_ads_model(raw)


@query(
    "ingest_tiktok_ads",
    f"""SELECT value AS spend, CAST(user_id % 7 AS DOUBLE) AS clicks,
      CAST(event_id % 3 AS DOUBLE) AS conversion, {AD_DAY_SQL} FROM events""",
)
def ingest_tiktok_ads(s):
    raw = _ad_events(s).select(
        F.col("value").alias("spend"),
        "clicks",
        (F.col("event_id") % 3).cast("string").alias("conversion"),
        F.col("day").alias("snapshotDate"),
    )
    return ingest_settings.tiktok_ads_model(raw)


@query(
    "ingest_meta_ads",
    f"""SELECT value AS spend, value / 2 AS cpc, NULL::DOUBLE AS ctr, 1.5e0 AS cpm,
      CAST(user_id % 7 AS DOUBLE) AS clicks, 'campaign ' || event_type AS campaign_name,
      strftime(ts, '%Y-%m-%d') AS date_start, strftime(ts, '%Y-%m-%d') AS date_stop,
      CAST(event_id % 10 AS VARCHAR) AS account_id, strftime(ts, '%Y-%m-%d') AS snapshot_date,
      {AD_DAY_SQL}, CASE event_type WHEN 'purchase' THEN 2 ELSE 1 END AS actions,
      CASE event_type WHEN 'purchase' THEN value + 1 END AS bought FROM events""",
)
def ingest_meta_ads(s):
    kind = F.col("event_type")
    text = F.when(
        kind == "purchase",
        F.concat(
            F.lit('[{"action_type":"purchase","value":"'), "value",
            F.lit('"},{"action_type":"purchase","value":1}]'),
        ),
    ).otherwise('[{"action_type":"link_click","value":"4"}]')
    empty = F.from_json(F.lit("[]"), "array<struct<action_type: string, value: string>>")
    lists = ("action_values", "purchase_roas", "outbound_clicks_ctr", "cost_per_outbound_click",
             "outbound_clicks")
    raw = _ad_events(s).select(
        F.col("value").alias("spend"),
        F.from_json(text, "array<struct<action_type: string, value: string>>").alias("actions"),
        (F.col("value").cast("double") / 2).cast("string").alias("cpc"),
        F.lit(None).cast("string").alias("ctr"),
        F.lit("1.5").alias("cpm"),
        "clicks",
        *[empty.alias(name) for name in lists],
        F.concat(F.lit("campaign "), kind).alias("campaign_name"),
        F.col("day").alias("date_start"),
        F.col("day").alias("date_stop"),
        (F.col("event_id") % 10).cast("string").alias("account_id"),
        F.col("day").alias("snapshotDate"),
    )
    model = ingest_settings.meta_ads_model(raw).drop(*lists)
    return model.withColumns(
        {
            "bought": R.purchase_conversions(F.col("actions")),
            "actions": F.size("actions"),
            **{c: F.col(c).cast("string") for c in ("date_start", "date_stop", "snapshot_date")},
        }
    )


@query(
    "ingest_cost_schedule",
    Q.with_base(
        final="""id, s_name AS expense_name, 'ACTIVE' AS status, 'general' AS category, cost,
          frequency, tag, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date
          FROM fx_schedule JOIN supplier ON id = CAST(s_suppkey AS VARCHAR)"""
    ),
)
def ingest_cost_schedule(s):
    model = ingest_settings.cost_schedule_model(s.raw_schedule())
    return model.withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query(
    "ingest_product_costs",
    """SELECT CAST(p_partkey AS VARCHAR) AS variant_id, 'product ' || (p_partkey // 3) AS product_id,
      p_retailprice AS product_cost, CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END AS packing_fee,
      p_name AS title, p_brand AS sku, p_retailprice AS price FROM part""",
)
def ingest_product_costs(s):
    key = F.col("p_partkey")
    price = F.col("p_retailprice").cast("string")
    raw = s.table("part").select(
        key.cast("string").alias("variantId"),
        F.concat(F.lit("product "), F.floor(key / 3)).alias("productId"),
        price.alias("productCost"),
        F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).alias("packingFee"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("sku"),
        price.alias("price"),
    )
    return ingest_settings.product_costs_model(raw)


@query(
    "ingest_shipping_list",
    Q.with_base(
        final="ship_country AS country_name, region, ship_country AS country_code, "
        "CAST(ship_cost AS DOUBLE) AS shipping_cost, back_cost AS return_cost FROM fx_ship"
    ),
)
def ingest_shipping_list(s):
    raw = s.shipping_entries().select(
        F.col("country_name").alias("countryName"),
        "region",
        F.col("country_code").alias("countryCode"),
        F.col("shipping_cost").cast("string").alias("shippingCost"),
        F.col("return_cost").cast("string").alias("returnShippingCost"),
    )
    listed = ingest_settings.shipping_by_country_model(ingest_settings.shipping_entries_model(raw))
    return listed.select(F.inline("entries"))


@query(
    "ingest_order_shipping",
    "SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_totalprice AS shipping_cost FROM orders",
)
def ingest_order_shipping(s):
    raw = s.table("orders").select(
        F.col("o_orderkey").cast("string").alias("orderId"),
        F.col("o_totalprice").cast("string").alias("shippingCost"),
    )
    return ingest_settings.order_shipping_model(raw)


@query(
    "ingest_default_values",
    """WITH tiers AS (
      SELECT *, 1 AS n, 0 AS low, 9999999 AS high FROM customer WHERE c_custkey % 3 <> 1
      UNION ALL SELECT *, 1, 0, 5 FROM customer WHERE c_custkey % 3 = 1
      UNION ALL SELECT *, 2, 6, 99 FROM customer WHERE c_custkey % 3 = 1)
    SELECT 'S' || c_custkey AS tenantid, CAST(c_custkey % 50 AS DOUBLE) AS margin_pct,
      6.5e0 AS shipping_margin, CASE WHEN c_custkey % 2 = 0 THEN 3e0 END AS return_margin,
      TRUE AS exclude_returned_cost,
      CASE WHEN c_custkey % 3 = 1 THEN 'variablePricing' ELSE 'simplePricing' END AS pricing,
      n AS tier, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE c_custkey + n END AS fulfillment_base,
      0.5e0 AS fulfillment_additional, 1e0 * n AS packaging_base, 0.25e0 AS packaging_additional,
      low AS min_units, high AS max_units
    FROM (SELECT * EXCLUDE (c_custkey), CAST(c_custkey AS DOUBLE) AS k, c_custkey FROM tiers)""".replace(
        "ELSE c_custkey + n END", "ELSE k + n END"
    ),
)
def ingest_default_values(s):
    key = F.col("c_custkey")
    rest = '"packagingBaseCostPerOrder":%s,"packagingCostPerAdditionalProduct":"0.25"'
    simple = '{"baseCostPerOrder":%s,"costPerAdditionalProduct":0.5,' + rest % "1" + "}"
    tier = (
        '{"fulFillmentBaseCostPerOrder":%s,"fulFillmentCostPerAdditionalProduct":"0.5",'
        + rest
        + ',"minUnits":{"id":%s},"maxUnits":{"id":"%s"}}'
    )
    both = "[" + tier % ("%s", "1", "0", "5") + "," + tier % ("%s", "2", "6", "99") + "]"
    raw = s.table("customer").select(
        F.concat(F.lit("S"), key).alias("tenantid"),
        (key % 50).cast("string").alias("defaultGrossProfitMargin"),
        F.lit("6.5").alias("defaultShippingMargin"),
        F.when(key % 2 == 0, "3").alias("defaultReturnMargin"),
        F.when(key % 3 == 0, F.format_string(simple, (key + 1).cast("string")))
        .when(key % 3 == 2, simple % "null")
        .otherwise(
            F.format_string(both, (key + 1).cast("string"), (key + 2).cast("string"))
        )
        .alias("defaultFulfillmentCosts"),
    )
    model = ingest_settings.default_values_model(raw)
    fields = [c for c in model.columns if c != "tiers"]
    exploded = model.select(*fields, F.posexplode("tiers").alias("pos", "t"))
    return exploded.select(*fields, (F.col("pos") + 1).alias("tier"), "t.*")


@query(
    "ingest_transaction_fees",
    f"""SELECT value / 100 AS fee_pct, event_type AS name, event_id % 2 = 0 AS apply_on_countries,
      CAST(event_id AS DOUBLE) AS id, 0.3e0 AS fixed_fee, '["IE","US"]' AS countries,
      CASE WHEN event_id % 3 = 0 THEN 0e0 ELSE value END AS currency_conversion_fee, {AD_DAY_SQL}
      FROM events""",
)
def ingest_transaction_fees(s):
    key = F.col("event_id")
    raw = _ad_events(s).select(
        (F.col("value").cast("double") / 100).cast("string").alias("feePerc"),
        F.col("event_type").alias("name"),
        F.when(key % 2 == 0, "true").otherwise("false").alias("applyOnCountries"),
        key.cast("string").alias("id"),
        F.lit("0.3").alias("fixedFee"),
        F.lit('["IE","US"]').alias("countries"),
        F.when(key % 3 == 0, "").otherwise(F.col("value")).alias("currencyConversionFee"),
        F.col("day").alias("snapshotDate"),
    )
    return ingest_settings.transaction_fees_model(raw)


# --- files --------------------------------------------------------------------------------------


def _write_lake(rows: DataFrame, root: str, table: str) -> None:
    """Write raw lines in lake layout, a partition per store and month of the order."""
    (
        rows.withColumn("tablename", F.lit(table))
        .hint("rebalance", "tenantid", "date")
        .write.partitionBy("tenantid", "tablename", "date")
        .option("compression", "gzip")
        .mode("append")
        .json(f"{root}/tenants")
    )


def _monthly(documents: DataFrame) -> DataFrame:
    month = F.concat(F.substring("date", 1, 7), F.lit("-01"))
    return documents.withColumn("date", month)


@query(
    "lake_roundtrip",
    Q.with_base(
        final="tenant_id AS tenantid, strftime(order_created_at, '%Y-%m-01') AS date, "
        "count(*) AS orders, 'rawShopifyOrdersCreated' AS tablename FROM fx_orders "
        f"WHERE order_created_at >= DATE '{START}' GROUP BY ALL"
    ),
)
def lake_roundtrip(s):
    root = scratch_dir(s.spark, "lake")
    _write_lake(_monthly(fixtures.order_documents(s)), root, "rawShopifyOrdersCreated")
    raw = read_lake(s.spark, root, "*", "rawShopifyOrdersCreated", LAKE["orders"], days=RANGE)
    counted = raw.select("tenantid", "tablename", "date", F.get_json_object("json", "$.id").alias("id"))
    return counted.groupBy("tenantid", "tablename", "date").agg(F.count("id").alias("orders"))


LAKE_DAYS = ("1995-03-15", "1996-11-01")


@query(
    "lake_date_range",
    Q.with_base(
        final="tenant_id AS tenantid, strftime(order_created_at, '%Y-%m-01') AS date, count(*) AS orders FROM fx_orders "
        f"WHERE strftime(order_created_at, '%Y-%m-01') BETWEEN '{LAKE_DAYS[0]}' AND '{LAKE_DAYS[1]}' GROUP BY ALL"
    ),
)
def lake_date_range(s):
    """A range of date partitions; those before and after it stay closed."""
    root = scratch_dir(s.spark, "lake")
    _write_lake(_monthly(fixtures.order_documents(s)), root, "rawShopifyOrdersCreated")
    raw = read_lake(s.spark, root, "*", "rawShopifyOrdersCreated", LAKE["orders"], days=LAKE_DAYS)
    return raw.groupBy("tenantid", "date").agg(F.count("json").alias("orders"))


_SUPPLIER_DATE = "CASE WHEN s_suppkey % 2 = 0 THEN '9999-99-99' ELSE '2024-01-' || lpad(CAST(1 + s_suppkey % 28 AS VARCHAR), 2, '0') END"


@query(
    "lake_settings_partitions",
    "SELECT 'history' AS read, date, count(*) AS rows, CAST(sum(s_suppkey) AS BIGINT) AS ids "
    f"FROM (SELECT *, {_SUPPLIER_DATE} AS date FROM supplier) GROUP BY date "
    "UNION ALL SELECT 'current', '9999-99-99', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier WHERE s_suppkey % 2 = 0",
)
def lake_settings_partitions(s):
    """Settings of all dates, and those of the partition of current values alone, whose date is none."""
    root = scratch_dir(s.spark, "lake")
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("s_suppkey") % 28).cast("string"), 2, "0"))
    rows = s.table("supplier").select(
        F.lit("A").alias("tenantid"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit(CURRENT_PARTITION)).otherwise(day).alias("date"),
        F.col("s_suppkey").cast("string").alias("id"),
    )
    _write_lake(rows, root, "settings")
    parts = []
    for name, partition in (("history", None), ("current", CURRENT_PARTITION)):
        raw = read_lake(s.spark, root, "A", "settings", "id string", partition)
        parts.append(
            raw.groupBy(F.lit(name).alias("read"), "date").agg(F.count("*").alias("rows"), F.sum(F.col("id").cast("long")).alias("ids"))
        )
    return parts[0].unionByName(parts[1])


@query(
    "lookup_model_roundtrip",
    Q.with_base(
        final=Q.rounded(
            "SELECT 'all' AS model, cost_variant_id AS variant_id, variant_cost AS product_cost, packing_fee FROM fx_product_costs "
            "UNION ALL SELECT 'store', cost_variant_id, variant_cost, packing_fee FROM fx_product_costs",
            "model, variant_id",
            4,
        )
    ),
)
def lookup_model_roundtrip(s):
    """A lookup table written as one model, and as the model of two stores of which one is read."""
    root, costs = scratch_dir(s.spark, "models"), s.product_costs()
    write_model(costs, model_path(root, "product_costs"))
    every = costs.withColumn("tenantid", F.explode(F.array(F.lit("007"), F.lit("8"))))
    write_model(every, model_path(root, "store_costs"), ["tenantid"])
    one = read_model(s.spark, root, "store_costs", "007").drop("tenantid")
    rows = read_model(s.spark, root, "product_costs").withColumn("model", F.lit("all"))
    return shown(rows.unionByName(one.withColumn("model", F.lit("store"))), 4)


@query(
    "order_csv_plain",
    Q.with_base(
        final="order_id, customer_name, tags, payment_gateways, province, strftime(order_created_at, '%Y-%m-%d %H:%M:%S') AS order_created_at FROM fx_orders"
    ),
)
def order_csv_plain(s):
    """Uncompressed CSV of texts with quotes, commas and NULLs, read back."""
    rows = s.orders().select("order_id", "customer_name", "tags", "payment_gateways", "province", at("order_created_at"))
    path = write_csv(rows, scratch_dir(s.spark, "export"), gzip=False)
    return read_csv(s.spark, path, ", ".join(f"{c} string" for c in rows.columns))


@query(
    "lake_repacked",
    Q.with_base(
        final="tenant_id AS tenantid, strftime(order_created_at, '%Y-%m-01') AS date, "
        "count(*) AS orders, 'rawShopifyOrdersCreated' AS tablename, sum(o_orderkey)::BIGINT AS ids FROM fx_orders "
        f"WHERE order_created_at >= DATE '{START}' GROUP BY ALL"
    ),
)
def lake_repacked(s):
    """The lake in even files: taken over in two runs, of which the second finds the later stores' files alone."""
    root, table = scratch_dir(s.spark, "lake"), "rawShopifyOrdersCreated"
    documents = _monthly(fixtures.order_documents(s))
    for part in (F.col("tenantid") < "F", F.col("tenantid") >= "F"):
        _write_lake(documents.where(part), root, table)
        repack(s.spark, root, table)
    raw = read_packed(s.spark, root, "*", table, LAKE["orders"], days=RANGE)
    one = raw.select("tenantid", "tablename", "date", F.get_json_object("json", "$.id").alias("id"))
    return one.groupBy("tenantid", "tablename", "date").agg(F.count("id").alias("orders"), F.sum(F.col("id").cast("long")).alias("ids"))


def _job_sql(model: str, table: str, ts: str, amount: str, where: str = "TRUE") -> str:
    return (
        f"SELECT '{model}' AS model, tenant_id AS tenantid, strftime({ts}, '%Y') AS year, "
        f"count(*) AS lines, sum({amount}) AS amount FROM {table} WHERE {where} GROUP BY ALL"
    )


@query(
    "ingest_orders_job",
    Q.with_base(
        "fees AS (SELECT t.*, o_orderkey FROM fx_transactions t JOIN fx_orders USING (order_id))",
        "fee_rows AS (SELECT transaction_at, tenant_id, amount FROM fees WHERE o_orderkey % 7 <> 0 "
        "UNION ALL SELECT transaction_at, tenant_id, 0.25e0 FROM fees WHERE o_orderkey % 7 = 1)",
        "order_rows AS (SELECT order_created_at, tenant_id, o_totalprice FROM fx_orders UNION ALL "
        "SELECT order_created_at, tenant_id, NULL FROM fx_sales)",
        "sale_rows AS (SELECT happened_at, tenant_id, total_amount FROM fx_sales UNION ALL "
        "SELECT happened_at, tenant_id, total_amount * 0.5e0 FROM fx_sales WHERE abs(quantity) > 25)",
        final=Q.rounded(
            " UNION ALL ".join(
                [
                    _job_sql("orders", "order_rows", "order_created_at", "o_totalprice"),
                    _job_sql("transactions", "fee_rows", "transaction_at", "amount"),
                    _job_sql("fulfillments", "fx_fulfillments", "fulfilled_at",
                             "CAST(total_quantity AS DOUBLE)"),
                    _job_sql("sales_items", "sale_rows", "happened_at", "total_amount"),
                ]
            ),
            "model, tenantid, year, lines",
        ),
    ),
)
def ingest_orders_job(s):
    """Write all four models twice; the second run replaces every order by itself."""
    root = scratch_dir(s.spark, "models")
    documents = fixtures.order_documents(s).drop("date").unionByName(fixtures.sale_documents(s))
    orders = ingest_orders.orders_model(ingest_orders.parse_orders(documents))
    for _ in range(2):
        write_order_models(orders, root)
    parts = []
    for model, year, amount in (
        ("orders", "created_year", "received_shop"),
        ("transactions", "transaction_year", "amount"),
        ("fulfillments", "fulfillment_year", "total_quantity"),
        ("sales_items", "happened_year", "total_amount"),
    ):
        rows = read_model(s.spark, root, model, None, year, (1990, 2010))
        parts.append(
            rows.groupBy(F.lit(model).alias("model"), "tenantid", F.col(year).alias("year")).agg(
                F.count("*").alias("lines"), F.sum(F.col(amount).cast("double")).alias("amount")
            )
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return shown(union)


#: The runs' lake days, and what each says of the orders it holds.
VERSIONS = {"2024-01-05": ("2024-01-05", "PENDING"), "2024-01-07": ("2024-01-07", "PAID")}


def _versions(s: SampleStore, day: str) -> DataFrame:
    """All orders as of the earlier day; as of the later one those of 100,000 or more, paid 365 days later."""
    rows = _order_models(s).drop("date").withColumn("lake_date", F.lit(day)).withColumn("financial_status", F.lit(VERSIONS[day][1]))
    if day == max(VERSIONS):
        moved = F.expr("transform(transactions, t -> date_format(cast(t.createdAt AS timestamp) + INTERVAL 365 DAYS, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"))")
        late = F.zip_with("transactions", moved, lambda t, m: t.withField("createdAt", m))
        rows = rows.where("received_shop >= 100000").withColumn("transactions", late)
    return rows


def _reingested(s: SampleStore, days: list[str]) -> str:
    root = scratch_dir(s.spark, "models")
    for day in days:
        write_order_models(_versions(s, day), root, small_bytes=0)
    return root


@query(
    "reingest_versions",
    Q.with_base(
        final="tenant_id AS tenantid, order_id, CASE WHEN o_totalprice >= 100000 THEN 'PAID' ELSE 'PENDING' END AS financial_status, "
        "CASE WHEN o_totalprice >= 100000 THEN '2024-01-07' ELSE '2024-01-05' END AS lake_date FROM fx_orders"
    ),
)
def reingest_versions(s):
    """Runs over the earlier day, the later one and the earlier one again: the later version stays."""
    first, second = VERSIONS
    root = _reingested(s, [first, second, first])
    return read_model(s.spark, root, "orders", None, "created_year").select("tenantid", "order_id", "financial_status", "lake_date")


@query(
    "reingest_moved_year",
    Q.with_base(
        "fees AS (SELECT fx_orders.tenant_id, order_id, transaction_at + CASE WHEN o_totalprice >= 100000 THEN INTERVAL 365 DAY "
        "ELSE INTERVAL 0 DAY END AS paid_at FROM fx_transactions t JOIN fx_orders USING (order_id) WHERE o_orderkey % 7 <> 0)",
        final=f"DISTINCT tenant_id AS tenantid, order_id, {at_sql('paid_at')}, strftime(paid_at, '%Y') AS transaction_year FROM fees",
    ),
)
def reingest_moved_year(s):
    """Transactions that a later version dates 365 days later leave the year they were stored in."""
    rows = read_model(s.spark, _reingested(s, list(VERSIONS)), "transactions", None, "transaction_year")
    return rows.withColumnRenamed("transaction_at", "paid_at").select("tenantid", "order_id", at("paid_at"), "transaction_year").distinct()


@query(
    "reingest_indexed",
    Q.with_base(
        final="tenant_id AS tenantid, strftime(order_created_at, '%Y') AS year, count(*) AS orders, "
        "count(*) FILTER (o_totalprice >= 100000) AS replaced FROM fx_orders GROUP BY ALL"
    ),
)
def reingest_indexed(s):
    """What the files that the index names hold of the orders to replace: all of them."""
    root = _reingested(s, [min(VERSIONS)])
    files = listed(s.spark, root, current(s.spark, root))
    keys = _versions(s, max(VERSIONS)).select("tenantid", "order_id").distinct()
    some = files_with(s.spark, root, "orders", files, keys)
    schema = schema_of(files, "orders")
    found = read_files(s.spark, root, "orders", some, schema, "created_year").join(keys, ["tenantid", "order_id"], "left_semi")
    year = F.col("created_year").alias("year")
    replaced = found.groupBy("tenantid", year).agg(F.count("*").alias("replaced"))
    every = read_model(s.spark, root, "orders", None, "created_year").groupBy("tenantid", year).agg(F.count("*").alias("orders"))
    return every.join(replaced, ["tenantid", "year"], "left").fillna(0, ["replaced"])


ORDER_MONTH = ("1996-05-01", "1996-05-31")


@query(
    "sales_of_order_month",
    Q.with_base(
        "sold AS (SELECT tenant_id, order_created_at, happened_at, total_amount FROM fx_sales "
        "UNION ALL SELECT tenant_id, order_created_at, happened_at, total_amount * 0.5e0 FROM fx_sales WHERE abs(quantity) > 25)",
        final=Q.rounded(
            "SELECT tenant_id AS tenantid, strftime(happened_at, '%Y-%m') AS month, count(*) AS lines, "
            "count(DISTINCT year(happened_at)) AS years, sum(total_amount) AS amount FROM sold "
            f"WHERE CAST(order_created_at AS DATE) BETWEEN DATE '{ORDER_MONTH[0]}' AND DATE '{ORDER_MONTH[1]}' GROUP BY ALL",
            "tenantid, month, lines, years",
        ),
    ),
)
def sales_of_order_month(s):
    """Sale entries of a month's orders, whenever they happened, from the files that hold such orders alone."""
    root = scratch_dir(s.spark, "models")
    orders = ingest_orders.orders_model(ingest_orders.parse_orders(fixtures.sale_documents(s)))
    write_order_models(orders, root, merge=False)
    rows = read_model(s.spark, root, "sales_items", None, "happened_year", created=ORDER_MONTH)
    kept = rows.where(in_local_range("order_created_at", "UTC", *ORDER_MONTH))
    return shown(
        kept.groupBy("tenantid", F.date_format("happened_at", "yyyy-MM").alias("month")).agg(
            F.count("*").alias("lines"), F.count_distinct("happened_year").alias("years"), F.sum("total_amount").alias("amount")
        )
    )


@query(
    "parquet_year_roundtrip",
    Q.with_base(
        final=Q.rounded(
            "SELECT tenant_id AS tenantid, strftime(happened_at, '%Y') AS happened_year, "
            "count(*) AS lines, sum(total_amount) AS total_amount FROM fx_sales GROUP BY ALL",
            "tenantid, happened_year, lines",
        )
    ),
)
def parquet_year_roundtrip(s):
    root = scratch_dir(s.spark, "models")
    rows = s.sales().withColumnRenamed("tenant_id", "tenantid")
    rows = rows.withColumn("happened_year", F.date_format("happened_at", "yyyy"))
    write_model(rows, model_path(root, "sales_items"), ["tenantid", "happened_year"])
    stored = read_model(s.spark, root, "sales_items", None, "happened_year", (1994, 2002))
    return shown(
        stored.groupBy("tenantid", "happened_year").agg(
            F.count("*").alias("lines"), F.sum("total_amount").alias("total_amount")
        )
    )


@query("order_csv_roundtrip", ORACLE["order_page_export"])
def order_csv_roundtrip(s):
    export = O.order_page_export(s.tables(), *RANGE, TZ)
    path = write_csv(export, scratch_dir(s.spark, "export"), gzip=True)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in export.schema.fields)
    return shown(read_csv(s.spark, path, schema))


# The SQL of priced reports matches the orders' linked costs once per order name.
for _name in [n for n, sql in ORACLE.items() if "LEFT JOIN fx_order_shipping" in sql]:
    ORACLE[_name] = Q.every_order(ORACLE[_name])
