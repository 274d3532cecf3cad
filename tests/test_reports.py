"""Reports on a tiny store: quirks, policies, order pages."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.timekeys import OWN_ZONE, in_local_range, local_date
from ledgerloom.operators import rollups as R
from ledgerloom.plans import orders as O
from ledgerloom.plans import period as P
from ledgerloom.plans.states import day_states, pnl_from_states, read_day_states, write_day_states
from ledgerloom.plans.tables import StoreTables, in_own_zones, with_zones
from checks import queries
from checks.sample_store import SETTINGS_SQL
from ledgerloom.functions.sales import line_is

AT = datetime.fromisoformat
ORDERS = (
    "order_id string, order_name string, order_created_at timestamp, customer_name string,"
    "customer_email string, tags string, financial_status string, fulfillment_status string,"
    "presentment_currency string, shipping_country string, shipping_city string,"
    "province_code string, province string, first_carrier string, payment_gateways string,"
    "created_year string"
)
SALES = (
    "sale_id string, order_id string, order_name string, order_created_at timestamp,"
    "happened_at timestamp, customer_id string, customer_order_index int, line_type string,"
    "action_type string, quantity int, variant_id string, product_name string, unit_price double,"
    "tax_rate_sum double, discount_before_taxes double, total_tax double, total_amount double,"
    "country_code string, province_code string"
)
DAY = "date string, month string, year string, week string"


def order(n, day, **other):
    base = dict(
        order_id=str(n), order_name=f"#{n}", order_created_at=AT(f"{day} 10:00:00"),
        customer_name=f"Customer {n}", customer_email=None, tags='["a"]', financial_status="PAID",
        fulfillment_status="FULFILLED", presentment_currency="EUR", shipping_country="IE",
        shipping_city="Cork", province_code="D", province="Dublin", first_carrier=None,
        payment_gateways='["card"]', created_year=day[:4],
    )
    return tuple({**base, **other}.values())


def line(n, order_id, day, kind="PRODUCT", action="ORDER", quantity=1, price=10.0, **other):
    amount = quantity * price if kind == "PRODUCT" else price
    base = dict(
        sale_id=f"s{n}", order_id=str(order_id), order_name=f"#{order_id}",
        order_created_at=AT(f"{day} 10:00:00"), happened_at=AT(f"{day} 10:00:00"),
        customer_id=f"c{order_id}", customer_order_index=1, line_type=kind, action_type=action,
        quantity=quantity, variant_id="v1", product_name="Thing", unit_price=price,
        tax_rate_sum=None, discount_before_taxes=0.0, total_tax=0.0, total_amount=amount,
        country_code="IE", province_code="D",
    )
    return tuple({**base, **other}.values())


def ads(day, *values):
    d = date.fromisoformat(day)
    year, week, _ = d.isocalendar()
    return (*values, day, day[:7], day[:4], f"{year}-W{week:02d}")


@pytest.fixture(scope="module")
def store(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    return StoreTables(
        orders=frame(
            [order(1, "2020-01-05"), order(2, "2020-01-06", financial_status="PENDING"),
             order(3, "2020-01-07", tags=None, province=None), order(100, "2020-01-07")],
            ORDERS,
        ),
        sales=frame(
            [
                line(1, 1, "2020-01-05", quantity=2),
                line(2, 1, "2020-01-05", "SHIPPING", price=5.0, variant_id=None),
                line(3, 2, "2020-01-06", customer_order_index=2, discount_before_taxes=1.0),
                line(4, 2, "2020-01-06", customer_order_index=2, discount_before_taxes=1.0),
                line(5, 1, "2020-01-06", action="RETURN", quantity=-1),
                line(6, 100, "2020-01-07", "SHIPPING", price=5.0, variant_id=None),
            ],
            SALES,
        ),
        transactions=frame(
            [("1", AT("2020-01-05 10:00:00"), AT("2020-01-05 11:00:00"), "SALE", None, 2.0, 0.5),
             ("3", AT("2020-01-07 10:00:00"), AT("2020-01-07 11:00:00"), "SALE", None, 4.0, 1.0),
             ("9", AT("2020-03-07 10:00:00"), AT("2020-03-07 11:00:00"), "SALE", None, 8.0, 1.0)],
            "order_id string, order_created_at timestamp, transaction_at timestamp, kind string,"
            "error_code string, amount double, fx_rate double",
        ),
        fulfillments=frame(
            [("1", "#1", AT("2020-01-05 10:00:00"), "f1", 2, AT("2020-01-05 12:00:00")),
             ("3", "#3", AT("2020-01-07 10:00:00"), "f3", 7, AT("2020-01-08 12:00:00"))],
            "order_id string, order_name string, order_created_at timestamp, resource_id string,"
            "total_quantity int, fulfilled_at timestamp",
        ),
        google_ads=frame(
            [ads("2020-01-05", 3000000.0, 4.0, 1.0)],
            f"cost_micros double, clicks double, conversions double, {DAY}",
        ),
        tiktok_ads=frame(
            [ads("2020-01-05", 2.0, 1.0, 1.0), ads("2020-01-06", 2.0, 1.0, 0.0)],
            f"spend double, clicks double, conversion double, {DAY}",
        ),
        meta_ads=frame(
            [ads("2020-01-06", 1.0, 1.0, [("purchase", "2")])],
            "spend double, clicks double, actions array<struct<action_type: string, value: string>>,"
            + DAY,
        ),
        schedule=frame(
            [("1", 31.0, "Monthly", "staff-costs", date(2020, 1, 5), date(2020, 1, 5))],
            "id string, cost double, frequency string, tag string, start_date date, end_date date",
        ),
        product_costs=frame(
            [("v1", 4.0, 0.5)], "variant_id string, product_cost double, packing_fee double"
        ),
        order_shipping=frame([("1", 2.0), ("10", 3.0)], "order_id string, shipping_cost double"),
        shipping_entries=frame(
            [("IE", "D", 7.0, 1.0, 1)],
            "country_code string, region string, shipping_cost double, return_cost double, position long",
        ),
        settings=spark.sql(SETTINGS_SQL),
    )


RANGE = ("2020-01-01", "2020-01-31")


def by_period(df):
    out = {}
    for row in df.collect():
        out.setdefault(row["period"], []).append(row)
    return out


def test_parity_pnl(store):
    got = by_period(P.period_pnl(store, "date", *RANGE))
    assert list(got) == sorted(got, reverse=True)
    # A day with Google rows is one row, any other day one row per source.
    (first,) = got["2020-01-05"]
    assert len(got["2020-01-06"]) == 3
    # Payments follow the years of the range, not the range.
    assert "2020-03-07" in got
    # The shipping line of order 1 matches id 1; cost flags are swapped, so sold cost is 0 here.
    assert first.gross_sales == 20.0 and first.shipping_charges == 5.0
    assert first.product_cost == 0.0 and first.returned_product_cost == 8.0
    assert first.shipping_cost == 2.0 and first.payment_fees == 1.0
    assert first.fulfillment_cost == 3.0 and first.handling_fee == 1.0
    assert first.product_cost_after_toggle == -8.0
    assert first.cogs == -8.0 + 1.0 + 1.0 + 3.0 + 2.0
    assert first.gross_profit == 25.0 - first.cogs
    assert first.staff_cost == 1.0 and first.ad_spend == 5.0 and first.ad_clicks == 5.0
    # No repeat customer: the raw value is NULL, so the profit is 0 and not -COGS.
    assert first.repeat_gross_profit == 0.0
    assert first.contribution_margin == first.net_profit == 25.0 - first.cogs - 5.0 - 1.0
    sales_day = next(r for r in got["2020-01-06"] if r.orders)
    # No fees that day: the sum is NULL and COGS come out as 0.
    assert sales_day.cogs == 0.0
    # Both lines have equal amounts, which the distinct sum counts once.
    assert sales_day.gross_sales == 20.0 and sales_day.repeat_gross_sales == 10.0


def test_corrected_pnl(store):
    got = by_period(P.period_pnl(store, "date", *RANGE, policy="corrected"))
    assert all(len(rows) == 1 for rows in got.values()) and "2020-03-07" not in got
    day = got["2020-01-06"][0]
    assert day.repeat_gross_sales == 20.0
    assert day.product_cost == 8.0 and day.returned_product_cost == -4.0
    assert day.product_cost_after_toggle == 12.0
    assert day.cogs == 12.0 + 1.0 and day.ad_spend == 3.0
    assert day.contribution_margin == (18.0 - 10.0) - 13.0 - 3.0
    # Order 100 holds ids 1 and 10 in its name; exact matching ignores both.
    assert got["2020-01-07"][0].shipping_cost == 7.0


def test_contains_match_counts_a_line_per_linked_id(store):
    day = next(r for r in by_period(P.period_pnl(store, "date", *RANGE))["2020-01-07"] if r.orders)
    assert day.shipping_charges == 10.0 and day.shipping_cost == 5.0 and day.orders == 1


def test_propagating_pnl(store):
    got = by_period(P.period_pnl(store, "date", *RANGE, policy="propagate"))
    assert got["2020-01-05"][0].ad_spend is None
    assert got["2020-01-05"][0].returns_pct == 100.0
    with pytest.raises(ValueError):
        P.period_pnl(store, "date", *RANGE, policy="other")


def test_sales_grain_leaves_other_sources_without_key(store):
    got = by_period(P.period_pnl(store, "variant_id", *RANGE))
    assert len(got["v1"]) == 1 and got["v1"][0].gross_sales == 40.0
    # Google, TikTok, Meta, expenses, payments, shipments and the lines without a variant.
    assert len(got[None]) == 7
    with pytest.raises(ValueError):
        P.period_pnl(store, "order_id; --", *RANGE)


def test_zero_divisors_give_zero(store):
    for row in P.period_pnl(store, "month", *RANGE).collect():
        values = [v for v in row.asDict().values() if isinstance(v, float)]
        assert all(v == v and abs(v) != float("inf") for v in values)


def test_local_day_moves_the_sale(store):
    got = by_period(P.period_pnl(store, "date", *RANGE, tz="Pacific/Kiritimati"))
    assert any(r.orders for r in got["2020-01-06"])
    assert not any(r.orders for r in got["2020-01-05"])


def test_order_page(store):
    page = {}
    for row in O.order_page(store, *RANGE).collect():
        page.setdefault(row.orderId, []).append(row)
    (one,) = page["#1"]
    assert one.paid == 20.0 + 5.0 - 10.0 and one.shipping_cost == 2.0
    # Sold 2 units at 4, returned one: the order page books them as named.
    assert one.productCost == 8.0 - (-4.0)
    assert one.cogs == 12.0 + 1.0 + 1.0 + 3.0 + 2.0
    variants = json.loads(one.variants_json)
    assert [v["quantity"] for v in variants] == [-1, 2] and variants[1]["gross_profit"] == 20 - 16
    assert set(variants[0]) == {
        "id", "lineType", "product", "quantity", "paid", "product_cost", "gross_profit", "gpm",
    }
    # Known to payments and shipments only: one row each, no variants, no COGS.
    assert len(page["#3"]) == 2 and page["#3"][0].variants_json is None
    assert {(r.transactions, r.fulfillment, r.cogs) for r in page["#3"]} == {(4.0, 0, 0), (0, 4.5, 0)}
    assert page["#2"][0].cogs == 0.0


def test_order_page_cut_and_sort_paths_agree(store):
    def ids(**options):
        return [r.orderId for r in O.order_page(store, *RANGE, **options).collect()]

    assert ids(order_by=[("date", "asc")], limit=2) == ["#1", "#2"]
    assert ids(order_by=[("paid", "desc")], limit=2) == ["#2", "#1"]
    assert ids(order_by=[("date", "desc")], limit=2) == ["#100", "#3"]
    assert len(ids(limit=4)) == 4
    with pytest.raises(ValueError):
        ids(order_by=[("paid; DROP", "asc")])
    with pytest.raises(ValueError):
        ids(order_by=[("paid", "up")])


def test_predicates(store):
    def ids(*where):
        return sorted(r.orderId for r in O.order_page_export(store, *RANGE, where=where).collect())

    assert ids(("financial_status", "!=", "PAID")) == ["#2"]
    assert ids(("order_name", "in", ["#1", "#2"]), ("order_id", ">", "1")) == ["#2"]
    assert ids(("tags", "is_null", True)) == ["#3", "#3"]
    assert ids(("order_id", "between", ("1", "2")), ("tags", "like", '%"a"%')) == ["#1", "#100", "#2"]
    with pytest.raises(ValueError):
        ids(("nope", "=", 1))
    with pytest.raises(ValueError):
        ids(("tags", "or 1=1", 1))


def test_summary(store):
    row = O.order_summary(store, *RANGE, "shipping_country").first()
    export = O.order_page_export(store, *RANGE)
    assert row.paid == export.agg(F.sum("paid")).first()[0]
    assert row.gpmargin == pytest.approx(export.agg(F.sum("gpmargin")).first()[0])


def test_any_not_and_membership(store):
    def ids(*where):
        return {r.order_id for r in O.orders_in_range(store, *RANGE, "UTC", where).collect()}

    every = ids()
    some = ids(("order_name", "=", "#1"))
    assert some and some < every
    assert ids(("not", ("order_name", "=", "#1"))) == every - some
    assert ids(("any", [("order_name", "=", "#1"), ("not", ("order_name", "=", "#1"))])) == every
    assert ids(("all", [("order_name", "=", "#1"), ("order_name", "!=", "#1")])) == set()
    assert ids(("any", [])) == set() and ids(("all", [])) == every
    tagged = ids(("tags", "has", "a"))
    assert tagged == ids(("tags", "like", '%"a"%')) and tagged
    with pytest.raises(ValueError):
        ids(("any", [("nope", "=", 1)]))


def test_filters_reach_the_sale_entries(store):
    where = [("order_name", "=", "#1")]
    for frame in (O.order_page_export(store, *RANGE, where=where), O.order_summary(store, *RANGE, "tags", where=where)):
        assert "LeftSemi" in frame._jdf.queryExecution().executedPlan().toString()


def test_order_shipping_is_the_last_lookup(store):
    """It repeats a line for every linked id, and no other lookup is to shuffle the repeats."""
    priced = P.priced_lines(store, P.sale_lines(store, *RANGE, "UTC"))
    plan = priced._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 4 and "_right_order_name" in joins[0] and "_right_order_name" not in "".join(joins[1:])


def test_long_orders_are_one_row(spark, store, rows):
    priced = P.priced_lines(store, P.sale_lines(store, *RANGE, "UTC"))
    copies = F.explode(F.sequence(F.lit(1), F.lit(30)))
    priced = priced.withColumn("quantity", copies).withColumn(
        "sale_id", F.concat("sale_id", F.col("quantity").cast("string"))
    )
    whole = O.order_variants(priced)
    entries = F.from_json("variants_json", "array<struct<id: string, quantity: int, paid: double>>")
    assert whole.count() == whole.select("order_id").distinct().count()
    assert rows(whole.select("order_id", F.inline(entries))) == rows(O.variant_lines(priced), "order_id", "id", "quantity", "paid")


def test_filter_values(store, spark):
    row = O.order_filter_values(store.orders, (2019, 2021)).first()
    assert row.provinces == '["Dublin",null]' and row.tags == '["a"]' and row.cities == '["Cork"]'
    none = O.order_filter_values(store.orders.where("order_id = '3'")).first()
    assert set(none) == {None}
    assert set(O.order_filter_values(store.orders.where("false")).first()) == {None}


def test_top_page_is_cut_before_pricing(store):
    text = O.order_page(store, *RANGE)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "LeftSemi" in text
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_pages_of_many_stores_are_ranked_in_parts_first(store, spark):
    orders = store.orders.withColumn("tenant_id", F.concat(F.lit("t"), F.col("order_id")))
    cut = O._cut(orders, [F.col("order_name").asc()], 2000, ["tenant_id"])
    assert cut._jdf.queryExecution().executedPlan().toString().count("Window [row_number()") == 2
    assert cut.count() == 4
    first = O._cut(orders.withColumn("tenant_id", F.lit("t")), [F.col("order_name").asc()], 2, ["tenant_id"])
    names = sorted(r.order_name for r in orders.collect())
    assert sorted(r.order_name for r in first.collect()) == names[:2]


# ------------------------------------------------------------------ a zone per store

EDGES = ["2018-11-03", "2018-11-04", "2018-11-05", "2020-03-07", "2020-03-08", "2020-03-09", "2020-11-01", "2020-11-02", "2020-04-05", "2020-10-04"]
ZONES = ["America/New_York", "America/Sao_Paulo", "America/Havana", "Australia/Lord_Howe", "Asia/Kolkata", "Pacific/Kiritimati", "Atlantic/Azores", None]


def test_bounds_of_own_zones_cut_as_local_dates_do(spark):
    """Midnights that don't exist, or come twice, included."""
    instants = spark.sql("SELECT explode(sequence(timestamp '2018-11-01', timestamp '2018-11-08', interval 15 minutes)) AS ts").unionAll(
        spark.sql("SELECT explode(sequence(timestamp '2020-02-28', timestamp '2020-11-10', interval 15 minutes)) AS ts")
    )
    zones = spark.createDataFrame([(f"s{i}", z) for i, z in enumerate(ZONES)], "tenant_id string, time_zone string")
    rows = instants.crossJoin(zones.select("tenant_id")).unionByName(instants.withColumn("tenant_id", F.lit("no settings")))
    settings = spark.sql(SETTINGS_SQL).crossJoin(zones.select("tenant_id"))
    empty = {name: rows.withColumnRenamed("ts", "at") for name in ("orders", "transactions", "fulfillments")}
    rest = dict.fromkeys(("google_ads", "tiktok_ads", "meta_ads", "schedule", "product_costs", "order_shipping", "shipping_entries"), rows)
    t = with_zones(StoreTables(sales=rows, settings=settings, scope=("tenant_id",), **empty, **rest), zones)
    wrong = None
    for day in EDGES:
        own = in_own_zones(t, OWN_ZONE, day, day).sales
        kept = own.withColumn("bounds", in_local_range("ts", OWN_ZONE, day, day))
        zone = F.create_map(*[F.lit(x) for i, z in enumerate(ZONES) for x in (f"s{i}", z or "UTC")], F.lit("no settings"), F.lit("UTC"))
        dated = local_date("ts", zone[F.col("tenant_id")]).cast("string") == day
        bad = kept.where(F.col("bounds") != dated).select("tenant_id", "ts")
        wrong = bad if wrong is None else wrong.unionAll(bad)
    assert wrong.take(3) == []


def test_one_store_in_its_own_zone(store, spark):
    zones = spark.createDataFrame([("America/New_York",)], "time_zone string")
    own = with_zones(store, zones)
    for tz in (OWN_ZONE, "America/New_York"):
        got = P.period_pnl(own if tz == OWN_ZONE else store, "date", "2020-01-05", "2020-01-06", tz, "corrected").collect()
        page = O.order_page(own if tz == OWN_ZONE else store, "2020-01-05", "2020-01-06", tz).collect()
        if tz == OWN_ZONE:
            first = got, page
    assert first == (got, page) and got and page
    with pytest.raises(ValueError, match="time_zone"):
        P.period_pnl(store, "date", *RANGE, OWN_ZONE)


def test_own_zones_reach_the_scan(store, spark, tmp_path):
    store.sales.write.parquet(f"{tmp_path}/sales")
    own = with_zones(replace(store, sales=spark.read.parquet(f"{tmp_path}/sales")), spark.createDataFrame([("Asia/Kolkata",)], "time_zone string"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = P.sale_lines(own, *RANGE, OWN_ZONE)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    (pushed,) = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert "GreaterThanOrEqual(happened_at,2019-12-31" in pushed and "LessThan(happened_at,2020-02-02" in pushed, pushed


# ------------------------------------------------------------------ grouped export


def test_a_grouping_never_sums_a_ratio(store):
    t = replace(store, orders=store.orders.withColumn("customer_id", F.when(F.col("order_id") != "3", F.lit("c"))))
    single = O.order_export_grouped(t, *RANGE, ["orderId"]).collect()
    (whole,) = O.order_export_grouped(t, *RANGE, []).collect()
    assert len(single) == t.orders.count() == whole.orders and whole.customers == 1
    for name in O.ADDITIVE:
        assert whole[name] == pytest.approx(sum(r[name] for r in single))
    assert whole.gpmargin == pytest.approx(whole.gross_profit / whole.net * 100)
    assert whole.gpmargin != pytest.approx(sum(r.gpmargin for r in single))
    page = {r.orderId: r for r in O.order_page_export(t, *RANGE).collect() if r.paid}
    assert page and all(r.gpmargin == pytest.approx(page[r.orderId].gpmargin) for r in single if r.orderId in page)
    some = O.order_export_grouped(t, *RANGE, ["month", "province"], where=[("order_id", "!=", "1")], order_by=[("paid", "desc")], measures=["paid", "orders"])
    assert some.columns == ["month", "province", "paid", "orders"]
    assert sum(r.orders for r in some.collect()) == whole.orders - 1
    assert O.order_export_grouped(t, "1999-01-01", "1999-01-02", ["month"]).collect() == []
    for bad in ({"group_by": ["nothing"]}, {"group_by": [], "measures": ["nothing"]}):
        with pytest.raises(ValueError, match="unknown"):
            O.order_export_grouped(t, *RANGE, **bad)


# ------------------------------------------------------------------ daily states


@pytest.mark.parametrize("policy", ["parity", "corrected"])
def test_periods_are_merged_from_stored_days(store, spark, tmp_path, policy):
    """Days written in parts, one of them twice, give every grain; sale entries are not at hand any more."""
    root = str(tmp_path)
    for span in (("2019-01-01", "2020-01-05"), ("2020-01-06", "2020-12-31"), ("2020-01-06", "2020-01-06")):
        write_day_states(day_states(store, *span, policy=policy), root, *span)
    states = read_day_states(spark, root)
    gone = replace(store, sales=None, transactions=None, fulfillments=None)
    for grain in ("date", "week", "month", "year"):
        got = pnl_from_states(states, gone, grain, *RANGE, policy).collect()
        expected = P.period_pnl(store, grain, *RANGE, policy=policy).collect()
        assert len(got) == len(expected) > 0
        for a, b in zip(sorted(got, key=repr), sorted(expected, key=repr), strict=True):
            assert a.asDict() == pytest.approx(b.asDict(), nan_ok=True)
    assert pnl_from_states(states, gone, "month", "2019-12-31", "2020-01-05", policy).count() == P.period_pnl(store, "month", "2019-12-31", "2020-01-05", policy=policy).count()
    kept = states.sums.select("date").distinct().collect()
    assert {r.date for r in kept} == {r.date for r in day_states(store, "2019-01-01", "2020-12-31", policy=policy).sums.select("date").collect()}


def test_shipping_queries_look_up_shipping_entries_alone(store, monkeypatch):
    """Other lines are left out before the lookups, and the rows are those of pricing all lines."""
    span = ("2020-01-01", "2020-12-31")
    every = P.priced_lines(store, P.sale_lines(store, *span, "UTC")).where(line_is("SHIPPING"))
    expected = sorted((r.sale_id, r.linked_order_id or "") for r in every.collect())
    seen, price = [], P.price_lines
    monkeypatch.setattr(queries, "RANGE", span)
    monkeypatch.setattr(P, "price_lines", lambda items, *a, **options: seen.append(items) or price(items, *a, **options))
    for build in (queries.shipping_decision, queries.return_shipping):
        got = build(SimpleNamespace(tables=lambda: store)).collect()
        assert expected and sorted((r.sale_id, r.linked_order_id or "") for r in got) == expected
    assert [{r.line_type for r in items.collect()} for items in seen] == [{"SHIPPING"}] * 2


def linked_store(store, spark):
    """Orders whose names hold several ids, some twice or without a cost; lines of all kinds; no region for some."""
    days = ("2020-01-05", "2020-01-06", "2020-01-07")
    kinds = [("PRODUCT", "ORDER"), ("SHIPPING", "ORDER"), ("SHIPPING", "RETURN"), ("PRODUCT", "RETURN"), ("GIFT_CARD", "ORDER")]
    sales = [
        line(100 * n + k, n, days[k % 3], kind, action, quantity=k + 1, price=10.1 * (n % 7) + k / 3, total_tax=0.1 * k, tax_rate_sum=0.07,
             country_code="IE" if n % 3 else "DE", variant_id="v1" if k % 2 else None, order_name=f"#{n}" if n != 13 else None)
        for n in range(1, 40) for k, (kind, action) in enumerate(kinds)
    ]
    ids = [(str(n), n / 7 if n % 4 else None) for n in range(1, 25)] + [("1", 0.1), ("2", None), ("%3", 1.25), (None, 9.0)]
    return replace(
        store,
        sales=spark.createDataFrame(sales, SALES),
        order_shipping=spark.createDataFrame(ids, "order_id string, shipping_cost double"),
        product_costs=spark.createDataFrame([("v1", 4.0, 0.5), ("v1", 5.0, None)], "variant_id string, product_cost double, packing_fee double"),
    )


@pytest.mark.parametrize("options", [{}, {"shipping_match": "exact", "shipping_fallback": "charge"}, {"shipping_fallback": "entry", "swapped_cost_flags": True}])
@pytest.mark.parametrize("unset", [False, True])
def test_counted_lines_sum_to_what_their_repeats_do(store, spark, rows, options, unset):
    t = linked_store(store, spark)
    if unset:
        t = replace(t, settings=t.settings.withColumns({c: F.lit(None).cast("double") for c in ("shipping_margin", "margin_pct")}))
    lines = P.sale_lines(t, *RANGE, "UTC")
    counted, repeated = (P.priced_lines(t, lines, counted=c, **options) for c in (True, False))
    for keys in (["date"], ["order_id"], []):
        assert rows(R.plain_sums(counted, keys)) == rows(R.plain_sums(repeated, keys))
    assert rows(R._segment_sums(counted, ["date"])) == rows(R._segment_sums(repeated, ["date"]))
    assert rows(O.order_variants(counted)) == rows(O.order_variants(repeated))
    assert rows(O.variant_lines(counted)) == rows(O.variant_lines(repeated))


def test_reports_do_not_repeat_lines_for_linked_ids(store, spark, monkeypatch):
    """What is looked up is a row for each name, and no line is copied for its ids."""
    t, seen = linked_store(store, spark), []
    price = P.price_lines
    monkeypatch.setattr(P, "price_lines", lambda items, *a, **options: seen.append((items, price(items, *a, **options))) or seen[-1][1])
    P.period_pnl(t, "month", *RANGE)
    O.order_totals(t, "month", *RANGE)
    O.order_summary(t, *RANGE, "province")
    assert len(seen) == 3
    for items, priced in seen:
        # each line of v1 has two costs
        assert priced.count() == items.count() + items.where("variant_id = 'v1'").count()


def test_a_linked_cost_too_large_is_an_error_only_where_it_is_summed(store, spark):
    for cost in (float("nan"), 1e300):
        ids = spark.createDataFrame([("2", cost)], "order_id string, shipping_cost double")
        t = replace(store, order_shipping=ids)
        assert P.period_pnl(t, "date", *RANGE).count()
        with pytest.raises(Exception, match="too large"):
            P.period_pnl(replace(t, order_shipping=ids.withColumn("order_id", F.lit("1"))), "date", *RANGE).collect()


def test_sale_ids_and_fields_are_not_shuffled_by_lookups(store, spark):
    t = linked_store(store, spark)
    sums = R.plain_sums(P.priced_lines(t, P.sale_lines(t, *RANGE, "UTC"), counted=True), ["date"])
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join LeftOuter"):]
    assert "sale_id" not in below.split("LogicalRDD")[0] and "profit_net_sales" not in below


def test_variant_texts_are_parsed_once(store, spark):
    page = O.order_variants(P.priced_lines(store, P.sale_lines(store, *RANGE, "UTC"), counted=True))
    plan = queries._with_variant_check(page)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
