"""Hand cases of the column expressions."""

from __future__ import annotations

import math
import random
from datetime import date, datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import costs as C
from ledgerloom.functions import lists, numbers
from ledgerloom.functions import timekeys as T
from ledgerloom.functions.numbers import exact_sum, sums
from ledgerloom.functions.sales import original_order_flag, with_sale_fields

SALE = (
    "line_type string, action_type string, quantity int, unit_price double, total_tax double,"
    "tax_rate_sum double, discount_before_taxes double, total_amount double"
)


def one(df, *columns):
    return tuple(df.select(*columns).first())


def sale(spark, *values):
    return with_sale_fields(spark.createDataFrame([values], SALE))


def test_sold_product(spark):
    row = sale(spark, "PRODUCT", "ORDER", 2, 11.0, 2.0, 0.1, 3.0, 19.0)
    assert one(row, "gross_sales", "total_discounts", "net_items") == (
        pytest.approx(20.0), 3.0, 2,
    )
    assert one(row, "net_sales", "total_sales") == (pytest.approx(17.0), pytest.approx(19.0))


def test_returned_product_counts_as_return_only(spark):
    row = sale(spark, "PRODUCT", "RETURN", -1, 11.0, -1.0, 0.1, 3.0, -11.0)
    assert one(row, "gross_sales", "product_discounts", "returns", "net_items") == (0, 0, -10, -1)


def test_shipping_line(spark):
    row = sale(spark, "SHIPPING", "ORDER", 1, 5.0, 1.0, 0.2, 0.5, 6.0)
    assert one(row, "gross_sales", "shipping_charges", "shipping_discounts", "net_items") == (
        0, 5.0, 0.5, 0,
    )
    assert one(row, "net_sales", "profit_net_sales") == (0, 5.0)


def test_gift_card_discount_is_a_product_discount(spark):
    row = sale(spark, "GIFT_CARD", "ORDER", 1, 5.0, 0.0, None, 0.5, 5.0)
    assert one(row, "gross_sales", "product_discounts", "net_items") == (0, 0.5, 1)


def test_missing_amounts_default_to_zero(spark):
    row = sale(spark, "PRODUCT", "ORDER", None, None, None, None, None, None)
    assert one(row, "gross_sales", "total_discounts", "taxes", "total_sales") == (0, 0, 0, 0)


def test_rate_of_minus_one_does_not_fail(spark):
    row = sale(spark, "PRODUCT", "ORDER", 1, 5.0, 1.0, -1.0, 0.0, 5.0)
    assert one(row, "gross_sales") == (0,)


COSTED = (
    "line_type string, action_type string, quantity int, unit_price double, total_tax double,"
    "tax_rate_sum double, variant_id string, cost_variant_id string, variant_cost double,"
    "packing_fee double, margin_pct double"
)


@pytest.mark.parametrize(
    ("variant", "found", "cost", "margin", "expected"),
    [
        (None, None, None, 40.0, 6.0),  # no variant
        ("1", None, None, 40.0, 6.0),  # variant unknown
        ("1", "1", None, 40.0, 6.0),  # cost missing
        ("1", "1", 0.0, 40.0, 6.0),  # cost zero
        ("1", "1", -2.0, 40.0, 6.0),
        ("1", "1", 3.5, 40.0, 3.5),
        ("1", "1", 0.0, None, 10.0),  # no margin to fall back on
        ("1", "1", 3.5, None, 3.5),
        (None, None, None, None, 10.0),
    ],
)
def test_unit_product_cost(spark, variant, found, cost, margin, expected):
    row = ("PRODUCT", "ORDER", 2, 10.0, 0.0, None, variant, found, cost, 0.7, margin)
    df = spark.createDataFrame([row], COSTED).withColumn("p", C.unit_price_ex_tax())
    unit = C.unit_product_cost(F.col("p"))
    assert one(df, unit)[0] == pytest.approx(expected)
    assert one(df, C.extended_cost(unit, False))[0] == pytest.approx(2 * expected)
    assert one(df, C.extended_cost(unit, True))[0] == 0
    assert one(df, C.unit_handling_fee())[0] == (0.7 if variant else 0)


SHIPPED = (
    "line_type string, action_type string, linked_shipping double, region_shipping double,"
    "everywhere_shipping double, default_shipping double, shipping_charges double,"
    "region_return double, everywhere_return double, default_return double,"
    "region_found boolean, everywhere_found boolean"
)


def shipped(spark, **values):
    base = dict(
        line_type="SHIPPING", action_type="ORDER", linked_shipping=None, region_shipping=None,
        everywhere_shipping=None, default_shipping=None, shipping_charges=9.0, region_return=None,
        everywhere_return=None, default_return=None, region_found=False, everywhere_found=False,
    )
    return spark.createDataFrame([tuple({**base, **values}.values())], SHIPPED)


@pytest.mark.parametrize(
    ("values", "plain", "charged", "by_entry"),
    [
        ({}, None, 9.0, 9.0),
        ({"default_shipping": 4.0}, 4.0, 4.0, 4.0),
        ({"everywhere_shipping": 3.0, "everywhere_found": True, "default_shipping": 4.0}, 3, 3, 3),
        ({"region_found": True, "default_shipping": 4.0}, 4.0, 4.0, None),
        ({"linked_shipping": 1.0, "region_shipping": 2.0, "region_found": True}, 1, 1, 1),
        ({"line_type": "PRODUCT", "linked_shipping": 1.0}, 0, 0, 0),
        ({"action_type": "RETURN", "linked_shipping": 1.0}, 0, 0, 0),
    ],
)
def test_shipping_cost(spark, values, plain, charged, by_entry):
    df = shipped(spark, **values)
    candidates = C.shipping_candidates()
    assert one(
        df,
        C.shipping_cost(candidates).alias("a"),
        C.shipping_cost(candidates, True).alias("b"),
        C.shipping_cost_by_entry().alias("c"),
    ) == (plain, charged, by_entry)


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ({}, 0),
        ({"default_return": 2.0}, 0),  # only counts when a shipping default is set
        ({"default_return": 2.0, "default_shipping": 1.0}, 2.0),
        ({"region_found": True, "region_return": 5.0}, 5.0),
        ({"everywhere_found": True, "everywhere_return": 6.0}, 6.0),
    ],
)
def test_return_shipping(spark, values, expected):
    df = shipped(spark, action_type="RETURN", **values)
    assert one(df, C.return_shipping_cost(True).alias("a"), C.return_shipping_cost().alias("b")) == (
        expected, 0,
    )
    sold = shipped(spark, **values)
    assert one(sold, C.return_shipping_cost(True)) == (0,)


def test_first_of_overlapping_tiers(spark):
    tiers = F.expr(
        "array(named_struct('min_units', 0, 'max_units', 5, 'fulfillment_base', 1D,"
        "'fulfillment_additional', 0.5D, 'packaging_base', 2D, 'packaging_additional', 0.25D),"
        "named_struct('min_units', 5, 'max_units', 9, 'fulfillment_base', 7D,"
        "'fulfillment_additional', 7D, 'packaging_base', 7D, 'packaging_additional', 7D))"
    )
    df = spark.createDataFrame([(5,), (9,), (10,)], "total_quantity int")
    costs = df.select("total_quantity", *[c.alias(n) for n, c in C.fulfillment_costs(tiers).items()])
    got = {r.total_quantity: r for r in costs.collect()}
    assert (got[5].packaging_cost, got[5].fulfillment_only_cost, got[5].fulfillment_cost) == (3, 3, 3)
    assert got[9].fulfillment_cost == 14
    assert got[10].fulfillment_cost is None


@pytest.mark.parametrize(
    ("frequency", "day", "expected"),
    [
        ("Monthly", "2020-02-03", 290 / 29),
        ("Monthly", "2021-02-03", 290 / 28),
        ("Weekly", "2020-02-03", 290 / 7),
        ("Yearly", "2020-02-03", 290 / 365),
        ("Daily", "2020-02-03", 290),
        ("Just Once", "2020-02-01", 290),
        ("Just Once", "2020-02-02", None),
        ("Quarterly", "2020-02-02", None),
    ],
)
def test_daily_cost(spark, frequency, day, expected):
    df = spark.createDataFrame(
        [(290.0, frequency, date(2020, 2, 1), date.fromisoformat(day))],
        "cost double, frequency string, start_date date, day date",
    )
    got = one(df, C.daily_cost(F.col("day")))[0]
    assert got is None if expected is None else got == pytest.approx(expected)


def test_toggle(spark):
    df = spark.createDataFrame([(None,), (False,), (True,)], "t boolean")
    got = df.select(C.toggled_product_cost(F.col("t"), F.lit(10.0), F.lit(3.0))).collect()
    assert [r[0] for r in got] == [10.0, 10.0, 7.0]


def test_tax_rates(spark):
    df = spark.createDataFrame(
        [([("0.1",), ("0.05",)],), ([],), (None,), ([(None,)],), ([(None,), ("0.2",)],)],
        "lines array<struct<rate: string>>",
    )
    got = [r[0] for r in df.select(lists.tax_rate_sum(F.col("lines"))).collect()]
    assert got == [pytest.approx(0.15), None, None, None, 0.2]


def test_purchase_conversions(spark):
    df = spark.createDataFrame(
        [([("purchase", "2"), ("view", "9"), ("purchase", "1.5")],), ([("view", "9")],), (None,)],
        "actions array<struct<action_type: string, value: string>>",
    )
    got = [r[0] for r in df.select(lists.purchase_conversions(F.col("actions"))).collect()]
    assert got == [3.5, None, None]


def test_ratio_and_rounding(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(numbers.ratio_or_zero(a, b)).collect()] == [0.0, 0.25, 0.0]
    values = spark.createDataFrame([(2.345,), (-2.345,), (2.3449,), (1e9 + 0.125,)], "x double")
    got = [r[0] for r in values.select(numbers.half_up(F.col("x"), 2)).collect()]
    assert got == [2.35, -2.34, 2.34, 1e9 + 0.13]


def instants(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return df.select(F.col("t").cast("timestamp").alias("ts"))


def test_iso_week_of_the_53rd_week(spark):
    df = instants(spark, "2020-12-31 12:00:00", "2021-01-03 12:00:00", "2021-01-04 00:00:00")
    got = T.with_period_keys(df, "ts", "UTC").select("week", "year").collect()
    assert [tuple(r) for r in got] == [("2020-W53", "2020"), ("2020-W53", "2021"), ("2021-W01", "2021")]


def test_local_keys_at_the_turn_of_the_year(spark):
    df = instants(spark, "2020-12-31 19:00:00")
    assert one(T.with_period_keys(df, "ts", "Asia/Kolkata"), "date", "month", "year") == (
        "2021-01-01", "2021-01", "2021",
    )
    assert one(T.with_period_keys(df, "ts", "America/New_York"), "date") == ("2020-12-31",)


def test_zone_per_row(spark):
    df = instants(spark, "2020-12-31 19:00:00").withColumn("tz", F.lit("Asia/Kolkata"))
    assert one(df, T.local_date("ts", F.col("tz")).cast("string")) == ("2021-01-01",)


def test_local_range_edges(spark):
    df = instants(
        spark, "2020-12-31 18:29:59", "2020-12-31 18:30:00", "2021-01-31 18:29:59",
        "2021-01-31 18:30:00",
    )
    kept = df.where(T.in_local_range("ts", "Asia/Kolkata", "2021-01-01", "2021-01-31"))
    assert kept.count() == 2
    far = instants(spark, "2021-01-01 13:59:00", "2020-12-31 10:00:00")
    assert far.where(T.in_local_range("ts", "Pacific/Kiritimati", "2021-01-01", "2021-01-01")).count() == 1


def test_utc_helpers(spark):
    df = instants(spark, "2020-02-09 03:00:00")
    parts = T.utc_parts("ts", "created")
    assert one(df, *[c.alias(n) for n, c in parts.items()]) == ("2020", "02", "09")
    assert one(df, T.days_in_month("ts")) == (29,)
    assert T.utc_years("2021-01-01", "2021-12-31") == (2020, 2022)
    with pytest.raises(ValueError):
        T.grain_column("1; DROP TABLE x")


def test_original_order_flag(spark):
    at = datetime(2020, 1, 1)
    rows = [
        ("PRODUCT", "ORDER", at, datetime(2020, 1, 1, 0, 0, 30)),
        ("PRODUCT", "ORDER", at, datetime(2020, 1, 1, 0, 0, 31)),
        ("PRODUCT", "RETURN", at, at),
        ("GIFT_CARD", "ORDER", at, at),
        ("SHIPPING", "ORDER", at, at),
    ]
    df = spark.createDataFrame(
        rows, "line_type string, action_type string, order_created_at timestamp, happened_at timestamp"
    )
    assert [r[0] for r in df.select(original_order_flag()).collect()] == [1, 0, 0, 0, 0]


def test_exact_sums_do_not_depend_on_order(spark):
    """Any order and partitioning gives the same double, the one nearest to the true sum."""
    rng = random.Random(4)
    values = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-3, 11) for _ in range(5000)]
    values += [-v for v in values[:4000]] + [0.1] * 10 + [None] * 5
    truth = float(sum(Fraction(v) for v in values if v is not None))
    found = set()
    for seed in range(4):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(1 + 3 * seed)
        row = df.agg(exact_sum(F.col("x")).alias("s"), exact_sum(F.when(F.lit(False), F.col("x"))).alias("none")).first()
        assert row.none is None
        found.add(row.s)
    assert len(found) == 1 and abs(found.pop() - truth) <= 9000 * 2**-45 + 2 * math.ulp(truth)
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.createDataFrame([(1e300,)], "x double").agg(exact_sum(F.col("x"))).collect()
    whole = spark.createDataFrame([(1, 1.5), (2, 2.5)], "n int, x double")
    assert whole.agg(*sums(whole, {"n": F.col("n"), "x": F.col("x")})).first() == (3, 4.0)
