"""Operators against brute force on small inputs, and the shape of their plans."""

from __future__ import annotations

import fnmatch
import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lookups as L
from ledgerloom.operators import rollups as R
from ledgerloom.operators.ingest_settings import shipping_by_country_model
from ledgerloom.operators.merge import merge_by_key
from ledgerloom.operators.pricing import daily_ledger
from ledgerloom.session import BROADCAST_KEYS, BROADCAST_LIMIT, UNPACKED_FACTOR, UNPACKED_KEY, configure


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def like(text: str, pattern: str) -> bool:
    """SQL LIKE without an escape character."""
    quoted = "".join(
        {"%": "*", "_": "?"}.get(c, f"[{c}]" if c in "*?[" else c) for c in pattern
    )
    return fnmatch.fnmatchcase(text, quoted)


ITEMS = "order_id string, sale_id string, order_name string"
SHIP = "order_id string, shipping_cost double"


def test_contains_join_matches_brute_force(spark, rows):
    rng = random.Random(7)
    letters = "0012_%\\#a"
    names = ["".join(rng.choices("#012a_%\\", k=rng.randint(0, 6))) for _ in range(300)]
    ids = ["".join(rng.choices(letters, k=rng.randint(0, 3))) for _ in range(60)] + ["%", "_", ""]
    items = [(str(i), str(i), n) for i, n in enumerate(names)] + [("n", "n", None)]
    ship = [(x, float(i)) for i, x in enumerate(ids)] + [(None, 5.0)]
    got = L.with_order_shipping(
        spark.createDataFrame(items, ITEMS), spark.createDataFrame(ship, SHIP)
    )
    expected = []
    for order, sale, name in items:
        hits = [(x, c) for x, c in ship if x is not None and name is not None
                and like(name, f"%{x}%")]
        for x, c in hits or [(None, None)]:
            expected.append((order, sale, name, x, c))
    assert rows(got) == sorted(expected, key=repr)


def test_contains_join_keeps_lookup_duplicates_and_needs_no_nested_loop(spark, rows):
    items = spark.createDataFrame([("1", "a", "#1001"), ("2", "b", "#7")], ITEMS)
    ship = spark.createDataFrame([("100", 1.0), ("1001", 2.0), ("100", 3.0)], SHIP)
    got = L.with_order_shipping(items, ship)
    assert rows(got, "sale_id", "linked_shipping") == [
        ("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", None),
    ]
    matches = plan(L.order_name_matches(items, ship)) + plan(got)
    assert "NestedLoop" not in matches and "Cartesian" not in matches


def test_broadcast_threshold_is_capped_and_a_lower_one_kept(spark):
    """The driver holds what is broadcast, so a session's small limit isn't raised."""
    key = BROADCAST_KEYS[0]
    before = spark.conf.get(key)
    try:
        for given, kept in (("256k", "256k"), ("-1", "-1"), ("32m", str(BROADCAST_LIMIT))):
            spark.conf.set(key, given)
            configure(spark)
            assert spark.conf.get(key) == kept
    finally:
        spark.conf.set(key, before)


def test_broadcast_threshold_is_capped_where_the_session_sets_none(spark):
    """Spark's default is ten times the cap; a session that leaves it alone doesn't keep it."""
    key = BROADCAST_KEYS[0]
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        configure(spark)
        assert spark.conf.get(key) == str(BROADCAST_LIMIT)
    finally:
        spark.conf.set(key, before)


def test_a_file_counts_by_what_it_unpacks_to(spark, tmp_path):
    """Numbers as text are small as a file; the driver would hold each as a row of a broadcast side."""
    path, keys = str(tmp_path / "ids"), (*BROADCAST_KEYS, UNPACKED_KEY)
    spark.range(150_000).selectExpr("CAST(id AS string) AS order_id").coalesce(1).write.option("compression", "zstd").parquet(path)
    size = sum(p.stat().st_size for p in (tmp_path / "ids").glob("*.parquet"))
    before = {key: spark.conf.get(key) for key in keys}
    lines = spark.range(1_000_000).selectExpr("CAST(id AS string) AS order_id")
    try:
        spark.conf.set(BROADCAST_KEYS[0], str(2 * size))
        for given, kept in (("1.0", str(UNPACKED_FACTOR)), ("20.0", "20.0")):
            spark.conf.set(UNPACKED_KEY, given)
            configure(spark)
            assert spark.conf.get(UNPACKED_KEY) == kept
            assert "Broadcast" not in plan(lines.join(spark.read.parquet(path), "order_id"))
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_ids_that_every_name_holds_are_spread(spark):
    """With `1` and `%` among the ids, no task of the join has much more than the others."""
    names = spark.range(20_000).selectExpr("concat('#1', id) AS order_name")
    ids = spark.createDataFrame([("1", 1.0), ("%", 2.0), ("_", 3.0)] + [(str(10_000 + i), 4.0) for i in range(3000)], SHIP)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = L.order_name_matches(names, ids).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("task").count().collect()]
        hits = {r.linked_order_id: r["count"] for r in joined.where("length(linked_order_id) = 1").groupBy("linked_order_id").count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert hits == {"1": 20_000, "%": 20_000, "_": 20_000}
    assert len(sizes) == 16 and max(sizes) < 2.5 * sorted(sizes)[8]


def test_long_ids_match_brute_force(spark, rows):
    """Short and long runs are joined apart; together they are what LIKE finds."""
    rng = random.Random(11)
    names = sorted({"#" + "".join(rng.choices("012", k=rng.randint(3, 9))) for _ in range(200)})
    ids = ["".join(rng.choices("012", k=rng.randint(1, 7))) for _ in range(200)]
    ids += ["".join(rng.choices("012%_", k=rng.randint(4, 9))) for _ in range(60)] + ["#0", "%01201", ""]
    ship = [(x, float(i)) for i, x in enumerate(ids)]
    got = L.order_name_matches(spark.createDataFrame([(n,) for n in names * 2], "order_name string"), spark.createDataFrame(ship, SHIP))
    expected = [(n, x, c) for n in names for x, c in ship if like(n, f"%{x}%")]
    assert rows(got) == sorted(expected, key=repr)


def test_equal_wildcard_ids_are_verified_once(spark, rows, monkeypatch):
    """Each of their rows still matches, with its own cost, null or not; they count once for what is broadcast."""
    monkeypatch.setattr(L, "SHORT_IDS", 3)
    names = spark.createDataFrame([("#1203",), ("#1034",), ("#77",)], "order_name string")
    ship = [("1%3", float(i)) for i in range(40)] + [("1%3", None), ("1%3", 5.0), ("_77", 1.0), ("7", 2.0), ("7", 2.0)]
    got = L.order_name_matches(names, spark.createDataFrame(ship, SHIP))
    expected = [(n, x, c) for n in ("#1203", "#1034", "#77") for x, c in ship if like(n, f"%{x}%")]
    assert len(expected) == 87 and rows(got) == sorted(expected, key=repr)
    ids = spark.createDataFrame([s for s in ship if "%" in s[0]], SHIP)
    assert "BroadcastHashJoin" in plan(L.order_name_matches(names, ids)) and rows(L.order_name_matches(names, ids)) == sorted([e for e in expected if "%" in e[1]], key=repr)
    monkeypatch.setattr(L, "SHORT_COSTS", 41)
    assert rows(L.order_name_matches(names, ids)) == sorted([e for e in expected if "%" in e[1]], key=repr)


def test_short_ids_are_broadcast_when_all_ids_are_too_many(spark):
    """Most pieces of a name are short; they aren't shuffled because of the many long ids."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        names = spark.range(20_000).selectExpr("concat('#', 500000 + id) AS order_name")
        ids = spark.range(60_000).selectExpr("CAST(id * 9 AS string) AS order_id", "rand(1) AS shipping_cost")
        joins = plan(L.order_name_matches(names, ids))
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in joins and "SortMergeJoin" in joins


def test_contains_join_without_ids(spark):
    items = spark.createDataFrame([("1", "a", "#1001")], ITEMS)
    got = L.with_order_shipping(items, spark.createDataFrame([], SHIP)).first()
    assert got.linked_shipping is None


def test_contains_join_stays_within_a_store(spark, rows):
    items = spark.createDataFrame(
        [("A", "1", "a", "#10"), ("B", "1", "b", "#10")], f"tenant_id string, {ITEMS}"
    )
    ship = spark.createDataFrame([("B", "10", 4.0)], f"tenant_id string, {SHIP}")
    got = L.with_order_shipping(items, ship, ["tenant_id"])
    assert rows(got, "sale_id", "linked_shipping") == [("a", None), ("b", 4.0)]


def test_exact_match(spark, rows):
    items = spark.createDataFrame([("1", "a", "#1001"), ("2", "b", "100"), ("3", "c", None)], ITEMS)
    ship = spark.createDataFrame([("100", 1.0), ("1001", 2.0)], SHIP)
    got = L.with_order_shipping(items, ship, method="exact")
    assert rows(got, "sale_id", "linked_order_id", "linked_shipping") == [
        ("a", "1001", 2.0), ("b", "100", 1.0), ("c", None, None),
    ]
    with pytest.raises(ValueError):
        L.with_order_shipping(items, ship, method="other")


def product_items(spark, variants):
    data = [(str(i), str(i), v) for i, v in enumerate(variants)]
    return spark.createDataFrame(data, "order_id string, sale_id string, variant_id string")


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_product_costs_shuffled_and_broadcast(spark, rows, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        items = product_items(spark, ["1", "2", None, "1", "none-5", None])
        costs = spark.createDataFrame(
            [("1", 2.0, 0.1), ("1", 3.0, None), (None, 9.0, 9.0), ("3", 4.0, 0.3)],
            "variant_id string, product_cost double, packing_fee double",
        )
        got = L.with_product_costs(items, costs)
        assert rows(got, "sale_id", "cost_variant_id", "variant_cost") == sorted(
            [("0", "1", 2.0), ("0", "1", 3.0), ("1", None, None), ("2", None, None),
             ("3", "1", 2.0), ("3", "1", 3.0), ("4", None, None), ("5", None, None)],
            key=repr,
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines_without_variant_are_spread_over_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        items = product_items(spark, [None] * 4000)
        costs = spark.createDataFrame(
            [("1", 2.0, 0.1)], "variant_id string, product_cost double, packing_fee double"
        )
        joined = L.with_product_costs(items, costs)
        sizes = [r[0] for r in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_region_shipping_first_entry_and_list_form(spark, rows):
    entries = spark.createDataFrame(
        [("Ireland", "D", "IE", 5.0, 1.0, 2), ("Ireland", "D", "IE", 4.0, 2.0, 1),
         ("Ireland", "All Regions", "IE", 9.0, None, 3), ("France", "P", "FR", None, 3.0, 4)],
        "country_name string, region string, country_code string, shipping_cost double,"
        "return_cost double, position long",
    )
    items = spark.createDataFrame(
        [("1", "IE", "D"), ("2", "IE", "C"), ("3", "FR", "P"), ("4", None, "D"), ("5", "IE", None),
         ("6", "XX", "D")],
        "order_id string, country_code string, province_code string",
    )
    columns = ["order_id", "region_shipping", "region_return", "region_found",
               "everywhere_shipping", "everywhere_return", "everywhere_found"]
    joined = L.with_region_shipping(items, entries)
    listed = L.with_region_shipping_from_list(items, shipping_by_country_model(entries))
    assert rows(joined, *columns) == rows(listed, *columns)
    assert rows(joined, *columns)[:3] == [
        ("1", 4.0, 2.0, True, 9.0, None, True),
        ("2", None, None, False, 9.0, None, True),
        ("3", None, 3.0, True, None, None, False),
    ]


def test_settings_rows(spark, rows):
    items = spark.createDataFrame([("A", 1), ("B", 2)], "tenant_id string, n int")
    schema = "margin_pct double, shipping_margin double, return_margin double"
    none = L.with_settings(items, spark.createDataFrame([], schema))
    assert rows(none.withColumns(L.setting_columns()), "n", "margin_pct") == [(1, None), (2, None)]
    two = L.with_settings(items, spark.createDataFrame([(5.0, 1.0, 1.0), (4.0, 9.0, 9.0)], schema))
    assert rows(two.withColumns(L.setting_columns()), "n", "margin_pct") == [(1, 4.0), (2, 4.0)]
    assert "Join" not in plan(two)
    own = spark.createDataFrame([("B", 7.0, 0.0, 0.0)], f"tenant_id string, {schema}")
    scoped = L.with_settings(items, own, ["tenant_id"]).withColumns(L.setting_columns())
    assert rows(scoped, "n", "margin_pct") == [(1, None), (2, 7.0)]


# --- merge --------------------------------------------------------------------------------------


def frames(spark):
    return {
        "g": spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "k string, g double"),
        "t": spark.createDataFrame([("a", 4.0), ("c", 5.0), (None, 6.0)], "k string, t double"),
        "m": spark.createDataFrame([("c", 7.0), ("b", 8.0), ("d", 9.0)], "k string, m double"),
    }


def test_anchored_merge_equals_outer_join_chain(spark, rows):
    f = frames(spark)
    g, t, m = (f[n].alias(n) for n in "gtm")
    chain = g.join(t, F.expr("g.k = t.k"), "full_outer").join(m, F.expr("g.k = m.k"), "full_outer")
    chain = chain.select(F.coalesce("g.k", "t.k", "m.k").alias("k"), "g.g", "t.t", "m.m")
    merged = merge_by_key(f, ["k"], "g")
    assert rows(merged, "k", "g", "t", "m") == rows(chain)
    assert sum(r[0] == "c" for r in rows(merged, "k")) == 2


def test_merge_without_anchor_has_one_row_per_key(spark, rows):
    merged = merge_by_key(frames(spark), ["k"])
    assert rows(merged, "k", "g", "t", "m") == sorted(
        [("a", 1.0, 4.0, None), ("b", 2.0, None, 8.0), ("c", None, 5.0, 7.0),
         ("d", None, None, 9.0), (None, 3.0, 6.0, None)], key=repr)


def test_merge_of_grouped_sources_adds_no_exchange(spark):
    def grouped(name):
        return spark.range(100).selectExpr("id % 7 AS k", f"id AS {name}").groupBy("k").agg(
            F.sum(name).alias(name))

    merged = merge_by_key({"a": grouped("a"), "b": grouped("b")}, ["k"], "a")
    assert plan(merged).count("Exchange hashpartitioning") == 2


def test_merge_refuses_equal_columns(spark):
    f = frames(spark)
    with pytest.raises(ValueError):
        merge_by_key({"x": f["g"], "y": f["g"]}, ["k"])


# --- rollups ------------------------------------------------------------------------------------

LINE = (
    "period string, customer_id string, order_id string, customer_order_index int,"
    "discount_before_taxes double, gross_sales double, total_discounts double, total_sales double,"
    "net_sales double, profit_net_sales double, shipping_charges double, returns double,"
    "taxes double, net_items int, total_amount double"
)


def random_lines(spark, n=600):
    rng = random.Random(3)

    def amount():
        return rng.choice([0.0, -0.0, 1.5, 2.25, rng.randint(-5, 5) / 4])

    data = [
        (
            rng.choice(["a", "b", "c", None]),
            rng.choice([None, "x", "y", "z"]),
            rng.choice([None, "1", "2", "3", "4"]),
            rng.choice([None, 0, 1, 2, 3]),
            rng.choice([None, 0.5, 0.5, 1.0]),
            *[amount() for _ in range(7)],
            1.0, 2, 3.0,
        )
        for _ in range(n)
    ]
    data += [("only-null", None, None, None, None, *[0.0] * 7, 0.0, 0, 0.0)]
    return spark.createDataFrame(data, LINE)


def approx_rows(got, expected):
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        for x, y in zip(a, b):
            same = x == y or (
                isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=1e-9)
            )
            assert same, (a, b)


def test_distinct_split_equals_direct(spark, rows):
    lines = random_lines(spark)
    columns = R.distinct_totals_direct(lines, ["period"]).columns
    direct = rows(R.distinct_totals_direct(lines, ["period"]), *columns)
    rolled = rows(R.sales_rollup(lines, ["period"], measures=R.SALES_ONLY), *columns)
    approx_rows(rolled, direct)


def test_conditional_sums_count_equal_amounts(spark):
    lines = random_lines(spark)
    rolled = R.sales_rollup(lines, ["period"], measures=R.SALES_ONLY, distinct_amounts=False)
    got = rolled.where("period = 'a'").first()
    expected = lines.where("period = 'a' AND customer_order_index = 1").agg(
        F.sum("gross_sales")).first()[0]
    assert got.new_gross_sales == pytest.approx(expected)


def test_distinct_totals_do_not_expand_whole_rows(spark):
    text = plan(R.distinct_totals(random_lines(spark), ["period"]))
    assert "Expand" not in text


def test_ratios_without_a_divisor_are_null(spark):
    lines = random_lines(spark).where("period = 'only-null'")
    row = R.sales_rollup(lines, ["period"], measures=R.SALES_ONLY).first()
    assert (row.orders, row.aov, row.items_per_order, row.sales_returns_pct) == (0, None, None, None)


def test_sales_sources_are_computed_one_by_one(spark, rows):
    """The driver follows one of them at a time; what is merged are stored rows, without a sale entry."""
    lines = random_lines(spark)
    rolled = R.sales_rollup(lines, ["period"], measures=R.SALES_ONLY)
    read = " ".join(rolled.inputFiles())
    assert "sales-sums" in read and "sales-distinct" in read and "ExistingRDD" not in plan(rolled)
    sums = R.plain_sums(lines, ["period"], R.SALES_ONLY)
    assert rows(rolled, *sums.columns) == rows(sums)


def test_payment_fees(spark, rows):
    tx = spark.createDataFrame(
        [("a", "SALE", None, 2.0, 1.5), ("a", "SALE", "DECLINED", 9.0, 1.0),
         ("a", "REFUND", None, 9.0, 1.0), ("a", "SALE", None, 1.0, None), ("b", "VOID", None, 1.0, 1.0)],
        "k string, kind string, error_code string, amount double, fx_rate double",
    )
    assert rows(R.payment_fees(tx, ["k"])) == [("a", 3.0)]


def test_ad_rollups(spark):
    google = spark.createDataFrame(
        [("a", 1500000.0, 2.0, None), ("a", None, None, 1.0)],
        "k string, cost_micros double, clicks double, conversions double",
    )
    assert tuple(R.ad_rollup(google, "google", ["k"]).first()) == ("a", 1.5, 2.0, 1.0)
    meta = spark.createDataFrame(
        [("a", 1.0, None, [("purchase", "3")]), ("a", 2.0, 4.0, None)],
        "k string, spend double, clicks double, actions array<struct<action_type: string, value: string>>",
    )
    assert tuple(R.ad_rollup(meta, "meta", ["k"]).first()) == ("a", 3.0, 4.0, 3.0)


# --- expenses -----------------------------------------------------------------------------------

SCHEDULE = "id string, cost double, frequency string, tag string, start_date date, end_date date"


def test_ledger_equals_product_with_calendar(spark, rows):
    rng = random.Random(5)
    base = date(2020, 1, 1)
    data = []
    for i in range(60):
        start = base + timedelta(days=rng.randint(-60, 90))
        end = start + timedelta(days=rng.randint(-3, 80))
        frequency = rng.choice(["Monthly", "Weekly", "Yearly", "Daily", "Just Once", "Other"])
        data.append((str(i), rng.choice([0.0, -1.0, 10.0, 365.0]), frequency,
                     rng.choice(["staff-costs", None]), start, end))
    data += [("open", 5.0, "Daily", None, base, date(9999, 1, 1)), ("x", 5.0, "Daily", None, None, base)]
    schedule = spark.createDataFrame(data, SCHEDULE)
    ledger = daily_ledger(schedule, "2020-01-10", "2020-03-05")
    days = [date(2020, 1, 10) + timedelta(days=n) for n in range(56)]
    expected = [
        (i, d) for i, cost, _, _, start, end in data for d in days
        if start is not None and cost > 0 and start <= d <= end
    ]
    assert rows(ledger, "id", "day") == sorted(expected, key=repr)
    once = ledger.where("frequency = 'Just Once' AND daily_cost IS NOT NULL")
    assert all(r.day == r.start_date for r in once.collect())
    text = plan(ledger)
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_cost_by_tag(spark, rows):
    ledger = spark.createDataFrame(
        [("a", "staff-costs", 1.0), ("a", "operational-expenses", 2.0), ("a", "", 9.0),
         ("a", "marketing-expenses", None), ("b", "staff-costs", None)],
        "k string, tag string, daily_cost double",
    )
    assert rows(R.cost_by_tag(ledger, ["k"])) == [
        ("a", 1.0, 0.0, 2.0, 3.0), ("b", None, None, None, None),
    ]


def test_hot_key_is_spread_by_value(spark):
    """A key with most of the rows reaches the second grouping merged, never row by row."""
    lines = random_lines(spark, 3000).withColumn("period", F.lit("hot"))
    distinct = R.distinct_totals(lines, ["period"]).first()
    direct = R.distinct_totals_direct(lines, ["period"]).first()
    for name in direct.asDict():
        a, b = distinct[name], direct[name]
        assert a == b or math.isclose(a, b, abs_tol=1e-9)


def expand_sizes(node) -> list[int]:
    """Copies of a row that each Expand of an optimized plan makes."""
    found = [node.projections().size()] if node.nodeName() == "Expand" else []
    children = node.children()
    for i in range(children.size()):
        found += expand_sizes(children.apply(i))
    return found


def test_direct_distinct_totals_copy_a_row_once_per_column(spark, rows):
    """New and repeat are filters of one DISTINCT: ten copies of a row, not one for each of 22 aggregates."""
    data = [("a", "c1", "o1", 1, 2.0), ("a", "c1", "o2", 2, 2.0), ("a", "c2", "o2", 3, 2.0),
            ("a", "c2", "o3", None, 5.0), ("a", None, "o4", 1, 3.0), ("b", "c3", None, None, 1.0)]
    items = spark.createDataFrame(data, "k string, customer_id string, order_id string, customer_order_index int, v double")
    items = items.select("*", *[(F.col("v") + i).alias(name) for i, name in enumerate(R.SEGMENTED.values())])
    got = R.distinct_totals_direct(items, ["k"])
    picked = ["k", "customers", "new_customers", "repeat_customers", "orders", "new_orders", "repeat_orders",
              "new_discounts", "repeat_discounts"]
    assert rows(got, *picked) == [("a", 2, 1, 2, 4, 2, 1, 5.0, 2.0), ("b", 1, 0, 0, 0, 0, 0, None, None)]
    assert rows(got, *picked) == rows(R.distinct_totals(items, ["k"]), *picked)
    assert expand_sizes(got._jdf.queryExecution().optimizedPlan()) == [10]
