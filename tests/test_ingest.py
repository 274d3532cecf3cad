"""Lake layout, models, sinks and whole jobs from files to a report."""

from __future__ import annotations

import gzip
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.timekeys import in_local_range, prune_years, utc_years
from ledgerloom.operators import ingest_orders as O
from ledgerloom.operators import ingest_settings as S
from ledgerloom.plans import ingest
from ledgerloom.plans.ingest import ingest_orders, ingest_settings
from ledgerloom.plans.orders import order_page
from ledgerloom.plans.period import period_pnl
from ledgerloom.plans.tables import load_tables
from ledgerloom.sources import keyindex, snapshots
from ledgerloom.sources.calendar import calendar
from ledgerloom.sources.lake import CURRENT_PARTITION, ORDER_LINES, read_lake
from ledgerloom.sources.models import model_path, read_csv, read_model, write_csv, write_model
from ledgerloom.sources.repack import read_packed, repack, taken
from ledgerloom.sources.schemas import LAKE


def put(root, tenant, table, day, *records):
    folder = f"{root}/tenants/tenantid={tenant}/tablename={table}/date={day}"
    os.makedirs(folder, exist_ok=True)
    with gzip.open(f"{folder}/part-{len(os.listdir(folder))}.jsonl.gz", "wt") as out:
        out.writelines(json.dumps(r) + "\n" for r in records)


def money(amount, currency="EUR"):
    return {"shopMoney": {"amount": str(amount), "currencyCode": currency}}


def document(n, created="2020-01-05T10:00:00Z", **other):
    sale = {
        "id": f"s{n}", "lineType": "PRODUCT", "actionType": "ORDER", "quantity": 2,
        "totalDiscountAmountBeforeTaxes": money(1), "totalDiscountAmountAfterTaxes": money(1),
        "totalTaxAmount": money(2), "totalAmount": money("21.0"),
        "lineItem": {
            "name": "Thing", "variant": {"legacyResourceId": "v1"}, "product": {"id": "p1"},
            "originalUnitPriceSet": money(11), "taxLines": [{"rate": 0.1}],
        },
    }
    base = {
        "id": f"gid/{n}", "name": f"#{n}", "createdAt": created,
        "customerJourneySummary": {"customerOrderIndex": 1},
        "customer": {"id": "c1", "displayName": "Ann B", "email": "a@example.com"},
        "totalReceivedSet": {
            "shopMoney": {"amount": "20.0"},
            "presentmentMoney": {"amount": "10.0", "currencyCode": "USD"},
        },
        "fulfillments": [
            {"legacyResourceId": "f1", "createdAt": "2020-01-06T10:00:00Z", "totalQuantity": 2,
             "trackingInfo": [{"company": "Post"}, {"company": "Other"}]}
        ],
        "transactions": [
            {"id": "t1", "createdAt": "2020-01-05T10:01:00Z", "errorCode": None, "kind": "SALE",
             "formattedGateway": "Card",
             "fees": [{"amount": {"amount": "0.5", "currencyCode": "EUR"}}]},
            {"id": "t2", "createdAt": "2020-01-05T10:02:00Z", "kind": "SALE", "fees": []},
        ],
        "refunds": [{"id": "r1"}], "paymentGatewayNames": ["card"], "tags": ["x", "y"],
        "agreements": {"edges": [
            {"node": {"happenedAt": "2019-12-31T23:30:00Z", "sales": {"edges": [{"node": sale}]}}},
            {"node": {"happenedAt": created, "sales": {"edges": []}}},
        ]},
        "displayFulfillmentStatus": "FULFILLED", "displayFinancialStatus": "PAID",
        "shippingAddress": {"countryCode": "IE", "provinceCode": "D", "province": "Dublin",
                            "city": "Cork", "country": "Ireland"},
    }
    return {"json": {**base, **other}}


TABLE = "rawShopifyOrdersCreated"


def test_lake_scan(spark, tmp_path):
    root = str(tmp_path)
    put(root, "007", TABLE, "2020-01-05", document(1))
    put(root, "007", TABLE, "2020-02-01", document(2))
    put(root, "8", TABLE, "2019-12-31", document(3))
    everything = read_lake(spark, root, "*", TABLE, LAKE["orders"])
    assert {(r.tenantid, r.date) for r in everything.collect()} == {
        ("007", "2020-01-05"), ("007", "2020-02-01"), ("8", "2019-12-31"),
    }
    days = read_lake(spark, root, "*", TABLE, LAKE["orders"], days=("2019-12-31", "2020-01-31"))
    assert {r.date for r in days.collect()} == {"2020-01-05", "2019-12-31"}
    assert "PartitionFilters: [isnotnull(date" in days._jdf.queryExecution().executedPlan().toString()
    put(root, "007", "settings", CURRENT_PARTITION, {"defaultGrossProfitMargin": 40})
    one = read_lake(spark, root, "007", "settings", LAKE["defaultValues"], CURRENT_PARTITION).first()
    assert (one.date, one.defaultGrossProfitMargin) == (CURRENT_PARTITION, "40")


def parsed(spark, *documents):
    rows = [(json.dumps(d["json"]),) for d in documents]
    return O.orders_model(O.parse_orders(spark.createDataFrame(rows, "json string")))


def test_a_large_file_is_packed_into_even_ones(spark, tmp_path, rows):
    """One large gzip file and many small ones become files of like size, and read the same."""
    root = str(tmp_path)
    put(root, "A", TABLE, "2020-01-05", *[document(n) for n in range(3000)])
    for n in range(20):
        put(root, "B", TABLE, f"2020-02-{1 + n:02d}", document(5000 + n))
    put(root, "B", "other", "2020-02-01", document(1))
    assert repack(spark, root, TABLE, file_bytes=100_000) == 21
    sizes = sorted(f.stat().st_size for f in (tmp_path / "packed/lines").rglob("*.parquet"))
    assert len(sizes) >= 4 and sizes[-1] < 2 * sizes[0], sizes
    for days in (None, ("2020-02-03", "2020-02-04")):
        for tenant in ("*", "B"):
            plain = read_lake(spark, root, tenant, TABLE, LAKE["orders"], days=days)
            packed = read_packed(spark, root, tenant, TABLE, LAKE["orders"], days)
            # the text of an object may differ in white space
            packed, plain = (d.withColumn("json", F.regexp_replace("json", r"\s", "")) for d in (packed, plain))
            assert rows(packed, *plain.columns) == rows(plain, *plain.columns)
    assert repack(spark, root, TABLE) == 0


def test_packing_takes_new_and_changed_files_once(spark, tmp_path):
    lake, models = f"{tmp_path}/lake", f"{tmp_path}/models"
    put(lake, "A", TABLE, "2020-01-05", document(1), document(2))
    assert repack(spark, lake, TABLE) == 1
    put(lake, "A", TABLE, "2020-01-06", document(3))
    assert repack(spark, lake, TABLE, days=("2020-01-07", "2020-01-31")) == 0
    assert repack(spark, lake, TABLE) == 1
    # a file written anew counts as it is now
    (path,) = [f"{d}/{f}" for d, _, files in os.walk(f"{lake}/tenants") for f in files if "2020-01-05" in d]
    os.remove(path)
    put(lake, "A", TABLE, "2020-01-05", document(1, name="new"), document(4), document(7))
    os.utime(path, (2e9, 2e9))
    assert repack(spark, lake, TABLE) == 1 and taken(spark, lake).count() == 3
    ingest_orders(spark, lake, models, "2020-01-01", "2020-01-31", packed=True)
    assert sorted((r.order_id, r.order_name) for r in stored_orders(spark, models).collect()) == [
        ("gid/1", "new"), ("gid/3", "#3"), ("gid/4", "#4"), ("gid/7", "#7"),
    ]


def test_order_models(spark):
    orders = parsed(spark, document(1))
    row = orders.first()
    assert (row.fx_rate, row.first_carrier, row.tags, row.created_year) == (2.0, "Post", '["x","y"]', "2020")
    assert json.loads(row.refunds) == [{"id": "r1"}]
    sale = O.sales_items_model(orders).first()
    assert (sale.happened_year, sale.happened_quarter, sale.tax_rate_sum) == ("2019", 4, 0.1)
    assert (sale.quantity, sale.unit_price, sale.total_amount) == (2, 11.0, 21.0)
    (fee,) = O.transactions_model(orders).collect()
    assert (fee.transaction_id, fee.amount, fee.currency_code) == ("t1", 0.5, "EUR")
    (slip,) = O.transactions_model(orders, as_shipped=True).collect()
    assert (slip.transaction_id, slip.currency_code) == ("2020-01-05T10:01:00Z", "0.5")
    (shipment,) = O.fulfillments_model(orders).collect()
    assert (shipment.resource_id, shipment.total_quantity, shipment.fulfillment_day) == ("f1", 2, "06")


def test_object_and_text_lines_read_alike(spark, tmp_path, rows):
    root = str(tmp_path)
    put(root, "A", "objects", "2020-01-05", document(1))
    put(root, "A", "texts", "2020-01-05", {"json": json.dumps(document(1)["json"])})
    got = []
    for table, lines, kind in (("objects", "object", "struct"), ("objects", "text", "string"), ("texts", "text", "string")):
        raw = read_lake(spark, root, "A", table, ORDER_LINES[lines])
        assert dict(raw.dtypes)["json"].startswith(kind)
        orders = O.orders_model(O.parse_orders(raw.select("tenantid", "json")))
        # The text of lists that stay JSON may differ in white space.
        orders = orders.withColumn("refunds", F.regexp_replace("refunds", r"\s", ""))
        models = (lambda o: o, O.sales_items_model, O.transactions_model, O.fulfillments_model)
        got.append([rows(model(orders)) for model in models])
    assert got[0] == got[1] == got[2] and all(len(part) == 1 for part in got[0])


def stored_orders(spark, models, table="orders"):
    return read_model(spark, models, table)


def test_stores_with_object_and_text_lines_load_in_one_job(spark, tmp_path):
    lake, models = f"{tmp_path}/lake", f"{tmp_path}/models"
    table = "rawShopifyOrdersCreated"
    put(lake, "A", table, "2020-01-05", *[document(n) for n in range(40)])
    put(lake, "B", table, "2020-01-05", {"json": json.dumps(document(99)["json"])})
    ingest_orders(spark, lake, models, "2020-01-01", "2020-01-31")
    counts = {r.tenantid: r["count"] for r in stored_orders(spark, models).groupBy("tenantid").count().collect()}
    assert counts == {"A": 40, "B": 1}


def test_reingest_replaces_moved_and_removed_rows(spark, tmp_path):
    lake, models = f"{tmp_path}/lake", f"{tmp_path}/models"
    table = "rawShopifyOrdersCreated"

    def shipped(day):
        return [{"legacyResourceId": "f1", "createdAt": f"{day}T10:00:00Z", "totalQuantity": 2, "trackingInfo": []}]

    put(lake, "A", table, "2020-01-05", document(1, fulfillments=shipped("2020-01-06")), document(2, fulfillments=shipped("2020-01-06")))
    ingest_orders(spark, lake, models, "2020-01-05", "2020-01-05")
    put(lake, "A", table, "2020-01-07", document(1, fulfillments=shipped("2021-01-06")), document(2, fulfillments=[]))
    ingest_orders(spark, lake, models, "2020-01-07", "2020-01-07")
    left = stored_orders(spark, models, "fulfillments").collect()
    assert [(r.order_id, str(r.fulfillment_year)) for r in left] == [("gid/1", "2021")]
    files = snapshots.listed(spark, models, snapshots.current(spark, models)).where("table = 'fulfillments' and file is not null")
    assert [(r.tenantid, r.year) for r in files.collect()] == [("A", "2021")]
    assert stored_orders(spark, models).count() == 2


def test_one_run_over_days_keeps_the_latest_version(spark, tmp_path):
    lake = f"{tmp_path}/lake"
    for day, name in (("2020-01-05", "old"), ("2020-01-06", "new"), ("2020-01-04", "oldest")):
        put(lake, "A", "rawShopifyOrdersCreated", day, document(1, name=name))
    for versions, names in (("latest", ["new"]), ("all", ["new", "old", "oldest"])):
        models = f"{tmp_path}/{versions}"
        ingest_orders(spark, lake, models, "2020-01-01", "2020-01-31", versions=versions)
        assert sorted(r.order_name for r in stored_orders(spark, models).collect()) == names


def everything(spark, models):
    """All rows of the four order models, without the names of runs."""
    out = []
    for table in ("orders", "sales_items", "transactions", "fulfillments"):
        out.append(sorted((repr(r.asDict(recursive=True)) for r in read_model(spark, models, table).collect())))
    return out


def test_runs_end_alike_in_any_order(spark, tmp_path):
    """A stored order gives way to later versions only, whatever the order of runs."""
    lake, table = f"{tmp_path}/lake", "rawShopifyOrdersCreated"
    put(lake, "A", table, "2020-01-05", document(1, displayFinancialStatus="PENDING"), document(2))
    put(lake, "A", table, "2020-01-06", document(2, fulfillments=[]), document(3))
    put(lake, "A", table, "2020-01-07", document(1, agreements={"edges": []}))
    ends = []
    for i, runs in enumerate(([(5, 5), (6, 6), (7, 7)], [(7, 7), (5, 6), (5, 5)], [(5, 7)])):
        models = f"{tmp_path}/models-{i}"
        for first, last in runs:
            ingest_orders(spark, lake, models, f"2020-01-0{first}", f"2020-01-0{last}")
        ends.append(everything(spark, models))
    assert all(e == ends[0] for e in ends[1:])
    statuses = {r.order_id: (r.financial_status, r.lake_date) for r in stored_orders(spark, models).collect()}
    assert statuses == {"gid/1": ("PAID", "2020-01-07"), "gid/2": ("PAID", "2020-01-06"), "gid/3": ("PAID", "2020-01-06")}


def orders_of(spark, numbers, **other):
    """Orders whose numbers begin with the year of all their dates, or are of 2015."""

    def text(n):
        day = f"{n // 1000 or 2015}-0{1 + n % 9}-05T10:00:00Z"
        made = document(n, created=day, **other)
        told = json.dumps(made["json"])
        return told.replace("2020-01-06T10:00:00Z", day).replace("2020-01-05T10:01:00Z", day).replace("2019-12-31T23:30:00Z", day)

    texts = [text(n) for n in numbers]
    raw = spark.createDataFrame([("A", t) for t in texts], "tenantid string, json string")
    return O.orders_model(O.parse_orders(raw))


def test_a_run_killed_between_two_models_is_not_seen(spark, tmp_path, monkeypatch):
    models = str(tmp_path)
    ingest.write_order_models(orders_of(spark, range(5)), models)
    before, number = everything(spark, models), snapshots.current(spark, models)
    write, written = ingest.write_batch, []

    def killed(rows, root, table, *rest):
        if table in ("transactions", "fulfillments"):
            raise KeyboardInterrupt
        write(rows, root, table, *rest)
        written.append(table)

    monkeypatch.setattr(ingest, "write_batch", killed)
    with pytest.raises(KeyboardInterrupt):
        ingest.write_order_models(orders_of(spark, range(3, 9), displayFinancialStatus="VOIDED"), models)
    monkeypatch.undo()
    assert sorted(written) == ["orders", "sales_items"] and snapshots.current(spark, models) == number
    assert everything(spark, models) == before
    ingest.write_order_models(orders_of(spark, range(3, 9), displayFinancialStatus="VOIDED"), models)
    assert read_model(spark, models, "orders").count() == 9
    # a reader of the old snapshot still sees it, until it is dropped with the folders nobody names
    assert read_model(spark, models, "orders", snapshot=number).count() == 5
    gone = snapshots.drop_old(spark, models, keep=1)
    assert any("_snapshots" in g for g in gone) and sum("/orders/batch=" in g for g in gone) == 2
    assert read_model(spark, models, "orders").count() == 9


def test_two_runs_at_once_cannot_both_publish(spark, tmp_path):
    models = str(tmp_path)
    ingest.write_order_models(orders_of(spark, [1]), models)
    number = snapshots.current(spark, models)
    files = snapshots.listed(spark, models, number)
    assert snapshots.publish(spark, models, files, number) == number + 1
    with pytest.raises(snapshots.PublishConflict):
        snapshots.publish(spark, models, files, number)
    assert read_model(spark, models, "orders").count() == 1


def opened(df):
    return set(df.inputFiles())


def test_a_day_opens_a_share_of_ten_years(spark, tmp_path):
    models = str(tmp_path)
    ingest.write_order_models(orders_of(spark, [1000 * year + i for year in range(2010, 2020) for i in range(30)]), models, small_bytes=0)
    files = snapshots.listed(spark, models, snapshots.current(spark, models)).where("file is not null")
    per_table = {r.table: r.n for r in files.groupBy("table").agg(F.count("*").alias("n")).collect()}
    assert per_table["orders"] >= 10
    keys = spark.createDataFrame([("A", "gid/2013007"), ("A", "gid/2019001"), ("A", "gid/2013999"), ("B", "gid/2013007")], "tenantid string, order_id string")
    for table in per_table:
        found = keyindex.files_with(spark, models, table, files, keys).collect()
        assert 2 <= len(found) <= 4, (table, found)
    moved = orders_of(spark, [2013007], displayFinancialStatus="VOIDED")
    ingest.write_order_models(moved, models, small_bytes=0)
    after = snapshots.listed(spark, models, snapshots.current(spark, models)).where("file is not null and table = 'orders'")
    same = files.join(after, ["table", "batch", "tenantid", "year", "file"], "left_semi").where("table = 'orders'").count()
    assert same == per_table["orders"] - 1  # the one file that held the order is replaced
    rows = read_model(spark, models, "orders")
    assert rows.count() == 300
    assert [r.financial_status for r in rows.where("order_id = 'gid/2013007'").collect()] == ["VOIDED"]
    # the list alone keeps other years' files from being opened
    one = read_model(spark, models, "orders", "A", "created_year", (2013, 2013))
    assert one.count() == 30 and len(opened(one)) == after.where("year = '2013'").count()


def test_a_page_of_a_month_opens_the_years_of_its_orders(spark, tmp_path):
    """Entries of an order may be years later; files of other years and orders stay closed."""
    models = str(tmp_path)
    day = [f"{y}-05-05T10:00:00Z" for y in range(2010, 2020)]
    late = {"edges": [{"node": {"happenedAt": day[7], "sales": document(1)["json"]["agreements"]["edges"][0]["node"]["sales"]}}]}
    docs = [document(n, created=day[n], agreements=late if n == 2 else {"edges": [{"node": {**late["edges"][0]["node"], "happenedAt": day[n]}}]}) for n in range(10)]
    raw = spark.createDataFrame([("A", json.dumps(d["json"])) for d in docs], "tenantid string, json string")
    ingest.write_order_models(O.orders_model(O.parse_orders(raw)), models)
    for table in ("settings", "google_ads", "tiktok_ads", "meta_ads", "cost_schedule", "product_costs", "order_shipping", "shipping_entries"):
        write_model(spark.createDataFrame([("A", 1)], "tenantid string, x int"), model_path(models, table), ["tenantid"])
    t = load_tables(spark, models, "A", created=("2012-05-01", "2012-05-31"))
    assert [r.order_id for r in t.orders.collect()] == ["gid/2"]
    # the file of 2017 holds the entry of the order of 2012 beside one of 2017
    assert {(r.order_id, r.happened_year) for r in t.sales.collect()} == {("gid/2", "2017"), ("gid/7", "2017")}
    assert len(opened(t.sales)) == 1 < len(opened(load_tables(spark, models, "A").sales))
    assert load_tables(spark, models, "A", created=("2030-01-01", "2030-01-31")).sales.count() == 0


def test_ids_are_found_in_their_files(spark, tmp_path):
    """No file that holds an id is missed, few others are found, whatever the ids' order."""
    models, schema = str(tmp_path), "order_id string, order_created_at timestamp, tenantid string, y string"
    files = None
    for b in range(3):
        rows = spark.createDataFrame([(f"o{(i * 7919 + b) % 3000 * 3 + b}", None, "t/%s" % (i % 2), str(2000 + i % 3) if i % 5 else None) for i in range(3000)], schema)
        snapshots.write_batch(rows, models, "m", f"b{b}", "y", ["order_id"])
        back = spark.read.schema(rows.schema).option("basePath", f"{models}/models/m").parquet(f"{models}/models/m/batch=b{b}")
        one = keyindex.describe(spark, models, "m", f"b{b}", back, "y")
        files = one if files is None else files.unionByName(one)
    files = files.cache()
    keys = spark.createDataFrame([(f"t/{t}", f"o{k}") for t in range(3) for k in (0, 1, 2, 4444, 8999, 99999)], "tenantid string, order_id string")
    every = snapshots.read_files(spark, models, "m", files, T.StructType.fromDDL(schema), "y")
    held = {tuple(r) for r in every.join(keys, ["tenantid", "order_id"]).select("batch", "tenantid", "y", "file").collect()}
    found = {(r.batch, r.tenantid, r.year, r.file) for r in keyindex.files_with(spark, models, "m", files, keys).collect()}
    assert held <= found and every.count() == 9000
    assert len(found - held) <= 2


def test_an_id_is_not_copied_for_each_file(spark, tmp_path):
    """Files of many years hold ids of one range; an id meets their filters as one row for each size of them."""
    models = str(tmp_path)
    ingest.write_order_models(orders_of(spark, [1000 * year + i for year in range(2010, 2020) for i in range(30)]), models, small_bytes=0)
    files = snapshots.listed(spark, models, snapshots.current(spark, models))
    keys = spark.createDataFrame([("A", f"gid/{1000 * year + 7}") for year in range(2010, 2015)], "tenantid string, order_id string")
    found = keyindex.files_with(spark, models, "orders", files, keys)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.year for r in found.collect()} >= {str(y) for y in range(2010, 2015)}


def test_files_without_filters_are_found_by_their_ids(spark, tmp_path):
    """Files listed before filters had their form are opened if their range may hold an id, beside those with filters."""
    models = str(tmp_path)
    for ids in ([2010001, 2010005], [2011001, 2011005]):
        ingest.write_order_models(orders_of(spark, ids), models, small_bytes=0)
    number = snapshots.current(spark, models)
    first = min(r.batch for r in snapshots.listed(spark, models, number).where("file is not null").select("batch").collect())
    shutil.rmtree(f"{snapshots.filters_path(models, 'orders')}/batch={first}")
    files = snapshots.listed(spark, models, number)

    def years(*ids):
        keys = spark.createDataFrame([("A", f"gid/{i}") for i in ids], "tenantid string, order_id string")
        return {r.year for r in keyindex.files_with(spark, models, "orders", files, keys).collect()}

    assert years(2010003) == {"2010"} and years(2011005) == {"2011"} and years(2010005, 2011001) == {"2010", "2011"}
    assert years(2009001) == set()
    ingest.write_order_models(orders_of(spark, [2010005], displayFinancialStatus="VOIDED"), models, small_bytes=0)
    rows = read_model(spark, models, "orders")
    assert sorted((r.order_id, r.financial_status == "VOIDED") for r in rows.collect()) == [
        ("gid/2010001", False), ("gid/2010005", True), ("gid/2011001", False), ("gid/2011005", False)
    ]


def test_small_files_do_not_pile_up(spark, tmp_path):
    """New orders join the small files of their partition; with no size called small they get files of their own."""
    for small, expected in ((ingest.SMALL_BYTES, 1), (0, 3)):
        models = f"{tmp_path}/{small}"
        for first in (0, 3, 6):
            ingest.write_order_models(orders_of(spark, range(first, first + 3)), models, small_bytes=small)
        files = snapshots.listed(spark, models, snapshots.current(spark, models)).where("file is not null and table = 'orders'")
        assert files.count() == expected and read_model(spark, models, "orders").count() == 9


def test_models_of_plain_folders_are_taken_over(spark, tmp_path):
    models = str(tmp_path)
    old = orders_of(spark, range(6))
    write_model(old, model_path(models, "orders"), ["tenantid", "created_year"])
    write_model(O.transactions_model(old), model_path(models, "transactions"), ["tenantid", "transaction_year"])
    ingest.write_order_models(orders_of(spark, [5, 6], displayFinancialStatus="VOIDED"), models)
    rows = read_model(spark, models, "orders").collect()
    assert sorted((r.order_id, r.financial_status) for r in rows) == [(f"gid/{n}", "VOIDED" if n > 4 else "PAID") for n in range(7)]
    assert read_model(spark, models, "transactions").select("order_id").distinct().count() == 7


def test_ads_of_a_range_leave_other_days(spark, tmp_path):
    lake, models = f"{tmp_path}/lake", f"{tmp_path}/models"
    for tenant in ("A", "B"):
        for day in ("2020-01-01", "2020-01-02"):
            put(lake, tenant, "tikTok", day, {"spend": "1", "clicks": "2", "conversion": "3", "snapshotDate": day})
    ingest_settings(spark, lake, models, "tiktok_ads", "2020-01-01", "2020-01-01")
    ingest_settings(spark, lake, models, "tiktok_ads", "2020-01-02", "2020-01-02")
    ingest_settings(spark, lake, models, "tiktok_ads", "2020-01-02", "2020-01-02", tenant="A")
    rows = sorted((r.tenantid, r.date) for r in read_model(spark, models, "tiktok_ads").collect())
    assert rows == [(t, d) for t in ("A", "B") for d in ("2020-01-01", "2020-01-02")]


def test_first_shipping_entry_follows_the_lake(spark, tmp_path):
    lake, models = f"{tmp_path}/lake", f"{tmp_path}/models"
    table = "defaultsnapshot_shippingCostsByCountry"

    def entry(cost, **more):
        return {"countryName": "Ireland", "region": "r", "countryCode": "IE", "shippingCost": cost, "returnShippingCost": 0, **more}

    put(lake, "A", table, "2020-01-01", entry(1), entry(7))
    put(lake, "A", table, "2020-01-02", *[entry(2, pad=str(i) * 50) for i in range(2000)])
    ingest_settings(spark, lake, models, "shipping_entries")
    first = read_model(spark, models, "shipping_entries").orderBy("position").first()
    assert first.shipping_cost == 1


def test_json_is_parsed_once(spark):
    text = O.sales_items_model(parsed(spark, document(1)))._jdf.queryExecution().executedPlan().toString()
    assert text.count("from_json(") == 1


def test_empty_and_missing_lists_give_no_rows(spark):
    bare = document(1, fulfillments=[], transactions=None, agreements=None)
    del bare["json"]["tags"]
    orders = parsed(spark, bare)
    row = orders.first()
    assert row.first_carrier is None and row.tags is None
    for model in (O.sales_items_model, O.transactions_model, O.fulfillments_model):
        assert model(orders).count() == 0


def test_zero_presentment_amount_gives_no_rate(spark):
    zero = {"shopMoney": {"amount": "20"}, "presentmentMoney": {"amount": 0}}
    assert parsed(spark, document(1, totalReceivedSet=zero)).first().fx_rate is None


def test_broken_document_raises(spark):
    broken = spark.createDataFrame([("{",)], "json string")
    with pytest.raises(Exception, match="MALFORMED"):
        O.orders_model(O.parse_orders(broken)).collect()


def settings_rows(spark, costs):
    raw = spark.createDataFrame(
        [("40", "6.5", None, costs)],
        "defaultGrossProfitMargin string, defaultShippingMargin string,"
        "defaultReturnMargin string, defaultFulfillmentCosts string",
    )
    return S.default_values_model(raw).first()


def test_default_values(spark):
    simple = settings_rows(spark, '{"baseCostPerOrder": null, "packagingBaseCostPerOrder": "2"}')
    assert simple.pricing == "simplePricing" and simple.exclude_returned_cost is True
    (tier,) = simple.tiers
    assert (tier.fulfillment_base, tier.packaging_base, tier.min_units, tier.max_units) == (
        None, 2.0, 0, 9999999,
    )
    many = settings_rows(
        spark,
        '[{"fulFillmentBaseCostPerOrder": 1, "minUnits": {"id": 0}, "maxUnits": {"id": "5"}},'
        '{"fulFillmentBaseCostPerOrder": 2, "minUnits": {"id": 6}, "maxUnits": {"id": 9}}]',
    )
    assert many.pricing == "variablePricing"
    assert [(t.fulfillment_base, t.min_units, t.max_units) for t in many.tiers] == [(1, 0, 5), (2, 6, 9)]
    none = settings_rows(spark, None)
    assert none.pricing == "variablePricing" and none.tiers is None


def test_schedule_and_fees_models(spark):
    raw = spark.createDataFrame(
        [("1", "10", "2020-01-01", ""), ("2", "10", "2020-01-01", None), ("3", "1", "2020-01-01", "2020-02-01")],
        "Id string, Cost string, StartDate string, EndDate string",
    ).selectExpr("*", *[f"'x' AS {c}" for c in ("ExpenseName", "Status", "Category", "Frequency", "Tags")])
    ends = [str(r.end_date) for r in S.cost_schedule_model(raw).collect()]
    assert ends == ["9999-01-01", "9999-01-01", "2020-02-01"]


def test_calendar(spark):
    got = [tuple(r) for r in calendar(spark, "2020-12-31", "2021-01-01").drop("day").collect()]
    assert got == [("2020-12-31", "2020-12", "2020", "2020-W53"), ("2021-01-01", "2021-01", "2021", "2020-W53")]


def test_partitions_are_merged_by_key(spark, tmp_path, rows):
    path = str(tmp_path / "m")

    def batch(*data):
        return spark.createDataFrame(list(data), "tenantid string, year string, id string, v int")

    def write(df):
        write_model(df, path, ["tenantid", "year"], df.select("tenantid", "id"))

    write(batch(("007", "2019", "a", 1), ("007", "2020", "b", 1), ("8", "2020", "b", 1)))
    write(batch(("007", "2020", "c", 2), ("007", "2020", "b", 3)))
    stored = spark.read.parquet(path)
    assert rows(stored, "tenantid", "year", "id", "v") == [
        ("007", "2019", "a", 1), ("007", "2020", "b", 3), ("007", "2020", "c", 2), ("8", "2020", "b", 1),
    ]
    # Without keys the partition is replaced as a whole; other partitions stay.
    write_model(batch(("8", "2020", "z", 9)), path, ["tenantid", "year"])
    assert rows(spark.read.parquet(path).where("tenantid = '8'"), "id") == [("z",)]
    assert spark.read.parquet(path).count() == 4


def test_model_files(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(1000).selectExpr("id", "'7' AS tenantid", "cast(2019 + id % 3 AS string) AS y")
    write_model(df, model_path(root, "m"), ["tenantid", "y"])
    names = [f for _, _, files in os.walk(model_path(root, "m")) for f in files if f.endswith(".parquet")]
    assert names and all(n.endswith(".zstd.parquet") for n in names)
    kept = read_model(spark, root, "m", "7", "y", (2020, 2021))
    assert kept.count() == df.where("y >= '2020'").count()
    assert "PartitionFilters: [isnotnull(tenantid" in kept._jdf.queryExecution().executedPlan().toString()
    write_model(spark.range(10).toDF("x"), model_path(root, "lookup"))
    assert read_model(spark, root, "lookup").count() == 10


@pytest.mark.parametrize("gz", [True, False])
def test_csv(spark, tmp_path, gz):
    df = spark.createDataFrame([("a,b", 1.5, None), ('say "hi"\nthere', None, "x")], "t string, n double, u string")
    path = write_csv(df.coalesce(1), str(tmp_path / "out"), gz)
    (name,) = [f for f in os.listdir(path) if f.startswith("part-")]
    assert name.endswith(".csv.gz") == gz
    opened = gzip.open if gz else open
    with opened(f"{path}/{name}", "rt") as lines:
        assert lines.readline() == "t,n,u\n"
    back = read_csv(spark, path, "t string, n double, u string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_from_lake_to_reports(spark, tmp_path):
    lake, models = str(tmp_path / "lake"), str(tmp_path / "models")
    for tenant in ("A", "B"):
        put(lake, tenant, TABLE, "2020-01-05", document(1), document(2))
        put(lake, tenant, "googleAds", "2019-12-31",
            {"metrics": {"costMicros": "3000000", "clicks": 4, "conversions": 1.0},
             "snapshotDate": "2019-12-31"})
        put(lake, tenant, "tikTok", "2019-12-31",
            {"spend": 2, "clicks": 1, "conversion": 0, "snapshotDate": "2019-12-31"})
        put(lake, tenant, "metaAds", "2019-12-31",
            {"spend": "1.5", "clicks": "2", "actions": [{"action_type": "purchase", "value": "3"}],
             "snapshotDate": "2019-12-31"})
        put(lake, tenant, "defaultsnapshot_costScheduler", "2020-01-01",
            {"Id": "1", "Cost": 7, "Frequency": "Weekly", "Tags": "staff-costs",
             "StartDate": "2019-12-01", "EndDate": ""})
        put(lake, tenant, "defaultsnapshot_productCosts", "2020-01-01",
            {"variantId": "v1", "productCost": "4", "packingFee": 0.5})
        put(lake, tenant, "defaultsnapshot_shippingCostsByCountry", "2020-01-01",
            {"countryName": "Ireland", "region": "D", "countryCode": "IE", "shippingCost": 7})
        put(lake, tenant, "shippingCosts", "2020-01-01", {"orderId": "77", "shippingCost": "2"})
        put(lake, tenant, "defaultsnapshot_defaultValues", CURRENT_PARTITION,
            {"defaultGrossProfitMargin": "40", "defaultShippingMargin": 6.5, "defaultReturnMargin": 3,
             "defaultFulfillmentCosts": {"baseCostPerOrder": "2" if tenant == "A" else "5",
                                         "packagingBaseCostPerOrder": 1}})
        put(lake, tenant, "transactionFees", "2020-01-01",
            {"feePerc": 2.9, "name": "card", "id": 1, "currencyConversionFee": "",
             "snapshotDate": "2020-01-01"})
    ingest_orders(spark, lake, models, "2020-01-01", "2020-01-31")
    # A later batch replaces order 2 and keeps order 1.
    put(lake, "A", TABLE, "2020-02-03", document(2, displayFinancialStatus="REFUNDED"))
    ingest_orders(spark, lake, models, "2020-02-01", "2020-02-28", tenant="A")
    for name in ("meta_ads", "google_ads", "tiktok_ads", "cost_schedule", "product_costs",
                 "shipping_entries", "order_shipping", "settings", "transaction_fees"):
        ingest_settings(spark, lake, models, name, "2019-01-01", "2020-12-31")
    assert read_model(spark, models, "transaction_fees", "A").first().currency_conversion_fee == 0.0
    assert read_model(spark, models, "sales_items").groupBy("tenantid").count().where("count = 2").count() == 2

    both = load_tables(spark, models)
    report = period_pnl(both, "date", "2019-12-01", "2020-01-31").where("period = '2019-12-31'")
    sold = {r.tenantid: r for r in report.where("orders > 0").collect()}
    assert sold["A"].orders == 2 and sold["A"].gross_sales == pytest.approx(40.0)
    assert sold["A"].google_spend == 3.0 and sold["A"].meta_conversions == 3.0
    assert sold["A"].staff_cost == 1.0
    one = load_tables(spark, models, "B", (2019, 2020))
    page = order_page(one, "2020-01-01", "2020-01-31").collect()
    assert [r.orderId for r in page] == ["#1", "#2"] and page[0].fulfillment == 6.0
    statuses = load_tables(spark, models, "A").orders.select("order_id", "financial_status").collect()
    assert dict(map(tuple, statuses)) == {"gid/1": "PAID", "gid/2": "REFUNDED"}


def test_short_ranges_prune_years_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "sales")
    seconds = F.timestamp_seconds(F.lit(1577836800) + F.col("id") * 86400)
    sales = spark.range(800).select(F.col("id"), seconds.alias("happened_at"))
    sales = sales.withColumn("happened_year", F.date_format("happened_at", "yyyy"))
    write_model(sales, path, ["happened_year"], sort_by=["happened_at"])
    stored = prune_years(spark.read.parquet(path), "happened_year", utc_years("2021-03-01", "2021-03-31"))
    kept = stored.where(in_local_range("happened_at", "Asia/Kolkata", "2021-03-01", "2021-03-31"))
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(happened_at" in text and "happened_year" in text.split("PartitionFilters")[1]
    assert kept.count() == 31
