"""Benchmark: headline reports over stored models, printed as one JSON line.

The models are written first, as the ingest jobs leave them, and timed as `write_models`. Every query
then runs cold once and is timed to the last row of its result. `reference_before` and `reference_after` time a
fixed job, so that a slower machine can be told from a slower query.
"""

from __future__ import annotations

import dataclasses
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from checks import queries as Q  # noqa: E402
from ledgerloom.functions.timekeys import utc_parts  # noqa: E402
from ledgerloom.operators import ingest_orders as ingest  # noqa: E402
from ledgerloom.operators import lookups, rollups  # noqa: E402
from ledgerloom.plans import orders, period  # noqa: E402
from ledgerloom.plans.tables import StoreTables  # noqa: E402
from checks.sample_store import SampleStore, order_documents, sale_documents  # noqa: E402
from ledgerloom.session import local_session, scratch_dir  # noqa: E402
from ledgerloom.sources.models import write_model  # noqa: E402
from ledgerloom.sources.schemas import ORDER_OBJECT_LINES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RANGE = Q.RANGE
# Instant -> year partition of the models that have one.
YEARS = {
    "orders": ("order_created_at", "created"),
    "sales": ("happened_at", "happened"),
    "transactions": ("transaction_at", "transaction"),
    "fulfillments": ("fulfilled_at", "fulfillment"),
}


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def write_models(store: SampleStore) -> StoreTables:
    """Write the sample store as Parquet models and return them as read back."""
    tables, root = store.tables(), scratch_dir(store.spark, "bench-models")
    stored = {}
    for field in dataclasses.fields(StoreTables):
        if field.name == "scope":
            continue
        df = getattr(tables, field.name)
        if field.name == "order_shipping":  # the input the recorded timings were made with
            df = store.every_order_shipping().where("o_totalprice >= 495000").drop("o_totalprice")
        parts, order = [], []
        if field.name in YEARS:
            instant, prefix = YEARS[field.name]
            df = df.withColumns(utc_parts(instant, prefix))
            parts, order = [f"{prefix}_year"], [instant]
        path = f"{root}/{field.name}"
        write_model(df, path, parts, sort_by=order)
        stored[field.name] = store.spark.read.parquet(path)
    return StoreTables(**stored)


def main() -> None:
    spark = local_session("bench", CPUS)
    # One file holds few bytes here; let all cores read it.
    spark.conf.set("spark.sql.files.openCostInBytes", str(256 * 1024))
    store = SampleStore(spark, SF_DIR)
    timings: dict[str, float] = {}

    def timed(name, build, consume=True):
        start = time.perf_counter()
        out = build()
        if consume and isinstance(out, DataFrame):
            run(out)
        timings[name] = round(time.perf_counter() - start, 3)
        return out

    def reference():
        """Work that no change of this repository touches: what its time says of the machine."""
        hashes = spark.range(0, 400_000_000, 1, 8 * CPUS).select(F.xxhash64("id").alias("h"))
        return hashes.groupBy(F.pmod("h", F.lit(1000))).agg(F.max("h"))

    timed("reference_before", reference)
    t = timed("write_models", lambda: write_models(store))

    def lines(tz="Asia/Kolkata"):
        return period.sale_lines(t, *RANGE, tz)

    def lake_lines(make):
        """Raw documents as gzipped lines in which `json` is an object, read back by schema."""
        path = scratch_dir(spark, "bench-lake")
        line = F.concat(F.lit('{"json":'), F.col("json"), F.lit("}"))
        lines = make(store).select(line).repartition(4 * CPUS)
        lines.write.option("compression", "gzip").text(path)
        return spark.read.schema(ORDER_OBJECT_LINES).option("mode", "FAILFAST").json(path)

    raw_orders = timed("write_order_lines", lambda: lake_lines(order_documents), consume=False)
    raw_sales = timed("write_sale_lines", lambda: lake_lines(sale_documents), consume=False)

    def sales_items():
        return ingest.sales_items_model(ingest.orders_model(ingest.parse_orders(raw_sales)))

    cases = {
        "pnl_day": lambda: period.period_pnl(t, "date", *RANGE, "Asia/Kolkata"),
        "pnl_month": lambda: period.period_pnl(t, "month", *RANGE, "Asia/Kolkata"),
        "pnl_month_corrected": lambda: period.period_pnl(
            t, "month", *RANGE, "Asia/Kolkata", "corrected"
        ),
        "pnl_by_variant": lambda: period.period_pnl(t, "variant_id", *RANGE),
        "order_page": lambda: orders.order_page(t, *RANGE),
        "order_page_by_profit": lambda: orders.order_page(
            t, *RANGE, order_by=[("gross_profit", "desc")]
        ),
        "order_page_export": lambda: orders.order_page_export(t, *RANGE),
        "order_summary_country": lambda: orders.order_summary(t, *RANGE, "shipping_country"),
        "order_filter_values": lambda: orders.order_filter_values(t.orders),
        "distinct_split": lambda: rollups.distinct_totals(lines(), ["date"]),
        "distinct_direct": lambda: rollups.distinct_totals_direct(lines(), ["date"]),
        "contains_join": lambda: lookups.with_order_shipping(lines(), t.order_shipping),
        "ingest_orders": lambda: ingest.orders_model(ingest.parse_orders(raw_orders)),
        "ingest_sales_items": sales_items,
    }
    for name, build in cases.items():
        timed(name, build)
    timed("reference_after", reference)
    # Not headline queries: the preparation, the fixed job, and a direct form that is there to compare with.
    headline = [n for n in timings if not n.startswith(("write_", "reference_")) and n != "distinct_direct"]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings[n] for n in headline), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
