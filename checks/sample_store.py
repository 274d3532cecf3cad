"""Store models derived from the TPC-H-like test tables, column by column.

Every table grows with its source. The same derivations are written as SQL in `checks/oracle.py`.
Days of the event stream are moved back so that ads overlap the sales; Google starts five days after
the other sources, which leaves days with some ads but none of Google's.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.timekeys import utc_parts, with_day_keys
from ledgerloom.plans.tables import StoreTables

SETTINGS_SQL = """
SELECT 40D AS margin_pct, 6.5D AS shipping_margin, 3D AS return_margin,
       true AS exclude_returned_cost, 'variablePricing' AS pricing,
       array(
         named_struct('fulfillment_base', 2D, 'fulfillment_additional', 0.5D,
                      'packaging_base', 1D, 'packaging_additional', 0.25D,
                      'min_units', 0, 'max_units', 5),
         named_struct('fulfillment_base', 3D, 'fulfillment_additional', 0.4D,
                      'packaging_base', 1.5D, 'packaging_additional', 0.2D,
                      'min_units', 5, 'max_units', 9),
         named_struct('fulfillment_base', 5D, 'fulfillment_additional', 0.3D,
                      'packaging_base', 2D, 'packaging_additional', 0.1D,
                      'min_units', 10, 'max_units', 9999999)
       ) AS tiers
"""


class SampleStore:
    """Lazily built tables; each is planned once per store object."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    @cache
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cache
    def orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        order = self.table("orders").select(
            "o_custkey",
            "o_orderkey",
            "o_totalprice",
            "o_orderstatus",
            key.cast("string").alias("order_id"),
            F.concat(F.lit("#"), key.cast("string")).alias("order_name"),
            _after(F.col("o_orderdate").cast("timestamp"), (key * 37) % 86400).alias(
                "order_created_at"
            ),
            F.when(key % 10 != 9, (1 + key % 3).cast("int")).alias("customer_order_index"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.concat(F.lit("P"), (F.col("o_custkey") % 3).cast("string")).alias("province_code"),
            F.when(F.col("o_custkey") % 3 != 2, F.concat(F.lit("Province "), F.col("o_custkey") % 3))
            .alias("province"),
            F.concat(F.lit("City "), F.col("o_custkey") % 40).alias("shipping_city"),
            (1 + (key % 5) / 10).alias("fx_rate"),
            F.concat(F.lit('["gateway-'), key % 4, F.lit('"]')).alias("payment_gateways"),
            F.when(key % 5 == 0, "EUR").otherwise("USD").alias("presentment_currency"),
            F.when(F.col("o_orderstatus") == "F", "PAID").otherwise("PENDING").alias(
                "financial_status"
            ),
            F.when(F.col("o_orderstatus") == "O", "UNFULFILLED").otherwise("FULFILLED").alias(
                "fulfillment_status"
            ),
            F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("Carrier "), key % 3)).alias(
                "first_carrier"
            ),
            "o_orderpriority",
        )
        customer = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", "c_mktsegment"
        )
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        joined = order.join(customer, "o_custkey").join(nation, "c_nationkey")
        return joined.select(
            *[c for c in order.columns if c not in ("o_orderpriority",)],
            F.col("c_mktsegment").alias("tenant_id"),
            F.col("c_name").alias("customer_name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("customer_email"),
            F.col("n_name").alias("country_code"),
            F.col("n_name").alias("shipping_country"),
            F.concat(
                F.lit('["'), "o_orderpriority", F.lit('","'), "c_mktsegment", F.lit('"]')
            ).alias("tags"),
        ).withColumns(utc_parts("order_created_at", "created"))

    @cache
    def sales(self) -> DataFrame:
        order = self.orders().select(
            "o_orderkey", "order_id", "order_name", "order_created_at", "customer_order_index",
            "customer_id", "country_code", "province_code", "fx_rate", "tenant_id",
        )
        # joined before anything is derived, as the tables' own columns are fewer bytes to shuffle
        line = self.table("lineitem").join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        number = F.col("l_linenumber")
        is_return = F.col("l_returnflag") == "R"
        sign = F.when(is_return, F.lit(-1)).otherwise(F.lit(1))
        kept = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        return line.select(
            F.concat_ws("-", F.col("l_orderkey"), number, F.col("l_partkey"), F.col("l_suppkey"))
            .alias("sale_id"),
            F.when(number == 7, "SHIPPING").when(number == 6, "GIFT_CARD").otherwise("PRODUCT")
            .alias("line_type"),
            F.when(is_return, "RETURN").otherwise("ORDER").alias("action_type"),
            (sign * F.col("l_quantity").cast("int")).alias("quantity"),
            F.when(F.col("l_partkey") % 17 != 0, F.col("l_partkey").cast("string")).alias(
                "variant_id"
            ),
            F.concat(F.lit("Item "), F.col("l_partkey")).alias("product_name"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.col("l_tax").alias("tax_rate_sum"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_before_taxes"),
            (sign * kept * F.col("l_tax")).alias("total_tax"),
            (sign * kept * (1 + F.col("l_tax"))).alias("total_amount"),
            _after(
                F.col("l_shipdate").cast("timestamp"),
                (F.col("l_orderkey") * 53 + number * 3601) % 86400,
            ).alias("happened_at"),
            *[c for c in order.columns if c != "o_orderkey"],
        )

    @cache
    def transactions(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.orders().select(
            "order_id",
            "order_created_at",
            "fx_rate",
            "tenant_id",
            _after(F.col("order_created_at"), key % 90000).alias("transaction_at"),
            F.when(key % 4 == 3, "REFUND").otherwise("SALE").alias("kind"),
            F.when(key % 10 == 0, "CARD_DECLINED").alias("error_code"),
            (F.col("o_totalprice") * 0.029 + 0.3).alias("amount"),
        )

    @cache
    def fulfillments(self) -> DataFrame:
        key = F.col("o_orderkey")
        shipped = self.orders().where(F.col("o_orderstatus") != "O")
        return shipped.select(
            "order_id",
            "order_name",
            "order_created_at",
            "tenant_id",
            F.concat(F.lit("F"), key).alias("resource_id"),
            (1 + key % 12).cast("int").alias("total_quantity"),
            _after(F.col("order_created_at"), 3600 + key % 200000).alias("fulfilled_at"),
        )

    def _events(self, kinds: list[str], shift: int) -> DataFrame:
        events = self.table("events").where(F.col("event_type").isin(kinds))
        day = F.date_sub(F.col("ts").cast("date"), shift)
        return with_day_keys(events.withColumn("snapshot_date", day), "snapshot_date")

    @cache
    def google_ads(self) -> DataFrame:
        return self._events(["click"], 10222).select(
            (F.col("value") * 1000000).alias("cost_micros"),
            (F.col("user_id") % 7).cast("double").alias("clicks"),
            (F.col("user_id") % 3).cast("double").alias("conversions"),
            "date", "month", "year", "week", _tenant_of_user(),
        )

    @cache
    def tiktok_ads(self) -> DataFrame:
        return self._events(["view"], 10227).select(
            F.col("value").alias("spend"),
            F.when(F.col("user_id") % 9 != 0, (F.col("user_id") % 7).cast("double")).alias("clicks"),
            (F.col("user_id") % 2).cast("double").alias("conversion"),
            "date", "month", "year", "week", _tenant_of_user(),
        )

    @cache
    def meta_ads(self) -> DataFrame:
        bought = F.struct(
            F.lit("purchase").alias("action_type"),
            (F.col("user_id") % 4).cast("string").alias("value"),
        )
        clicked = F.struct(F.lit("link_click").alias("action_type"), F.lit("9").alias("value"))
        actions = F.when(
            F.col("event_type") == "purchase", F.array(bought, clicked)
        ).otherwise(F.array(clicked))
        return self._events(["signup", "purchase", "error"], 10227).select(
            F.col("value").alias("spend"),
            (F.col("user_id") % 7).cast("double").alias("clicks"),
            actions.alias("actions"),
            "date", "month", "year", "week", _tenant_of_user(),
        )

    def raw_schedule(self) -> DataFrame:
        """Scheduled expenses as the lake holds them, all text."""
        key = F.col("s_suppkey")
        start = F.date_add(F.lit("1995-01-01").cast("date"), ((key * 97) % 2400).cast("int"))
        end = F.date_add(start, ((key * 31) % 900).cast("int"))
        often = F.array(*[F.lit(x) for x in
                          ("Monthly", "Weekly", "Yearly", "Daily", "Just Once", "Quarterly")])
        tags = F.array(*[F.lit(x) for x in
                         ("staff-costs", "marketing-expenses", "operational-expenses", None)])
        return self.table("supplier").select(
            key.cast("string").alias("Id"),
            F.col("s_name").alias("ExpenseName"),
            F.lit("ACTIVE").alias("Status"),
            F.lit("general").alias("Category"),
            F.col("s_acctbal").cast("string").alias("Cost"),
            F.get(often, (key % 6).cast("int")).alias("Frequency"),
            F.get(tags, F.col("s_nationkey") % 4).alias("Tags"),
            start.cast("string").alias("StartDate"),
            F.when(key % 3 == 0, "").otherwise(end.cast("string")).alias("EndDate"),
        )

    @cache
    def schedule(self) -> DataFrame:
        from ledgerloom.operators.ingest_settings import cost_schedule_model

        return cost_schedule_model(self.raw_schedule())

    @cache
    def product_costs(self) -> DataFrame:
        key = F.col("p_partkey")
        known = self.table("part").where(F.col("p_brand") != "Brand#11")
        return known.select(
            key.cast("string").alias("variant_id"),
            F.when(key % 13 == 0, F.lit(None).cast("double"))
            .when(key % 13 == 1, F.lit(0.0))
            .otherwise(F.col("p_retailprice") * 0.4)
            .alias("product_cost"),
            F.when(F.col("p_size") % 4 != 0, F.col("p_size") / 10).alias("packing_fee"),
        )

    @cache
    def shipping_entries(self) -> DataFrame:
        region = self.table("region").where(F.col("r_name") != "AFRICA")
        nation = self.table("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        sides = F.array(
            F.struct(F.lit("P0").alias("region"), F.lit(1).alias("extra")),
            F.struct(F.lit("All Regions").alias("region"), F.lit(2).alias("extra")),
        )
        rows = nation.select("n_name", "n_nationkey", F.inline(sides))
        cost = (F.col("n_nationkey") + F.col("extra")).cast("double")
        return rows.select(
            F.col("n_name").alias("country_name"),
            "region",
            F.col("n_name").alias("country_code"),
            cost.alias("shipping_cost"),
            (cost / 2).alias("return_cost"),
            (F.col("n_nationkey") * 2 + F.col("extra")).alias("position"),
        )

    @cache
    def order_shipping(self) -> DataFrame:
        """A shipping cost agreed for each order; ids are parts of other ids, so lines fan out widely."""
        return self.every_order_shipping().drop("o_totalprice")

    @cache
    def every_order_shipping(self, wildcards: bool = False) -> DataFrame:
        """A shipping cost for each order, so that names hold many ids; dear orders may have wildcards."""
        key = F.col("o_orderkey").cast("string")
        order_id = key
        if wildcards:
            first = F.substring(key, 1, 1)
            order_id = (
                F.when(F.col("o_totalprice") >= 499000, F.concat(first, F.lit("%"), F.right(key, F.lit(2))))
                .when(F.col("o_totalprice") >= 498000, F.concat(F.lit("_"), F.right(key, F.lit(3))))
                .otherwise(key)
            )
        return self.table("orders").select(
            "o_totalprice",
            order_id.alias("order_id"),
            (F.col("o_orderkey") % 23).cast("double").alias("shipping_cost"),
        )

    @cache
    def settings(self) -> DataFrame:
        return self.spark.sql(SETTINGS_SQL)

    @cache
    def tables(self) -> StoreTables:
        return StoreTables(
            orders=self.orders(),
            sales=self.sales(),
            transactions=self.transactions(),
            fulfillments=self.fulfillments(),
            google_ads=self.google_ads(),
            tiktok_ads=self.tiktok_ads(),
            meta_ads=self.meta_ads(),
            schedule=self.schedule(),
            product_costs=self.product_costs(),
            order_shipping=self.order_shipping(),
            shipping_entries=self.shipping_entries(),
            settings=self.settings(),
        )


STORES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
#: Zones on both sides of Greenwich, with and without daylight saving, one of them half an hour off.
#: MACHINERY has none, so it is in UTC.
ZONES = {
    "AUTOMOBILE": "America/New_York",
    "BUILDING": "Europe/Dublin",
    "FURNITURE": "Asia/Kolkata",
    "HOUSEHOLD": "Australia/Lord_Howe",
}


def all_stores(store: SampleStore) -> StoreTables:
    """The same tables split over five stores, each with lookups and a margin of its own."""
    every = F.explode(F.array(*[F.lit(n) for n in STORES])).alias("tenant_id")
    owners = store.orders().select("order_id", "tenant_id")
    margins = (
        store.table("customer")
        .select(F.col("c_mktsegment").alias("tenant_id"))
        .distinct()
        .withColumn("own_margin", (30 + F.length("tenant_id")).cast("double"))
    )
    shared = store.settings().drop("margin_pct")
    row = shared.agg(F.min(F.struct("*"))).scalar()
    settings = margins.withColumn("shared", row).select(
        "tenant_id", F.col("own_margin").alias("margin_pct"), "shared.*"
    )
    schedule = store.schedule().withColumn(
        "tenant_id",
        F.get(F.array(*[F.lit(n) for n in STORES]), (F.col("id").cast("int") % 5)),
    )
    return replace(
        store.tables(),
        schedule=schedule,
        product_costs=store.product_costs().select(every, "*"),
        order_shipping=store.order_shipping().join(owners, "order_id"),
        shipping_entries=store.shipping_entries().select(every, "*"),
        settings=settings,
        scope=("tenant_id",),
    )


def _after(instant: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(instant) + seconds * 1000000)


def _tenant_of_user() -> Column:
    store = F.get(F.array(*[F.lit(n) for n in STORES]), (F.col("user_id") % 5).cast("int"))
    return store.alias("tenant_id")


def _iso(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _money(amount: Column, currency: Column | None = None) -> Column:
    text = amount.cast("string").alias("amount")
    code = (F.lit("USD") if currency is None else currency).alias("currencyCode")
    return F.struct(text, code)


def _shop(amount: Column) -> Column:
    return F.struct(_money(amount).alias("shopMoney"))


def order_documents(store: SampleStore) -> DataFrame:
    """Raw order documents as JSON text, one per order, with shipments and payments inside."""
    key = F.col("o_orderkey")
    created = F.col("order_created_at")
    shipment = F.struct(
        F.concat(F.lit("F"), key).alias("legacyResourceId"),
        _iso(_after(created, 3600 + key % 200000)).alias("createdAt"),
        (1 + key % 12).alias("totalQuantity"),
        F.array(F.struct(F.col("first_carrier").alias("company"))).alias("trackingInfo"),
    )
    fee = F.struct(_money(F.col("o_totalprice") * 0.029 + 0.3).alias("amount"))
    flat = F.struct(_money(F.lit(0.25), F.lit("EUR")).alias("amount"))
    payment = F.struct(
        F.concat(F.lit("T"), key).alias("id"),
        _iso(_after(created, key % 90000)).alias("createdAt"),
        F.when(key % 10 == 0, "CARD_DECLINED").alias("errorCode"),
        F.when(key % 4 == 3, "REFUND").otherwise("SALE").alias("kind"),
        F.lit("Card").alias("formattedGateway"),
        F.when(key % 7 == 0, F.array())
        .when(key % 7 == 1, F.array(fee, flat))
        .otherwise(F.array(fee))
        .alias("fees"),
    )
    document = F.struct(
        F.col("order_id").alias("id"),
        F.col("order_name").alias("name"),
        _iso(created).alias("createdAt"),
        F.struct(F.col("customer_order_index").alias("customerOrderIndex")).alias(
            "customerJourneySummary"
        ),
        F.struct(
            F.col("customer_id").alias("id"),
            F.col("customer_name").alias("displayName"),
            F.split_part("customer_name", F.lit("#"), F.lit(1)).alias("firstName"),
            F.split_part("customer_name", F.lit("#"), F.lit(2)).alias("lastName"),
            F.col("customer_email").alias("email"),
        ).alias("customer"),
        F.struct(
            _money(F.col("o_totalprice")).alias("shopMoney"),
            _money(
                F.when(key % 8 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / 2),
                F.col("presentment_currency"),
            ).alias("presentmentMoney"),
        ).alias("totalReceivedSet"),
        F.when(F.col("o_orderstatus") != "O", F.array(shipment)).otherwise(F.array()).alias(
            "fulfillments"
        ),
        F.array(payment).alias("transactions"),
        F.array(F.struct(F.lit("none").alias("note"))).alias("refunds"),
        F.from_json("payment_gateways", "array<string>").alias("paymentGatewayNames"),
        F.from_json("tags", "array<string>").alias("tags"),
        F.col("fulfillment_status").alias("displayFulfillmentStatus"),
        F.col("financial_status").alias("displayFinancialStatus"),
        F.struct(
            F.col("country_code").alias("countryCode"),
            F.col("province_code").alias("provinceCode"),
            "province",
            F.col("shipping_city").alias("city"),
            F.col("shipping_country").alias("country"),
        ).alias("shippingAddress"),
    )
    return store.orders().select(
        F.col("tenant_id").alias("tenantid"),
        F.date_format("order_created_at", "yyyy-MM-dd").alias("date"),
        F.to_json(document).alias("json"),
    )


def sale_documents(store: SampleStore) -> DataFrame:
    """Raw order documents that hold one agreement each, one document per sale entry.

    Entries of more than 25 units carry a second sale, an adjustment without a line item. Untaxed
    entries have an empty list of tax lines, others two.
    """
    rate = F.col("tax_rate_sum")
    line_item = F.struct(
        F.col("product_name").alias("name"),
        F.when(
            F.col("variant_id").isNotNull(),
            F.struct(F.col("variant_id").alias("legacyResourceId")),
        ).alias("variant"),
        F.struct(F.concat(F.lit("gid/"), "product_name").alias("id")).alias("product"),
        _shop(F.col("unit_price")).alias("originalUnitPriceSet"),
        F.when(rate == 0, F.array())
        .otherwise(F.array(F.struct(rate.alias("rate")), F.struct(F.lit(0.01).alias("rate"))))
        .alias("taxLines"),
    )

    def sale(kind: Column, ident: Column, quantity: Column, item: Column, factor: float) -> Column:
        return F.struct(
            F.struct(
                ident.alias("id"),
                kind.alias("lineType"),
                F.col("action_type").alias("actionType"),
                quantity.alias("quantity"),
                _shop(F.col("discount_before_taxes") * factor).alias(
                    "totalDiscountAmountBeforeTaxes"
                ),
                _shop(F.col("discount_before_taxes") / 2).alias("totalDiscountAmountAfterTaxes"),
                _shop(F.col("total_tax") * factor).alias("totalTaxAmount"),
                _shop(F.col("total_amount") * factor).alias("totalAmount"),
                item.alias("lineItem"),
            ).alias("node")
        )

    main = sale(F.col("line_type"), F.col("sale_id"), F.col("quantity"), line_item, 1.0)
    none = F.when(F.lit(False), line_item)
    extra = sale(F.lit("ADJUSTMENT"), F.concat("sale_id", F.lit("-x")), F.lit(0), none, 0.5)
    sales = F.when(F.abs("quantity") > 25, F.array(main, extra)).otherwise(F.array(main))
    agreement = F.struct(
        F.struct(
            _iso(F.col("happened_at")).alias("happenedAt"),
            F.struct(sales.alias("edges")).alias("sales"),
        ).alias("node")
    )
    document = F.struct(
        F.col("order_id").alias("id"),
        F.col("order_name").alias("name"),
        _iso(F.col("order_created_at")).alias("createdAt"),
        F.struct(F.col("customer_order_index").alias("customerOrderIndex")).alias(
            "customerJourneySummary"
        ),
        F.struct(F.col("customer_id").alias("id")).alias("customer"),
        F.struct(F.array(agreement).alias("edges")).alias("agreements"),
        F.struct(
            F.col("country_code").alias("countryCode"),
            F.col("province_code").alias("provinceCode"),
        ).alias("shippingAddress"),
    )
    return store.sales().select(
        F.col("tenant_id").alias("tenantid"), F.to_json(document).alias("json")
    )


def store_zones(store: SampleStore) -> DataFrame:
    """Store and zone of the stores that have one."""
    owners = store.table("customer").select(F.col("c_mktsegment").alias("tenant_id")).distinct()
    zone = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])[F.col("tenant_id")]
    return owners.withColumn("time_zone", zone).where(F.col("time_zone").isNotNull())
