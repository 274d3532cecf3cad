"""Lookup joins that attach settings and costs to sale entries and fulfillments.

`scope` names the columns that identify a store (for example `["tenant_id"]`). It is empty when the
input holds a single store, and part of every lookup key when one job covers many.

No lookup carries a broadcast hint but that of a counted, small set of ids. Spark broadcasts a side when its size is below
`spark.sql.autoBroadcastJoinThreshold` (from statistics, or from the shuffled size under adaptive
execution) and otherwise sort-merges, where adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import exact_parts
from ledgerloom.session import broadcasts, stored

EVERY_REGION = "All Regions"
NO_SCOPE: tuple[str, ...] = ()
# Runs of an id this short are in so many names that they are spread over shares.
HOT_LENGTH = 2
HOT_SALTS = 32
# Most pieces of a name are this short, and few ids are: these ids are joined apart, and broadcast up to so many rows.
SHORT_LENGTH = 4
SHORT_IDS = 1 << 14
SHORT_COSTS = 1 << 18


def with_settings(df: DataFrame, settings: DataFrame, scope: Sequence[str] = NO_SCOPE) -> DataFrame:
    """Add the store's settings row as struct column `settings`; NULL where a store has none.

    One row per store counts. Should a table hold several, the least one is taken, so that repeated
    runs agree. Without a scope the row is a scalar subquery: no join is planned at all.
    """
    fields = [c for c in settings.columns if c not in scope]
    row = F.min(F.struct(*fields)).alias("settings")
    if not scope:
        return df.withColumn("settings", settings.agg(row).scalar())
    return df.join(settings.groupBy(*scope).agg(row), list(scope), "left")


def setting_columns() -> dict[str, Column]:
    return {
        "margin_pct": F.col("settings.margin_pct"),
        "default_shipping": F.col("settings.shipping_margin"),
        "default_return": F.col("settings.return_margin"),
    }


def _left_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_over: Sequence[str],
    needed: Column | None = None,
) -> DataFrame:
    """Left join on `keys` (same names on both sides) that never piles up rows without a match.

    Rows whose first key is NULL, or that `needed` rules out, cannot match. If the join shuffles, an
    ordinary key would send all of them to one task. They get one of 4096 placeholder keys instead,
    by a hash of `spread_over`, and the join condition still keeps them from matching anything.
    """
    first = keys[0]
    wanted = F.col(first).isNotNull() if needed is None else needed & F.col(first).isNotNull()
    slot = F.pmod(F.xxhash64(*spread_over), F.lit(4096)).cast("string")
    left = left.withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
    left = left.withColumn(
        "_key", F.when(F.col("_wanted"), F.col(first)).otherwise(F.concat(F.lit("none-"), slot))
    )
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.col("_wanted") & (F.col("_key") == F.col(f"_right_{first}"))
    for key in keys[1:]:
        on = on & (F.col(key) == F.col(f"_right_{key}"))
    return left.join(right, on, "left").drop("_wanted", "_key", *[f"_right_{k}" for k in keys])


def with_product_costs(
    items: DataFrame, costs: DataFrame, scope: Sequence[str] = NO_SCOPE, spread_over: Sequence[str] = ("order_id", "sale_id")
) -> DataFrame:
    """Add `cost_variant_id`, `variant_cost` and `packing_fee`; duplicate variants fan out."""
    lookup = costs.select(
        *scope,
        "variant_id",
        F.col("variant_id").alias("cost_variant_id"),
        F.col("product_cost").alias("variant_cost"),
        "packing_fee",
    )
    return _left_lookup(items, lookup, ["variant_id", *scope], spread_over)


def shipping_table(entries: DataFrame, scope: Sequence[str] = NO_SCOPE) -> DataFrame:
    """First entry per country and region of a shipping cost table, by its `position`."""
    first = F.min_by(F.struct("shipping_cost", "return_cost"), F.col("position")).alias("first")
    return (
        entries.groupBy(*scope, "country_code", "region")
        .agg(first)
        .select(*scope, "country_code", "region", "first.shipping_cost", "first.return_cost")
    )


def with_region_shipping(
    items: DataFrame,
    entries: DataFrame,
    scope: Sequence[str] = NO_SCOPE,
    needed: Column | None = None,
) -> DataFrame:
    """Add the costs of the order's region and of its country as a whole.

    Columns: `region_shipping`, `region_return`, `region_found` and the same for `everywhere_`.
    Rows outside `needed` are left without.
    """
    table = shipping_table(entries, scope)

    def side(prefix: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.select(
            *keys,
            F.col("shipping_cost").alias(f"{prefix}_shipping"),
            F.col("return_cost").alias(f"{prefix}_return"),
            F.lit(True).alias(f"{prefix}_found"),
        )

    by_region = side(
        "region",
        table.withColumnRenamed("region", "province_code"),
        ["country_code", "province_code", *scope],
    )
    whole = side(
        "everywhere", table.where(F.col("region") == EVERY_REGION), ["country_code", *scope]
    )
    spread = ["order_id"]
    joined = _left_lookup(
        items, by_region, ["country_code", "province_code", *scope], spread, needed
    )
    joined = _left_lookup(joined, whole, ["country_code", *scope], spread, needed)
    return joined.fillna(False, ["region_found", "everywhere_found"])


def with_region_shipping_from_list(items: DataFrame, listed: DataFrame) -> DataFrame:
    """The same columns from the one-row list form of the table, by filtering the list per line."""
    country, region = F.col("country_code"), F.col("province_code")
    rows = listed.agg(F.min("entries").alias("entries")).scalar()
    items = items.withColumn("_entries", rows)
    here = F.filter("_entries", lambda e: e["country_code"] == country)
    by_region = F.get(F.filter(here, lambda e: e["region"] == region), F.lit(0))
    whole = F.get(F.filter(here, lambda e: e["region"] == EVERY_REGION), F.lit(0))
    columns = {}
    for prefix, entry in (("region", by_region), ("everywhere", whole)):
        columns[f"{prefix}_shipping"] = entry["shipping_cost"]
        columns[f"{prefix}_return"] = entry["return_cost"]
        columns[f"{prefix}_found"] = entry.isNotNull()
    return items.withColumns(columns).drop("_entries")


def _literal_part(order_id: Column) -> Column:
    """Longest run of an id that holds no LIKE wildcard; the whole id when it holds none."""
    runs = F.split(order_id, "[%_]")
    return F.aggregate(
        runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best)
    )


def order_name_matches(
    names: DataFrame, shipping: DataFrame, scope: Sequence[str] = NO_SCOPE
) -> DataFrame:
    """All (order_name, linked_order_id, linked_shipping) with order_name LIKE '%' || id || '%'.

    A contains-join has no equality key, so Spark could only nest loops over it. Here each name is
    expanded to its distinct substrings of the lengths that occur among the ids, which gives an
    equality key on the longest wildcard-free run of an id. Ids with wildcards are then verified with
    LIKE. Names are short, so the expansion is a small multiple of the distinct names.

    Equal ids with wildcards are verified once, with a list of their costs.

    Runs of up to SHORT_LENGTH characters are joined apart. Most pieces of a name are that short, but there are
    only so many such ids, unless many stores or rows share them. They are stored and counted first, and up to
    SHORT_IDS of them with SHORT_COSTS costs are broadcast; then only the names' longer pieces are shuffled.
    """
    ids = shipping.where(F.col("order_id").isNotNull()).select(
        *scope, F.col("order_id").alias("linked_order_id"), F.col("shipping_cost").alias("linked_shipping")
    )
    ids = stored(ids, "shipping-ids").withColumns(
        {"_part": _literal_part(F.col("linked_order_id")), "_wild": F.col("linked_order_id").rlike("[%_]")}
    )
    cost = F.struct("linked_shipping")
    keys = [*scope, "linked_order_id", "_part", "_wild"]
    plain = ids.where(~F.col("_wild")).select(*keys, F.array(cost).alias("_costs"))
    ids = plain.union(ids.where("_wild").groupBy(*keys).agg(F.collect_list(cost).alias("_costs")))
    distinct = names.where(F.col("order_name").isNotNull()).select(*scope, "order_name").distinct()
    # Names are few bytes and many pieces: by size they would be merged into a task or two. (By the name itself the
    # exchange would be left out, being that of the distinct.)
    partitions = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = distinct.repartition(partitions, F.xxhash64("order_name"))
    short = F.length("_part") <= SHORT_LENGTH
    if not broadcasts(names.sparkSession):
        return _name_matches(distinct, ids, scope)
    few = stored(ids.where(short), "short-ids")
    held = few.agg(F.count("*").alias("ids"), F.coalesce(F.sum(F.size("_costs")), F.lit(0)).alias("costs")).first()
    if held.ids > SHORT_IDS or held.costs > SHORT_COSTS:
        return _name_matches(distinct, ids, scope)
    long = _name_matches(distinct, ids.where(~short), scope)
    return _name_matches(distinct, few, scope, F.broadcast).union(long)


def _name_matches(
    names: DataFrame, ids: DataFrame, scope: Sequence[str], hint: Callable[[DataFrame], DataFrame] = lambda ids: ids
) -> DataFrame:
    """`order_name_matches` of distinct names, by the run `_part` of each id.

    An id such as `1`, or one of wildcards alone, is held by nearly every name. In case the ids are not broadcast,
    runs of up to HOT_LENGTH characters are spread: a name's piece goes to one of HOT_SALTS shares by the name's
    hash, and the id to all of them. Longer runs that many names share are split by adaptive execution.

    Pieces that begin with a character no run begins with match nothing and are left out.
    """
    shares = F.when(F.length("_part") <= HOT_LENGTH, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    lengths = F.array_sort(F.collect_set(F.length("_part"))).alias("lengths")
    firsts = F.collect_set(F.substring("_part", 1, 1)).alias("firsts")
    name = F.col("order_name")

    def pieces(length: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(name) - length + 1)
        cut = F.transform(starts, lambda at: F.substring(name, at, length))
        cut = F.filter(cut, lambda piece: F.array_contains("_runs.firsts", F.substring(piece, 1, 1)))
        return F.when(F.length(name) >= length, cut).otherwise(F.array().cast("array<string>"))

    substrings = F.array_distinct(F.flatten(F.transform("_runs.lengths", pieces)))
    expanded = (
        names.withColumn("_runs", ids.agg(F.struct(lengths, firsts)).scalar())
        .select(*scope, "order_name", F.explode(substrings).alias("_part"))
        .withColumn("_share", F.when(F.length("_part") <= HOT_LENGTH, F.pmod(F.xxhash64("order_name"), F.lit(HOT_SALTS)).cast("int")).otherwise(F.lit(0)))
    )
    escaped = F.replace(F.col("linked_order_id"), F.lit("\\"), F.lit("\\\\"))
    like = F.like(name, F.concat(F.lit("%"), escaped, F.lit("%")))
    return (
        expanded.join(hint(ids.withColumn("_share", F.explode(shares))), [*scope, "_part", "_share"])
        .where(F.when(F.col("_wild"), like).otherwise(F.lit(True)))
        .select(*scope, "order_name", "linked_order_id", F.inline("_costs"))
    )


def with_order_shipping(
    items: DataFrame,
    shipping: DataFrame,
    scope: Sequence[str] = NO_SCOPE,
    method: str = "contains",
    names: DataFrame | None = None,
    counted: bool = False,
    spread_over: Sequence[str] = ("sale_id",),
) -> DataFrame:
    """Add `linked_order_id` and `linked_shipping`, the shipping cost linked to the order.

    `contains` repeats a line for every linked id found inside its order name (`#1001` holds both
    1001 and 100). `exact` matches the number after `#` only. `names` are rows with the same order names
    that are cheaper to read, such as the items before other lookups.

    With `counted` a line stays one row, for what sums it. It gets the columns of `LINKED` instead: how many rows it
    would be, how many of these have a cost, and the exact parts of the costs' sum.
    """
    if method == "contains":
        # Matches are few unless most orders have a cost of their own. Their size is unknown before
        # they are computed, so they are stored first: a small set is then broadcast and the sale
        # entries are not shuffled at all.
        pairs = order_name_matches(items if names is None else names, shipping, scope)
        pairs = stored(linked_costs(pairs, ["order_name", *scope]) if counted else pairs, "order-shipping")
        return _with_linked(items, pairs, ["order_name", *scope], spread_over, counted)
    ids = shipping.select(
        *scope,
        F.col("order_id").alias("linked_order_id"),
        F.col("shipping_cost").alias("linked_shipping"),
    )
    if method == "exact":
        keyed = items.withColumn("_number", F.regexp_replace("order_name", "^#", ""))
        numbered = ids.withColumn("_number", F.col("linked_order_id"))
        if counted:
            numbered = linked_costs(numbered, ["_number", *scope])
        return _with_linked(keyed, numbered, ["_number", *scope], spread_over, counted).drop("_number")
    raise ValueError(f"unknown method {method!r}")


#: What `linked_costs` gives of a name's linked costs.
LINKED = ("linked_rows", "linked_known", "linked_whole", "linked_rest")


def linked_costs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each name: its linked rows, those with a cost, and the exact parts of these costs' sum.

    The parts are NULL where a cost doesn't fit, which is no error unless a line sums it.
    """
    whole, rest = exact_parts(F.col("linked_shipping"), raising=False)
    fit = F.count(whole) == F.count("linked_shipping")
    values = (F.count("*"), F.count("linked_shipping"), F.when(fit, F.try_sum(whole)), F.when(fit, F.try_sum(rest)))
    return pairs.groupBy(*keys).agg(*[v.cast("long").alias(name) for name, v in zip(LINKED, values, strict=True)])


def _with_linked(items: DataFrame, pairs: DataFrame, keys: list[str], spread_over: Sequence[str], counted: bool) -> DataFrame:
    joined = _left_lookup(items, pairs, keys, spread_over)
    # a line without a match is one row too
    return joined.fillna({"linked_rows": 1, "linked_known": 0}) if counted else joined
