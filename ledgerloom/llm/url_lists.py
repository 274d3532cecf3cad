"""Temporal URL lists: dated entries become validity intervals, captures are judged as of their fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of a URL with a scheme, without user, port and final dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and every domain above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals in which entries hold: list, domain, rule, valid_from, valid_to (exclusive, null: open).

    `entries`: list, domain, rule (block or allow), action (add or remove), at. An entry holds from an add
    to the next event of the same list, domain and rule; of events of one day the removal counts.
    Rows with a null in any of these are left out, repeated ones count once.
    """
    key = ["list", "domain", "rule"]
    events = entries.select(*key, "action", "at").dropna().withColumn("domain", F.lower("domain"))
    events = events.groupBy(*key, "at").agg(F.max("action").alias("action"))  # remove comes after add
    until = F.lead("at").over(Window.partitionBy(*key).orderBy("at"))
    return events.withColumn("valid_to", until).where(F.col("action") == "add").select(*key, F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, intervals: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """All rows of `captures` with host, blocked, domain, n_active, lists as of each row's fetch.

    Of the entries active then for the host or a domain above it, the one with the most labels decides,
    then the latest, then a block. Without one, or without a host or a time, a capture isn't blocked.
    `n_active` counts the active entries, `lists` names their lists. Columns of `captures` of these
    names are replaced. Each host and time is judged once, before the captures are joined.
    """
    rows = captures.withColumn("host", host_of(F.col(url_col)))
    asked = rows.where(F.col("host").isNotNull() & F.col(time_col).isNotNull()).select("host", F.col(time_col).alias("asked")).distinct()
    domains = asked.withColumn("domain", F.explode(suffixes(F.col("host"))))
    active = (F.col("valid_from") <= F.col("asked")) & (F.col("valid_to").isNull() | (F.col("asked") < F.col("valid_to")))
    found = domains.join(intervals, "domain").where(active)
    weight = F.struct(
        F.size(F.split("domain", r"\.")).alias("labels"), F.col("valid_from"), (F.col("rule") == "block").alias("blocked"), F.col("domain").alias("domain")
    )
    verdicts = found.groupBy("host", "asked").agg(
        F.max(weight).alias("w"), F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists")
    )
    verdicts = verdicts.select(
        F.col("host").alias("__host"),
        F.col("asked").alias("__asked"),
        F.col("w.blocked").alias("blocked"),
        F.col("w.domain").alias("domain"),
        "n_active",
        "lists",
    )
    kept = [c for c in rows.columns if c not in ("blocked", "domain", "n_active", "lists")]
    joined = rows.select(kept).join(verdicts, (F.col("host") == F.col("__host")) & (F.col(time_col) == F.col("__asked")), "left")
    return joined.select(
        *kept,
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
        "domain",
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.coalesce("lists", F.lit("")).alias("lists"),
    )


# ---- lists and fetch days derived from the pages ----


def _byte(text: Column, place: int) -> Column:
    return F.ascii(F.substring(F.md5(text.cast("binary")), place, 1))


def _day(text: Column, place: int) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (_byte(text, place) * 37 + _byte(text, place + 1) * 11) % 366)


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch day that follows from their id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched"))


def page_lists(pages: DataFrame) -> DataFrame:
    """Dated entries about the pages' hosts and domains; days follow from a hash of the name."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where(F.col("host").isNotNull()).distinct()
    domains = hosts.select(F.substring_index("host", ".", -2).alias("domain")).distinct()
    h, d = F.col("host"), F.col("domain")

    def entry(frame: DataFrame, name: str, of: Column, rule: str, action: str, at: Column) -> DataFrame:
        return frame.select(F.lit(name).alias("list"), of.alias("domain"), F.lit(rule).alias("rule"), F.lit(action).alias("action"), at.alias("at"))

    return (
        entry(hosts, "malware", h, "block", "add", _day(h, 1))
        .union(entry(hosts, "malware", h, "block", "remove", F.date_add(_day(h, 1), _byte(h, 3) % 90 + 1)))
        .union(entry(hosts, "malware", h, "block", "add", F.date_add(_day(h, 1), _byte(h, 3) % 90 + 60)))
        .union(entry(hosts, "trusted", h, "allow", "add", _day(h, 5)))
        .union(entry(hosts, "trusted", h, "allow", "remove", _day(h, 7)))
        .union(entry(domains, "spam", d, "block", "add", _day(d, 1)))
    )
