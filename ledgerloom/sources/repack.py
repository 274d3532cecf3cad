"""Raw lake lines taken over into even, splittable files.

A gzipped file can't be split, so one large file is one long task in every job that reads it. Here each new
file is read once as lines and its lines are dealt out into files of even size, whatever their number and
sizes were. A ledger says which files have been taken over, so a later run takes the new ones alone.
"""

from __future__ import annotations

import uuid
from datetime import UTC, date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import stored
from ledgerloom.sources.lake import PATH_COLUMNS, between_dates, lake_files

#: Bytes of lines in one packed file, before compression.
FILE_BYTES = 128 << 20
_TAKEN = "run string, file string, size long, changed timestamp"
_LINES = f"line string, file string, {PATH_COLUMNS}, run string"
PATH_NAMES = ["tenantid", "tablename", "date"]
#: Lines take about this many times the size of their gzipped file.
SHRUNK = 10


def _root(root: str) -> str:
    return f"{root.rstrip('/')}/packed"


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def taken(spark: SparkSession, root: str) -> DataFrame:
    """Files that have been taken over, by which run, and their sizes and times then."""
    return _read(spark, _TAKEN, f"{_root(root)}/_taken")


def repack(
    spark: SparkSession,
    root: str,
    table: str,
    tenant: str = "*",
    days: tuple[str | date, str | date] | None = None,
    file_bytes: int = FILE_BYTES,
) -> int:
    """Take over the files of a lake table that are new or have changed; returns their number.

    Lines are kept as they are. The packed files of a run are written first and its entries in the ledger
    last; readers follow the ledger, so a run that is killed is as if it hadn't been. Of a file that has
    changed the lines of its latest run count.
    """
    found = spark.read.format("binaryFile").option("basePath", f"{root.rstrip('/')}/tenants")
    found = found.load(lake_files(root, tenant, table, None, days))
    found = found if days is None else between_dates(found, *days)
    # the content isn't asked for, so nothing is read here but names, sizes and times
    about = F.col("_metadata")
    listed = found.select("path", about.file_path.alias("file"), about.file_size.alias("size"), about.file_modification_time.alias("changed"))
    new = stored(listed.join(taken(spark, root).select("file", "size", "changed"), ["file", "size", "changed"], "left_anti"), "new-files")
    paths = [r.path for r in new.select("path").toLocalIterator()]  # names pass the driver, as for any scan
    if not paths:
        return 0
    # runs sort by time
    run = f"{datetime.now(UTC):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    lines = spark.read.option("basePath", f"{root.rstrip('/')}/tenants").text(paths)
    rows = lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), *PATH_NAMES, F.lit(run).alias("run"))
    size = new.agg(F.sum("size")).first()[0]
    (
        rows.repartition(int(max(1, -(-SHRUNK * size // file_bytes))))
        .sortWithinPartitions("tenantid", "date")
        .write.partitionBy("run")
        .mode("append")
        .option("compression", "zstd")
        .parquet(f"{_root(root)}/lines")
    )
    ledger = new.select(F.lit(run).alias("run"), "file", "size", "changed")
    ledger.hint("rebalance").write.mode("append").parquet(f"{_root(root)}/_taken")
    return len(paths)


def packed_lines(
    spark: SparkSession, root: str, tenant: str, table: str, days: tuple[str | date, str | date] | None = None
) -> DataFrame:
    """Lines of a lake table that have been taken over: line, tenantid, tablename, date."""
    runs = taken(spark, root).groupBy("file").agg(F.max_by("run", F.struct("changed", "run")).alias("run"))
    rows = _read(spark, _LINES, f"{_root(root)}/lines")
    rows = rows.where(F.col("tablename") == table)
    if tenant != "*":
        rows = rows.where(F.col("tenantid") == tenant)
    if days is not None:
        rows = between_dates(rows, *days)
    return rows.join(runs, ["file", "run"], "left_semi").drop("file", "run")


def read_packed(
    spark: SparkSession, root: str, tenant: str, table: str, schema: str, days: tuple[str | date, str | date] | None = None
) -> DataFrame:
    """`read_lake` of lines that have been taken over. A line that doesn't parse raises."""
    lines = packed_lines(spark, root, tenant, table, days)
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("row"), *PATH_NAMES).select("row.*", *PATH_NAMES)
