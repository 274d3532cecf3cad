"""Raw lake: gzipped NDJSON below `tenants/tenantid=T/tablename=X/date=D/`."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.schemas import ORDER_OBJECT_LINES, ORDER_TEXT_LINES

# Partition that holds settings without a history. Not a valid DATE, so `date` stays text.
CURRENT_PARTITION = "9999-99-99"
PATH_COLUMNS = "tenantid string, tablename string, date string"


def read_lake(
    spark: SparkSession,
    root: str,
    tenant: str,
    table: str,
    schema: str,
    partition: str | None = None,
    days: tuple[str | date, str | date] | None = None,
) -> DataFrame:
    """Scan one lake table, with `tenantid`, `tablename` and `date` taken from the path.

    `tenant` may be `*` to read all stores in one job. `days` restricts the scan to a range of date
    partitions; only folders of its months are listed. Each .gz file is one split, so the producer's
    file count sets the parallelism of this stage.
    """
    columns = T.StructType.fromDDL(f"{schema}, {PATH_COLUMNS}")
    raw = (
        spark.read.schema(columns)
        .option("basePath", f"{root.rstrip('/')}/tenants")
        .option("mode", "FAILFAST")
        .json(lake_files(root, tenant, table, partition, days))
    )
    return raw if days is None else between_dates(raw, *days)


def lake_files(root, tenant, table, partition, days) -> str:
    """Pattern of the files of a lake table; of a range of days, those of its months."""
    folders = [f"date={partition or '*'}"]
    if days is not None and partition is None:
        folders = [f"date={month}-*" for month in _months(*days)]
    pattern = folders[0] if len(folders) == 1 else "{" + ",".join(folders) + "}"
    return f"{root.rstrip('/')}/tenants/tenantid={tenant}/tablename={table}/{pattern}/*.json*.gz"


#: What the lines of an order table hold. Text lines read objects as well, so a lake of both kinds, or of
#: an unknown one, is read as text; a lake known to hold objects alone is parsed by the scan itself.
ORDER_LINES = {"text": ORDER_TEXT_LINES, "object": ORDER_OBJECT_LINES}


def _months(start: str | date, end: str | date) -> list[str]:
    first, last = str(start)[:7], str(end)[:7]
    months = []
    year, month = int(first[:4]), int(first[5:7])
    while f"{year:04d}-{month:02d}" <= last:
        months.append(f"{year:04d}-{month:02d}")
        year, month = (year, month + 1) if month < 12 else (year + 1, 1)
    return months


def between_dates(raw: DataFrame, start: str | date, end: str | date) -> DataFrame:
    """Restrict a lake scan to a range of its `date` partitions; pruned before any file is opened."""
    return raw.where(F.col("date").between(str(start), str(end)))
