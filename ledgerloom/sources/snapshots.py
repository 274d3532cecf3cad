"""Snapshots of models: which data files hold.

Data files are written once, below `models/<table>/batch=B/tenantid=T/<year>=Y/`, and never changed. A run
writes new files beside the old ones, then a list of all files that hold from now on, of all its tables,
and publishes the list by renaming one folder to `models/_snapshots/<number>`. Readers open the latest
list, so they see all tables of a run or none, and a run that is killed leaves files that nobody reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import date
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: One row a file; a row without a file gives a table's schema, which tables without rows have too.
LISTED = (
    "table string, batch string, tenantid string, year string, file string, rows long, bytes long, "
    "low string, high string, filter_bits long, created_low timestamp, created_high timestamp, schema string"
)
_FILE = ["table", "batch", "tenantid", "year", "file"]


class PublishConflict(RuntimeError):
    """Another run has published since this one read the models; run again."""


def _snapshots(root: str) -> str:
    return f"{root.rstrip('/')}/models/_snapshots"


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/models/{table}"


def filters_path(root: str, table: str) -> str:
    """Folder of the filters of a table's files; `_filters` beside it held those of an earlier form."""
    return f"{table_path(root, table)}/_words"


def held_path(spark: SparkSession, path: str) -> bool:
    folder = _path(spark, path)
    return folder.getFileSystem(_hadoop(spark)).exists(folder)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jsc.hadoopConfiguration()


def current(spark: SparkSession, root: str) -> int | None:
    """Number of the latest snapshot; None if nothing has been published."""
    folder = _path(spark, _snapshots(root))
    fs = folder.getFileSystem(_hadoop(spark))
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=None)


def listed(spark: SparkSession, root: str, number: int | None) -> DataFrame:
    """The files of a snapshot; none for None."""
    if number is None:
        return spark.createDataFrame([], LISTED)
    return spark.read.schema(LISTED).parquet(f"{_snapshots(root)}/{number:09d}")


def publish(spark: SparkSession, root: str, files: DataFrame, after: int | None) -> int:
    """Make `files` the snapshot that follows `after`; fails if another run has done so."""
    number = (after or 0) + 1
    # a name that readers of folders skip
    written = f"{_snapshots(root)}/_writing-{uuid.uuid4().hex}"
    files.hint("rebalance").write.option("compression", "zstd").parquet(written)
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    source, target = _path(spark, written), _path(spark, f"{_snapshots(root)}/{number:09d}")
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), _hadoop(spark))
        context.rename(source, target, spark.sparkContext._gateway.new_array(kind, 0))
    except Exception as error:
        if target.getFileSystem(_hadoop(spark)).exists(target):
            raise PublishConflict(f"snapshot {number} exists") from error
        raise
    return number


def read_files(spark: SparkSession, root: str, table: str, files: DataFrame, schema: StructType, year_column: str) -> DataFrame:
    """The rows of listed files, with `batch` and `file`.

    Names of files pass the driver, as they do whenever Spark plans a scan.
    """
    named = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString

    @cache
    def folder(batch: str, tenant: str, year: str) -> str:
        parts = (named(c, v) for c, v in (("batch", batch), ("tenantid", tenant), (year_column, year)))
        return "/".join([table_path(root, table), *parts])

    some = files.where((F.col("table") == table) & F.col("file").isNotNull()).select("batch", "tenantid", "year", "file")
    paths = [f"{folder(r.batch, r.tenantid, r.year)}/{r.file}" for r in some.toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], schema).withColumns({c: F.lit("") for c in ("batch", "file")})
    rows = spark.read.schema(schema).option("basePath", table_path(root, table)).parquet(*paths)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def schema_of(files: DataFrame, table: str) -> StructType | None:
    row = files.where((F.col("table") == table) & F.col("file").isNull()).select("schema").first()
    return None if row is None else StructType.fromJson(json.loads(row.schema))


def read_snapshot(
    spark: SparkSession,
    root: str,
    table: str,
    year_column: str | None,
    tenant: str | None = None,
    years: tuple[int, int] | None = None,
    number: int | None = None,
    created: tuple[str | date, str | date] | None = None,
) -> DataFrame | None:
    """A table of a snapshot (default: the latest), or None if it isn't listed there.

    With `created` (local days), files without an order created then are left out, in whatever zone the
    days are: rows of an order may lie years after it, and the list knows which files hold them.

    Files of other stores and years are left out by the list, before any is opened. The year column is the
    last one of a listed model.
    """
    number = current(spark, root) if number is None else number
    files = listed(spark, root, number).where(F.col("table") == table)
    schema = None if number is None else schema_of(files, table)
    if schema is None:
        return None
    if tenant is not None:
        files = files.where((F.col("tenantid") == tenant) | F.col("file").isNull())
    if years:
        files = files.where(F.col("year").cast("int").between(*years) | F.col("file").isNull())
    if created:
        first, last = (F.to_timestamp(F.lit(str(d))) for d in created)
        day = F.expr("INTERVAL 1 DAY")
        inside = (F.col("created_high") >= first - day) & (F.col("created_low") < last + day + day)
        files = files.where(inside | F.col("created_low").isNull())
    return read_files(spark, root, table, files, schema, year_column or schema.names[-1]).drop("batch", "file")


def without(files: DataFrame, gone: DataFrame) -> DataFrame:
    """Listed files but for those in `gone`; null stores and years are values of their own."""
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"g.{c}")) for c in _FILE]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    return files.alias("f").join(gone.select(_FILE).alias("g"), condition, "left_anti")


def write_batch(rows: DataFrame, root: str, table: str, batch: str, year_column: str, sort_by: Sequence[str]) -> None:
    """Write new files. The rebalance hint splits a hot store or year over files and merges small ones."""
    columns = ["tenantid", year_column]
    (
        rows.hint("rebalance", *columns)
        .sortWithinPartitions(*columns, *sort_by)
        .write.mode("error")
        .option("compression", "zstd")
        .partitionBy(*columns)
        .parquet(f"{table_path(root, table)}/batch={batch}")
    )


def drop_old(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the lists before the last `keep`, and batch folders that none of those names; return their paths.

    Run it when no run is writing. Names of folders only pass the driver.
    """
    number = current(spark, root)
    if number is None:
        return []
    held = set()
    for n in range(max(1, number - keep + 1), number + 1):
        held |= {(r.table, r.batch) for r in listed(spark, root, n).select("table", "batch").distinct().toLocalIterator()}
    fs = _path(spark, _snapshots(root)).getFileSystem(_hadoop(spark))
    gone = []
    for s in fs.listStatus(_path(spark, _snapshots(root))):
        name = s.getPath().getName()
        if not name.isdigit() or int(name) <= number - keep:
            gone.append(s.getPath())
    for table in sorted({t for t, _ in held}):
        for base in (table_path(root, table), f"{table_path(root, table)}/_filters", filters_path(root, table)):
            if fs.exists(_path(spark, base)):
                gone += [
                    s.getPath()
                    for s in fs.listStatus(_path(spark, base))
                    if s.getPath().getName().startswith("batch=") and (table, s.getPath().getName()[6:]) not in held
                ]
    for path in gone:
        fs.delete(path, True)
    return [p.toString() for p in gone]
