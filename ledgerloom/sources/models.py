"""Typed models: zstd Parquet below `models/<table>/tenantid=T/[<year>=Y/]`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.session import stored
from ledgerloom.sources.snapshots import read_snapshot


def model_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/models/{table}"


def read_model(
    spark: SparkSession,
    root: str,
    table: str,
    tenant: str | None = None,
    year_column: str | None = None,
    years: tuple[int, int] | None = None,
    snapshot: int | None = None,
    created: tuple[str, str] | None = None,
) -> DataFrame:
    """Scan a model of one store, or of all stores when no tenant is given.

    A model that a snapshot lists is read as of the latest one, or of `snapshot`; others by their folder.
    `created` then leaves out files without rows of orders created in those days; it doesn't filter rows.
    `tenantid` and the year come from the path. Both filters are on partition columns, so other
    stores and years are pruned before any file is opened.
    """
    df = read_snapshot(spark, root, table, year_column, tenant, years, snapshot, created)
    if df is None:
        df = spark.read.parquet(model_path(root, table))
    if tenant is not None:
        df = df.where(F.col("tenantid") == tenant)
    if year_column and years:
        df = df.where(F.col(year_column).cast("int").between(*years))
    return df


def folder_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The rows of a model's folder, or None if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_model(
    df: DataFrame,
    path: str,
    partition_columns: Sequence[str] = (),
    replaced: DataFrame | None = None,
    sort_by: Sequence[str] = (),
    keep: Column | None = None,
) -> None:
    """Write a model; with partition columns only the partitions that the batch touches are replaced.

    The rebalance hint lets adaptive execution merge small partitions and split large ones, so
    neither a busy year nor a busy store becomes one task or one file, and small lookups end up in
    one file. `replaced` holds the keys the batch replaces (for example all order ids of the batch):
    stored rows of these keys go, from whatever partition they are in, and all others stay. `keep`
    says the same as a condition on stored rows. A partition that loses its last row is dropped after
    the write. Without both the caller must hand over complete partitions. Rows are sorted by `sort_by` within a file, so that readers of
    a short date range skip most row groups of a year.
    """
    if not partition_columns:
        df.hint("rebalance").write.mode("overwrite").option("compression", "zstd").parquet(path)
        return
    emptied = None
    if replaced is not None or keep is not None:
        df, emptied = _with_kept_rows(df, path, partition_columns, replaced, keep)
    rows = df.hint("rebalance", *partition_columns)
    if sort_by:
        rows = rows.sortWithinPartitions(*partition_columns, *sort_by)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*partition_columns)
        .parquet(path)
    )
    if emptied is not None:
        _drop_partitions(emptied, path)


def _with_kept_rows(
    df: DataFrame, path: str, partitions: Sequence[str], replaced: DataFrame | None, keep: Column | None
) -> tuple[DataFrame, DataFrame | None]:
    """The batch with the stored rows that stay in the partitions it touches, and the partitions left empty.

    Touched are the partitions the batch has rows in and those that hold a row it replaces, found by a
    scan of keys and partition columns alone. The joins on partition columns prune folders at run time.
    """
    model = folder_rows(df.sparkSession, path, df.schema)
    if model is None:
        return df, None
    columns = list(partitions)
    if replaced is not None:
        gone = model.join(replaced, replaced.columns, "left_semi")
    else:
        gone = model.where(~F.coalesce(keep, F.lit(False)))
    touched = stored(df.select(columns).union(gone.select(columns)).distinct(), "touched")
    kept = model.join(touched, columns, "left_semi")
    kept = kept.where(keep) if replaced is None else kept.join(replaced, replaced.columns, "left_anti")
    rows = df.unionByName(kept)
    return rows, stored(touched.join(rows.select(columns).distinct(), columns, "left_anti"), "emptied")


def _drop_partitions(partitions: DataFrame, path: str) -> None:
    """Delete the folders of partitions that have no rows any more; names only pass the driver."""
    spark = partitions.sparkSession
    jvm = spark.sparkContext._jvm
    named = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for row in partitions.toLocalIterator():
        folder = "/".join([path, *(named(c, str(row[c])) for c in partitions.columns)])
        target = jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_csv(df: DataFrame, path: str, gzip: bool = True) -> str:
    """Write CSV parts with a header line and return the folder."""
    codec = "gzip" if gzip else "none"
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("compression", codec)
        .csv(path)
    )
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )
