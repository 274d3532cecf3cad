"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Timestamps are UTC instants everywhere; arithmetic errors must surface, never turn into NULL.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # INT96 timestamps carry no usable statistics; date ranges could not skip row groups.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Store ids such as 007 and the day 9999-99-99 must stay text.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


# Most bytes, as files or shuffled, of a join side that Spark may broadcast. A report has some twenty joins, and
# the driver holds each broadcast side unpacked, which for repetitive columns is a hundred times as much.
BROADCAST_LIMIT = 1 << 20
# A file's size tells little of what a broadcast side holds: 150,000 numbers as text are some 200 kB of Parquet and 7 MB
# as rows, and the driver keeps them twice. So planned sizes of files are taken this many times.
UNPACKED_FACTOR = 8.0
UNPACKED_KEY = "spark.sql.sources.fileCompressionFactor"
BROADCAST_KEYS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the engine relies on to an existing session.

    A lower broadcast threshold of the session, or none at all (-1), stays as it is, and so does a higher factor
    for the size of files.
    """
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key in BROADCAST_KEYS:
        # Without a second argument Spark's own default counts, where the session sets nothing; None: the other key's.
        size = spark.conf.get(key)
        if size is not None and _bytes(spark, size) > BROADCAST_LIMIT:
            spark.conf.set(key, str(BROADCAST_LIMIT))
    if float(spark.conf.get(UNPACKED_KEY)) < UNPACKED_FACTOR:
        spark.conf.set(UNPACKED_KEY, str(UNPACKED_FACTOR))
    return spark


def broadcasts(spark: SparkSession) -> bool:
    """Whether the session broadcasts join sides at all."""
    return _bytes(spark, spark.conf.get(BROADCAST_KEYS[0])) > 0


def _bytes(spark: SparkSession, size: str) -> int:
    sign, digits = (-1, size[1:]) if size.startswith("-") else (1, size)
    return sign * spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(digits)


def local_session(app: str, cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark. A cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_LIMIT))
        .config(UNPACKED_KEY, str(UNPACKED_FACTOR))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="ledgerloom-")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, the shared folder every executor can reach.

    Only a local session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_scratch()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared scratch folder and read it back.

    Later joins then plan with its true size, it is computed once, and a lost executor does not
    recompute what led to it.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
