"""Spark helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import stored

#: Rows and bytes of one Arrow batch: texts may be long, so few at a time. A longer row is a batch of its own.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
}


def prepared(spark: SparkSession) -> SparkSession:
    """Bound the batches that Python workers receive."""
    for key, value in ARROW_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pd.Series) -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t if isinstance(t, str) else "" for t in column]


def row_key(*columns: str) -> Column:
    """64-bit key of a row's values; nulls count as values of their own.

    Rows that agree in all the columns share a key, and so share every result computed per key.
    """
    parts = []
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def sorted_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups out of batches that are sorted by `key`."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        if rest and frame[key].iat[0] == rest[-1][key].iat[-1] == frame[key].iat[-1]:
            rest.append(frame)
            continue
        frame = pd.concat([*rest, frame], ignore_index=True) if rest else frame
        keys = frame[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield frame.iloc[a:b]
        rest = [frame.iloc[edges[-1] :]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def bitmap(df: DataFrame, key: Column, bits: int) -> np.ndarray:
    """A set of 64-bit keys as a bitmap of 2**bits bits, whatever the number of keys.

    For dropping most rows before a shuffle: a key of `df` is always found, others rarely while the
    keys are fewer than the bits. Its size is fixed by `bits`, so it may be sent to every executor.
    """
    place = F.shiftrightunsigned(key, 64 - bits)
    words = (
        df.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(63).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(one, cast(bit as int))")).alias("set"))
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    got = words.toPandas()
    out[got["word"].to_numpy(np.int64)] = got["set"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether each 64-bit key may be in the bitmap."""
    place = keys.astype(np.uint64, copy=False) >> np.uint64(64 - bits)
    found = words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))
    return (found & np.uint64(1)).astype(bool)


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (node, root), root being the smallest node.

    `edges`: long columns a, b. Each round links every node and its larger neighbours to the smallest
    node it sees (large star), then its smaller neighbours and itself to that (small star), until no
    link changes. A hub's links are grouped by the other end next round, so they halve fast; the links
    of a round are written to the shared folder, never collected.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
