"""64-bit values of all chunks of a table, met by hash bucket and answered chunk by chunk.

A chunk sends its distinct values once, with their counts, however often they occur in it. So a value that
stands everywhere costs a bucket one entry a chunk, and no key gathers the rows of a table in one task. A
bucket is a share of the hash range; their number follows the number of values, so its size does not grow.

What a chunk sends to a bucket is one row. Beyond some 10**11 values a chunk has only a few for each bucket, and the
exchange comes near a row for each value, which is the most it can cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import sorted_groups

#: Values of a bucket, on average.
BUCKET_VALUES = 1 << 19

#: Bits of the bucket number that are used for the tasks' sake alone.
MOST_SPLIT = 12

Emitted = Iterator[tuple[int, np.ndarray, np.ndarray]]


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, lowest first, without the empty ones; these compress well."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(from_planes(data, n), dtype=np.uint64)


def chunk_ids() -> Iterator[int]:
    """Ids of a task's chunks; the table they are written to fixes which chunk has which."""
    task = TaskContext.get()
    at = (task.partitionId() if task else 0) << 32
    while True:
        yield at
        at += 1


def bucket_bits(values: int) -> int:
    """Bits of the bucket number for so many values."""
    return min(30, max(1, int(np.ceil(np.log2(max(1, values) / BUCKET_VALUES)))))


def met(
    chunks: DataFrame,
    emit: Callable[[pd.DataFrame], Emitted],
    answer: Callable[[list[np.ndarray], list[np.ndarray]], list[tuple[bytes, bytes] | None]],
    bits: int,
) -> DataFrame:
    """Answers to all chunks: chunk, answers (array of bucket, first, second; by rising bucket).

    `emit` gives, for every chunk of a batch, its id, its distinct values in rising order and their
    counts. `answer` sees what all chunks sent to one bucket, by rising chunk, and answers each with two
    byte strings or not at all.
    """
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # work for the tasks, few values or many, but not so many buckets that a chunk has few values for each
    bits = max(bits, min((2 * parts).bit_length(), MOST_SPLIT))
    shift = np.uint64(64 - bits)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, values, counts in emit(frame):
                bucket = (values >> shift).astype(np.int64)
                edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(values)]
                rows = [
                    (int(bucket[a]), chunk, b - a, pack_sorted(values[a:b]), planes(counts[a:b]))
                    for a, b in zip(edges, edges[1:], strict=False)
                    if b > a
                ]
                for a in range(0, len(rows), 256):
                    yield pd.DataFrame(rows[a : a + 256], columns=["bucket", "chunk", "n", "values", "counts"])

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, "bucket"):
            sizes = group["n"].tolist()
            values = [unpack_sorted(v, n) for v, n in zip(group["values"], sizes, strict=True)]
            counts = [from_planes(c, n).astype(np.int64) for c, n in zip(group["counts"], sizes, strict=True)]
            bucket = int(group["bucket"].iat[0])
            found = answer(values, counts)
            rows = [(c, bucket, *a) for c, a in zip(group["chunk"].tolist(), found, strict=True) if a is not None]
            for a in range(0, len(rows), 256):
                yield pd.DataFrame(rows[a : a + 256], columns=["chunk", "bucket", "first", "second"])

    dealt = chunks.mapInPandas(deal, "bucket long, chunk long, n int, values binary, counts binary")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk")
    answers = dealt.mapInPandas(gather, "chunk long, bucket long, first binary, second binary")
    # as many answers as a chunk has buckets at most
    return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "first", "second"))).alias("answers"))
