"""Optimal length buckets and token-budget batches.

The lengths of all documents are counted in a histogram, dynamic programming over it picks the bucket
boundaries with the least padding, and inside a bucket documents are numbered and cut into batches of
at most `budget` padded tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stored

BUDGET = 65_536
BUCKETS = 24
#: Documents numbered together in one task.
SHARD_ROWS = 1024


def word_count(text: Column) -> Column:
    """Tokens of a text: words between white space. Null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def best_boundaries(tops: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most `buckets` of the lengths `tops`, the last one the largest, with the least padding.

    Padding to the top of the bucket costs top x documents. With P(j) documents of the first j lengths,
    best(k, j) = min over i of best(k - 1, i) + tops[j] * (P(j) - P(i)): for fixed k the candidates i are
    lines over tops[j] of falling slope, so their lower envelope answers rising tops in one sweep.
    """
    n = len(tops)
    if not n:
        return []
    seen = np.concatenate([[0], np.cumsum(counts)]).astype(object)
    best = [0] + [int(tops[j]) * int(seen[j + 1]) for j in range(n)]  # one bucket
    chosen = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        lines: list[tuple[int, int, int]] = []  # slope, intercept, i
        at, nxt, back = 0, [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            m, c = -int(seen[j - 1]), best[j - 1]
            while len(lines) >= 2 and (c - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - m):
                lines.pop()
            lines.append((m, c, j - 1))
            at = min(at, len(lines) - 1)
            x = int(tops[j - 1])
            while at + 1 < len(lines) and lines[at + 1][0] * x + lines[at + 1][1] <= lines[at][0] * x + lines[at][1]:
                at += 1
            nxt[j], back[j] = lines[at][0] * x + lines[at][1] + x * int(seen[j]), lines[at][2]
        best = nxt
        chosen.append(back)
    out, j = [], n
    for back in reversed(chosen):
        if j == 0:
            break
        out.append(int(tops[j - 1]))
        j = back[j]
    return out[::-1]


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", tie: Column | None = None, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """A batch for every row: doc_id, length, padded_length, bucket, batch, place, batch_rows.

    `batch` numbers the batches of a bucket from 0, `place` the rows of a batch. Each batch has
    max(1, budget // padded_length) rows but the last of its bucket, which has what is left; a document
    beyond the budget is a batch of its own, whole. Rows of length 0 go to the shortest bucket. Repeated
    rows are rows of their own; null ids are kept. An empty table gives no rows. `tie` (a hash of the
    text, say) makes the order inside a bucket the same on every run when ids repeat. Further columns
    are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), length.cast("long").alias("length"), (F.lit(0) if tie is None else tie).cast("long").alias("tie")
    )
    rows = stored(rows, "lengths")
    # as many rows as there are different lengths
    histogram = rows.groupBy(F.greatest("length", F.lit(1).cast("long")).alias("top")).agg(F.count("*").alias("n")).orderBy("top").toPandas()
    tops, counts = histogram["top"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64)
    ends = best_boundaries(tops, counts, buckets)
    sizes = np.diff(np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(tops, ends, side="right")], prepend=0)
    shards = [int(-(-n // SHARD_ROWS)) for n in sizes]
    ends_, shards_ = (F.array(*[F.lit(v).cast("long") for v in values or [1]]) for values in (ends, shards))
    mixed = F.xxhash64("doc_id", "tie", "length")
    bucket = F.size(F.filter(ends_, lambda e: e < F.col("length")))
    placed = rows.withColumn("bucket", bucket).withColumn("padded_length", F.get(ends_, F.col("bucket")))
    placed = placed.withColumn("fits", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("padded_length")).cast("long")))
    placed = placed.withColumn("shard", F.pmod(mixed, F.get(shards_, F.col("bucket")))).withColumn("mixed", mixed)
    in_shard = Window.partitionBy("bucket", "shard").orderBy("mixed", "doc_id", "tie", "length")
    numbered = placed.withColumn("at", F.row_number().over(in_shard) - 1)
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("bucket").orderBy("shard")
    sizes = sizes.select("bucket", "shard", (F.sum("n").over(earlier) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy("bucket")).alias("all"))
    place = F.col("first") + F.col("at")
    batch = F.floor(place / F.col("fits")).cast("long")
    return numbered.join(sizes, ["bucket", "shard"]).select(
        "doc_id",
        "length",
        "padded_length",
        "bucket",
        batch.alias("batch"),
        (place - batch * F.col("fits")).alias("place"),
        F.least(F.col("fits"), F.col("all") - batch * F.col("fits")).alias("batch_rows"),
    )
