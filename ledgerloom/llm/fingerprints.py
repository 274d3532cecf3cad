"""Threshold-scaled sketches of texts.

A sketch keeps every distinct shingle hash below a fixed share of the hash range. Its size follows the
text's, sketches of parts merge by union, and the share of one sketch found in another estimates
containment even between very unequal texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import texts_of
from ledgerloom.llm.text import batches, hash_words, mix, shingles

#: One hash in SCALE is kept.
SCALE = 4
#: Stand-in for a null doc_id, which is ordered after all others.
_NULL_ID = -(1 << 63)


def sketches(texts: list[str], scale: int = SCALE) -> tuple[list[np.ndarray], list[int]]:
    """Sorted 32-bit sketch of each text, and a hash of its whole shingle set (0: no words)."""
    out, whole = [], []
    limit = np.uint64((1 << 64) // scale)
    for a, b in batches(texts):
        hashes, offsets = shingles(*hash_words(texts[a:b]))
        for i in range(b - a):
            own = np.unique(hashes[offsets[i] : offsets[i + 1]])
            # the kept hashes start alike, so their lower half is stored
            out.append(np.unique(own[own < limit].astype(np.uint32)))
            whole.append(int(mix(own).sum(dtype=np.uint64)))
    return out, whole


def to_string(sketch: np.ndarray, whole: int) -> str:
    """Hash of the whole set, then the kept hashes in rising order, 8 hex digits each."""
    return f"{whole:016x}:{sketch.astype('>u4').tobytes().hex()}"


def from_string(fingerprint: str) -> tuple[np.ndarray, int]:
    whole, _, kept = fingerprint.partition(":")
    return np.frombuffer(bytes.fromhex(kept), ">u4").astype(np.uint32), int(whole, 16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two shingle sets."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 0 if a's sketch is empty."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """Estimated containment of the smaller set in the larger, 0 to 1; 1 for equal sets with words."""
    if a[1] == b[1]:
        return float(a[1] != 0)
    return containment(*sorted((a[0], b[0]), key=len))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many characters from the start of another."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text, of its edited text and how like the next document is.

    The next document has the next lower doc_id; the first follows the last. Rows of one id are ordered
    by text, null ids come after all others. A null text counts as empty. Texts without words have
    an empty sketch and are like nothing. A single row follows itself. Other columns are not read.

    Ids are cut into ranges at approximate quantiles. Every range also gets the rows of the id that opens
    the range after it, so one shuffle by range brings all neighbours together; only the
    bounds and the largest id of each range reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [(i + 1) / ranges for i in range(ranges - 1)]
    bounds = sorted(set(rows.agg(F.percentile_approx("key", steps, 20 * ranges)).first()[0] or []))

    def place(key: int) -> int:  # ranges in descending order of key
        return len(bounds) - bisect_left(bounds, key)

    @F.pandas_udf("int")
    def ranged(keys: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(np.array(bounds, np.int64), keys.to_numpy(np.int64), side="left"))

    heads = rows.groupBy(ranged("key").alias("range")).agg(F.max("key").alias("key")).orderBy("range").collect()
    # a range's opening id -> the range before it, around the end
    before = {heads[i]["key"]: heads[i - 1]["range"] for i in range(len(heads))}

    @F.pandas_udf("array<int>")
    def wanted(keys: pd.Series) -> pd.Series:
        own = len(bounds) - np.searchsorted(np.array(bounds, np.int64), keys.to_numpy(np.int64), side="left")
        return pd.Series([[r, before[k]] if k in before else [r] for k, r in zip(keys.tolist(), own.tolist(), strict=True)])

    # position 1: the copy that only follows the last row of the range before
    spread = rows.select("key", "text", F.posexplode(wanted("key")).alias("extra", "range"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = spread.repartition(n, "range").sortWithinPartitions("range", "extra", F.desc("key"), "text")

    def described(ids: list[int], texts: list[str], after: str, after_sketch: tuple) -> pd.DataFrame:
        following = [*texts[1:], after]
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        own = list(zip(*sketches(texts, scale), strict=True))
        new = list(zip(*sketches(changed, scale), strict=True))
        nexts = [*own[1:], after_sketch]
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if i == _NULL_ID else i for i in ids], "Int64"),
                "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
                "fingerprint": [to_string(*s) for s in own],
                "edited_fingerprint": [to_string(*s) for s in new],
                "near_edited": [likeness(a, b) for a, b in zip(own, new, strict=True)],
                "near_next": [likeness(a, b) for a, b in zip(own, nexts, strict=True)],
            }
        )

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        texts: list[str] = []
        current = None
        done = size = 0
        for frame in frames:
            for key, text, extra, place in zip(frame["key"].tolist(), texts_of(frame["text"]), frame["extra"].tolist(), frame["range"].tolist(), strict=True):
                if place != current:
                    current, done = place, False
                if extra and done:
                    continue  # a further row of the opening id
                if ids and (extra or size > 2_000_000):
                    yield described(ids, texts, text, tuple(s[0] for s in sketches([text], scale)))
                    ids, texts, size = [], [], 0
                if extra:
                    done = True
                else:
                    ids.append(key)
                    texts.append(text)
                    size += len(text)

    return sorted_rows.mapInPandas(
        walk,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
