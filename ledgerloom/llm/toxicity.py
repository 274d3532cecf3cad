"""Character n-gram linear classifier with naive Bayes scaled features.

A text's features are the hashed character n-grams of its words that occur in it, each worth the
log-count ratio of its bin between toxic and other labelled texts. Ratios are shrunk by NOISE standard
errors, and those then below LEAST count as 0, so long harmless texts gather no score. A logistic
regression weighs the features.

The ratios come from every labelled training text. The regression is fitted on at most FIT_ROWS of them,
those with the smallest hash of their id; that is the only bound, and it is on labelled rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import bitmap, in_bitmap, texts_of
from ledgerloom.llm.text import CHUNK_BYTES, IS_WORD, constants, mix

SIZES = (3, 4, 5, 6, 7)
BITS = 18
#: Chosen by log loss over three folds of the training rows of the test tables, and by what the fit takes.
NOISE = 3.0
LEAST = 0.25
FIT_ROWS = 12_000
ROUNDS = 150
PENALTY = 1e-3
THRESHOLD = 0.7
#: Bits of the map of labelled ids that spares other texts the shuffle: 2 MB.
MAP_BITS = 24

_KEYS = constants(max(SIZES), 47)
_FOLD = np.where(IS_WORD, np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)), 32)
_SPREAD = constants(256, 53)[_FOLD]


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    bias: float


def features(text: str) -> np.ndarray:
    """Sorted distinct bins of the n-grams of a text; n-grams count bytes, and other characters are spaces."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    mark = np.zeros(1 << BITS, bool)
    step = CHUNK_BYTES // 4
    for at in range(0, len(data), step):
        values = _SPREAD[data[at : at + step + max(SIZES) - 1]]
        for size in SIZES:
            n = len(values) - size + 1
            if n <= 0:
                continue
            total = np.zeros(n, np.uint64)
            for i in range(size):
                total += values[i : i + n] * _KEYS[i]
            mark[mix(total + np.uint64(size)) >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(mark)


def log_ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Log-count ratio of each bin, shrunk by NOISE standard errors; 0 where less than LEAST is left."""
    p, q = (toxic + 1) / (n_toxic + 2), (clean + 1) / (n_clean + 2)
    error = np.sqrt(1 / (toxic + 1) + 1 / (clean + 1))
    ratio = np.log(p / q)
    left = np.abs(ratio) - NOISE * error
    return np.where(left >= LEAST, np.sign(ratio) * left, 0.0)


def fit_linear(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled features; both classes weigh the same."""
    n = len(rows)
    at = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    bins = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32, copy=False)
    used = np.flatnonzero(np.bincount(bins, minlength=len(ratio)))
    place = np.zeros(len(ratio), np.int32)
    place[used] = np.arange(len(used))
    column, scale = place[bins], ratio[used]
    del bins
    toxic = (labels == 1).mean() if n else 0.5
    share = np.where(labels == 1, toxic**-0.5, (1 - toxic) ** -0.5) / max(1, n)  # halfway to equal classes
    w, b = np.zeros(len(used)), 0.0
    grad2, bias2 = np.full(len(used), 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = np.bincount(at, (scale * w)[column], n) + b
        d = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        g, gb = scale * np.bincount(column, d[at], len(used)) + PENALTY * w / max(1, len(used)), d.sum()
        grad2, bias2 = grad2 + g * g, bias2 + gb * gb
        w, b = w - 0.2 * g / np.sqrt(grad2), b - 0.2 * gb / np.sqrt(bias2)
    full = np.zeros(len(ratio))
    full[used] = w
    return full * ratio, float(b)


def is_held_out(id_col: str) -> Column:
    """crc32 of the id as text, mod 3, is 1. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the labelled documents that aren't held out.

    Null ids and null labels are left out; of several labels of one id the largest counts; a null text is
    empty. Repeated documents count as often as they occur. Without labels of both kinds every score is
    the same.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def labelled(wanted: DataFrame) -> DataFrame:
        found = spark.sparkContext.broadcast(bitmap(wanted, F.xxhash64("id"), MAP_BITS))

        @F.pandas_udf("boolean")
        def maybe(keys: pd.Series) -> pd.Series:
            return pd.Series(in_bitmap(found.value, keys.to_numpy(np.int64).view(np.uint64), MAP_BITS))

        few = texts.where(F.col("id").isNotNull()).where(maybe(F.xxhash64("id")))
        return few.join(wanted.hint("merge"), "id")  # one plan at every size

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        total = np.zeros(2, np.int64)
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                counts[label, features(text)] += 1
                total[label] += 1
        seen = np.flatnonzero(counts.any(0))
        if total.any():
            yield pd.DataFrame({"bin": np.append(seen, -1), "clean": np.append(counts[0, seen], total[0]), "toxic": np.append(counts[1, seen], total[1])})

    sums = labelled(known).mapInPandas(count, "bin int, clean long, toxic long")
    # 2**BITS rows and one of the totals, however many texts there are
    sums = sums.groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas().set_index("bin")
    size = 1 << BITS
    if -1 not in sums.index or 0 in sums.loc[-1].tolist():
        return Model(np.zeros(size, np.float32), -1.0)
    n_clean, n_toxic = (int(v) for v in sums.loc[-1])
    every = sums.drop(index=-1).reindex(range(size), fill_value=0)
    ratio = log_ratios(every["clean"].to_numpy(), every["toxic"].to_numpy(), n_clean, n_toxic)
    picked = known.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
    shared_ratio = spark.sparkContext.broadcast(ratio)

    def bins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [features(t) for t in frame["text"]]
            rows = [r[shared_ratio.value[r] != 0].astype("<i4").tobytes() for r in rows]
            yield pd.DataFrame({"label": frame["label"], "bins": rows})

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [np.frombuffer(b, "<i4") for b in frame["bins"]]
        weight, bias = fit_linear(rows, frame["label"].to_numpy(np.float64), shared_ratio.value)
        kept = np.flatnonzero(weight)
        return pd.DataFrame({"bin": np.append(kept, -1), "weight": np.append(weight[kept], bias)})

    # one task fits the bounded sample; its result has a row for each bin at most
    sample = labelled(picked).mapInPandas(bins, "label int, bins binary")
    fitted = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "bin int, weight double").toPandas().set_index("bin")["weight"]
    weight = np.zeros(size, np.float32)
    weight[fitted.index[fitted.index >= 0]] = fitted[fitted.index >= 0]
    return Model(weight, float(fitted[-1]))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Add a column with the score of each row's whole text, 0 to 1. A null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        z = np.array([shared.value.weight[features(t)].sum(dtype=np.float64) for t in texts_of(texts)]) + shared.value.bias
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(name, scored(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted. Only the text enters a score."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    held = is_held_out("doc_id")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose text isn't predicted toxic, with their columns."""
    kept = score(docs, train(docs, labels), name="__toxicity")
    return kept.where(F.col("__toxicity") < THRESHOLD).drop("__toxicity")
