"""Benchmark passages in documents, found by spaced-seed hashing.

A seed hashes the words of a window at the places a fixed mask marks, so a changed word at another place
leaves it as it is. Seeds of the benchmark and of the documents are joined by hash; around each meeting
the words are compared along its alignment. A document holds an item if a stretch of WIDTH words of the
item (all of a shorter one) agrees with it in LEAST of the words, in place.

Items of fewer words than the longest mask have masks of their own length, each of which leaves out every third
word: whichever word is changed, one of the three doesn't see it, and `needed` allows them one changed word. Such
an item has to stand inside the document, not over its ends.
Items below SHORTEST words are too common to be evidence and are found nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import bitmap, in_bitmap, row_key, texts_of
from ledgerloom.llm.text import batches, hash_words, windows
from ledgerloom.session import stored

#: Whichever two words of 10 to 13 are changed, at least one of these masks leaves them out at some place.
#: The masks from number _LONG on are for items of at least _SPAN words.
MASKS = ("110110111", "1011101011", "1110011101", "1101010111", "111111", "1111011", "11011101", "111000111")
_LONG = 4
WIDTH = 13
LEAST = 0.8
SHORTEST = 5
#: Bits of the map of benchmark seeds: 2 MB whatever the benchmark's size. A fuller map lets more windows
#: through to the join, which is exact.
MAP_BITS = 24

_PLACES = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
_SPAN = max(map(len, MASKS))
_THIRDS = 3


def short_places(n: int) -> list[list[int]]:
    """Places that the masks of items of n words see."""
    return [[i for i in range(n) if i % _THIRDS != k] for k in range(_THIRDS)]


def seeds(words: np.ndarray, short: list[int]) -> list[np.ndarray]:
    """Hash of every window by mask, then by the masks of short lengths; the place in each array is the first word's."""
    spaced = [windows(words, len(m), p, seed=101 + k) for k, (m, p) in enumerate(zip(MASKS, _PLACES, strict=True))]
    return spaced + [windows(words, n, p, seed=201 + _THIRDS * n + k) for n in short for k, p in enumerate(short_places(n))]


def best_stretch(document: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Most words that agree in a stretch of min(WIDTH, len(item)) item words; its start in the document
    and its width. `shift` is the place in `document` of the item's first word."""
    width = min(WIDTH, len(item))
    low, high = max(0, -shift), min(len(item), len(document) - shift)
    equal = np.zeros(len(item), np.int64)
    if high > low:
        equal[low:high] = document[low + shift : high + shift] == item[low:high]
    sums = np.convolve(equal, np.ones(width, np.int64), "valid")
    at = int(sums.argmax())
    return int(sums[at]), at + shift, width


def needed(width: int) -> int:
    return int(np.ceil(LEAST * width - 1e-9))


def _item_words(benchmark: DataFrame) -> DataFrame:
    """item, item_id, words of every item long enough; equal items of one id count once."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashes, offsets = hash_words(texts_of(frame["text"]))
            frame["words"] = [hashes[a:b].view(np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield frame.loc[np.diff(offsets) >= SHORTEST, ["item", "item_id", "words"]]

    rows = benchmark.select(row_key("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.dropDuplicates(["item"]).mapInPandas(split, "item long, item_id long, words array<long>")


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where documents hold benchmark items: key, doc_id, item_id, start, matched, width.

    One row for a document and item, the best stretch, the first of equals; `start` counts the document's
    words from 0. `key` is the row_key of doc_id and text, so repeated rows give one. Null and
    empty texts hold nothing and are found nowhere; an empty table on either side gives no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    items = stored(_item_words(benchmark), "items")
    lengths = items.where(F.size("words") < _SPAN).select(F.size("words").alias("n")).distinct().collect()
    short = sorted(r["n"] for r in lengths)  # lengths below the span: fewer than it

    def seeded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, words in zip(frame["item"].tolist(), frame["words"], strict=True):
                words = np.asarray(words, np.int64).view(np.uint64)
                found = seeds(words, [n for n in short if n == len(words)])
                if len(words) < _SPAN:
                    found = [s for k, s in enumerate(found) if not _LONG <= k < len(MASKS)]
                places = np.concatenate([np.arange(len(s)) for s in found])
                yield pd.DataFrame({"hash": np.concatenate(found).view(np.int64), "item": item, "at": places})

    item_seeds = stored(items.mapInPandas(seeded, "hash long, item long, at int").distinct(), "seeds")
    known = spark.sparkContext.broadcast(bitmap(item_seeds, F.col("hash"), MAP_BITS))

    def regions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Stretches of documents around windows that may be benchmark seeds."""
        for frame in frames:
            texts = texts_of(frame["text"])
            for a, b in batches(texts):
                words, offsets = hash_words(texts[a:b])
                ends = np.repeat(offsets[1:], np.diff(offsets))
                spans = [len(m) for m in MASKS] + [n for n in short for _ in range(_THIRDS)]
                places, hashes = [], []
                for span, found in zip(spans, seeds(words, short), strict=True):
                    at = np.flatnonzero(in_bitmap(known.value, found, MAP_BITS))
                    at = at[at + span <= ends[at]]
                    places.append(at)
                    hashes.append(found[at])
                place, hashed = np.concatenate(places), np.concatenate(hashes)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, hashed = place[order], hashed[order]
                owner = np.searchsorted(offsets, place, side="right") - 1
                apart = (np.diff(place) > 2 * WIDTH + _SPAN) | (np.diff(owner) > 0)
                cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(place)]
                out = []
                for s, e in zip(cuts, cuts[1:], strict=False):
                    d = owner[s]
                    low = max(offsets[d], place[s] - WIDTH)
                    high = min(offsets[d + 1], place[e - 1] + _SPAN + WIDTH)
                    out.append((frame["key"].iat[a + d], frame["doc_id"].iat[a + d], low - offsets[d], words[low:high].view(np.int64), place[s:e] - low, hashed[s:e].view(np.int64)))
                yield pd.DataFrame(out, columns=["key", "doc_id", "low", "words", "places", "hashes"]).astype({"doc_id": "Int64"})

    rows = docs.select(row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    shape = "key long, doc_id long, low int, words array<long>, places array<int>, hashes array<long>"
    found = stored(rows.mapInPandas(regions, shape), "regions")
    hits = found.select("key", "low", F.explode(F.arrays_zip("places", "hashes")).alias("hit"))
    hits = hits.select("key", "low", F.col("hit.places").alias("place"), F.col("hit.hashes").alias("hash"))
    # a meeting is known by its document, stretch, item and alignment, however many seeds agree on it
    meetings = hits.join(item_seeds, "hash").select("key", "low", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    meetings = meetings.join(items.select("item", F.size("words").alias("n")), "item")
    around = found.dropDuplicates(["key", "low"]).select("key", "low", "doc_id", F.col("words").alias("document"))
    # of a stretch as long as its text, only the words along the alignment go on
    first = F.greatest("shift", F.lit(0))
    along = F.slice("document", first + 1, F.greatest(F.col("n") + F.least("shift", F.lit(0)), F.lit(0)))
    pairs = meetings.join(around, ["key", "low"]).select(
        "key", "doc_id", "item", along.alias("document"), (F.col("low") + first).alias("low"), (F.col("shift") - first).alias("shift")
    )
    pairs = pairs.join(items, "item")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best = [
                best_stretch(np.asarray(d), np.asarray(i), s)
                for d, i, s in zip(frame["document"], frame["words"], frame["shift"].tolist(), strict=True)
            ]
            frame["matched"], at, frame["width"] = zip(*best, strict=True) if best else ((), (), ())
            frame["start"] = frame["low"] + np.array(at, np.int64)
            good = frame["matched"] >= frame["width"].map(needed)
            yield frame.loc[good, ["key", "doc_id", "item_id", "start", "matched", "width"]]

    checked = pairs.mapInPandas(verify, "key long, doc_id long, item_id long, start int, matched int, width int")
    best = checked.groupBy("key", "doc_id", "item_id").agg(F.max(F.struct("matched", (-F.col("start")).alias("back"), "width")).alias("b"))
    return best.select("key", "doc_id", "item_id", (-F.col("b.back")).alias("start"), F.col("b.matched").alias("matched"), F.col("b.width").alias("width"))


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with their columns."""
    key = row_key("doc_id", "text")
    leaks = passages(docs, benchmark).select(F.col("key").alias("__leak")).distinct()
    return docs.join(leaks, key == F.col("__leak"), "left_anti")
