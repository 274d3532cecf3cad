"""Phrases whose words stand together far more often than alone.

Texts become chunks of word numbers with a vocabulary of their own. Every chunk sends the counts of its
runs of one to three words to hash partitions (buckets). A partition merges them into a Misra-Gries summary
of a capacity beyond its mass divided by the threshold: whenever more runs are held than that, the
count that is one too many is taken from all. What is taken from a run in total stays below the
threshold, so every frequent run survives. A second pass over the partition's counts sums the
survivors exactly, and the first chunk that has a frequent run is asked for its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.buckets import bucket_bits, chunk_ids, from_planes, met, planes
from ledgerloom.llm.frames import texts_of
from ledgerloom.llm.text import constants, mix
from ledgerloom.session import stored

LEAST = 10
WORDS = 3
TOP = 2000
#: A phrase goes if a longer one holds it in this many of a hundred of its places.
WITHIN = 50
UNKNOWN = "und"
#: Words of a chunk; a longer text is a chunk of its own.
CHUNK_WORDS = 1 << 19
#: Runs a summary takes over at a time, beyond its capacity.
MERGE = 1 << 18
#: Shares of a language that are cut to the wanted number on their own first.
RANK_SHARES = 64

_KEYS = constants(WORDS, 131)
_KINDS = constants(WORDS + 1, 137)
# fixed values: what parts phrases, what parts words, and A-Z
_BREAK = 0xFF  # a byte that UTF-8 never holds
_FOLD = bytes.maketrans(
    b".,;:!?\x0a\x0b\x0c\x0d\x09ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    bytes([_BREAK] * 10) + b" abcdefghijklmnopqrstuvwxyz",
)
_SPLIT = bytes([_BREAK])


def word_numbers(texts: list[str], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Numbers of all words of the texts, 0 between pieces and texts; new words join the vocabulary."""
    data = _SPLIT.join(t.encode("utf-8", "replace").translate(_FOLD) for t in texts)
    found = data.replace(_SPLIT, b" " + _SPLIT + b" ").split(b" ")
    return np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in found if w), np.uint32)


def _new_vocabulary() -> dict[bytes, int]:
    return {_SPLIT: 0}


def word_chunks(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Chunks of one language: chunk, lang, n (numbers), n_words, vocabulary (blanks between), words (byte planes)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = chunk_ids()
        open_: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        held = 0

        def made(lang: str) -> pd.DataFrame:
            vocabulary, parts = open_.pop(lang)
            words = np.concatenate(parts)
            row = (next(ids), lang, len(words), int((words > 0).sum()), b" ".join(list(vocabulary)[1:]), planes(words.astype(np.uint64)))
            return pd.DataFrame([row], columns=["chunk", "lang", "n", "n_words", "vocabulary", "words"])

        for frame in frames:
            texts, langs = texts_of(frame["text"]), frame["lang"].tolist()
            for lang in dict.fromkeys(langs):
                vocabulary, parts = open_.setdefault(lang, (_new_vocabulary(), []))
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                parts.append(np.append(word_numbers(own, vocabulary), np.uint32(0)))
                held += len(parts[-1])
                if sum(map(len, parts)) >= CHUNK_WORDS:
                    held -= sum(map(len, parts))
                    yield made(lang)
            if held >= 2 * CHUNK_WORDS:  # many small languages
                for lang in list(open_):
                    yield made(lang)
                held = 0
        for lang in list(open_):
            yield made(lang)

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInPandas(work, "chunk long, lang string, n long, n_words long, vocabulary binary, words binary")


def _chunk(row) -> tuple[list[bytes], np.ndarray]:
    return [_SPLIT, *row.vocabulary.split(b" ")], from_planes(row.words, row.n).astype(np.int64)


def run_hashes(vocabulary: list[bytes], words: np.ndarray, lang: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the runs of 1 to WORDS words inside pieces."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))[words]
    out, inside, total = [], words > 0, np.zeros(len(words), np.uint64)
    for k in range(WORDS):
        n = max(0, len(words) - k)
        inside, total = inside[:n] & (words[k:] > 0), total[:n] + hashed[k:] * _KEYS[k]
        at = np.flatnonzero(inside)
        out.append((at, mix(total[at] + _KINDS[k])))
    return out


def _emit_runs(frame: pd.DataFrame):
    for row in frame.itertuples():
        found = [h for _, h in run_hashes(*_chunk(row), row.lang)]
        if sum(map(len, found)):
            yield row.chunk, *np.unique(np.concatenate(found), return_counts=True)


class Summary:
    """A Misra-Gries summary of weighted items; two of them merge by `add` of one's items to the other."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)

    def add(self, items: np.ndarray, counts: np.ndarray) -> None:
        items, place = np.unique(np.concatenate([self.items, items]), return_inverse=True)
        total = np.zeros(len(items), np.int64)
        np.add.at(total, place, np.concatenate([self.counts, counts]))
        if len(items) > self.capacity:
            total -= np.partition(total, len(total) - self.capacity - 1)[len(total) - self.capacity - 1]
            items, total = items[total > 0], total[total > 0]
        self.items, self.counts = items, total


def survivors(items: list[np.ndarray], counts: list[np.ndarray], threshold: int) -> np.ndarray:
    """Items, rising, among them every one whose counts sum to the threshold or more."""
    mass = sum(int(c.sum()) for c in counts)
    summary = Summary(mass // threshold + 1)
    at, size = 0, 0
    for i, own in enumerate(items):
        size += len(own)
        if size >= MERGE or i + 1 == len(items):
            summary.add(np.concatenate(items[at : i + 1]), np.concatenate(counts[at : i + 1]))
            at, size = i + 1, 0
    return summary.items


def frequent(items: list[np.ndarray], counts: list[np.ndarray], threshold: int) -> list[tuple[bytes, bytes] | None]:
    """To the first chunk that has a frequent item: the item and its exact count."""
    kept = survivors(items, counts, threshold)
    total, first = np.zeros(len(kept), np.int64), np.full(len(kept), len(items), np.int64)
    for i, (own, n) in enumerate(zip(items, counts, strict=True)):
        place = np.minimum(np.searchsorted(kept, own), max(len(kept) - 1, 0))
        hit = kept[place] == own if len(kept) else np.zeros(len(own), bool)
        total[place[hit]] += n[hit]
        first[place[hit]] = np.minimum(first[place[hit]], i)
    out: list[tuple[bytes, bytes] | None] = [None] * len(items)
    often = np.flatnonzero(total >= threshold)
    often = often[np.argsort(first[often], kind="stable")]
    for own in np.split(often, np.flatnonzero(np.diff(first[often])) + 1):
        if len(own):
            out[int(first[own[0]])] = kept[own].tobytes(), total[own].astype("<i8").tobytes()
    return out


def _named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of the runs that a chunk is asked for."""
    for frame in frames:
        for row in frame.itertuples():
            vocabulary, words = _chunk(row)
            asked = np.concatenate([np.frombuffer(a["first"], np.uint64) for a in row.answers])
            count = np.concatenate([np.frombuffer(a["second"], "<i8") for a in row.answers])
            for k, (at, hashes) in enumerate(run_hashes(vocabulary, words, row.lang), 1):
                distinct, first = np.unique(hashes, return_index=True)
                place = np.minimum(np.searchsorted(distinct, asked), max(len(distinct) - 1, 0))
                hit = np.flatnonzero(distinct[place] == asked) if len(distinct) else np.zeros(0, np.int64)
                start = at[first[place[hit]]] if len(hit) else hit
                phrase = [b" ".join([vocabulary[w] for w in words[s : s + k].tolist()]).decode("utf-8", "replace") for s in start.tolist()]
                if phrase:
                    yield pd.DataFrame({"lang": row.lang, "size": k, "phrase": phrase, "f": count[hit]})


def frequent_runs(chunks: DataFrame, threshold: int = LEAST) -> DataFrame:
    """lang, size, phrase, f of every run of 1 to WORDS words that occurs `threshold` times or more."""
    total = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    answers = met(chunks, _emit_runs, lambda items, counts: frequent(items, counts, threshold), bucket_bits(WORDS * total))
    return chunks.join(answers, "chunk").mapInPandas(_named, "lang string, size int, phrase string, f long")


def scored(runs: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of the phrases: the lowest-scoring cut, the earliest of equals."""
    words = F.split("phrase", " ")
    cuts = runs.where("size >= 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select(
        "lang",
        "phrase",
        "size",
        F.col("f").alias("a"),
        "k",
        F.array_join(F.slice(words, 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    # both parts of a frequent run are frequent
    heads = runs.where(f"size < {WORDS}").select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = runs.where(f"size < {WORDS}").select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    # counts below 10**16 keep the products within 38 digits
    a, l, r = (F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r"))
    both = both.withColumn("a2", (a * a).cast("decimal(32,0)")).withColumn("lr", (l * r).cast("decimal(32,0)"))
    both = both.withColumn("scaled", (F.col("a2") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"))
    both = both.withColumn("score", F.expr("scaled div lr"))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "size", "a")).alias("b"))
    return best.select("lang", "phrase", "b.size", "b.a", "b.l", "b.r", "b.score")


def maximal(phrases: DataFrame, within: int = WITHIN) -> DataFrame:
    """Phrases without those that longer ones hold in `within` of a hundred of their places."""
    words = F.split("phrase", " ")
    longer = phrases.where(f"size = {WORDS}").select("lang", "a", F.explode(F.array(*[F.array_join(F.slice(words, i, 2), " ") for i in (1, 2)])).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    joined = phrases.join(longer, ["lang", "phrase"], "left")
    return joined.where(F.col("held").isNull() | (100 * F.col("held") < within * F.col("a"))).drop("held")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = LEAST, top: int = TOP) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z. Texts are split at `.,;:!?` and line ends into pieces, these at blanks and tabs
    into words; a phrase is two or three words of one piece. `a` counts all its occurrences, `l` and `r`
    those of the parts of its lowest-scoring cut, `n` all words of the language; score is a*a / (l*r) in
    millionths. Ties go by `a`, then by the phrase. Null and empty texts have no words, a null language
    is `und`. Repeated rows count as often as they stand. Languages without a phrase and an empty
    table give no rows; further columns are not read. Runs are known by 64-bit hashes. A text is worked on
    in memory, about 150 bytes a word.
    """
    chunks = stored(word_chunks(docs, text_col, lang_col), "word-chunks")
    runs = stored(frequent_runs(chunks, threshold), "runs")
    phrases = maximal(scored(runs)).drop("size")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    shares = phrases.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SHARES)))
    shares = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= top)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    words = chunks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
