"""Removal of passages that stand more than once, found by level-wise doubling.

A passage is a window of WIDTH words. Short windows are looked at first, and only where a window repeats
are windows of twice its length tried: one of length 2L repeats only if the two of length L that make
it up do. The last level has the wanted width, its two halves overlapping where needed.

The first level needs no window at every word. Of the short windows inside a wanted window, those with the
smallest hash are its anchors; equal windows have equal anchors at equal places, so a repeated window has a
repeated anchor. Around these the texts are cut into stretches, which the later levels work on. Windows
are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.buckets import bucket_bits, chunk_ids, from_planes, met, planes
from ledgerloom.llm.frames import bitmap, in_bitmap, row_key, texts_of
from ledgerloom.llm.text import SPACED, batches, hash_words, windows
from ledgerloom.session import stored

WIDTH = 35
#: Hashes and words of a chunk; a longer text is a chunk of its own.
CHUNK = 1 << 18
#: Bits of the map of texts that have candidates: 8 MB whatever their number.
MAP_BITS = 26
_FAR = np.uint64((1 << 64) - 1)


def lengths(width: int) -> list[int]:
    """Window lengths of the levels: about a quarter of the width, doubled up to the width."""
    first = max(1, -(-width // 4))
    out = [first]
    while out[-1] < width:
        out.append(min(2 * out[-1], width))
    return out


def _slide(values: np.ndarray, span: int, pick) -> np.ndarray:
    """Smallest or largest of every `span` neighbours."""
    out, done = values, 1
    while done < span:
        step = min(done, span - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the short windows with the smallest hash of any wanted window."""
    short = lengths(width)[0]
    if len(words) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = windows(words, short)
    span = width - short + 1
    least = _slide(hashed, span, np.minimum)  # of the window that starts here
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    inside = np.arange(len(least)) + width <= ends
    # the largest least of the windows that hold a place equals its hash if it is the least of one of them
    padded = np.zeros(len(least) + 2 * (span - 1), np.uint64)
    padded[span - 1 : span - 1 + len(least)] = np.where(inside, least, np.uint64(0))
    at = np.flatnonzero(_slide(padded, span, np.maximum)[: len(hashed)] == hashed)
    return at, hashed[at]


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, rising, with 1 or 2: whether a hash stands here more than once."""
    values, counts = np.unique(hashes, return_counts=True)
    return values, np.minimum(counts, 2)


def _repeated(values: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple[bytes, bytes] | None]:
    """Bits of each chunk's values: whether they stand more than once in all chunks."""
    flat = np.concatenate(values)
    distinct, place = np.unique(flat, return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(distinct))
    out, at = [], 0
    for v in values:
        bits = total[place[at : at + len(v)]] >= 2
        out.append((np.packbits(bits).tobytes(), len(v).to_bytes(4, "little")))
        at += len(v)
    return out


def _bits_of(answers) -> np.ndarray:
    """A chunk's answers, for its distinct values in rising order."""
    parts = [np.unpackbits(np.frombuffer(a["first"], np.uint8))[: int.from_bytes(a["second"], "little")] for a in answers]
    return np.concatenate(parts).astype(bool)


def _hits(hashes: np.ndarray, answers) -> np.ndarray:
    """Whether each hash of a chunk repeats."""
    if not len(hashes):
        return np.zeros(0, bool)
    _, place = np.unique(hashes, return_inverse=True)
    return _bits_of(answers)[place]


def _total(table: DataFrame, column: str) -> int:
    return table.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]


def _anchored(rows: DataFrame, width: int) -> DataFrame:
    """Chunks of texts: chunk, n, keys and counts of the texts, places and hashes of their anchors."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = chunk_ids()
        keys, counts, places, hashes, size = [], [], [], [], 0

        def made() -> pd.DataFrame:
            at = np.concatenate(places).astype("<i4").tobytes()
            return pd.DataFrame([(next(ids), size, keys, counts, at, np.concatenate(hashes).tobytes())], columns=["chunk", "n", "keys", "counts", "places", "hashes"])

        for frame in frames:
            texts, own = texts_of(frame["text"]), frame["key"].tolist()
            for a, b in batches(texts):
                words, offsets = hash_words(texts[a:b], SPACED)
                at, found = anchors(words, offsets, width)
                owner = np.searchsorted(offsets, at, side="right") - 1
                n = np.bincount(owner, minlength=b - a)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                keys += [own[a + i] for i in some.tolist()]
                counts += n[some].tolist()
                places.append(at - offsets[owner])
                hashes.append(found)
                size += len(found)
                if size >= CHUNK:
                    yield made()
                    keys, counts, places, hashes, size = [], [], [], [], 0
        if size:
            yield made()

    return rows.mapInPandas(work, "chunk long, n int, keys array<long>, counts array<int>, places binary, hashes binary")


def _emit_hashes(frame: pd.DataFrame):
    for chunk, hashes in zip(frame["chunk"].tolist(), frame["hashes"], strict=True):
        yield chunk, *counted(np.frombuffer(hashes, np.uint64))


def _candidate_texts(chunks: DataFrame) -> DataFrame:
    """key, places of the anchors that repeat, of every text that has one."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for keys, counts, places, hashes, answers in zip(frame["keys"], frame["counts"], frame["places"], frame["hashes"], frame["answers"], strict=True):
                hit = _hits(np.frombuffer(hashes, np.uint64), answers)
                at, ends = np.frombuffer(places, "<i4"), np.cumsum(np.asarray(counts))
                found = [at[e - n : e][hit[e - n : e]] for n, e in zip(np.asarray(counts).tolist(), ends.tolist(), strict=True)]
                some = [i for i, f in enumerate(found) if len(f)]
                yield pd.DataFrame({"key": np.asarray(keys)[some].astype(np.int64), "places": [found[i].tobytes() for i in some]})

    return chunks.mapInPandas(work, "key long, places binary")


_STATE = "chunk long, n int, keys array<long>, lows array<int>, sizes array<int>, vocabulary binary, words binary, alive binary"


def _words(row) -> np.ndarray:
    vocabulary = np.frombuffer(row.vocabulary, np.uint64)
    return vocabulary[from_planes(row.words, int(np.sum(row.sizes)))]


def _tries(words: np.ndarray, sizes: np.ndarray, alive: bytes, length: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of `length` words whose parts of `before` words repeat."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(max(0, len(words) - length + 1))
    at = at[at + length <= ends[: len(at)]]
    if before:
        bits = np.unpackbits(np.frombuffer(alive, np.uint8))[: len(words)].astype(bool)
        at = at[bits[at] & bits[at + length - before]]
    return at, windows(words, length)[at] if len(at) else np.zeros(0, np.uint64)


def _stretches(rows: DataFrame, width: int) -> DataFrame:
    """Chunks of the stretches of texts around anchors: a window with one of them lies in a stretch."""
    reach = width - lengths(width)[0]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = chunk_ids()
        keys, lows, parts, size = [], [], [], 0

        def made() -> pd.DataFrame:
            vocabulary, words = np.unique(np.concatenate(parts), return_inverse=True)
            row = (next(ids), size, keys, lows, [len(p) for p in parts], vocabulary.tobytes(), planes(words.astype(np.uint64)), b"")
            return pd.DataFrame([row], columns=["chunk", "n", "keys", "lows", "sizes", "vocabulary", "words", "alive"])

        for frame in frames:
            texts, own = texts_of(frame["text"]), frame["key"].tolist()
            for a, b in batches(texts):
                words, offsets = hash_words(texts[a:b], SPACED)
                for d in range(a, b):
                    text = words[offsets[d - a] : offsets[d - a + 1]]
                    at = np.frombuffer(frame["places"].iat[d], "<i4").astype(np.int64)
                    low, high = np.maximum(at - reach, 0), np.minimum(at + width, len(text))
                    first = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
                    for s, e in zip(low[first].tolist(), high[np.append(first[1:], len(at)) - 1].tolist(), strict=True):
                        keys.append(own[d])
                        lows.append(s)
                        parts.append(text[s:e])
                        size += e - s
                    if size >= CHUNK:
                        yield made()
                        keys, lows, parts, size = [], [], [], 0
        if size:
            yield made()

    return rows.mapInPandas(work, _STATE)


def _level(state: DataFrame, length: int, before: int, bits: int) -> DataFrame:
    """The state with what the windows of `length` words came to; chunks without a repeated one go."""

    def emit(frame: pd.DataFrame):
        for row in frame.itertuples():
            _, hashes = _tries(_words(row), np.asarray(row.sizes), row.alive, length, before)
            if len(hashes):
                yield row.chunk, *counted(hashes)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, row in enumerate(frame.itertuples()):
                words = _words(row)
                at, hashes = _tries(words, np.asarray(row.sizes), row.alive, length, before)
                alive = np.zeros(len(words), bool)
                alive[at] = _hits(hashes, row.answers)
                if alive.any():
                    one = frame.iloc[i : i + 1].drop(columns="answers")
                    one["alive"] = [np.packbits(alive).tobytes()]
                    yield one

    answers = met(state, emit, _repeated, bits)
    return state.join(answers, "chunk").mapInPandas(work, _STATE)


def _spans(state: DataFrame, width: int) -> DataFrame:
    """key, starts, ends of the covered words of every text that has some."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                bits = np.unpackbits(np.frombuffer(row.alive, np.uint8))
                edges = np.concatenate([[0], np.cumsum(np.asarray(row.sizes))])
                found: dict[int, tuple[list[int], list[int]]] = {}
                for key, low, a, b in zip(row.keys, row.lows, edges.tolist(), edges[1:].tolist(), strict=False):
                    at = np.flatnonzero(bits[a:b])
                    if not len(at):
                        continue
                    first = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + width]))
                    last = np.append(first[1:], len(at)) - 1
                    starts, ends = found.setdefault(int(key), ([], []))
                    # the second of two equal rows brings the same spans again
                    if not starts or starts[-1] < at[0] + low:
                        starts += (at[first] + low).tolist()
                        ends += (at[last] + low + width).tolist()
                if found:
                    yield pd.DataFrame([(k, s, e) for k, (s, e) in found.items()], columns=["key", "starts", "ends"])

    return state.mapInPandas(work, "key long, starts array<int>, ends array<int>").dropDuplicates(["key"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Words of texts that windows of `width` words cover which also start elsewhere: key, starts, ends.

    One row for a text that has any; words count from 0, ends are exclusive, spans rise and don't meet.
    `key` is the row_key of id and text, so equal rows, which repeat each other, share one row.
    """
    if width < 2:
        raise ValueError(f"a window needs two words or more, got {width}")
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    levels = lengths(width)
    chunks = stored(_anchored(rows, width), "anchors")
    answers = met(chunks, _emit_hashes, _repeated, bucket_bits(_total(chunks, "n")))
    texts = stored(_candidate_texts(chunks.join(answers, "chunk")).dropDuplicates(["key"]), "candidates")
    known = rows.sparkSession.sparkContext.broadcast(bitmap(texts, F.col("key"), MAP_BITS))

    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[in_bitmap(known.value, frame["key"].to_numpy(np.int64).view(np.uint64), MAP_BITS)]

    state = stored(_stretches(rows.mapInPandas(some, "key long, text string").join(texts, "key"), width), "stretches")
    bits = bucket_bits(_total(state, "n"))
    for before, length in zip([0, *levels[1:]], levels[1:], strict=False):
        state = stored(_level(state, length, before, bits), f"level-{length}")
    return stored(_spans(state, width), "spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every row: the text without its repeated passages.

    Words stand between white space ([\\x20\\x09-\\x0D]) and are compared as they are; kept ones are
    joined by one blank. Windows are judged on the texts as given. Texts shorter than the width, empty
    and null ones lose nothing; a null text has no words. Repeated rows are passages of each other.
    An empty table gives no rows, null ids are kept, further columns are not read. A text is worked
    on in memory, about 60 bytes a word.
    """
    # ids travel as text: among nulls pandas would hold them as floats
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, id_col, text_col, width)
    known = rows.sparkSession.sparkContext.broadcast(bitmap(spans, F.col("key"), MAP_BITS))
    shape = "doc_id string, n_words long, n_removed long, kept string"

    def cut(frame: pd.DataFrame, spans) -> pd.DataFrame:
        out = []
        for text, (starts, ends) in zip(texts_of(frame["text"]), spans, strict=True):
            words = text.encode("utf-8", "replace").split()
            kept, at = [], 0
            for s, e in zip(starts, ends, strict=True):
                kept += words[at:s]
                at = e
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
        made = pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])
        made.insert(0, "doc_id", frame["doc_id"].to_numpy())
        return made

    def maybe(frame: pd.DataFrame) -> np.ndarray:
        return in_bitmap(known.value, frame["key"].to_numpy(np.int64).view(np.uint64), MAP_BITS)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame[~maybe(frame)]
            if len(own):
                yield cut(own, [((), ())] * len(own))

    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[maybe(frame)]

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [((), ()) if s is None else (s, e) for s, e in zip(frame["starts"], frame["ends"], strict=True)]
            yield cut(frame, found)

    untouched = rows.mapInPandas(whole, shape)
    touched = rows.mapInPandas(some, "key long, doc_id string, text string").join(spans, "key", "left").mapInPandas(parts, shape)
    return untouched.union(touched).withColumn("doc_id", F.col("doc_id").cast("long"))
