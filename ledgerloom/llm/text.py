"""Words, shingles and hashes of whole texts, in numpy over UTF-8 bytes.

A word is a maximal run of ASCII letters and digits and of characters beyond ASCII; A-Z count as a-z.
Nothing here keeps more than one batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SHINGLE_WORDS = 5
#: Texts are worked on in batches of about BATCH_BYTES characters and hashed in chunks of CHUNK_BYTES, which
#: bounds what a Python worker holds beside its Arrow batch. A single longer text is a batch of its own.
BATCH_BYTES = 200_000
CHUNK_BYTES = 400_000

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256)
    upper = (code >= 65) & (code <= 90)
    is_word = ((code >= 48) & (code <= 57)) | upper | ((code >= 97) & (code <= 122)) | (code >= 128)
    value = constants(256, 11)[np.where(upper, code + 32, code)]
    return is_word, np.where(is_word, value, np.uint64(0))


IS_WORD, _VALUE = _tables()
#: Byte tables of words: case-folded words of letters and digits, and whatever stands between white space.
FOLDED = IS_WORD, _VALUE
_NOT_SPACE = (np.arange(256) != 32) & ((np.arange(256) < 9) | (np.arange(256) > 13))
SPACED = _NOT_SPACE, np.where(_NOT_SPACE, constants(256, 13), np.uint64(0))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_steps(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; tables beyond the usual chunk are not kept."""
    if n > CHUNK_BYTES + 4096:
        return _power_steps(n, _BASE), _power_steps(n, _BASE_INVERSE)
    if len(_powers[0]) < n:
        _powers[:] = [_power_steps(CHUNK_BYTES + 4096, _BASE), _power_steps(CHUNK_BYTES + 4096, _BASE_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def _hash_chunk(data: np.ndarray, is_word: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a chunk that cuts no word."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = is_word[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * power[: len(data)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def hash_words(texts: list[str], table: tuple[np.ndarray, np.ndarray] = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words begin (len(texts) + 1)."""
    is_word, value = table
    raw = [t.encode("utf-8", "replace") for t in texts]
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=first[1:])
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        while end < len(data) and is_word[data[end - 1]]:  # never cut inside a word
            end += 1
        s, h = _hash_chunk(data[at:end], is_word, value)
        starts.append(s + at)
        hashes.append(h)
        at = end
    all_starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return all_hashes, np.searchsorted(all_starts, first)


def windows(words: np.ndarray, width: int, places: Iterable[int] | None = None, seed: int = 23) -> np.ndarray:
    """Hash of the words at `places` (default: all) of every window of `width` words."""
    n = max(0, len(words) - width + 1)
    keys = constants(width, seed)
    total = np.zeros(n, np.uint64)
    for i in range(width) if places is None else places:
        total += words[i : i + n] * keys[i]
    return mix(total)


def shingles(words: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text in order, and their offsets.

    A text of 1 to width - 1 words has one shingle of all of them; a text without words has none.
    """
    counts = np.diff(offsets)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(sizes, out=out_offsets[1:])
    out = np.empty(out_offsets[-1], np.uint64)
    hashed = windows(words, width)
    owner = np.repeat(np.arange(len(counts)), counts)[: len(hashed)]
    at = np.arange(len(hashed))
    whole = at + width <= offsets[1:][owner]
    out[(out_offsets[owner] + at - offsets[owner])[whole]] = hashed[whole]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        n = counts[d]
        out[out_offsets[d]] = windows(words[offsets[d] : offsets[d + 1]], int(n), seed=23 + int(n))[0]
    return out, out_offsets


def batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about BATCH_BYTES characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
