"""Token ids as binary files of patched frame-of-reference blocks.

Documents are range-partitioned by doc_id, so that the partitions, and the files inside one, follow
doc_id order. A file holds whole documents and is closed at about FILE_TOKENS ids:

    magic "TKPF0001"
    blocks: BLOCK ids each, the last one shorter
    documents: their ids and numbers of tokens, as little-endian int64 arrays
    block starts: byte offsets as little-endian int64
    footer: documents, tokens, blocks, offset of the documents (4 x int64), magic

A block is: uint32 minimum, uint16 count, uint8 width, uint16 exceptions; the values less the minimum,
their low `width` bits packed; then uint16 places and uint32 high parts of the exceptions. The width is
the cheapest that at least PERCENTILE of the values fit in.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.frames import texts_of
from ledgerloom.llm.text import constants, mix, power_tables
from ledgerloom.session import scratch_dir, stored

BLOCK = 4096
PERCENTILE = 0.9
FILE_TOKENS = 4_000_000
END_ID = 0
MAGIC = b"TKPF0001"
#: Characters of the texts encoded in one call.
CALL_CHARS = 1_000_000

_HEAD = struct.Struct("<IHBH")
_FOOT = struct.Struct("<qqqq8s")


# ---- blocks ----


def pack_block(values: np.ndarray) -> bytes:
    """Pack 1 to BLOCK uint32 values."""
    low = int(values.min())
    rest = values.astype(np.uint32) - np.uint32(low)
    sizes = np.bincount(np.frexp(rest.astype(np.float64))[1], minlength=33)  # bits each value needs
    fitting = np.cumsum(sizes)
    cost = [
        (len(rest) * w + 48 * int(len(rest) - fitting[w]), w) for w in range(33) if fitting[w] >= PERCENTILE * len(rest)
    ]
    width = min(cost)[1]
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = (rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    body = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    patches = over.astype("<u2").tobytes() + (rest[over] >> np.uint32(min(width, 31))).astype("<u4").tobytes()
    return _HEAD.pack(low, len(rest), width, len(over)) + body + patches


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    low, n, width, patches = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little")
    rest = np.zeros(n, np.uint32)
    columns = bits.reshape(n, width)
    for i in range(width):
        rest |= columns[:, i].astype(np.uint32) << np.uint32(i)
    at += size
    places = np.frombuffer(data, "<u2", patches, at)
    rest[places] |= np.frombuffer(data, "<u4", patches, at + 2 * patches) << np.uint32(min(width, 31))
    return rest + np.uint32(low)


# ---- files ----


def file_bytes(doc_ids: list[int | None], counts: list[int], tokens: np.ndarray) -> bytes:
    """One file of whole documents; a null doc_id is stored as the smallest int64."""
    parts, starts, at = [MAGIC], [], len(MAGIC)
    for i in range(0, len(tokens), BLOCK):
        block = pack_block(tokens[i : i + BLOCK])
        starts.append(at)
        parts.append(block)
        at += len(block)
    ids = np.array([np.iinfo(np.int64).min if d is None else d for d in doc_ids], "<i8")
    parts += [ids.tobytes(), np.array(counts, "<i8").tobytes(), np.array(starts, "<i8").tobytes()]
    return b"".join([*parts, _FOOT.pack(len(ids), len(tokens), len(starts), at, MAGIC)])


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, numbers of tokens, and all ids of a file."""
    n_docs, n_tokens, n_blocks, at, magic = _FOOT.unpack_from(data, len(data) - _FOOT.size)
    if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    ids = np.frombuffer(data, "<i8", n_docs, at)
    counts = np.frombuffer(data, "<i8", n_docs, at + 8 * n_docs)
    starts = np.frombuffer(data, "<i8", n_blocks, at + 16 * n_docs)
    blocks = [unpack_block(data, int(s)) for s in starts]
    tokens = np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)
    if len(tokens) != n_tokens:
        raise ValueError("token file is damaged")
    return ids, counts, tokens


def read_tokens(data: bytes, first: int, count: int) -> np.ndarray:
    """`count` ids of a file from place `first` on; opens only the blocks that hold them."""
    n_docs, _, _, at, _ = _FOOT.unpack_from(data, len(data) - _FOOT.size)
    if count <= 0:
        return np.zeros(0, np.uint32)
    a, b = first // BLOCK, (first + count - 1) // BLOCK
    starts = np.frombuffer(data, "<i8", b - a + 1, at + 16 * n_docs + 8 * a)
    tokens = np.concatenate([unpack_block(data, int(s)) for s in starts])
    return tokens[first - a * BLOCK : first - a * BLOCK + count]


# ---- encoding ----


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Encodes whole texts with a byte-level BPE, most pieces without calling the tokenizer.

    The pre-tokenizer always cuts before a single space between two characters that aren't white space.
    Texts are cut there; a piece is known by its length and 64-bit hash, and a table with one place a hash
    prefix keeps the ids of pieces seen before. New pieces are strung together, which leaves the cuts
    where they are, and encoded; the known byte length of every id tells them apart again. Texts that hold
    the string of a special token, which the tokenizer knows as that token, are encoded whole. Tests compare
    with encoding whole texts. Two pieces of one hash and different bytes would share their ids; the table holds
    2**22 pieces, so a new piece is taken for another with a probability of 2**-64 at its one place.
    """

    SLOTS = 22

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        self.tokenizer = _tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        letters = set(pre_tokenizers.ByteLevel.alphabet())
        for word, i in vocabulary.items():
            self.id_bytes[i] = len(word) if letters.issuperset(word) else len(word.encode())
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.SLOTS
        self.keys, self.at, self.n = np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.arena, self.used = np.zeros(1 << 22, np.uint32), 0

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and their numbers; the pieces' byte ranges are given."""
        loose = (data[starts] != 32) | ~_SOLID[data[ends - 1]] | _wide_before(data, ends)
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        strings, owners, run, size = [], [], [], 0
        for i, alone in enumerate(loose.tolist()):
            if alone:
                strings.append(pieces[i].decode())
                owners.append([i])
                continue
            run.append(i)
            size += len(pieces[i])
            if size > 20_000:
                strings.append(b"".join([pieces[j] for j in run]).decode())
                owners.append(run)
                run, size = [], 0
        if run:
            strings.append(b"".join([pieces[j] for j in run]).decode())
            owners.append(run)
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        order = np.array([i for run in owners for i in run], np.int64)
        flat = np.concatenate(found)
        last = np.cumsum(self.id_bytes[flat])
        cuts = np.searchsorted(last, np.cumsum((ends - starts)[order]), side="left") + 1
        sizes = np.diff(cuts, prepend=0)
        firsts = np.empty(len(order), np.int64)
        lengths = np.empty(len(order), np.int64)
        firsts[order], lengths[order] = cuts - sizes, sizes
        source = np.repeat(firsts - np.cumsum(lengths) + lengths, lengths) + np.arange(len(flat))
        return flat[source], lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, each text's closed by END_ID, and the numbers of ids."""
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if not whole:
            return self._encode(texts)
        own = dict(zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True))
        ids, counts = self._encode(["" if i in own else t for i, t in enumerate(texts)])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        parts = [np.append(np.array(own[i].ids, np.uint32), np.uint32(END_ID)) if i in own else p for i, p in enumerate(parts)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without the string of a special token."""
        raw = [t.encode("utf-8") for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return np.full(len(raw), END_ID, np.uint32), np.ones(len(raw), np.int64)
        inner = np.flatnonzero((data[1:-1] == 32) & _SOLID[data[:-2]] & _SOLID[data[2:]] & ~_WIDE[data[2:]]) + 1
        inner = inner[~_wide_before(data, inner)]
        cut = np.zeros(len(data) + 1, bool)
        cut[inner] = True
        cut[bounds[1:][sizes > 0] - 1] = False  # a space that ends a text has nothing after it
        cut[bounds[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut[: len(data)])
        ends = np.append(starts[1:], len(data))
        piece_hash = self._hashes(data, starts, ends)
        if self.used > 12_000_000:
            self._clear()
        place = (piece_hash >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        miss = np.flatnonzero(self.keys[place] != piece_hash)
        count = self.n[place].astype(np.int64)
        origin = self.at[place].astype(np.int64)
        if len(miss):
            new, which, back = np.unique(piece_hash[miss], return_index=True, return_inverse=True)
            learned, lengths = self._learn(data, starts[miss[which]], ends[miss[which]])
            begin = self.used + np.cumsum(lengths) - lengths
            need = self.used + len(learned)
            if need > len(self.arena):
                self.arena = np.concatenate([self.arena, np.zeros(need, np.uint32)])
            self.arena[self.used : need] = learned
            self.used = need
            count[miss], origin[miss] = lengths[back], begin[back]
            slot = place[miss[which]]
            self.keys[slot], self.at[slot], self.n[slot] = new, begin, lengths
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.arena[np.repeat(origin - total[:-1], count) + np.arange(total[-1])]
        per_text = total[np.searchsorted(starts, bounds)]
        return np.insert(ids, per_text[1:], END_ID), np.diff(per_text) + 1

    @staticmethod
    def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        power, inverse = power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:-1], out=total[1:])
        found = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        return np.where(found == 0, np.uint64(1), found)


@cache
def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which serves many tasks and keeps what it has seen."""
    return Encoder(path)


def _wide_before(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the character before a place may be white space beyond ASCII."""
    two, three = data[(places - 2).clip(0)], data[(places - 3).clip(0)]
    return ((two == 0xC2) & (places >= 2)) | (_WIDE[three] & (three != 0xC2) & (places >= 3))


#: Bytes that aren't ASCII white space or control characters; lead bytes of all white space beyond ASCII.
_SOLID = np.array([b > 32 and b != 127 for b in range(256)])
_WIDE = np.array([b in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])
_BYTE = constants(256, 31)


# ---- Spark ----


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write the documents; returns the file list: part, seq, path, n_docs, n_tokens.

    Parts and the files of a part follow ascending doc_id; null ids come first, and rows with one id
    are ordered by their text. A null text is empty and has the end id alone. Other columns are not
    read. A file's name holds the task attempt, so a repeated task never touches a listed file.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        encoder = worker_encoder(tokenizer_path)
        ids: list[int | None] = []
        counts: list[int] = []
        tokens: list[np.ndarray] = []
        held = seq = 0

        def close() -> pa.RecordBatch:
            nonlocal held, seq
            name = f"part-{part:06d}-{seq:04d}-{attempt}.tkpf"
            with filesystem.open_output_stream(f"{root}/{name}") as out:
                out.write(file_bytes(ids, counts, np.concatenate(tokens)))
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [f"{folder}/{name}"],
                 "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([held], pa.int64())}
            )
            ids.clear(), counts.clear(), tokens.clear()
            held, seq = 0, seq + 1
            return row

        def add(some_ids: list, some_texts: list[str]) -> None:
            nonlocal held
            flat, sizes = encoder.encode(some_texts)
            ids.extend(some_ids)
            counts.extend(sizes.tolist())
            tokens.append(flat)
            held += len(flat)

        for frame in frames:
            batch_ids, texts = frame.column(0).to_pylist(), frame.column(1).to_pylist()
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= CALL_CHARS or i == len(texts) - 1:
                    add(batch_ids[start : i + 1], texts[start : i + 1])
                    start, size = i + 1, 0
                    if held >= FILE_TOKENS:
                        yield close()
        if ids:
            yield close()

    return stored(ordered.mapInArrow(write, "part int, seq int, path string, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Every document of the listed files, in no order: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it: sums of the parts (as many as partitions) give
    a part's start, the files before it in its part a file's, and the file itself its documents'.
    """
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("in_part", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).join(parts, "part")
    places = files.select("path", (F.col("part_start") + F.col("in_part")).alias("start"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, first in zip(frame["path"], frame["start"], strict=True):
                filesystem, name = _filesystem(path)
                with filesystem.open_input_stream(name) as source:
                    ids, counts, tokens = read_file(source.read())
                ends = np.cumsum(counts)
                raw = tokens.astype("<u4").tobytes()
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if i == np.iinfo(np.int64).min else i for i in ids.tolist()], "Int64"),
                        "start": first + ends - counts,
                        "n_tokens": counts,
                        "ids_crc32": [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)],
                    }
                )

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(n, "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write the documents' token files and return what is read back from them, a row per document."""
    folder = folder or scratch_dir(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_path, folder))


def texts_to_ids(texts: pd.Series, tokenizer_path: str) -> list[np.ndarray]:
    """Ids of each text with the end id, encoded as the files are."""
    flat, sizes = worker_encoder(tokenizer_path).encode(texts_of(texts))
    return np.split(flat, np.cumsum(sizes)[:-1])
