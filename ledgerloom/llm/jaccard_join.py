"""N-gram Jaccard join by chosen paths.

Texts are sets of word shingles; equal sets are one set. In each run a set picks the tokens whose hash is
below 1 / (similarity x size), one and a quarter on average, and joins their buckets; within a bucket it
picks further tokens by hashes of the path so far. Two sets of the wanted similarity share one picked
token a level on average, so a run finds them with fair odds and RUNS runs nearly surely:
at one level a run misses them with probability 1/e, at two with 0.54, at three with 0.63, which leaves
6e-6, 6e-4 and 4e-3 after RUNS. All picks depend on the set alone and are made in one pass.

Buckets of at most SMALL entries are compared by brute force, larger ones are split by the next level.
What is still large at the last level (near copies can't be split) is compared in blocks of BLOCK
sets against BLOCK, so every pair is still compared and no task holds a whole bucket. Sketches find
candidates; whole sets decide. A pair counts in the first bucket that its sets share, so numbers of links
need no list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import bitmap, connected, in_bitmap, row_key, sorted_groups, texts_of
from ledgerloom.llm.text import batches, constants, hash_words, mix, shingles
from ledgerloom.session import stored

SIMILARITY = 0.8
RUNS = 12
SMALL = 1024
BLOCK = 256
#: One byte of each of SKETCH minhashes; a pair of the wanted similarity agrees in 51 of 64 on average,
#: and in fewer than ALIKE with a probability of 2e-5.
SKETCH = 64
ALIKE = 38
#: Bits of the map of sets that have candidates: 8 MB whatever their number.
MAP_BITS = 26

_RUN = constants(RUNS, 61)
_MINHASH = constants(SKETCH, 67)
_CELLS = 4_000_000


def token_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Sorted distinct 32-bit shingle hashes of each text."""
    for a, b in batches(texts):
        hashes, offsets = shingles(*hash_words(texts[a:b]))
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(b - a):
            yield np.unique(short[offsets[i] : offsets[i + 1]])


def signature(tokens: np.ndarray) -> int:
    """64-bit hash of a set, 0 for the empty one."""
    if not len(tokens):
        return 0
    total = mix(tokens.astype(np.uint64) + np.uint64(1)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(tokens))])).view(np.int64)[0])


def sketch(tokens: np.ndarray) -> bytes:
    wide = tokens.astype(np.uint64)
    step = max(1, _CELLS // max(1, len(wide)))
    low = [(wide[:, None] * _MINHASH[None, c : c + step]).min(0) for c in range(0, SKETCH, step)]
    return (np.concatenate(low) >> np.uint64(20)).astype(np.uint8).tobytes()


def _picks(wide: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, key) places whose hash is below the limit."""
    step = max(1, _CELLS // len(wide))
    tokens, columns = [], []
    for c in range(0, len(keys), step):
        t, k = np.nonzero((wide[:, None] * keys[None, c : c + step]) <= np.uint64(limit))
        tokens.append(t)
        columns.append(k + c)
    return np.concatenate(tokens), np.concatenate(columns)


def chosen_paths(tokens: np.ndarray) -> np.ndarray:
    """Rows of three path hashes, one for each leaf; 0 where a path has no further token."""
    wide = tokens.astype(np.uint64)
    limit = min((1 << 64) - 1, int((1 << 64) / (SIMILARITY * len(wide))))
    t1, run = _picks(wide, _RUN, limit)
    p1 = mix(wide[t1] + _RUN[run]) | np.uint64(1)
    if not len(p1):
        return np.zeros((0, 3), np.int64)
    t2, of1 = _picks(wide, p1, limit)
    fresh = t2 != t1[of1]
    t2, of1 = t2[fresh], of1[fresh]
    p2 = mix(wide[t2] + mix(p1[of1])) | np.uint64(1)
    rows = [np.stack([p1[c], np.zeros_like(p1[c]), np.zeros_like(p1[c])], 1) for c in [np.setdiff1d(np.arange(len(p1)), of1)]]
    if len(p2):
        t3, of2 = _picks(wide, p2, limit)
        fresh = (t3 != t2[of2]) & (t3 != t1[of1[of2]])
        t3, of2 = t3[fresh], of2[fresh]
        p3 = mix(wide[t3] + mix(p2[of2])) | np.uint64(1)
        rows.append(np.stack([p1[of1[of2]], p2[of2], p3], 1))
        dead = np.setdiff1d(np.arange(len(p2)), of2)
        rows.append(np.stack([p1[of1[dead]], p2[dead], np.zeros(len(dead), np.uint64)], 1))
    return np.concatenate(rows).view(np.int64)


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for tokens in token_sets(texts_of(frame["text"])):
            if len(tokens):
                paths = chosen_paths(tokens)
                out.append((signature(tokens), len(tokens), sketch(tokens), paths[:, 0], paths[:, 1], paths[:, 2]))
            else:
                out.append((0, 0, b"", [], [], []))
        made = pd.DataFrame(out, columns=["sig", "size", "sketch", "p1", "p2", "p3"])
        made.insert(0, "doc_id", frame["doc_id"].astype("Int64"))
        made.insert(0, "key", frame["key"])
        yield made


def _first_meetings(pairs: tuple[np.ndarray, np.ndarray], buckets: list, bucket: int) -> np.ndarray:
    """For each pair, whether the smallest bucket that both are in is this one."""
    width = max(map(len, buckets))
    table = np.zeros((len(buckets), width), np.int64)
    for i, own in enumerate(buckets):
        table[i, : len(own)] = own
    out = []
    for c in range(0, len(pairs[0]), 20_000):
        x, y = table[pairs[0][c : c + 20_000]], table[pairs[1][c : c + 20_000]]
        before = (x < bucket) & (x != 0)
        met = np.zeros(len(x), bool)
        for k in range(width):
            met |= (before & (x == y[:, k : k + 1])).any(1)
        out.append(~met)
    return np.concatenate(out) if out else np.zeros(0, bool)


def _pairs_apart(sides: np.ndarray) -> np.ndarray:
    """Pairs a group has to compare: sides 0 and 1 with each other, or a block (side 2) in itself."""
    if sides[0] == 2:
        return np.triu(np.ones((len(sides), len(sides)), bool), 1)
    return (sides[:, None] == 0) & (sides[None, :] == 1)


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of a bucket with a partner of a like sketch that they meet here first."""
    for group in sorted_groups(frames, "group"):
        n = len(group)
        sides = group["side"].to_numpy()
        if n < 2 or sides.min() == sides.max() != 2:
            continue
        bytes_ = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(n, SKETCH)
        size = group["size"].to_numpy()
        alike = np.zeros((n, n), bool)
        for i in range(n):
            alike[i] = (bytes_[i] == bytes_).sum(1) >= ALIKE
        alike &= _pairs_apart(sides) & (np.minimum.outer(size, size) >= SIMILARITY * np.maximum.outer(size, size) - 1e-9)
        pairs = np.nonzero(alike)
        if not len(pairs[0]):
            continue
        first = _first_meetings(pairs, list(group["buckets"]), int(group["bucket"].iat[0]))
        kept = np.unique(np.concatenate([pairs[0][first], pairs[1][first]]))
        if len(kept):
            yield group.iloc[kept].drop(columns="sketch")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(sets)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    row, column = row[shared], place[column[shared]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int((count > 1).sum()), 4096):
        here = (column >= c) & (column < c + 4096)
        block = np.zeros((len(sets), 4096), np.float32)
        block[row[here], column[here] - c] = 1
        total += block @ block.T  # whole numbers below 2**24 stay exact
    return total.astype(np.int64)


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members with links: how many they meet here first, and the smallest member they reach here."""
    for group in sorted_groups(frames, "group"):
        sides = group["side"].to_numpy()
        if len(group) < 2 or sides.min() == sides.max() != 2:
            continue
        sets = [np.frombuffer(b, "<u4") for b in group["tokens"]]
        size = np.array([len(s) for s in sets])
        common = _intersections(sets)
        linked = (common >= SIMILARITY * (size[:, None] + size[None, :] - common) - 1e-9) & _pairs_apart(sides)
        pairs = np.nonzero(linked)
        if not len(pairs[0]):
            continue
        first = _first_meetings(pairs, list(group["buckets"]), int(group["bucket"].iat[0]))
        count = np.bincount(pairs[0][first], minlength=len(group)) + np.bincount(pairs[1][first], minlength=len(group))
        sig = group["sig"].to_numpy()
        root, both = sig.copy(), linked | linked.T
        while True:
            lower = np.minimum(root, np.where(both, root[None, :], np.iinfo(np.int64).max).min(1))
            if (lower == root).all():
                break
            root = lower
        some = both.any(1)
        yield pd.DataFrame({"sig": sig[some], "links": count[some], "root": root[some]})


def _ended(entries: DataFrame, level: str, deeper: str | None) -> tuple[DataFrame, DataFrame | None]:
    """Entries whose bucket ends at this level, and those that are split further."""
    sizes = entries.where(F.col(level) != 0).groupBy(level).agg(F.count("*").alias("n"), F.min("sig").alias("lo"), F.max("sig").alias("hi"))
    # written first, so that the join has two plain shuffles and a hot bucket's can be split
    sizes = stored(sizes.where("lo <> hi").select(level, "n"), "bucket-sizes")
    counted = entries.join(sizes.hint("merge"), level)  # one plan at every size
    small = counted if deeper is None else counted.where(F.col("n") <= SMALL)
    small = small.select("sig", F.col(level).alias("bucket"), "n")
    return small, None if deeper is None else counted.where((F.col("n") > SMALL) & (F.col(deeper) != 0)).drop("n")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, doc_id, class_id, n_links, n_copies, class_key.

    A class is what links of SIMILARITY or more connect; class_id is its smallest doc_id (null if it has
    none) and class_key its smallest key. n_links counts the other distinct sets that a row's set is
    linked to, n_copies the rows with the same set. Texts without words, null ones among them, are like
    nothing: each has itself as class, no links and one copy. `key` is the row_key of id and text, so
    repeated rows share it. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shape = "key long, doc_id long, sig long, size int, sketch binary, p1 array<long>, p2 array<long>, p3 array<long>"
    every = stored(rows.mapInPandas(_features, shape), "features")
    sized = every.where("size > 0")
    sets = stored(sized.drop("key", "doc_id").dropDuplicates(["sig"]), "sets")

    # buckets
    entries = sets.select("sig", F.explode(F.arrays_zip("p1", "p2", "p3")).alias("p")).select("sig", "p.p1", "p.p2", "p.p3")
    first, rest = _ended(entries, "p1", "p2")
    second, rest = _ended(stored(rest, "rest"), "p2", "p3")
    third, _ = _ended(stored(rest, "rest"), "p3", None)
    members = first.union(second).union(third).groupBy("sig", "bucket").agg(F.max("n").alias("n"))
    # a set is in as many buckets as it has paths at most
    members = members.groupBy("sig").agg(F.collect_list(F.struct("bucket", "n")).alias("in"))
    members = members.join(sets.select("sig", "size", "sketch"), "sig")
    members = members.select("sig", "size", "sketch", F.col("in.bucket").alias("buckets"), F.explode("in").alias("one"))
    blocks = F.ceil(F.col("one.n") / BLOCK).cast("int")
    members = members.withColumn("own", F.pmod(F.xxhash64("sig"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.select(
        F.xxhash64("one.bucket", F.least("own", "other"), F.greatest("own", "other")).alias("group"),
        F.col("one.bucket").alias("bucket"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
        "sig",
        "size",
        "sketch",
        "buckets",
    )
    kept = "group long, bucket long, side int, sig long, size int, buckets array<long>"
    alike = members.repartition(parts, "group").sortWithinPartitions("group").mapInPandas(_candidates, kept)
    alike = stored(alike, "candidates")

    # exact links
    wanted = spark.sparkContext.broadcast(bitmap(alike, F.col("sig"), MAP_BITS))

    def whole_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(signature(t), t) for t in token_sets(texts_of(frame["text"]))]
            sigs = np.array([s for s, _ in found], np.int64)
            picked = np.flatnonzero((sigs != 0) & in_bitmap(wanted.value, sigs.view(np.uint64), MAP_BITS))
            yield pd.DataFrame({"sig": sigs[picked], "tokens": [found[i][1].astype("<u4").tobytes() for i in picked]})

    tokens = rows.select("text").mapInPandas(whole_sets, "sig long, tokens binary").dropDuplicates(["sig"])
    compared = alike.join(tokens, "sig").repartition(parts, "group").sortWithinPartitions("group")
    links = stored(compared.mapInPandas(_links, "sig long, links long, root long"), "set-links")

    # classes
    roots = connected(links.select(F.col("sig").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "sig")
    counts = links.groupBy("sig").agg(F.sum("links").alias("n_links"))
    own = sized.groupBy("sig").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("low_id"), F.min("key").alias("low_key"))
    own = own.join(counts, "sig", "left").join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    heads = own.groupBy("root").agg(F.min("low_id").alias("class_id"), F.min("low_key").alias("class_key"))
    own = own.join(heads, "root").select("sig", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "class_id", "class_key")
    linked = sized.select("key", "doc_id", "sig").join(own, "sig")
    empty = every.where("size = 0")
    columns = ["key", "doc_id", "class_id", "n_links", "n_copies", "class_key"]
    return linked.select(columns).union(
        empty.select("key", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("key").alias("class_key"))
    )


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """One row of each class of `docs`, with its columns: the one with the smallest doc_id, null last."""
    found = classes(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    heads = found.groupBy("class_key").agg(F.min(order).alias("head")).select(F.col("head.key").alias("__row"))
    kept = docs.withColumn("__row", row_key("doc_id", "text")).join(heads, "__row", "left_semi")
    return kept.dropDuplicates(["__row"]).drop("__row")
