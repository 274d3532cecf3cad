"""Prefix trie of conversations from sorted neighbours.

A conversation is the path of the hashes of its prefixes, so two paths agree up to some depth and nowhere
beyond it, and sorted paths have common prefixes side by side. Within a run of sorted paths the links of
neighbours are taken by falling length of their common prefix: union-find joins the two components, and
the join makes a branching node (or adds to one) at that depth; the nodes between it and the
components' tops have one child each. What may go on beyond the ends of a run, the nodes on its first and
last path, is kept as a contracted forest; neighbouring forests are merged the same way, some at a time,
until one is left.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.frames import sorted_groups
from ledgerloom.session import stored

#: Bytes of a prefix hash.
HASH = 16
#: Turns of a run of paths that a task joins at once; a longer path is a run of its own.
RUN_TURNS = 100_000
#: Neighbouring partitions whose forests one task merges.
FAN = 16
#: Hash of no conversations: of the empty text.
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id long, depth long, parent_conv_id long, parent binary, key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


@dataclass
class Node:
    """What is known of a node: its members, and what its finished children add."""

    n: int
    low: int
    size: int  # bytes of its last turn
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None

    def above(self, size: int) -> Node:
        """The node one turn up, as far as this one's members tell."""
        return Node(self.n, self.low, size)

    def add(self, other: Node) -> None:
        """The same node, seen by other members."""
        self.n += other.n
        self.low = min(self.low, other.low)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends

    def adopt(self, child: tuple[int, int]) -> None:
        self.children += 1
        self.leaves += child[0]
        self.saved += child[1]


@dataclass
class Path:
    key: bytes  # prefix hashes, HASH bytes a turn
    sizes: list[int]

    def __len__(self) -> int:
        return len(self.sizes)

    def prefix(self, depth: int) -> bytes:
        return self.key[HASH * (depth - 1) : HASH * depth] if depth else b""

    def size(self, depth: int) -> int:
        return self.sizes[depth - 1] if depth else 0

    def common(self, other: Path) -> int:
        """Depth up to which two paths agree; prefix hashes agree up to it and not beyond."""
        low, high = 0, min(len(self), len(other))
        while low < high:
            mid = (low + high + 1) // 2
            if self.prefix(mid) == other.prefix(mid):
                low = mid
            else:
                high = mid - 1
        return low


def _close(out: list, path: Path, depth: int, node: Node, parent: Node | None) -> None:
    """Finish a node: a row without its parent's smallest member, which isn't known yet."""
    leaves, saved = (node.leaves if node.children else 1), node.saved + (node.n - 1) * node.size
    above = path.prefix(depth - 1) if depth else None
    out.append([node.low, depth, None, above, path.prefix(depth), node.n, node.children, leaves, saved, node.ends or NO_ENDS])
    if parent is not None:
        parent.adopt((leaves, saved))


def _resolve(out: list, since: int) -> None:
    """Nodes closed one above the other tell each other's smallest member."""
    for child, parent in zip(out[since:], out[since + 1 :], strict=False):
        child[2], child[3] = parent[0], None


@dataclass
class Forest:
    """Nodes on the first and the last path of a run; they share those up to depth `shared`."""

    first: Path
    last: Path
    shared: int
    on_first: list[Node]  # depth 0 up
    on_last: list[Node] = field(default_factory=list)  # depth shared + 1 up

    def at_last(self, depth: int) -> Node:
        return self.on_first[depth] if depth <= self.shared else self.on_last[depth - self.shared - 1]


def _close_end(out: list, path: Path, nodes: list[Node], base: int, keep: int, under: Node | None) -> None:
    """Close nodes[i], which stand at depth base + i, from the end down to those at depth keep."""
    since = len(out)
    while nodes and base + len(nodes) - 1 > keep:
        node = nodes.pop()
        _close(out, path, base + len(nodes), node, nodes[-1] if nodes else under)
    _resolve(out, since)


def merge(a: Forest, b: Forest, depth: int, out: list) -> Forest:
    """Join neighbouring forests whose facing paths agree up to `depth`; finished nodes go to `out`."""
    # what lies deeper on the facing paths alone is finished
    _close_end(out, a.last, a.on_last, a.shared + 1, max(depth, a.shared), a.on_first[a.shared])
    _close_end(out, b.first, b.on_first, 0, max(depth, b.shared), None)
    for d in range(depth + 1):
        a.at_last(d).add(b.on_first[d])
    shared = min(a.shared, b.shared, depth)
    both = min(depth, b.shared)  # up to here the joined nodes are on the last path
    last = [a.at_last(d) for d in range(shared + 1, both + 1)] + b.on_first[both + 1 : b.shared + 1] + b.on_last
    if depth > both:  # deeper ones are on the first path, or on neither and finished
        _close_end(out, a.last, a.on_last, a.shared + 1, max(both, a.shared), a.on_first[a.shared])
    return Forest(a.first, b.last, shared, a.on_first, last)


def finish(forest: Forest, out: list) -> None:
    """Close all nodes; no neighbours are left."""
    _close_end(out, forest.last, forest.on_last, forest.shared + 1, forest.shared, forest.on_first[forest.shared])
    since = len(out)
    nodes = forest.on_first
    while nodes:
        node = nodes.pop()
        _close(out, forest.first, len(nodes), node, nodes[-1] if nodes else None)
    _resolve(out, since)


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def joined(forests: list[Forest], out: list) -> Forest:
    """Neighbouring forests as one: union-find over their links by falling common depth."""
    depths = [a.last.common(b.first) for a, b in zip(forests, forests[1:], strict=False)]
    parent = list(range(len(forests)))
    held = list(forests)
    for i in sorted(range(len(depths)), key=lambda i: (-depths[i], i)):
        left, right = _find(parent, i), _find(parent, i + 1)
        held[left] = merge(held[left], held[right], depths[i], out)
        held[right] = None
        parent[right] = left
    return held[_find(parent, 0)]


def joined_paths(paths: list[Path], leaves: list[Node], out: list) -> Forest:
    """The forest of distinct sorted paths, whose nodes at full depth are given.

    As `joined`, but a component inside the run holds its top node alone: what lies between a top and the
    depth of the next join has one child each and is finished there. The nodes on the first and last
    path of the run stay open.
    """
    count = len(paths)
    depths = [a.common(b) for a, b in zip(paths, paths[1:], strict=False)]
    parent = list(range(count))
    tops = [(len(p), leaf) for p, leaf in zip(paths, leaves, strict=True)]
    first: dict[int, Node] = {}
    last: dict[int, Node] = {}

    def lowered(root: int, path: Path, to: int, opened: dict[int, Node] | None) -> Node:
        """The component's node at depth `to`; those it passes are finished or stay open."""
        depth, node = tops[root]
        since = len(out)
        while depth > to:
            up = node.above(path.size(depth - 1))
            if opened is None:
                _close(out, path, depth, node, up)
            else:
                opened[depth] = node
            depth, node = depth - 1, up
        _resolve(out, since)
        return node

    ends = {}  # the last path of a component, by its root; its first path is the root's
    for i in sorted(range(count - 1), key=lambda i: (-depths[i], i)):
        left, right, to = _find(parent, i), _find(parent, i + 1), depths[i]
        high = ends.get(right, right)
        node = lowered(left, paths[left], to, first if left == 0 else None)
        node.add(lowered(right, paths[right], to, last if high == count - 1 else None))
        tops[left], parent[right], ends[left] = (to, node), left, high
    shared, node = tops[0]
    nodes = [node]
    for d in range(shared, 0, -1):
        nodes.append(nodes[-1].above(paths[0].size(d - 1)))
    on_first = nodes[::-1] + [first[d] for d in range(shared + 1, len(paths[0]) + 1)]
    return Forest(paths[0], paths[-1], shared, on_first, [last[d] for d in range(shared + 1, len(paths[-1]) + 1)])


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of hash and UTF-8 bytes) by turn, role and text; turn null first, null ids left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    told = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    turn = F.struct(at.alias("at"), told.alias("hash"), F.octet_length("text").cast("long").alias("size"))
    return rows.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(turns: DataFrame, base: Column, head: Column) -> DataFrame:
    """conv_id, turns: the first `head` turns of the conversation `base`, then a conversation's own after as many."""
    own = turns.withColumn("base", base).withColumn("head", head.cast("int"))
    bases = turns.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    start = F.slice(F.coalesce("base_turns", F.slice("turns", 1, 0)), F.lit(1), F.col("head"))
    rest = F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(bases, "base", "left").select("conv_id", F.concat(start, rest).alias("turns"))


def _paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prefix hashes of every conversation."""
    for frame in frames:
        made = []
        for hashes in frame["hashes"]:
            raw, key, parts = bytes.fromhex(hashes), b"", []
            for i in range(0, len(raw), 16):
                key = hashlib.blake2b(key + raw[i : i + 16], digest_size=HASH).digest()
                parts.append(key)
            made.append(b"".join(parts))
        yield pd.DataFrame({"conv_id": frame["conv_id"], "path": made, "sig": [p[-HASH:] for p in made], "sizes": frame["sizes"]})


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash of the ids of each signature, which come in rising order; no list of them is held."""
    sig, digest = None, hashlib.sha256()
    for frame in frames:
        out = []
        for own, conv in zip(frame["sig"], frame["conv_id"].tolist(), strict=True):
            if own != sig:
                if sig is not None:
                    out.append((sig, digest.hexdigest()))
                sig, digest = own, hashlib.sha256()
                digest.update(b"%d" % conv)
            else:
                digest.update(b",%d" % conv)
        if out:
            yield pd.DataFrame(out, columns=["sig", "ends"])
    if sig is not None:
        yield pd.DataFrame([(sig, digest.hexdigest())], columns=["sig", "ends"])


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """path, sizes, n, low, ends of every distinct sequence of turns: its copies, the smallest and all their ids."""
    listed = conversations.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["hash"]), "").alias("hashes"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = stored(listed.mapInPandas(_paths, "conv_id long, path binary, sig binary, sizes array<long>"), "paths")
    ids = paths.select("sig", "conv_id").repartition(parts, "sig").sortWithinPartitions("sig", "conv_id")
    ends = ids.mapInPandas(_ends, "sig binary, ends string")
    known = paths.groupBy("sig").agg(F.count("*").alias("n"), F.min(F.struct("conv_id", "path", "sizes")).alias("one"))
    return known.join(ends, "sig").select("one.path", "one.sizes", "n", F.col("one.conv_id").alias("low"), "ends")


def _node_frame(out: list) -> pd.DataFrame:
    return pd.DataFrame(out, columns=_COLUMNS, dtype=object).assign(place=None, part=None, forest=None)


def _emitted(out: list, place: tuple[int, int] | None, forest: Forest | None) -> Iterator[pd.DataFrame]:
    """Finished nodes, and the forest that is left."""
    for a in range(0, len(out), 5000):
        yield _node_frame(out[a : a + 5000])
    if forest is not None:
        row = dict.fromkeys(_COLUMNS) | {"part": place[0], "place": place[1], "forest": pickle.dumps(forest)}
        yield pd.DataFrame([row])[[*_COLUMNS, "place", "part", "forest"]]


_STATE = f"{_NODE}, place long, part long, forest binary"


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of a partition's sorted paths, each joined to a forest."""
    task = TaskContext.get()
    part, place = (task.partitionId() if task else 0), 0
    paths, leaves, size = [], [], 0
    for frame in frames:
        for path, sizes, n, low, ends in zip(frame["path"], frame["sizes"], frame["n"].tolist(), frame["low"].tolist(), frame["ends"], strict=True):
            paths.append(Path(path, [int(s) for s in sizes]))
            leaves.append(Node(n, low, paths[-1].size(len(paths[-1])), ends=ends))
            size += len(sizes) + 1
            if size >= RUN_TURNS:
                out: list = []
                forest = joined_paths(paths, leaves, out)
                yield from _emitted(out, (part, place), forest)
                paths, leaves, size, place = [], [], 0, place + 1
    if paths:
        out = []
        forest = joined_paths(paths, leaves, out)
        yield from _emitted(out, (part, place), forest)


def _merged(only: bool):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, "group"):
            out: list = []
            forest = joined([pickle.loads(f) for f in group["forest"]], out)
            if only:
                finish(forest, out)
                forest = None
            yield from _emitted(out, (int(group["group"].iat[0]), 0), forest)

    return work


def trie(conversations: DataFrame, fan: int = FAN) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations (conv_id, turns).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256; a node is known by conv_id and depth. A conversation without turns is a
    member of the root alone. No conversations give no nodes. A conversation is worked on as a whole, at
    about 200 bytes a turn; copies of one are met once, with their number.
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = stored(distinct_paths(conversations), "distinct-paths")
    ranged = paths.repartitionByRange(parts, "path").sortWithinPartitions("path")
    state = stored(ranged.mapInPandas(_runs, _STATE), "runs")
    rounds, width = [state], parts
    while True:
        forests = state.where(F.col("forest").isNotNull())
        width = -(-width // fan)
        grouped = forests.select(F.floor(F.col("part") / fan).cast("long").alias("group"), "part", "place", "forest")
        grouped = grouped.repartition(width, "group").sortWithinPartitions("group", "part", "place")
        state = stored(grouped.mapInPandas(_merged(width == 1), _STATE), "forests")
        rounds.append(state)
        if width == 1:
            break
    nodes = rounds[0]
    for more in rounds[1:]:
        nodes = nodes.unionByName(more)
    nodes = nodes.where(F.col("forest").isNull()).drop("forest", "place", "part")
    # a node that isn't finished with its parent hangs below a branching one or one where a conversation ends
    waiting = nodes.where(F.col("parent").isNotNull())
    known = nodes.where((F.col("n_children") > 1) | (F.col("ends_sha256") != NO_ENDS))
    known = known.select(F.col("key").alias("parent"), F.col("conv_id").alias("found"))
    answered = waiting.join(known, "parent").withColumn("parent_conv_id", F.col("found")).drop("found")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes.where(F.col("parent").isNull()).select(columns).union(answered.select(columns))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations of which each fifth lends its first turns to the four ids after it.

    Turns are ordered by `turn` (null first, ties by role and text), null roles and texts are empty,
    repeated rows are turns of their own, rows without a conv_id are left out. A conversation c begins
    with the first h turns of c - c % 5 (none if there is no such conversation), h being crc32(c) % 9, and
    goes on with its own turns after the first h. Further columns are not read.
    """
    turns = stored(turn_lists(conversations), "turns")
    base = F.col("conv_id") - F.col("conv_id") % 5
    return trie(rebuilt(turns, base, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9))
