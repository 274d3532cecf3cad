"""Prefix trie, repeated passages and collocations against brute force, and their SQL on small tables."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import collocations, prefix_trie, queries, substrings
from ledgerloom.llm.buckets import from_planes, pack_sorted, planes, unpack_sorted

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ shared


@pytest.mark.parametrize("values", [[], [0], [0, 1, 255, 256, 2**63, 2**64 - 1], [7] * 5])
def test_planes_round_trip(values):
    made = np.array(values, np.uint64)
    assert from_planes(planes(made), len(made)).tolist() == values
    assert unpack_sorted(pack_sorted(made), len(made)).tolist() == values


@pytest.mark.parametrize("name", ["op11_conversation_prefix_trie", "op12_substring_dedup", "op13_phrase_collocation_mining"])
def test_matches_sql(corpus, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = queries.QUERIES[name](corpus, SF)
    expected = duck.execute(queries.ORACLE[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(result.columns)
    mine = sorted((tuple(r) for r in result.select(columns).collect()), key=repr)
    assert mine == sorted(expected.fetchall(), key=repr) and mine


# ------------------------------------------------------------------ trie


def brute_trie(rebuilt):
    """rebuilt: conv_id -> list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def own(p):
        return (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0

    out = []
    for p, ids in members.items():
        under, leaves, saved = [p], 0, 0
        while under:
            q = under.pop()
            leaves += not children[q]
            saved += own(q)
            under += children[q]
        told = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children[p]), leaves, saved, told))
    return sorted(out, key=repr)


def brute_rebuilt(rows):
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append((turn is not None, turn or 0, role or "", text or ""))
    lists = {c: [t[2:] for t in sorted(own)] for c, own in told.items()}
    out = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = lists.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
    return out


def nodes_of(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


def conversations_of(spark, rows):
    schema = "conv_id long, turn long, role string, text string, hash string, path string, at long"
    return spark.createDataFrame([(*r, "x", "x", 1) for r in rows], schema)


def random_conversations(rng, n, longest=6, words=2):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", None, "bot"]), rng.choice(["é", "b", "", None][: words + 1])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    rows = random_conversations(random.Random(seed), 120)
    rows += rows[:30] + [(None, 1, "user", "lost"), (-7, 1, "user", "a"), (2**62, 1, "user", "b"), (7, 0, "user", "z" * 100_000)]
    assert nodes_of(prefix_trie.prefix_trie(conversations_of(spark, rows))) == brute_trie(brute_rebuilt(rows))


@pytest.mark.parametrize("run_turns", [1, 7, 60])
def test_forests_merge_across_boundaries(run_turns):
    """Any cut of the sorted paths into runs, and any grouping of the runs, gives the same nodes."""
    rng = random.Random(run_turns)
    for _ in range(60):
        told = {c: [("u", rng.choice("ab")) for _ in range(rng.randint(0, 7))] for c in range(rng.randint(1, 40))}
        paths = {}
        for c, turns in told.items():
            key, parts = b"", []
            for role, text in turns:
                key = hashlib.blake2b(key + f"{role}{text}".encode(), digest_size=prefix_trie.HASH).digest()
                parts.append(key)
            paths.setdefault((b"".join(parts), len(turns)), []).append(c)
        ordered = sorted(paths)
        out, forests, at = [], [], 0
        while at < len(ordered):
            some = ordered[at : at + rng.randint(1, run_turns)]
            at += len(some)
            own = [prefix_trie.Path(k, [1] * n) for k, n in some]
            leaves = [
                prefix_trie.Node(len(paths[p]), min(paths[p]), min(p[1], 1), ends=hashlib.sha256(",".join(map(str, sorted(paths[p]))).encode()).hexdigest())
                for p in some
            ]
            forests.append(prefix_trie.joined_paths(own, leaves, out))
        while len(forests) > 1:
            fan = rng.randint(2, 4)
            forests = [prefix_trie.joined(forests[i : i + fan], out) for i in range(0, len(forests), fan)]
        prefix_trie.finish(forests[0], out)
        low = {r[4]: r[0] for r in out if r[6] > 1 or r[8] != prefix_trie.NO_ENDS}
        nodes = [(r[0], r[1], r[2] if r[3] is None else low[r[3]], *r[5:]) for r in out]
        assert sorted(nodes, key=repr) == brute_trie(told)


def test_trie_rounds_on_a_session(spark):
    """More runs than one task merges."""
    rows = random_conversations(random.Random(5), 60, words=3)
    turns = prefix_trie.turn_lists(conversations_of(spark, rows))
    found = prefix_trie.trie(prefix_trie.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9), fan=2)
    assert nodes_of(found) == brute_trie(brute_rebuilt(rows))


def test_trie_edge_tables(spark):
    assert nodes_of(prefix_trie.prefix_trie(conversations_of(spark, []))) == []
    one = [(0, None, None, None)]
    assert nodes_of(prefix_trie.prefix_trie(conversations_of(spark, one))) == brute_trie(brute_rebuilt(one))
    deep = [(0, t, "user", "x") for t in range(3000)] + [(5, t, "user", "x") for t in range(2999)]
    assert nodes_of(prefix_trie.prefix_trie(conversations_of(spark, deep))) == brute_trie_chain(deep)


def brute_trie_chain(rows):
    """The brute force for deep chains, whose prefixes can't all be held."""
    rebuilt = brute_rebuilt(rows)
    long, short = (max(rebuilt.values(), key=len), min(rebuilt.values(), key=len))
    assert long[: len(short)] == short
    ids = sorted(rebuilt)
    out = []
    for d in range(len(long) + 1):
        members = ids if d <= len(short) else [c for c in ids if len(rebuilt[c]) >= d]
        ends = [c for c in ids if len(rebuilt[c]) == d]
        saved = sum((sum(len(rebuilt[c]) >= e for c in ids) - 1) * 1 for e in range(max(d, 1), len(long) + 1))
        above = None if d == 0 else min(c for c in ids if len(rebuilt[c]) >= d - 1)
        out.append((min(members), d, above, len(members), int(d < len(long)), 1, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


# ------------------------------------------------------------------ repeated passages

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(texts, width):
    words = [SPACED.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def removed(docs, width):
    rows = substrings.without_repeats(docs, width=width).select("doc_id", "n_words", "n_removed", "kept").collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("width", [2, 5, 35])
def test_repeats_equal_brute_force(docs_of, width):
    rng = random.Random(width)
    passage = [f"p{i}" for i in range(width + 3)]
    texts = []
    for _ in range(80):
        words = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(0, 3 * width))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(words))
            words[at:at] = passage[: rng.choice([width - 1, width, width + 3])]
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(words))
    texts += ["same word " * 200, "same " * (width + 1), "same " * (width - 1), "", None, "\x1f \x85\xa0x", "É " * (width + 2), "é " * (width + 2)]
    texts += texts[:6]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2
    expected = sorted(((i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows], width), strict=True)), key=repr)
    assert removed(docs_of(rows), width) == expected


def test_repeats_in_many_chunks(docs_of, monkeypatch):
    rng = random.Random(9)
    block = " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(40))
    texts = [" ".join(f"u{rng.randint(0, 10**9)}" for _ in range(rng.randint(0, 300))) + (" " + block if i % 3 == 0 else "") for i in range(150)]
    texts.append(" ".join(f"v{i % 50_000}" for i in range(150_000)))  # very long, repeats itself
    rows = list(enumerate(texts))
    expected = sorted(((i, *b) for (i, _), b in zip(rows, brute_repeats(texts, 35), strict=True)), key=repr)
    assert removed(docs_of(rows).repartition(7), 35) == expected


def test_repeats_of_an_empty_table(docs_of):
    assert removed(docs_of([]), 35) == []
    with pytest.raises(ValueError):
        substrings.repeated_spans(docs_of([]), width=1)


def test_anchors_are_those_of_windows():
    """Every wanted window has an anchor, which depends on its words alone."""
    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, 500).astype(np.uint64)
    offsets = np.array([0, 100, 100, 134, 500])
    at, _ = substrings.anchors(words, offsets, 35)
    short = substrings.lengths(35)[0]
    hashed = substrings.windows(words, short)
    want = set()
    for a, b in zip(offsets, offsets[1:], strict=False):
        for i in range(a, b - 34):
            own = hashed[i : i + 35 - short + 1]
            want |= set((i + np.flatnonzero(own == own.min())).tolist())
    assert set(at.tolist()) == want


# ------------------------------------------------------------------ collocations


def brute_collocations(rows, least=10, top=2000):
    count, words_of = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] += len(w)
            for k in (1, 2, 3):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        scored = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            longer = [f[q] for q in f if len(q) == 3 and f[q] >= least and p in (q[:2], q[1:])] if len(p) == 2 else []
            if not any(100 * x >= 50 * a for x in longer):
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words_of[lang], -score))
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(t, x, "x", 1) for x, t in rows], "text string, lang string, phrase string, n long")
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted((tuple(r) for r in collocations.collocations(docs, **options).select(columns).collect()), key=repr)


def random_texts(rng, n, words=12, langs=("en", "de", None, "und", "")):
    weight = [1 / (i + 1) for i in range(words)]
    names = [f"{c}{i}" for i, c in enumerate("aBéç日xYzqwrt"[:words])]
    return [(rng.choice(langs), rng.choice(["", "!", "\x1c"]).join([rng.choice([" ", "\t ", ", ", "\n"]).join(rng.choices(names, weight, k=rng.randint(0, 60)))] * 2)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_brute_force(corpus, seed):
    rng = random.Random(seed)
    rows = random_texts(rng, 80) + [("en", None), ("en", ""), (None, " \t"), ("xx", "one two. " * 9), ("yy", "One two three. " * 10), ("zz", "a a a a " * 20)]
    rows += rows[:5]
    assert mined(corpus, rows) == brute_collocations(rows)
    assert mined(corpus, rows, top=3) == brute_collocations(rows, top=3)


def test_collocations_in_many_chunks(corpus, monkeypatch):
    rng = random.Random(4)
    rows = random_texts(rng, 60) + [("en", "far off " * 40_000)]
    docs = corpus.createDataFrame([(t, x) for x, t in rows], "text string, lang string").repartition(9)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = sorted((tuple(r) for r in collocations.collocations(docs).select(columns).collect()), key=repr)
    assert found == brute_collocations(rows)


def test_collocations_of_an_empty_table(corpus):
    assert mined(corpus, []) == []
    assert mined(corpus, [("en", "too rare")]) == []


def test_summaries_keep_every_frequent_item():
    """Whatever the order and the steps of merging, an item at the threshold survives a capacity over mass / threshold."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        items = rng.zipf(1.3, 3000) % 1500
        parts = np.array_split(items.astype(np.uint64), rng.integers(1, 40))
        counted = [np.unique(p, return_counts=True) for p in parts if len(p)]
        summary = collocations.Summary(len(items) // 10 + 1)
        for own, n in counted:
            summary.add(own, n)
            assert len(summary.items) <= summary.capacity
        distinct, total = np.unique(items, return_counts=True)
        assert set(distinct[total >= 10].tolist()) <= set(summary.items.tolist())
        answers = collocations.frequent([v for v, _ in counted], [c for _, c in counted], 10)
        told = [(v, c) for a in answers if a for v, c in zip(np.frombuffer(a[0], np.uint64).tolist(), np.frombuffer(a[1], "<i8").tolist(), strict=True)]
        assert sorted(told) == sorted((int(v), int(c)) for v, c in zip(distinct, total, strict=True) if c >= 10)


def test_scores_beyond_64_bits(corpus):
    rows = [("en", 1, "a", 3 * 10**12), ("en", 1, "b", 10**12), ("en", 2, "a b", 7 * 10**11 + 1)]
    runs = corpus.createDataFrame(rows, "lang string, size int, phrase string, f long")
    found = collocations.scored(runs).first()
    assert found["score"] == 1_000_000 * (7 * 10**11 + 1) ** 2 // (3 * 10**24)
    assert os.path.isdir(SF)
