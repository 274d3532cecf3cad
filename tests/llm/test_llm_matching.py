"""Similarity joins, benchmark passages and licences against brute force."""

from __future__ import annotations

import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import decontamination, jaccard_join, oracle
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(1, None), (2, ""), (3, "!!"), (4, "one"), (5, "one"), (5, "one"), (6, "One two"), (None, "one two"), (None, None)]


def words(t):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))


def shingle_set(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    """(doc_id, class_id, n_links, n_copies) of every row, by comparing all pairs of sets."""
    sets = [shingle_set(t) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    links = {s: {o for o in distinct if o != s and 5 * len(s & o) >= 4 * len(s | o)} for s in distinct}
    label = {}
    for s in distinct:
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = s
                todo += links[x]
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        if not s:
            out.append((i, i, 0, 1))
            continue
        ids = [j for (j, _), o in zip(rows, sets, strict=True) if o and label[o] == label[s] and j is not None]
        out.append((i, min(ids, default=None), len(links[s]), sets.count(s)))
    return out


def by_repr(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def found(docs):
    return by_repr(jaccard_join.classes(docs).select("doc_id", "class_id", "n_links", "n_copies").collect())


def near_copies(n, length, changes, seed):
    rng = random.Random(seed)
    base = [f"v{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_query_matches_sql(corpus):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = con.execute(oracle.NGRAM_JACCARD).fetchall()
    assert by_repr(QUERIES["op1_ngram_jaccard_join"](corpus, SF).collect()) == by_repr(expected)


def test_jaccard_join_of_odd_rows(docs_of):
    rows = ODD + [(20 + i, t) for i, t in enumerate(near_copies(6, 90, 3, 1))] + [(9, "w " * 5000), (8, "w " * 6000)]
    assert found(docs_of(rows)) == by_repr(brute_classes(rows))
    assert jaccard_join.classes(docs_of([])).count() == 0


def test_large_groups_are_compared_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "SMALL", 24)
    common = " ".join(f"c{i}" for i in range(30))  # a passage that unrelated texts share
    texts = near_copies(70, 120, 5, 2) + [f"{common} " + t for s in range(40) for t in near_copies(2, 60, 1, 100 + s)]
    rows = list(enumerate(texts))
    expected = brute_classes(rows)
    got = dict((r[0], r) for r in found(docs_of(rows)))
    assert {i: r[1] for i, r in got.items()} == {r[0]: r[1] for r in expected}
    links, seen = sum(r[2] for r in expected), sum(r[2] for r in got.values())
    assert 0.97 * links <= seen <= links and all(got[r[0]][2] <= r[2] for r in expected)


def test_recall_of_the_least_similar_pairs(docs_of):
    texts = []
    for s in range(150):
        rng = random.Random(s)
        w = [f"t{rng.randrange(10**7)}" for _ in range(104)]
        texts += [" ".join(w), " ".join(w[:84])]  # 80 of 100 shingles: exactly the wanted similarity
    expected = brute_classes(list(enumerate(texts)))
    assert all(r[2] == 1 for r in expected) and found(docs_of(list(enumerate(texts)))) == by_repr(expected)


def test_one_row_of_each_class_stays(docs_of):
    near = near_copies(5, 90, 2, 7)
    rows = [(9, near[0]), (3, near[1]), (3, near[1]), (4, near[2]), (None, near[3]), (1, "other text"), (2, ""), (5, None), (7, "a b"), (8, "a b")]
    kept = jaccard_join.one_of_each_class(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert by_repr((r.doc_id, r.text) for r in kept.collect()) == by_repr([(3, near[1]), (1, "other text"), (2, ""), (5, None), (7, "a b")])


# ---- benchmark passages ----


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, hash string, words string")


def brute_passages(docs, items):
    out = set()
    for (d, t), (i, b) in itertools.product(docs, items):
        w, v = words(t), words(b)
        if len(v) < decontamination.SHORTEST:
            continue
        width = min(decontamination.WIDTH, len(v))
        for shift in range(-len(v), len(w) + 1) if len(v) >= 10 else range(len(w) - len(v) + 1):
            equal = [int(0 <= k + shift < len(w) and w[k + shift] == v[k]) for k in range(len(v))]
            best = max(sum(equal[k : k + width]) for k in range(len(v) - width + 1))
            if best >= decontamination.needed(width):
                out.add((d, i))
    return out


def test_benchmark_query_matches_brute_force(corpus):
    docs = [tuple(r) for r in corpus.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in corpus.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    near = [(d, t) for d, t in docs if any(" ".join(words(b)[k : k + 4]) in " ".join(words(t)) for _, b in items for k in range(0, len(words(b)) - 3, 4))]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_benchmark_decontamination"](corpus, SF).collect()}
    assert got and got == brute_passages(near, items)


def test_changed_words_are_tolerated(docs_of, spark):
    rng = random.Random(4)
    items = [(k, " ".join(f"b{rng.randrange(10**6)}" for _ in range(n))) for k, n in enumerate([40, 25, 15, 8, 5, 4])]
    filler = " ".join(f"f{i}" for i in range(50))

    def changed(text, every):
        return " ".join("zz" if (k + 1) % every == 0 else w for k, w in enumerate(text.split()))

    docs = [(10 + k, f"{filler} {t}. {filler}") for k, t in items]
    docs += [(20 + k, f"{filler} {changed(t, 8)} {filler}") for k, t in items]
    docs += [(30 + k, f"{filler} {changed(t, 3)} {filler}") for k, t in items]
    docs += [(40, items[0][1].upper()), (41, " ".join(items[0][1].split()[:14])), (42, " ".join(items[0][1].split()[:9])), (41, None), (None, items[1][1])]
    docs += [(50, items[0][1].replace(" ", "\n", 3) + " " + items[1][1]), (50, items[0][1].replace(" ", "\n", 3) + " " + items[1][1])]
    table = items_of(spark, [(k, t, "x", "x") for k, t in items] + [(9, None, "x", "x"), (8, "", "x", "x"), (0, items[0][1], "x", "x")])
    found_rows = decontamination.passages(docs_of(docs), table).collect()
    got = {(r.doc_id, r.item_id) for r in found_rows}
    assert len(found_rows) == len({(r.key, r.item_id) for r in found_rows})
    assert got == brute_passages(docs, items)
    assert {d for d, _ in got} == {10, 11, 12, 13, 14, 20, 21, 22, 23, 24, 34, 40, 41, None, 50}
    clean = decontamination.without_passages(docs_of(docs), table)
    assert clean.columns == docs_of(docs).columns
    assert sorted((r.doc_id or -1) for r in clean.collect()) == sorted(d or -1 for d, t in docs if not any((d, k) in got and t for k, _ in items))
    assert decontamination.passages(docs_of([]), table).count() == 0
    assert decontamination.without_passages(docs_of(docs), items_of(spark, [])).count() == len(docs)


def test_any_two_changed_words_are_tolerated(docs_of, spark):
    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in (10, 11, 12, 13)]
    docs = [
        (10000 * n + 100 * a + b, " ".join(["so", *("zz" if k in (a, b) else w for k, w in enumerate(ws)), "on"]))
        for n, ws in items
        for a, b in itertools.combinations(range(n), 2)
    ]
    assert all(decontamination.needed(n) == n - 2 for n, _ in items)
    table = items_of(spark, [(n, " ".join(ws), "x", "x") for n, ws in items])
    got = {(r.doc_id, r.item_id) for r in decontamination.passages(docs_of(docs), table).collect()}
    assert got == {(d, d // 10000) for d, _ in docs}


def test_best_stretch_is_the_best():
    rng = np.random.default_rng(5)
    for _ in range(100):
        d, i = rng.integers(0, 3, 40), rng.integers(0, 3, int(rng.integers(5, 30)))
        shift = int(rng.integers(-10, 35))
        width = min(13, len(i))
        equal = [int(0 <= k + shift < 40 and d[k + shift] == i[k]) for k in range(len(i))]
        assert decontamination.best_stretch(d, i, shift)[0] == max(sum(equal[k : k + width]) for k in range(len(i) - width + 1))


def test_short_items_survive_any_changed_word(spark, docs_of):
    """Items of 5 to 9 words with one word changed are found, with two they aren't; all places are tried."""
    items, docs, wanted = [], [], set()
    for n in range(5, 10):
        assert decontamination.needed(n) == n - 1
        own = [f"s{n}w{k}" for k in range(n)]
        items.append((n, " ".join(own)))
        for k in range(n):
            one = [w if i != k else "other" for i, w in enumerate(own)]
            docs.append((100 * n + k, " ".join(["before it", *one, "after"])))
            wanted.add((100 * n + k, n))
            two = [w if i not in (k, (k + 1) % n) else "other" for i, w in enumerate(own)]
            docs.append((100 * n + 50 + k, " ".join(["before", *two])))
    got = decontamination.passages(docs_of(docs), items_of(spark, [(*i, "x", "x") for i in items])).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted == brute_passages(docs, items)


def test_stretches_full_of_hits_are_cut(spark, docs_of):
    """A text that repeats an item throughout is one stretch; a meeting takes along the item's length of it."""
    own = [f"r{k}" for k in range(14)]
    docs = [(1, " ".join(own * 3000)), (2, " ".join(own[2:])), (3, " ".join(own[:4]))]
    got = decontamination.passages(docs_of(docs), items_of(spark, [(7, " ".join(own), "x", "x"), (8, " ".join(own[:6]), "x", "x")])).collect()
    assert {(r.doc_id, r.item_id, r.start, r.matched) for r in got} == {(1, 7, 0, 13), (1, 8, 0, 6), (2, 7, -1, 12)}  # one word before the text
