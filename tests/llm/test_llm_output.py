"""Token files, packing and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import fingerprints, packing, text, token_output
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "x", "x", "one two three four", "É été été", "!! ??", "a  b \n c ", " lead", "w " * 3000, "z" * 20000, "日本 語　x"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokenizer():
    return Tokenizer.from_file(PATH)


def words(t):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))


def test_word_hashes_follow_words():
    texts = [t or "" for t in ODD]
    hashes, offsets = text.hash_words(texts)
    flat = [w for t in texts for w in words(t)]
    assert np.diff(offsets).tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("high", [0, 1, 50_000, 2**32 - 1])
def test_blocks_round_trip(high):
    rng = np.random.default_rng(1)
    for n in (1, 7, token_output.BLOCK):
        values = rng.integers(0, high, n, endpoint=True).astype(np.uint32)
        values[n // 2] = 2**32 - 1
        assert (token_output.unpack_block(token_output.pack_block(values)) == values).all()


def test_outliers_do_not_widen_a_block():
    values = np.full(4096, 7, np.uint32)
    values[::512] = 2**31
    assert len(token_output.pack_block(values)) < 100


def test_pieces_encode_as_whole_texts():
    odd = ["".join(p) for p in itertools.product(["a", " ", "\n", "é", "1", "'s", " ", "　"], repeat=4)]
    odd += [t or "" for t in ODD] + ["<|endoftext|> a <|endoftext|>", "a\u0085 b", "a \x1cb", "﻿ a"]
    ids, sizes = token_output.Encoder(PATH).encode(odd)
    expected = [e.ids + [0] for e in tokenizer().encode_batch(odd, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == expected


def test_range_reads_from_a_file():
    tokens = np.arange(10_000, dtype=np.uint32) % 777
    data = token_output.file_bytes([1, None], [4000, 6000], tokens)
    ids, counts, back = token_output.read_file(data)
    assert ids.tolist() == [1, -(1 << 63)] and counts.tolist() == [4000, 6000] and (back == tokens).all()
    for first, count in ((0, 1), (4095, 2), (4096, 4096), (9999, 1), (5, 0), (10, 9990)):
        assert (token_output.read_tokens(data, first, count) == tokens[first : first + count]).all()


def expected_tokens(rows):
    made, start, out = tokenizer(), 0, []
    for i, t in rows:
        ids = made.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query_matches_the_tokenizer(corpus):
    got = QUERIES["op8_token_id_output"](corpus, SF).orderBy("doc_id").collect()
    rows = corpus.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected_tokens([tuple(r) for r in rows])


def test_token_files_of_odd_rows(docs_of, monkeypatch):
    monkeypatch.setattr(token_output, "FILE_TOKENS", 50)
    got = token_output.token_output(docs_of(list(enumerate(ODD))), PATH).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected_tokens(list(enumerate(ODD)))
    special = [(1, "hello <|endoftext|> world"), (2, "plain"), (3, "<|endoftext|>"), (4, "a <|endoftext|>" * 3), (5, " <|endoftext"), (6, "")]
    got = token_output.token_output(docs_of(special), PATH).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected_tokens(special) and 0 in tokenizer().encode(special[0][1]).ids + [0]
    repeated = token_output.token_output(docs_of([(None, "q"), (3, "a"), (3, "a"), (3, None)]), PATH)
    got = sorted(tuple(r) for r in repeated.select("start", "n_tokens", F.coalesce("doc_id", F.lit(-1))).collect())
    assert got[0] == (0, 2, -1) and sorted(n for _, n, _ in got[1:]) == [1, 2, 2]
    assert all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(got))
    assert token_output.token_output(docs_of([]), PATH).count() == 0


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(150):
        tops = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 9) for _ in tops])
        k = rng.randint(1, 5)

        def cost(ends):
            return sum(int(c) * min(e for e in ends if e >= t) for t, c in zip(tops, counts, strict=True))

        best = min(cost([*some, tops[-1]]) for r in range(min(k, len(tops))) for some in itertools.combinations(tops[:-1], r))
        got = packing.best_boundaries(tops, counts, k)
        assert len(got) <= k and got[-1] == tops[-1] and cost(got) == best


def least_padded(lengths, buckets):
    """Fewest padded words of any choice of bucket ends, by trying all of them length by length."""
    tops = sorted(set(lengths))
    seen = [sum(1 for x in lengths if x <= t) for t in tops]
    best = [t * n for t, n in zip(tops, seen, strict=True)]
    for _ in range(buckets - 1):
        best = [min([best[j], *(best[i] + tops[j] * (seen[j] - seen[i]) for i in range(j))]) for j in range(len(tops))]
    return best[-1]


def test_padding_is_least_over_true_lengths(docs_of):
    """No length is rounded, however long; the optimum is over the lengths as they are."""
    rng = random.Random(8)
    lengths = [int(1.5 ** rng.uniform(0, 22)) for _ in range(300)] + [5000] * 40 + [5001] * 3
    docs = docs_of([(i, "w " * n) for i, n in enumerate(lengths)])
    for buckets in (1, 4, 24):
        rows = packing.pack(docs, packing.word_count(F.col("text")), buckets=buckets).collect()
        check_batches(rows, packing.BUDGET)
        assert sum(r.padded_length for r in rows) == least_padded(lengths, buckets)


def check_batches(rows, budget):
    by_batch = {}
    for r in rows:
        assert r.length <= r.padded_length
        by_batch.setdefault((r.bucket, r.batch), []).append(r)
    last = {}
    for (bucket, batch), members in by_batch.items():
        fits = max(1, budget // members[0].padded_length)
        assert sorted(m.place for m in members) == list(range(len(members)))
        assert {m.batch_rows for m in members} == {len(members)} and len(members) <= fits
        last[bucket] = max(last.get(bucket, 0), batch)
    for (bucket, batch), members in by_batch.items():
        assert batch == last[bucket] or len(members) == max(1, budget // members[0].padded_length)
    assert all((b, i) in by_batch for b, n in last.items() for i in range(n + 1))


def test_packing_fills_batches(corpus, docs_of):
    docs = corpus.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, packing.word_count(F.col("text")), budget=2000, buckets=5).collect()
    check_batches(rows, 2000)
    assert sorted((r.doc_id, r.length) for r in rows) == sorted((r.doc_id, len(r.text.split())) for r in docs.collect())
    odd = packing.pack(docs_of([(None, None), (1, ""), (1, ""), (2, "w " * 9000), (3, "a b")]), packing.word_count(F.col("text"))).collect()
    check_batches(odd, packing.BUDGET)
    assert len(odd) == 5 and packing.pack(docs_of([]), packing.word_count(F.col("text"))).count() == 0


def test_hot_length_is_numbered_across_shards(docs_of):
    rows = packing.pack(docs_of([(i, "a b c") for i in range(3000)]), packing.word_count(F.col("text")), budget=21).collect()
    check_batches(rows, 21)
    assert len({(r.bucket, r.batch) for r in rows}) == 429


def brute_fingerprints(rows):
    """(n_chars, edited hash) by (doc_id, text) in descending order of doc_id, the last followed by the first."""
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 3
        changed = t[: len(t) - n] + after[:n]
        shingle_sets = []
        for x in (t, changed, after):
            w = words(x)
            shingle_sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), shingle_sets))
    return out


def test_fingerprint_query(corpus, docs_of):
    docs = corpus.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in QUERIES["op6_document_fingerprints"](corpus, SF).collect()}
    errors = []
    for i, n, sha, (own, new, after) in brute_fingerprints([tuple(r) for r in docs.collect()]):
        assert (got[i].n_chars, got[i].edited_sha256) == (n, sha)
        if len(own) > 60:
            errors += [got[i].near_edited - len(own & new) / min(len(own), len(new)), got[i].near_next - len(own & after) / max(1, min(len(own), len(after)))]
    assert abs(np.mean(errors)) < 0.02 and np.mean(np.abs(errors)) < 0.05
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(got[a].fingerprint == got[b].fingerprint for a in texts for b in texts if texts[a] == texts[b])


def test_fingerprints_of_odd_rows(docs_of):
    rows = [*enumerate(ODD), (None, "null id"), (None, None), (5, "again"), (5, "again")]
    got = fingerprints.fingerprint_next(docs_of(rows)).collect()
    expected = brute_fingerprints(rows)
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted((i or -1, n, s) for i, n, s, _ in expected)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = fingerprints.fingerprint_next(docs_of([(7, "abcdef")])).collect()
    assert [r.edited_sha256 for r in one] == [hashlib.sha256(b"abcdab").hexdigest()]
    assert fingerprints.fingerprint_next(docs_of([])).count() == 0


def test_sketches_merge_and_scale():
    a, b = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(3000, 8000))
    (x, y, both), _ = fingerprints.sketches([a, b, " ".join(f"w{i}" for i in range(8000))])
    assert (fingerprints.merge(x, y) == both).all() and abs(len(x) - 1000) < 120
    (x, y), whole = fingerprints.sketches(["p " + a + " q", a[:3000]])
    assert fingerprints.containment(y, x) > 0.98
    s = fingerprints.to_string(x, whole[0])
    assert (fingerprints.from_string(s)[0] == x).all() and fingerprints.from_string(s)[1] == whole[0]
