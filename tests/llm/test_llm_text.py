"""HTML, personal data, toxicity, URL lists and licences against brute force, and the pipeline."""

from __future__ import annotations

import datetime
import hashlib
import html
import random
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from ledgerloom.llm import decontamination, html_text, jaccard_join, licenses, pii, toxicity, url_lists
from ledgerloom.llm.queries import ORACLE, QUERIES
from ledgerloom.llm.text import hash_words

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "benchmark", "labels"]


def by_repr(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["op5_url_filters", "op7_license_scans"])
def test_query_matches_sql(corpus, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.execute(ORACLE[name])
    columns = [d[0] for d in expected.description]
    got = QUERIES[name](corpus, SF)
    assert sorted(got.columns) == sorted(columns)
    assert by_repr(got.select(columns).collect()) == by_repr(expected.fetchall())


# ---- HTML ----


def extracted(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, host string, article string")
    return {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract(pages).collect()}


def article_of(page):
    """What stands between the article's tags, without markup, for the test tables' plain pages."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    text = re.sub(r"<[^>]*(?:>|\Z)", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body[1] if body else "")
    return " ".join(html.unescape(text).split())


def test_html_query_reads_the_articles(corpus):
    pages = corpus.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op2_html_extraction"](corpus, SF).collect()}
    assert {p.page_id: article_of(p.html) for p in pages} == {i: r.text for i, r in got.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())


PARTS = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="has-sidebar">
<header class="site-header"><h2>Head</h2></header><nav><ul><li><a href="/x">Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside><div id="sidebar-left">Left</div>
<main><article><h1>A &lt;b&gt; title</h1><p>One<b>two</b> th&eacute;&nbsp;x &#x41;&#66; &copy;<br>line
 two<p>No <i>close</i><script>var a = "</p><p>no";</script><!-- gone --><div class='ad ad-slot' title="a>b">Buy</div>
<form><input value=x>Send</form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><section id="comments"><p>First!</p></section>
<div role="alert">Alert</div><p hidden>hid</p><div style="display: none">hid</div>1 < 2 &amp;amp; &unknown; end</article></main>
<footer>Foot</footer></body></html>"""


def test_html_of_odd_pages(corpus):
    pages = {
        1: None, 2: "", 3: "   ", 4: "plain text only", 5: PARTS, 6: "<article><p>cut off <b>he", 7: "<article>cut &am", 8: "<article>x<!-- open",
        9: "<article>a<scr", 10: "<p>one<p>two", 11: "<article>" + "word " * 50_000 + "</article>", 12: "</div></p><article>late</div></b></article>tail",
        13: "<nav>only menu</nav>", 14: "<script>if (a < b) {}", 15: "<ARTICLE>Upper<BR/>case</ARTICLE>",
    }
    got = {i: t for (i, _), (t, n) in extracted(corpus, [(i, "http://h.example/x", p, "k", "h", "a") for i, p in pages.items()]).items()}
    assert got[5] == "A <b> title Onetwo thé x AB © line two No close a b c d 1 < 2 &amp; &unknown; end"
    assert {i: got[i] for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)} == {1: "", 2: "", 3: "", 4: "plain text only", 6: "cut off he", 7: "cut &am", 8: "x", 9: "a", 10: "one two"}
    assert got[11] == ("word " * 50_000).strip() and [got[i] for i in (12, 13, 14, 15)] == ["late", "", "", "Upper case"]
    twice = corpus.createDataFrame([(1, None, "<p>a b"), (1, None, "<p>a b"), (None, "no url", "<p>a b")], "page_id long, url string, html string")
    assert [r.text for r in html_text.extract(twice).collect()] == ["a b"] * 3
    assert html_text.extract(twice.limit(0)).count() == 0


def test_quotes_outside_values_hide_no_text():
    """As in browsers a quote opens a value after an equals sign alone, and `<!-->` is a whole comment."""
    pages = {
        "<article><p title=Bob's>One</p><p>two</p></article>": ["One", "two"],
        '<article><a href="x"">One</a> two<p>three</article>': ["One two", "three"],
        "<article><p don't>One<p class = 'it' \">two</article>": ["One", "two"],
        "<article><a href=/a?b=\"c>One</a><p title='a>b' x= >two</article>": ["One", "two"],
        "<article>One<!-->two<!--->three<!-- a > b --!>four<!-- c -->five</article>": ["Onetwothreefourfive"],
        "<article><p class==\"a>One</article>": ["One"],
        "<article>One<p title=\"a>b</article>": ["One"],
        "<article>One<p title='never closed>two</article>": ["One"],
    }
    assert {page: html_text.blocks_of(page)[0] for page in pages} == pages
    assert html_text.blocks_of("<article>One<p class=sidebar>two<p class='ad'>three<p id=Bob's>four</article>")[0] == ["One", "four"]
    for odd in ("<a " + " " * 200_000, "<a " + "x=" * 100_000, "<a " + "x = " * 100_000, "<a " + "'" * 200_000, "<!--" * 50_000):
        assert html_text.blocks_of("<article>One" + odd) == (["One"], [], [])


def test_repeated_passages_of_a_host_are_removed(corpus):
    line = "join our mailing list for the latest news and offers"

    def page(host, own, more=""):
        return (f"https://{host}/p", f"<body><div>{line}</div><div>{own}</div>{more}</body>")

    rows = [(i, *page("a.example", f"text{i} of page{i} stands here{i} alone{i} and{i} more{i}")) for i in range(4)]
    rows += [(10 + i, *page("b.example", f"other{i} words{i}")) for i in range(2)]  # too few pages
    rows += [(20 + i, *page("c.example", "the very same words on every page")) for i in range(4)]  # copies
    got = {i: t for (i, _), (t, _) in extracted(corpus, [(*r, "k", "h", "a") for r in rows]).items()}
    assert [got[i] for i in range(4)] == [f"text{i} of page{i} stands here{i} alone{i} and{i} more{i}" for i in range(4)]
    assert got[10] == f"{line} other0 words0"
    assert {got[20 + i] for i in range(4)} == {f"{line} the very same words on every page"}


def test_unmarked_notices_inside_articles_are_removed(corpus):
    """A block that half of a host's articles repeat goes; shared sentences, rarer blocks and copies stay."""
    notice = "Accept our cookies to read on"

    def page(host, *blocks):
        return (f"https://{host}/p", "<main>" + "".join(f"<p>{b}</p>" for b in blocks) + "</main>")

    own = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(8)]
    shared = "the same six words in here"
    rows = [(i, *page("a.example", own[i], notice, f"{shared} {own[i]}", "The end")) for i in range(4)]
    rows += [(10 + i, *page("b.example", own[i], *[notice] * (i < 3))) for i in range(7)]  # three of seven articles
    rows += [(20 + i, *page("c.example", notice, f"{shared} and more", f"only{i}")) for i in range(4)]  # near copies
    rows += [(30 + i, *page("d.example", own[i], notice)) for i in range(2)]  # too few pages
    rows += [(40 + i, *page("e.example", own[0], own[1])) for i in range(4)]  # copies
    got = {i: t for (i, _), (t, _) in extracted(corpus, [(*r, "k", "h", "a") for r in rows]).items()}
    assert [got[i] for i in range(4)] == [f"{own[i]} {shared} {own[i]} The end" for i in range(4)]
    assert [got[10 + i] for i in range(7)] == [f"{own[i]} {notice}" if i < 3 else own[i] for i in range(7)]
    assert [got[20 + i] for i in range(4)] == [f"{notice} {shared} and more only{i}" for i in range(4)]
    assert [got[30 + i] for i in range(2)] == [f"{own[i]} {notice}" for i in range(2)]
    assert {got[40 + i] for i in range(4)} == {f"{own[0]} {own[1]}"}


def test_sorted_suffixes_count_the_pages_of_passages():
    """By neighbours, over any cuts of the sorted rows, as a plain count of distinct pages."""
    rng = random.Random(3)
    rows = sorted((rng.choice("ab"), rng.randint(0, 5), rng.choice([0, 9]), rng.randint(0, 6)) for _ in range(300))
    expected = {}
    for *passage, page in rows:
        expected.setdefault(tuple(passage), set()).add(page)
    whole = html_text.pd.DataFrame(rows, columns=["host", "run", "rest", "page"])
    for size in (1, 2, 7, 300):
        got = {}
        for frame in html_text._passages(whole[k : k + size] for k in range(0, 300, size)):
            for host, run, rest, n in frame.itertuples(index=False):
                got[host, run, rest] = got.get((host, run, rest), 0) + n
        enough = {p: len(pages) for p, pages in expected.items() if len(pages) >= html_text.PAGES}
        assert enough and {p: n for p, n in got.items() if n >= html_text.PAGES} == enough


# ---- personal data ----

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(d) <= 19 and luhn(d),
                "phone": 10 <= len(d) <= 15,
            }
            if good[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


ODD_PII = [
    "", None, "a@b.c_x@d.e", "a@b..c a@b", "x.y@@z.w a@b.c@d.e", "a@b.c.@d.e-", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004",
    "é 4111 1111 1111 1111, 4111-1111-1111-1111", "+1 (017) 555-7713. +123 +44 20 7946 0958)", "4" * 5000, "4111111111111111" * 3,
    "日本 1.2.3.4 é +12345678901 x@y.zz", "5 - 5 5-5 5  5", "+1.2.3.4.5.6.7.8.9.0", "." * 3000 + "@a.b", "ab" * 40000, "0000.0.0.0 1.1.1.0256",
    "a@b.cc 4111111111111111 " * 300, "".join(f"é {i} u{i}@ex.org, 10.0.{i % 256}.1 +123456789{i} " for i in range(2000)),
]


def check_base(rows, found):
    for r in pii.summary(found).collect():
        base = brute_spans(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in PATTERNS]
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_base_spans(corpus, docs_of):
    check_base(dict(enumerate(ODD_PII)), pii.find(docs_of(list(enumerate(ODD_PII)))))
    docs = corpus.read.parquet(f"{SF}/documents.parquet")
    check_base({r.doc_id: r.text for r in docs.collect()}, pii.find(docs))
    assert pii.find(docs_of([])).count() == 0
    assert pii.find(docs_of([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c")])).count() == 3


def test_contexts_discover_unseen_identifiers(docs_of):
    good = [n for n in range(4000000000000000, 4000000000000200) if luhn(str(n))][:12]
    bad = 4999999999999990 if not luhn("4999999999999990") else 4999999999999991
    rows = [(i, f"some word{i} paid by card {n} before noon{i}") for i, n in enumerate(good)]
    rows += [(50, f"hé they paid by card ({bad}), before it"), (51, f"the number {bad + 10} is lonely and {bad + 1} too")]
    got = {r.doc_id: r.spans for r in pii.summary(pii.find(docs_of(rows))).collect()}
    at = rows[12][1].index(str(bad))
    assert got[50] == f"card:{at}:{at + 16}" and got[51] == ""
    assert all(got[i].count("card") == 1 for i in range(12))


def test_spans_with_blanks_and_plain_addresses_seed_the_graph(docs_of):
    rows = [(i, f"w{chr(97 + i)} dial +1 (743) 555-38{i:02} today, write john{chr(97 + i)}@example.com soon") for i in range(12)]
    rows += [(50, "so dial +1 (743) 555-38 today, ok"), (51, "then write jörg@müller.de, soon"), (52, "only 5 55 and x@y here")]
    got = {r.doc_id: r.spans for r in pii.summary(pii.find(docs_of(rows))).collect()}
    assert got[50] == "phone:8:23" and got[51] == "email:11:25" and got[52] == ""
    assert all(got[i].count(":") == 4 for i in range(12))


def test_masking(docs_of):
    rows = [(1, "é mail a@b.cc, ip 1.2.3.4."), (2, "+12345678901, 4111111111111111"), (3, None), (4, "none"), (4, "none"), (5, "+4111111111111111 x")]
    got = pii.without_pii(docs_of(rows))
    assert got.columns == docs_of(rows).columns
    expected = [(1, "é mail [EMAIL], ip [IP].", 24), (3, None, None), (4, "none", None), (4, "none", None)]
    out = [(r.doc_id, r.text, r.n_chars) for r in got.collect()]
    assert by_repr(r for r in out if r[0] in (1, 3, 4)) == by_repr(expected)
    assert not any("1111" in (t or "") for _, t, _ in out)


def brute_mask(text, spans):
    out, at = "", 0
    for s in spans:
        if s.start >= at:
            out, at = out + text[at : s.start] + f"[{s.kind.upper()}]", s.end
    return out + text[at:]


@pytest.mark.parametrize("run", [2, 256])
def test_masking_over_runs_of_spans(docs_of, monkeypatch, run):
    monkeypatch.setattr(pii, "RUN", run)
    texts = [t for t in ODD_PII if t]
    rows = docs_of(list(enumerate(texts)))
    spans = {r.doc_id: r.spans for r in pii.find(rows).collect()}
    got = {r.doc_id: r.text for r in pii.without_pii(rows).collect()}
    assert got == {i: brute_mask(t, spans[i]) for i, t in enumerate(texts)}


# ---- toxicity ----


def test_toxicity_query_on_held_out_rows(corpus):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    got = QUERIES["op4_toxicity"](corpus, sf)
    labels = corpus.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()
    n = {(r.toxic, r.predicted): r.n for r in rows}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.75
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.limit(200).collect())


def test_toxicity_of_odd_rows(docs_of, spark):
    rows = [(i, "you nasty fool" if i % 4 == 0 else f"a calm text number {i}") for i in range(200)]
    rows += [(None, "nasty"), (900, None), (901, ""), (902, "x" * 100_000), (0, "you nasty fool")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(1, 1, None), (None, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs_of(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.doc_id for r in got if r.predicted} >= {i for i in range(0, 200, 4)} and not {r.doc_id for r in got if r.predicted} & {900, 901, 902, 1, 2, 3}
    kept = toxicity.without_toxic(docs_of(rows), labels)
    assert kept.columns == docs_of(rows).columns and kept.where("text = 'you nasty fool'").count() == 0
    assert toxicity.toxicity(docs_of(rows), labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(docs_of([]), labels).count() == 0


# ---- URL lists ----


def test_lists_hold_as_of_the_fetch(spark):
    day = datetime.date.fromisoformat
    entries = spark.createDataFrame(
        [
            ("l", "bad.example", "block", "add", day("2024-01-10")), ("l", "bad.example", "block", "add", day("2024-01-10")),
            ("l", "bad.example", "block", "remove", day("2024-01-20")), ("m", "OK.bad.example", "allow", "add", day("2024-01-15")),
            ("l", "bad.example", "block", "add", day("2024-02-01")), ("l", "x.example", "block", "add", day("2024-01-05")),
            ("l", "x.example", "block", "remove", day("2024-01-05")), (None, "q.example", "block", "add", day("2024-01-05")),
        ],
        "list string, domain string, rule string, action string, at date",
    )
    captures = [
        (1, "http://bad.example/", "2024-01-09", False), (2, "http://u@A.Bad.Example.:80/x", "2024-01-10", True), (3, "http://bad.example", "2024-01-20", False),
        (4, "https://ok.bad.example/?", "2024-01-16", False), (5, "https://ok.bad.example", "2024-01-12", True), (6, "http://notbad.example", "2024-01-12", False),
        (7, "http://x.example", "2024-01-05", False), (8, None, "2024-01-12", False), (9, "http://bad.example", None, False), (10, "bad.example", "2024-01-12", False),
        (11, "http://bad.example", "2030-01-01", True), (11, "http://bad.example", "2030-01-01", True),
    ]
    table = spark.createDataFrame([(i, u, t and day(t), "mine") for i, u, t, _ in captures], "page_id long, url string, fetched date, domain string")
    got = url_lists.judge(table, url_lists.validity(entries))
    assert by_repr((r.page_id, r.blocked) for r in got.collect()) == by_repr((i, b) for i, _, _, b in captures)
    assert url_lists.judge(table.limit(0), url_lists.validity(entries)).count() == 0
    assert url_lists.judge(table, url_lists.validity(entries.limit(0))).where("blocked").count() == 0


# ---- licences ----


def test_licence_notices(docs_of):
    mit, apache = licenses.TEMPLATES["mit"], licenses.TEMPLATES["apache"]
    filler = " ".join(f"f{i}" for i in range(300))
    rows = [
        (1, f"{filler} {mit} {filler}"), (2, f"{filler}\n{apache.upper()}\n"), (3, " ".join(mit.split()[:8])), (4, None), (5, ""), (6, "CC BY, cc-by MIT\nLicense"),
        (7, " ".join(w for i, w in enumerate(mit.split()) if i % 6)), (8, "gnu general public licenses; gnu general public license"), (8, "gnu general public licenses; gnu general public license"),
    ]
    got = sorted((r.doc_id, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(docs_of(rows)).collect())
    assert got == [
        (1, 0, None, None, "", "mit"), (2, 1, 303, 303, "apache", "apache"), (3, 0, None, None, "", ""), (4, 0, None, None, "", ""), (5, 0, None, None, "", ""),
        (6, 3, 0, 4, "cc-by,mit", "cc-by,mit"), (7, 0, None, None, "", "mit"), (8, 1, 4, 4, "gpl", "gpl"), (8, 1, 4, 4, "gpl", "gpl"),
    ]
    assert licenses.scan(docs_of([])).count() == 0


# ---- pipeline ----


def test_pipeline_stages(corpus):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]
    docs = corpus.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (corpus.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(corpus, docs, SF)
        assert out.dtypes == docs.dtypes
        before, after = by_repr(docs.collect()), by_repr(out.collect())
        ids = {r[0] for r in after}
        if name == "toxicity":
            rejected = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
            assert after == [r for r in before if r[0] not in rejected]
        if name == "ngram_jaccard_join":
            assert ids == {r.class_id for r in jaccard_join.classes(docs).collect()} and len(ids) == len(after) < len(before)
        if name == "benchmark_decontamination":
            held = {r.doc_id for r in decontamination.passages(docs, benchmark).collect()}
            assert held and after == [r for r in before if r[0] not in held]
        if name == "pii":
            assert ids == {r[0] for r in before} and not any(brute_spans(r[1]) for r in after)
            assert all(r[4] == len(r[1]) for r in after)
        docs = corpus.createDataFrame(after, docs.schema)
    packed = corpus_pipeline.STAGES[4][1](corpus, docs, SF).collect()
    assert sorted(r.doc_id for r in packed) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_of_odd_rows(corpus, docs_of):
    rows = [(None, None), (1, ""), (1, ""), (2, "a@b.cc and text"), (3, "a@b.cc and text"), (4, "w " * 20_000), (None, "text")]
    docs = docs_of(rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(corpus, docs, SF)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == [(False, 1), (False, 2), (False, 4), (True, 0), (True, 0)]
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(corpus, docs, SF)
    assert docs.count() == 0


def brute_held(text, templates):
    """Containment of every template in any of its blocks, by whole sets."""
    own, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()), {}
    for name, t in templates.items():
        told = re.findall(r"[a-z0-9]+", t.lower())
        m, wanted = len(told), set(told)
        for s in range(0, max(len(own) - m, 1), m) if own else ():
            share = len(wanted & set(own[s : s + 2 * m])) / len(wanted)
            if share >= licenses.CONTAINMENT - 1e-9:
                out[name] = max(out.get(name, 0), share)
    return out


def test_license_blocks_follow_each_template(docs_of):
    """Short, long and very long templates are found wherever they stand, edited ones as far as they keep."""
    rng = random.Random(6)
    templates = {f"t{n}": " ".join(f"q{rng.randint(0, 3 * n)}" for _ in range(n)) for n in (1, 3, 40, 200, 500, 3000)}
    texts = ["", "q1", "plain words"]
    for told in templates.values():
        for keep in (1.0, 0.9, 0.75):
            around = [f"z{rng.randint(0, 50)}" for _ in range(rng.randint(0, 400))]
            at = rng.randint(0, len(around))
            texts.append(" ".join([*around[:at], *[w if rng.random() < keep else "zz" for w in told.split()], *around[at:]]))
    index = licenses.Templates(templates, {})
    for text in texts:
        held = index.held_by(index.encode(hash_words([text])[0]))
        assert held == pytest.approx(brute_held(text, templates))
    assert sum(bool(brute_held(t, templates)) for t in texts) > 12
    whole = "Intro. " * 77 + licenses.TEMPLATES["zlib/text"] + " end" * 300
    rows = licenses.scan(docs_of([(1, whole), (2, licenses.TEMPLATES["bsd/text"][:400]), (3, None)])).collect()
    assert {r.doc_id: r.labels for r in rows} == {1: "zlib", 2: "bsd", 3: ""}
    assert [r.labels for r in licenses.scan(docs_of([(1, "mit license"), (2, whole)]), {}).orderBy("doc_id").collect()] == ["mit", ""]
    with pytest.raises(ValueError):
        licenses.Templates({"t": "word " * (licenses.MOST_WORDS + 1)}, {})
