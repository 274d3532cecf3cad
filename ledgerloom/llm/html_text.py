"""Main text of web pages by markup and by a host's repeated passages.

A page with an article or main element is read from it, without the parts whose element, class, id or
role marks them as something else. What markup leaves open, the host's other pages decide. The words of
every page's blocks are a stream. Its suffixes are sorted by host and by the words they begin with, and
neighbours that agree are a passage that repeats; the sort is dealt out by ranges.

Outside articles every place begins a suffix, which is compared by its first RUN words, longer passages
being chains of consecutive places. (The words of passages of RUN or more words that stand on PAGES pages
are just those of runs of RUN words that do.) In a page without an article, words that lie in passages of PAGES or more
distinct pages of the host are removed and the unique runs stay; a page with no word left is a copy of
others and stays whole.

Articles may share sentences, so in them a suffix begins at a block of RUN or more words alone, and is compared to the
block's end. A block that repeats in PAGES or more articles of the host, and in one of SHARE of them at least, is a
notice without a mark and removed. An article that would keep less than one of PART of its words is a copy of
others and stays whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import row_key, texts_of
from ledgerloom.llm.text import windows
from ledgerloom.llm.url_lists import host_of
from ledgerloom.session import stored

RUN = 5
PAGES = 3
SHARE = 2
PART = 2

#: HTML's void, raw-text and inline elements, and those that hold no text of the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CHROME = frozenset(
    "head nav header footer aside form script style noscript template iframe svg math canvas object audio video button select option datalist textarea input dialog menu noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar sidebar aside rail widget widgets
    header masthead topbar footer colophon copyright cookie cookies consent gdpr notice notices alert popup modal overlay
    newsletter subscribe subscription signup login search share sharing social related recommended recommendations
    comment comments commentlist respond reply replies disqus hidden""".split()
)
_NEVER = frozenset(("html", "body", "main", "article"))
_CONTAINER = frozenset(("main", "article"))
#: A quote opens a value after an equals sign alone; anywhere else in a tag it is a character like others.
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]|=?[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*)?)?+|=)*+)(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
#: Start tags that close an open element of the same kind, up to the elements they can't leave.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = frozenset("ul ol dl table article section main div body nav aside header footer blockquote".split())


def _marked(name: str, attributes: str) -> bool:
    """Whether an element's class, id, role or visibility marks it as no part of the article."""
    if not attributes or attributes.isspace():
        return False
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    if found.get("role", "").strip().lower() in ROLES:
        return True
    for one in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [p for p in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower()) if p]
        if parts and not {"has", "with", "no", "without"}.intersection(parts) and (parts[0] in MARKS or parts[-1] in MARKS):
            return True
    return False


def blocks_of(page: str) -> tuple[list[str], list[str], list[str]]:
    """Blocks of text inside articles, outside them, and in marked parts.

    A tag or comment that the page's end cuts off is no text. Character references are decoded after
    tags are found; white space in a block is one space.
    """
    out: tuple[list[str], list[str], list[str]] = ([], [], [])
    held: list[list[str]] = [[], [], []]
    open_: list[tuple[str, int, int]] = []  # name, depth of articles, depth of marked parts
    inside = marked = at = 0

    def flush() -> None:
        for parts, blocks in zip(held, out, strict=True):
            if parts and (text := " ".join("".join(parts).split())):
                blocks.append(text)
            parts.clear()

    def text(upto: int) -> None:
        if upto > at:
            held[2 if marked else 0 if inside else 1].append(html.unescape(page[at:upto]))

    search = _TAG.search
    while (m := search(page, at)) is not None:
        text(m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[4] != ">":  # cut off
            break
        if name not in INLINE:
            flush()
        if m[1]:
            if any(o[0] == name for o in open_):
                while open_.pop()[0] != name:
                    pass
                _, inside, marked = open_[-1] if open_ else ("", 0, 0)
            continue
        if closes := _CLOSES.get(name):
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in _BARRIER and open_[k][0] not in closes:
                    break
                if open_[k][0] in closes:
                    del open_[k:]
                    _, inside, marked = open_[-1] if open_ else ("", 0, 0)
                    break
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        inside += name in _CONTAINER or bool(m[3] and re.search(r"role\s*=\s*[\"']?(?:main|article)\b", m[3], re.I))
        marked += name in CHROME or (name not in _NEVER and _marked(name, m[3]))
        if not m[3].rstrip().endswith("/") or name not in ("svg", "path"):
            open_.append((name, inside, marked))
    else:
        text(len(page))
    flush()
    return out


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for page in texts_of(frame["html"]):
            article, outside, chrome = blocks_of(page)
            out.append((article or None, outside, chrome))
        made = pd.DataFrame(out, columns=["article", "outside", "chrome"])
        yield pd.concat([frame.drop(columns="html").reset_index(drop=True), made], axis=1)


def _suffixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The suffixes of a page's stream: host, page, run, rest, at (-1: not in question).

    `run` is a suffix's first RUN words. `rest` is 0 outside articles, where `at` is a word's number. Inside, it is the
    whole block and `at` the block's number.
    """
    for frame in frames:
        words: list[str] = []
        row, place, left = [], [], []  # of each word: its page, its number there, the words to its block's end
        whole_blocks, heads, owner, number = [], [], [], []
        for i, (article, outside, chrome) in enumerate(zip(frame["article"], frame["outside"], frame["chrome"], strict=True)):
            at = 0
            for asked, blocks in ((article is None, outside), (False, chrome)):
                for block in blocks:
                    own = block.split()
                    n = len(own)
                    words += own
                    row += [i] * n
                    place += range(at, at + n) if asked else [-1] * n
                    left += range(n, 0, -1)
                    at += n
            for k, block in enumerate(() if article is None else article):
                head = block.split(" ", RUN)[:RUN]
                if len(head) == RUN:
                    whole_blocks.append(block)
                    heads += head
                    owner.append(i)
                    number.append(k)
        host, key = frame["host"].to_numpy(), frame["key"].to_numpy()

        def made(pages: np.ndarray, runs: np.ndarray, rest: np.ndarray, at: np.ndarray, host=host, key=key) -> pd.DataFrame:
            return pd.DataFrame({"host": host[pages], "page": key[pages], "run": runs.view(np.int64), "rest": rest, "at": at})

        if len(words) >= RUN:
            hashes = pd.util.hash_array(np.array(words, object), categorize=True)
            whole = np.flatnonzero(np.array(left) >= RUN)
            yield made(np.array(row)[whole], windows(hashes, RUN)[whole], np.zeros(len(whole), np.int64), np.array(place)[whole])
        if whole_blocks:
            runs = windows(pd.util.hash_array(np.array(heads, object), categorize=True), RUN)[::RUN]
            rest = pd.util.hash_array(np.array(whole_blocks, object), categorize=False) | np.uint64(1)
            yield made(np.array(owner), runs, rest.view(np.int64), np.array(number))


def _passages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Passages and their distinct pages out of sorted suffixes, by neighbours that agree.

    A passage may go on in the next batch or range, so a batch's first and last are given whatever their pages are;
    their numbers are to be added up. All equal rows are in one range, so no page of a passage counts twice.
    """
    last = None
    for frame in frames:
        if frame.empty:
            continue
        keys = [frame[c].to_numpy() for c in ("host", "run", "rest", "page")]
        differs = [np.append(True, k[1:] != k[:-1]) for k in keys]
        begins = differs[0] | differs[1] | differs[2]
        turns = begins | differs[3]
        turns[0] = last != tuple(k[0] for k in keys)
        last = tuple(k[-1] for k in keys)
        starts = np.flatnonzero(begins)
        n = np.add.reduceat(turns.astype(np.int64), starts)
        given = n >= PAGES
        given[[0, -1]] = True
        yield pd.DataFrame({"host": keys[0][starts], "run": keys[1][starts], "rest": keys[2][starts], "n": n})[given]


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    Null and empty pages, and pages without text, have the text "". A null or unreadable url has no host;
    such pages' passages are compared with each other. Repeated rows have one result and count as
    one page. An empty table gives no rows. Other columns are not read.
    """
    rows = pages.select(
        row_key("page_id", "url", "html").alias("key"), "page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "html"
    )
    shape = "key long, page_id long, url string, host string, article array<string>, outside array<string>, chrome array<string>"
    parsed = stored(rows.mapInPandas(_parse, shape), "pages")
    suffixes = parsed.select("key", "host", "article", "outside", "chrome").mapInPandas(_suffixes, "host string, page long, run long, rest long, at int")
    suffixes = stored(suffixes, "suffixes")
    order = ["host", "run", "rest", "page"]
    neighbours = suffixes.select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    passages = neighbours.mapInPandas(_passages, "host string, run long, rest long, n long")
    passages = stored(passages.groupBy("host", "run", "rest").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES), "passages")
    articles = parsed.where("article is not null")
    of_host = articles.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("articles"))
    notices = passages.where("rest <> 0").join(of_host, "host").where(F.col("n") * SHARE >= F.col("articles"))
    removed = passages.where("rest = 0").unionByName(notices.drop("articles"))
    covered = suffixes.where("at >= 0").join(removed, ["host", "run", "rest"], "left_semi").groupBy(F.col("page").alias("key"))
    # stored, so that the texts are shuffled for it only if it is large
    covered = stored(covered.agg(F.collect_set("at").alias("runs")), "covered")

    def remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for blocks, runs in zip(frame["outside"], frame["runs"], strict=True):
                words = np.array(" ".join(blocks).split(), object)
                keep = np.ones(len(words), bool)
                if runs is not None and len(runs):
                    keep[np.unique(np.add.outer(np.asarray(runs, np.int64), np.arange(RUN)))] = False
                texts.append(" ".join(words[keep] if keep.any() else words))
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts})

    open_pages = parsed.where("article is null").select("key", "page_id", "url", "outside")
    decided = open_pages.join(covered, "key", "left").mapInPandas(remove, "page_id long, url string, text string")
    whole = F.array_join("article", " ")
    kept = F.array_join(F.filter("article", lambda block, k: ~F.array_contains("runs", k)), " ")
    enough = F.size(F.split(kept, " ")) * PART >= F.size(F.split(whole, " "))
    text = F.when(F.col("runs").isNotNull() & enough, kept).otherwise(whole).alias("text")
    read = articles.select("key", "page_id", "url", "article").join(covered, "key", "left").select("page_id", "url", text)
    return read.union(decided).withColumn("n_chars", F.char_length("text").cast("long"))
