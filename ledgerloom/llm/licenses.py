"""License scan: phrases in place, and an exact set-similarity join with notice templates.

A template of m words is looked for in blocks of 2 m words that begin every m words, so wherever it stands, it is
whole in one of them, however long it is. A block holds a template if it has at least CONTAINMENT of its distinct words.
The template words are ordered by how often they occur in all documents, rarest first; a block can only
hold a template if it has one of its prefix words (prefix filter), enough template words at all (length
filter) and enough of them after the first common one (positional filter). What is left is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import texts_of
from ledgerloom.llm.text import batches, hash_words

CONTAINMENT = 0.8
#: Words that all templates may have together: their index, some 100 bytes a word, goes to every task.
MOST_WORDS = 1 << 18

#: Phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public license notices and, named `/text`, whole licenses. The label is what
#: stands before the stroke.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "apache": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit/text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc/text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "zlib/text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "bsd/text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
}


def needed(size: int) -> int:
    return int(np.ceil(CONTAINMENT * size - 1e-9))


class Templates:
    """Template words by rising frequency, and the prefix index; as large as the templates."""

    def __init__(self, templates: dict[str, str], counts: dict[int, int]):
        words = {name: hash_words([t])[0].tolist() for name, t in templates.items()}
        if sum(map(len, words.values())) > MOST_WORDS:
            raise ValueError(f"templates have more than {MOST_WORDS} words")
        self.sizes = {name: len(w) for name, w in words.items() if w}
        order = sorted({h for w in words.values() for h in w}, key=lambda h: (counts.get(h, 0), h))
        rank = {h: i for i, h in enumerate(order)}
        self.ranks = {name: np.array(sorted({rank[h] for h in words[name]})) for name in self.sizes}
        self.prefix: dict[int, list[str]] = {}
        for name, ranks in self.ranks.items():
            for r in ranks[: len(ranks) - needed(len(ranks)) + 1].tolist():
                self.prefix.setdefault(r, []).append(name)
        by_hash = np.argsort(np.array(order, np.uint64)) if order else np.zeros(0, np.int64)
        self.hashes, self.rank_of = np.array(order, np.uint64)[by_hash], by_hash
        self.is_prefix = np.zeros(max(1, len(order)), bool)
        self.is_prefix[list(self.prefix)] = True

    def encode(self, words: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 for words of no template."""
        if not len(self.hashes):
            return np.full(len(words), -1, np.int64)
        at = np.searchsorted(self.hashes, words).clip(max=len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.rank_of[at], -1)

    def held_by(self, ranks: np.ndarray) -> dict[str, float]:
        """Containment of every template that a document's ranked words hold in a block, the largest."""
        found: dict[str, float] = {}
        tried = set()
        at = np.flatnonzero((ranks >= 0) & self.is_prefix[ranks])
        for p, r in zip(at.tolist(), ranks[at].tolist(), strict=True):
            for name in self.prefix[r]:
                m = self.sizes[name]
                for start in ((p // m) * m, (p // m - 1) * m):
                    if start < 0 or start >= max(len(ranks) - m, 1) or (name, start) in tried:
                        continue
                    tried.add((name, start))
                    share = self._share(self.ranks[name], ranks[start : start + 2 * m])
                    if share:
                        found[name] = max(found.get(name, 0.0), share)
        return found

    @staticmethod
    def _share(own: np.ndarray, ranks: np.ndarray) -> float:
        """Containment of a template in a block, 0 below the threshold."""
        need, block = needed(len(own)), np.unique(ranks)
        block = block[np.searchsorted(block, 0) :]
        if len(block) < need:
            return 0.0
        place = np.searchsorted(block, own).clip(max=len(block) - 1)
        common = block[place] == own
        first = int(common.argmax())
        # before the first common word there is none, so only what follows it on both sides can be common too
        if 1 + min(len(own) - first - 1, len(block) - int(place[first]) - 1) < need:
            return 0.0
        n = int(common.sum())
        return n / len(own) if n >= need else 0.0


def label_of(name: str) -> str:
    return name.split("/")[0]


def _phrase_places(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all phrases, sorted, and the label number of each."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    places, labels = [], []
    for k, phrase in enumerate(PHRASES):
        wanted, _ = hash_words([phrase])
        n = max(0, len(words) - len(wanted) + 1)
        at = np.flatnonzero(words[:n] == wanted[0])
        for i in range(1, len(wanted)):
            at = at[words[at + i] == wanted[i]]
        at = at[at + len(wanted) <= ends[at]]
        places.append(at)
        labels.append(np.full(len(at), k))
    place, label = np.concatenate(places), np.concatenate(labels)
    order = np.argsort(place, kind="stable")
    return place[order], label[order]


def word_counts(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> dict[int, int]:
    """How often each template word occurs in all documents; a task sends a row for each word at most."""
    wanted = np.unique(hash_words(list(templates.values()))[0])
    if not len(wanted):
        return {}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(wanted), np.int64)
        for frame in frames:
            texts = texts_of(frame["text"])
            for a, b in batches(texts):
                words, _ = hash_words(texts[a:b])
                at = np.searchsorted(wanted, words).clip(max=len(wanted) - 1)
                total += np.bincount(at[wanted[at] == words], minlength=len(wanted))
        yield pd.DataFrame({"word": wanted.view(np.int64), "n": total})

    rows = docs.select("text").mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in rows}


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Places are word numbers from 0, null without any. `labels` joins the phrases' labels and those of the
    templates held; `score` is 1 where a phrase stands, else the largest containment among the templates
    held, 0 without any. Null and empty texts have no words. Repeated rows are
    rows of their own; an empty table gives no rows, no templates none of their labels. Other columns are not
    read. A text is worked on in memory, at some 60 bytes a character.
    """
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(Templates(templates, word_counts(docs, templates)))
    names = list(PHRASES.values())

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, out = texts_of(frame["text"]), []
            for a, b in batches(texts):
                words, offsets = hash_words(texts[a:b])
                place, label = _phrase_places(words, offsets)
                ranks = index.value.encode(words)
                some = np.add.reduceat(np.append(index.value.is_prefix[ranks] & (ranks >= 0), False).astype(np.int64), offsets[:-1]) if len(words) else np.zeros(b - a, np.int64)
                for d in range(b - a):
                    low, high = offsets[d], offsets[d + 1]
                    s, e = np.searchsorted(place, [low, high])
                    base = sorted({names[k] for k in label[s:e]})
                    held = index.value.held_by(ranks[low:high]) if high > low and some[d] else {}
                    score = 1.0 if base else max(held.values(), default=0.0)
                    first, last = (place[s] - low, place[e - 1] - low) if e > s else (None, None)
                    out.append((high - low, e - s, first, last, ",".join(base), ",".join(sorted({*base, *map(label_of, held)})), score))
            made = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            made.insert(0, "doc_id", frame["doc_id"].astype("Int64"))
            yield made.astype({"first_word": "Int64", "last_word": "Int64"})

    shape = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(look, shape)
