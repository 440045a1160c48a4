"""License scans: exact containment join between text blocks and license templates.

A text is a sequence of lower-cased words; its blocks are all windows of a template's block length at a
stride of half of it (the last one may be shorter). Half a block is the least power of two that holds the
template (``BLOCK / 2`` at least), so a passage as long as the template lies whole in some block, whatever
its offset and line breaks. A block matches a template when it holds at least ``THRESHOLD`` of the
template's distinct words, and all of them where those are fewer than ``SHORT``. Words that are strewn
over more than half a block may be missed or found, by their offset.

The join is the prefix-filtering set-similarity join. Words outside every template cannot add to an
overlap and are dropped first, which leaves the exact overlap unchanged; the rest are ordered by
their frequency over the whole corpus (number of documents, rarest first, ties by word). With a need
of ``o = ceil(THRESHOLD * |T|)`` words (``|T|`` for short ones),

* length filter: a block with fewer than ``o`` template words is skipped;
* prefix filter: the first ``|T| - o + 1`` words of T and the first ``|B| - o + 1`` words of B in that
  order must share a word, found through an inverted index over template prefixes;
* positional filter: a shared word at ranks i, j leaves at most ``1 + min(|T| - i, |B| - j) - 1``
  common words, which must reach ``o``;

survivors are verified by the exact overlap. Templates of one block length share an index. At most
``MAX_WORDS`` template words are accepted, which bounds what is sent to the executors; more, or a template
without words, raise ValueError. Documents are neither shuffled nor collected.
Phrases (the base labels) are found as consecutive words. One pass counts frequencies, one joins.

Defined cases: a null text is empty (0 words, no labels, score 0); equal rows give equal results;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import load

#: The least length of a block, in words.
BLOCK = 64
THRESHOLD = 0.8
SHORT = 8
MAX_WORDS = 1_000_000

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Opening lines of public licenses, the usual one-line notices, and whole short licenses, by label.
TEMPLATES = [
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind"),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("rights-reserved", "All rights reserved."),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

#: All bytes of ASCII that are neither digits nor lower-case letters part words; others never do.
_PART = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; UTF-8 bytes above 0x7F all belong to words."""
    return text.encode().lower().translate(_PART).split() if text else []


def need_of(n_words: int, threshold: float) -> int:
    """How many of a template's distinct words a block must hold."""
    return n_words if n_words < SHORT else math.ceil(threshold * n_words - 1e-9)


def block_of(template: str, least: int = BLOCK) -> int:
    """The block length of a template: twice a power of two that holds its words, or ``least``."""
    return max(least, 2 << (len(words_of(template)) - 1).bit_length())


def ranked(templates: Iterable[tuple[str, str]], frequency: Mapping[bytes, int]) -> dict[bytes, int]:
    """Rank of every template word, rarest first."""
    vocabulary = sorted({w for _, t in templates for w in words_of(t)}, key=lambda w: (frequency.get(w, 0), w))
    return {w: i for i, w in enumerate(vocabulary)}


class TemplateIndex:
    """Templates as word sets in global frequency order, with an inverted index over their prefixes."""

    def __init__(self, templates: Iterable[tuple[str, str]], frequency: Mapping[bytes, int], threshold: float, rank: Mapping[bytes, int] | None = None):
        templates = list(templates)
        sets = [(label, frozenset(words_of(t))) for label, t in templates]
        self.rank = ranked(templates, frequency) if rank is None else rank
        self.words = frozenset(self.rank[w] for _, s in sets for w in s)
        self.items, self.index = [], {}
        for k, (label, s) in enumerate(sets):
            ranks = sorted(self.rank[w] for w in s)
            need = need_of(len(ranks), threshold)
            self.items.append((label, frozenset(ranks), len(ranks), need))
            for i, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.index.setdefault(r, []).append((k, i))
        self.least = min((need for *_, need in self.items), default=0)

    def matches(self, block: set[int]) -> dict[int, float]:
        """Containment of every template that the block (a set of ranks) holds to the threshold."""
        found: dict[int, float] = {}
        if len(block) < self.least:
            return found
        ordered, seen = sorted(block), set()
        for j, r in enumerate(ordered):
            for k, i in self.index.get(r, ()):
                _, ranks, size, need = self.items[k]
                if k in seen or len(ordered) < need or j > len(ordered) - need or 1 + min(size - i, len(ordered) - j) - 1 < need:
                    continue
                seen.add(k)
                both = len(ranks & block)
                if both >= need:
                    found[k] = both / size
        return found


def blocks_of(n_words: int, block: int) -> list[tuple[int, int]]:
    step = block // 2
    return [(a, min(a + block, n_words)) for a in range(0, max(n_words - step, 1), step)] if n_words else []


def indexes(templates: Iterable[tuple[str, str]], frequency: Mapping[bytes, int], threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[dict[bytes, int], list[tuple[int, TemplateIndex]]]:
    """Ranks of all template words, and an index for every block length."""
    templates = list(templates)
    if block < 2 or block % 2 or not all(words_of(t) for _, t in templates) or sum(len(words_of(t)) for _, t in templates) > MAX_WORDS:
        raise ValueError(f"blocks must be even, templates must have words, and at most {MAX_WORDS} in all")
    rank = ranked(templates, frequency)
    lengths = sorted({block_of(t, block) for _, t in templates})
    return rank, [(n, TemplateIndex([x for x in templates if block_of(x[1], block) == n], frequency, threshold, rank)) for n in lengths]


def scan(words: list[bytes], rank: Mapping[bytes, int], by_block: list[tuple[int, TemplateIndex]], phrases: Mapping[tuple[bytes, ...], str]) -> dict:
    """Phrase places and template matches of one text."""
    starts, base = [], set()
    heads: dict[bytes, list] = {}
    for p, label in phrases.items():
        heads.setdefault(p[0], []).append((p, label))
    if not heads.keys().isdisjoint(words):
        for i, w in enumerate(words):
            for p, label in heads.get(w, ()):
                if tuple(words[i : i + len(p)]) == p:
                    starts.append(i)
                    base.add(label)
    hits = [(i, rank[w]) for i, w in enumerate(words) if w in rank]
    labels, score, spans = set(base), 1.0 if base else 0.0, []
    for block, index in by_block:
        step = block // 2
        by_step: dict[int, set[int]] = {}
        for i, r in hits:
            if r in index.words:
                by_step.setdefault(i // step, set()).add(r)
        last = max(-(-len(words) // step) - 2, 0)
        for s in sorted({min(t, last) for s in by_step for t in (s - 1, s) if t >= 0}):
            for k, containment in index.matches(by_step.get(s, set()) | by_step.get(s + 1, set())).items():
                labels.add(index.items[k][0])
                score = max(score, containment)
                spans.append((index.items[k][0], s * step, min(s * step + block, len(words)), containment))
    return {"n_base": len(starts), "first": min(starts, default=None), "last": max(starts, default=None), "base": base, "labels": labels, "score": score, "spans": spans}


def template_frequencies(docs: DataFrame, text_col: str, templates) -> Counter:
    """Number of documents of the corpus that hold each template word; at most one row a word comes back."""
    vocabulary = frozenset(w for _, t in templates for w in words_of(t))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                total.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in total], "n": list(total.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return Counter({r["word"].encode(): r["n"] for r in rows})


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row a document with its phrase places, labels, score and matching spans (label, words from, to, containment)."""
    ship(docs.sparkSession)
    rank, by_block = indexes(templates, template_frequencies(docs, text_col, templates), threshold, block)
    split = {tuple(words_of(p)): label for p, label in phrases.items()}
    kind = docs.schema[id_col].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                words = words_of(text.as_py())
                rows.append((len(words), scan(words, rank, by_block, split)))
            arrays = [
                b.column(0),
                pa.array([n for n, _ in rows], pa.int64()),
                pa.array([r["n_base"] for _, r in rows], pa.int64()),
                pa.array([r["first"] for _, r in rows], pa.int64()),
                pa.array([r["last"] for _, r in rows], pa.int64()),
                pa.array([",".join(sorted(r["base"])) for _, r in rows], pa.string()),
                pa.array([",".join(sorted(r["labels"])) for _, r in rows], pa.string()),
                pa.array([r["score"] for _, r in rows], pa.float64()),
                pa.array([[dict(zip(("label", "from_word", "to_word", "containment"), s, strict=True)) for s in r["spans"]] for _, r in rows], pa.list_(pa.struct([("label", pa.string()), ("from_word", pa.int64()), ("to_word", pa.int64()), ("containment", pa.float64())]))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(id_col, text_col).mapInArrow(
        join, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,from_word:long,to_word:long,containment:double>>"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents")).drop("spans")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_T = ", ".join(f"({k}, {_quoted(label)}, {_quoted(t)}, {block_of(t) // 2})" for k, (label, t) in enumerate(TEMPLATES))
_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_P = ", ".join(f"({_quoted(p)}, {_quoted(label)})" for p, label in PHRASES.items())

#: Every window against every template by plain counting, without the filters.
SQL = f"""
WITH low AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents
), pos AS (
  SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM low
), phrases AS (
  SELECT string_split(p, ' ') AS p, label FROM (VALUES {_P}) v(p, label)
), places AS (
  SELECT rid, i, label FROM pos JOIN low USING (rid) JOIN phrases ON word = p[1] AND w[i + 1:i + len(p)] = p
), base AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM places GROUP BY rid
), t AS (
  SELECT k, label, step, unnest(list_distinct(regexp_extract_all(lower(t), '{_W}'))) AS word FROM (VALUES {_T}) v(k, label, t, step)
), sized AS (
  SELECT k, count(*) AS size, CASE WHEN count(*) < {SHORT} THEN count(*) ELSE ceil({THRESHOLD} * count(*) - 1e-9) END AS need FROM t GROUP BY k
), hits AS (
  SELECT rid, least(s, greatest((len(w) + step - 1) // step - 2, 0)) AS s, k, label, word
  FROM (SELECT rid, k, t.label, t.word, step, unnest([i // step, i // step - 1]) AS s FROM pos JOIN t USING (word)) JOIN low USING (rid) WHERE s >= 0
), found AS (
  SELECT rid, h.label, count(DISTINCT word) / any_value(size) AS score FROM hits h JOIN sized USING (k) GROUP BY rid, s, k, h.label HAVING count(DISTINCT word) >= any_value(need)
), labels AS (
  SELECT rid, string_agg(label, ',' ORDER BY label) FILTER (b) AS base_labels, string_agg(label, ',' ORDER BY label) FILTER (NOT b) AS labels
  FROM (SELECT DISTINCT rid, label, b FROM (SELECT rid, label, true AS b FROM places UNION ALL SELECT rid, label, false FROM places UNION ALL SELECT rid, label, false FROM found))
  GROUP BY rid
), scores AS (SELECT rid, max(score) AS score FROM found GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM low LEFT JOIN base USING (rid) LEFT JOIN labels USING (rid) LEFT JOIN scores USING (rid)
"""

QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES = {"op2_license_scan": SQL}
