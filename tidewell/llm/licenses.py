"""License scans with a positional index of rare licence words.

A template is a licence's text or notice with the key phrases that it must have. One pass counts in how many documents each
word of any template occurs (a bounded vocabulary), which gives its IDF. The index holds each template's rarest words with
their positions: as many as it takes that their weight is over 1 - ``MIN_SHARE`` of the whole, so every place that has
``MIN_SHARE`` of the weight has one of them.

A second pass looks up each file's rare licence words. A hit of word q of a template at word p of the file says that the
template would begin at p - q; the postings that agree on that, up to ``SLOP`` words, are intersected: for every beginning in reach
of a hit the weight of all template words that stand at most ``SLOP`` words from their places is summed up. A place with ``MIN_SHARE`` of the weight is
a match if each key phrase of the template stands there word for word. Beside that, ``PHRASES`` name labels wherever they stand.

Defined cases: null and empty texts have no words; texts of any length are read in pieces, whole; a document without a place has null
first and last words, empty labels and a score of 0; repeated rows and null ids give their rows again; an empty table gives none. Only the two named columns
are read, so no other column can clash. Documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import small_batches

#: Phrases that name a label wherever they stand.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Share of a template's weight that a match has, and words by which its words may be off their places.
MIN_SHARE = 0.8
SLOP = 4
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
_PIECE = 1 << 20

#: Published licences and notices as (label, text, key phrases).
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("permission is hereby granted free of charge", "without restriction", "shall be included in all copies"),
    ),
    ("mit", "Licensed under the terms of the MIT license", ("mit license",)),
    ("mit", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    (
        "bsd-2",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors as is",
        ("redistribution and use in source and binary forms", "in binary form must reproduce"),
    ),
    (
        "bsd-3",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("redistribution and use in source and binary forms", "neither the name of", "without specific prior written permission"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided as is and the author disclaims all warranties",
        ("with or without fee is hereby granted", "appear in all copies"),
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    ("gpl-2", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-3", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    (
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        ("gnu general public license as published by", "version 2 of the license"),
    ),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        ("gnu general public license as published by", "version 3 of the license"),
    ),
    ("lgpl-2.1", "licensed under the GNU Lesser General Public License, version 2.1", ("gnu lesser general public license version 2 1",)),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license version 3",)),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license version 3",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software released into the public domain",),
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("without any express or implied warranty", "alter it and redistribute it freely"),
    ),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0 international",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0 international",)),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ("creative commons attribution noncommercial sharealike 4 0 international",)),
)


def split_words(text: str) -> list[bytes]:
    """Words of a text; only A-Z are lower-cased."""
    return _WORD.findall(text.encode().lower())


def word_ids(raw: bytes, ids: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words of a UTF-8 text, 0 for those that no template has; piece by piece."""
    raw = raw.lower()  # of bytes: A-Z only
    parts, at = [np.zeros(0, np.int32)], 0
    while at < len(raw):
        gap = _GAP.search(raw, at + _PIECE) if at + _PIECE < len(raw) else None
        end = gap.start() if gap else len(raw)
        found = _WORD.findall(raw, at, end)
        parts.append(np.fromiter(map(ids.get, found, repeat(0)), np.int32, len(found)))
        at = end
    return np.concatenate(parts)


def places(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand one after the other."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[words[at + k] == phrase[k]]
    return at


class Template:
    """Words, weights, rare words and key phrases of a template, as numbers of the vocabulary."""

    def __init__(self, label: str, words: np.ndarray, keys: list[np.ndarray], idf: np.ndarray):
        self.label, self.words, self.keys = label, words, keys
        self.weights = idf[words]
        self.whole = float(self.weights.sum())
        # the rarest words, until a place without any of them is below the share
        self.postings: dict[int, np.ndarray] = {}
        missed = self.whole
        for w in sorted(set(words.tolist()), key=lambda w: (-idf[w], w)):
            if missed < MIN_SHARE * self.whole * (1 - 1e-9):
                break
            self.postings[w] = np.flatnonzero(words == w)
            missed -= float(idf[w]) * len(self.postings[w])

    def match(self, words: np.ndarray, begins: np.ndarray) -> tuple[int, int, float] | None:
        """(first word, end, share) of the best match that begins within ``SLOP`` words of ``begins`` (sorted)."""
        best = None
        m, out = len(self.words), SLOP + len(self.words)
        # beginnings that are near each other are looked at in one range
        cut = np.flatnonzero(np.diff(begins) > 2 * SLOP + m) + 1
        for lo, hi in zip(begins[np.r_[0, cut]] - SLOP, begins[np.r_[cut - 1, len(begins) - 1]] + SLOP):
            # the file's words from lo - SLOP to hi + m + SLOP, with nothing where the file has none
            a, b = int(lo) - SLOP, int(hi) + out
            near = np.full(b - a, -1, np.int32)
            near[max(-a, 0) : max(len(words) - a, 0)] = words[max(a, 0) : max(min(b, len(words)), 0)]
            n = int(hi - lo) + 1
            score, exact = np.zeros(n), np.zeros(n)
            for j in range(m):
                exact += self.weights[j] * (near[j + SLOP : j + SLOP + n] == self.words[j])
                there = np.concatenate([[0], np.cumsum(near[j : j + n + 2 * SLOP] == self.words[j])])
                score += self.weights[j] * (there[2 * SLOP + 1 :] > there[: -2 * SLOP - 1])
            good = score >= MIN_SHARE * self.whole * (1 - 1e-9)
            for key in self.keys if good.any() else ():
                stands = np.zeros(len(near) + 1, np.int64)
                stands[places(near, key) + 1] = 1
                stands = np.cumsum(stands)  # how many begin before a place
                first = np.arange(n)
                good &= stands[first + m + 2 * SLOP - len(key) + 1] > stands[first]
            if good.any():
                top = np.where(good, score, -1)
                k = int(np.argmax(np.where(top >= top.max() - 1e-9, exact, -1)))  # ties: most words at their very places
                if best is None or (score[k], exact[k]) > best[2:]:
                    best = (max(int(lo) + k, 0), min(int(lo) + k + m, len(words)), float(score[k]), float(exact[k]))
        return best and (best[0], best[1], min(best[2] / self.whole, 1.0))


def vocabulary(templates=TEMPLATES, phrases=PHRASES) -> dict[bytes, int]:
    """Numbers from 1 of all words of templates and phrases."""
    words = sorted({w for _, text, keys in templates for t in (text, *keys) for w in split_words(t)} | {w for p in phrases for w in split_words(p)})
    return {w: i + 1 for i, w in enumerate(words)}


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _batch_ids(batch, ids: dict[bytes, int]):
    import pyarrow as pa

    for raw in batch.column(1).cast(pa.binary()):
        yield word_ids(raw.as_py(), ids)


def document_counts(docs: DataFrame, ids: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each word of the vocabulary occurs: as many rows a task as there are words."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(len(ids) + 1, np.int64)
        n = 0
        for big in batches:
            for batch in small_batches(big):
                n += batch.num_rows
                for words in _batch_ids(batch, ids):
                    there = np.zeros(len(counts), bool)
                    there[words] = True
                    counts += there
        counts[0] = n  # all documents
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts)), pa.int32()), pa.array(counts)], ["word", "n"])

    rows = _texts(docs, id_col, text_col).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(ids) + 1, np.int64)
    for r in rows:
        counts[r["word"]] = r["n"]
    return int(counts[0]), counts


def index_templates(n_docs: int, counts: np.ndarray, ids: dict[bytes, int], templates=TEMPLATES) -> list[Template]:
    idf = np.array([math.log(1 + (n_docs + 0.5) / (c + 0.5)) for c in counts.tolist()])
    number = lambda text: np.array([ids[w] for w in split_words(text)], np.int32)
    return [Template(label, number(text), [number(k) for k in keys], idf) for label, text, keys in templates]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) for every row.

    n_base, first_word and last_word: places of ``phrases``. score: 1 with such a place, else the best share of a template.
    matches: (label, first_word, end_word, share) of each template that is found, at its best place.
    """
    ids = vocabulary(templates, phrases)
    n_docs, counts = document_counts(docs, ids, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(index_templates(n_docs, counts, ids, templates))  # of the size of the templates
    named = [(np.array([ids[w] for w in split_words(p)], np.int32), label) for p, label in phrases.items()]

    def run(batches):
        import pyarrow as pa

        index = shared.value
        # for each rare word, the templates and positions that it may stand for
        by_word: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, t in enumerate(index):
            for w, at in t.postings.items():
                by_word.setdefault(w, []).append((k, at))
        rare = np.zeros(len(ids) + 1, bool)
        rare[list(by_word)] = True
        match = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())])
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(match)]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        for big in batches:
            for batch in small_batches(big):
                out = []
                for words in _batch_ids(batch, ids):
                    found = _scan(words, index, by_word, rare, ids)
                    at = [(places(words, p), label) for p, label in named]
                    base = {label for p, label in at if len(p)}
                    whole = np.concatenate([p for p, _ in at]) if at else np.zeros(0, np.int64)
                    some = len(whole) > 0
                    labels = base | {m["label"] for m in found}
                    score = 1.0 if some else max((m["share"] for m in found), default=0.0)
                    out.append((len(words), len(whole), int(whole.min()) if some else None, int(whole.max()) if some else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, found))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(kinds), kinds)]], ["doc_id", *names])

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "matches array<struct<label:string,first_word:long,end_word:long,share:double>>"
    )
    return _texts(docs, id_col, text_col).mapInArrow(run, schema)


def _scan(words: np.ndarray, index: list[Template], by_word: dict, rare: np.ndarray, ids: dict) -> list[dict]:
    """Matches of all templates in a file."""
    at = np.flatnonzero(rare[words])
    if not len(at):
        return []
    begins: dict[int, list[np.ndarray]] = {}
    here = words[at]
    for w in np.unique(here).tolist():
        p = at[here == w]
        for k, q in by_word[w]:
            begins.setdefault(k, []).append((p[:, None] - q[None, :]).ravel())
    found = []
    for k, parts in sorted(begins.items()):
        hit = index[k].match(words, np.unique(np.concatenate(parts)))
        if hit:
            found.append({"label": index[k].label, "first_word": hit[0], "end_word": hit[1], "share": hit[2]})
    return found
