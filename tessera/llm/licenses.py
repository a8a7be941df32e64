"""Licence scan with a positional rare-token index.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  One pass counts
in how many documents each word of the licence templates occurs (whole corpus), and
gives every word its inverse document frequency.  The second pass looks up each
file's occurrences of the rarest words of each template and of its rarest mandatory one,
turns every occurrence into the place where the template would begin (its position minus
the word's position in the template), and intersects: a place counts only if as many of
these words agree on it as every match must hold. A match may lack words of ``1 - share``
of the weight in all and none that is mandatory, so that number follows from the weights
and no match is lost.  There the template is compared word by word; it is found if words
with at least ``share`` of its IDF weight agree and every mandatory key phrase stands
in full.  Base phrases are templates whose words are all mandatory.  Words of places found
are compared as bytes, not only as hashes. Licence texts are templates by paragraph, as
names are put in between.

``score`` is the largest matched share of IDF weight of all that was found, else 0, rounded
to six digits. A task holds about 60 bytes for each byte of a long text.

Defined results: null and empty texts have no words and no labels (empty strings,
null places, score 0); repeated rows get equal results; columns named like the
outputs are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import frames
from tessera.llm import textbatch as tb

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Template wording and mandatory key phrases of common licences.
TEMPLATES = [
    ("agpl-3.0", "gnu affero general public license version 3", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", ["cc0", "public domain"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("lgpl-3.0", "gnu lesser general public license version 3", ["lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]

#: Paragraphs of whole licence texts and notices, with their mandatory key phrases.
PARAGRAPHS = [
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions:""",
        ["without restriction", "sublicense and or sell copies of the software"],
    ),
    (
        "mit",
        """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
        ["copies or substantial portions of the software"],
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
        ["permission notice appear in all copies"],
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met:""",
        ["source and binary forms", "conditions are met"],
    ),
    (
        "bsd",
        """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
        ["redistributions in binary form must reproduce"],
    ),
    (
        "bsd-3-clause",
        """may be used to endorse or promote products derived from this software without specific prior written permission.""",
        ["endorse or promote products"],
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at""",
        ["apache license version 2 0"],
    ),
    (
        "apache-2.0",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        ["distributed under the license is distributed on an as is basis"],
    ),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        ["gnu general public license", "version 3 of the license"],
    ),
    (
        "gpl-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
        ["gnu general public license", "version 2 of the license"],
    ),
    (
        "lgpl-2.1",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
        ["gnu lesser general public license", "version 2 1 of the license"],
    ),
    (
        "agpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        ["gnu affero general public license", "version 3 of the license"],
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at""",
        ["mozilla public license v 2 0"],
    ),
    (
        "unlicense",
        """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ["anyone is free to copy modify publish use compile sell or distribute this software"],
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software.""",
        ["authors be held liable"],
    ),
    (
        "boost-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license""",
        ["person or organization obtaining a copy of the software"],
    ),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    must: tuple[bool, ...]  # words of mandatory key phrases
    base: bool


def _template(label: str, text: str, keys: list[str], base: bool = False) -> Template:
    words = tuple(re.findall("[a-z0-9]+", text.lower()))
    must = [False] * len(words)
    for key in keys:
        k = key.split()
        at = next(i for i in range(len(words)) if list(words[i : i + len(k)]) == k)
        must[at : at + len(k)] = [True] * len(k)
    return Template(label, words, tuple(must), base)


def templates() -> list[Template]:
    return [_template(label, phrase, [phrase], base=True) for phrase, label in BASE.items()] + [_template(*t) for t in TEMPLATES + PARAGRAPHS]


def _word_hash(word: str) -> int:
    return int(tb.words(pa.array([word]), tb.ALNUM).hashes()[0])


class Index:
    """Vocabulary of the templates, and postings of each one's rarest words."""

    def __init__(self, found: list[Template], df: dict[str, int], n_docs: int, share: float, rare: int = 3):
        self.templates = found
        vocabulary = sorted({w for t in found for w in t.words}, key=_word_hash)
        self.vocabulary = [w.encode() for w in vocabulary]
        self.hashes = np.array([_word_hash(w) for w in vocabulary], np.uint64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.hashes & np.uint64(0xFFFF)] = True
        ids = {w: i for i, w in enumerate(vocabulary)}
        self.ids = [np.array([ids[w] for w in t.words]) for t in found]
        idf = np.log((n_docs + 1) / (np.array([df.get(w, 0) for w in vocabulary]) + 1)) + 1e-3
        self.weights = [idf[i] / idf[i].sum() for i in self.ids]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        self.votes = []
        for k, t in enumerate(found):
            own = self.weights[k]
            order = sorted(range(len(t.words)), key=lambda i: (-own[i], i))
            first = next(i for i in order if t.must[i])
            chosen = [first] if t.base else [first, *[i for i in order if i != first][:rare]]
            # Of these a match may lack the lightest that aren't mandatory, while they weigh no more than it may.
            spare = np.cumsum(sorted(own[i] for i in chosen if not t.must[i]))
            self.votes.append(len(chosen) - int(np.count_nonzero(spare <= 1 - share + 1e-9)))
            for i in chosen:
                self.postings.setdefault(int(self.ids[k][i]), []).append((k, i))

    def known(self, h: np.ndarray) -> np.ndarray:
        """The vocabulary id of each word, -1 for other words."""
        out = np.full(len(h), -1, np.int32)
        some = np.flatnonzero(self.maybe[h & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        real = self.hashes[at] == h[some]
        out[some[real]] = at[real]
        return out

    def scan(self, w: tb.Words, share: float) -> list[tuple[int, int, float]]:
        """(template, first word, matched share) of every place found."""
        ids = self.known(w.hashes())
        at = np.flatnonzero(ids >= 0)
        places: dict[int, list[np.ndarray]] = {}
        at = at[np.argsort(ids[at], kind="stable")]
        by = ids[at]
        for word, uses in self.postings.items():
            here = at[np.searchsorted(by, word) : np.searchsorted(by, word + 1)]
            for k, rel in uses:
                places.setdefault(k, []).append(here - rel)
        out = []
        for k, starts in places.items():
            start, votes = np.unique(np.concatenate(starts), return_counts=True)
            n = len(self.ids[k])
            start = start[(votes >= self.votes[k]) & (start >= 0) & (start + n <= len(ids))]
            start = start[w.doc[start] == w.doc[start + n - 1]]
            agree = ids[start[:, None] + np.arange(n)] == self.ids[k]
            got = (agree * self.weights[k]).sum(axis=1)
            must = np.array(self.templates[k].must)
            ok = (got >= (1 - 1e-9 if self.templates[k].base else share)) & agree[:, must].all(axis=1)
            for s, a, g in zip(start[ok].tolist(), agree[ok], got[ok].tolist()):
                if all(w.buf[w.starts[s + i] : w.ends[s + i]].tobytes() == self.vocabulary[self.ids[k][i]] for i in np.flatnonzero(a)):
                    out.append((k, s, round(min(1.0, g), 6)))
        return out


def document_frequencies(docs: DataFrame, index: Index, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each template word occurs, and how many documents there are."""

    def count(batches):
        n = 0
        total = np.zeros(len(index.vocabulary), np.int64)
        for batch in batches:
            for part in tb.slices(batch):
                w = tb.words(part.column(0), tb.ALNUM, lower=True)
                ids = index.known(w.hashes())
                at = np.flatnonzero(ids >= 0)
                key = np.unique(w.doc[at].astype(np.int64) * len(total) + ids[at])
                total += np.bincount(key % len(total), minlength=len(total))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.append(n, total))], names=["word", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return {w.decode(): found.get(i, 0) for i, w in enumerate(index.vocabulary)}, found.get(-1, 0)


def scan(docs: DataFrame, text: str = "text", share: float = 0.8) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    own = templates()
    df, n_docs = document_frequencies(docs, Index(own, {}, 1, share), text)
    index = Index(own, df, n_docs, share)
    fields = [T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()))]

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        w = tb.words(part.column(text), tb.ALNUM, lower=True)
        n = part.num_rows
        places: list[list[int]] = [[] for _ in range(n)]
        base: list[set[str]] = [set() for _ in range(n)]
        every: list[set[str]] = [set() for _ in range(n)]
        best = np.zeros(n)
        for k, start, got in index.scan(w, share):
            d = int(w.doc[start])
            t = own[k]
            every[d].add(t.label)
            best[d] = max(best[d], got)
            if t.base:
                base[d].add(t.label)
                places[d].append(start - int(w.first[d]))
        return [
            pa.array(w.counts.astype(np.int64)),
            pa.array([len(p) for p in places], pa.int64()),
            pa.array([min(p, default=None) for p in places], pa.int64()),
            pa.array([max(p, default=None) for p in places], pa.int64()),
            pa.array([",".join(sorted(x)) for x in base], pa.string()),
            pa.array([",".join(sorted(x)) for x in every], pa.string()),
            pa.array(best),
        ]

    return frames.append(docs, fields, compute, text)


def sql(table: str = "documents", share: float = 0.8) -> str:
    """The same as SQL text: every template is compared at every place where one of its words
    stands."""
    own = templates()
    rows = ", ".join(f"({k}, '{t.label}', {t.base}, {i}, '{w}', {m})" for k, t in enumerate(own) for i, (w, m) in enumerate(zip(t.words, t.must)))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {table}
        ), t AS (
            SELECT * FROM (VALUES {rows}) AS x(k, label, base, i, word, must)
        ), w AS (
            SELECT r, p, word FROM (SELECT r, unnest(range(0, len(words))) AS p, unnest(words) AS word FROM texts) WHERE word IN (SELECT word FROM t)
        ), df AS (
            SELECT word, count(DISTINCT r) AS df FROM w GROUP BY word
        ), idf AS (
            SELECT k, label, base, i, word, must, ln(((SELECT count(*) FROM texts) + 1) / (coalesce(df, 0) + 1)) + 1e-3 AS idf FROM t LEFT JOIN df USING (word)
        ), weighed AS (
            SELECT *, idf / sum(idf) OVER (PARTITION BY k) AS weight, count(*) OVER (PARTITION BY k) AS n, count_if(must) OVER (PARTITION BY k) AS n_must FROM idf
        ), places AS (
            SELECT r, k, label, base, n, n_must, p - i AS start, sum(weight) AS got, count(*) AS agree, count_if(must) AS musts
            FROM w JOIN weighed USING (word) GROUP BY r, k, label, base, n, n_must, p - i
        ), found AS (
            SELECT r, label, base, start, least(got, 1.0) AS got FROM places JOIN texts USING (r)
            WHERE start >= 0 AND start + n <= len(words) AND musts = n_must AND (agree = n OR NOT base AND got >= {share})
        ), told AS (
            SELECT r, count_if(base)::BIGINT AS n_base, (min(start) FILTER (WHERE base))::BIGINT AS first_word, (max(start) FILTER (WHERE base))::BIGINT AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(max(got), 6) AS score
            FROM found GROUP BY r
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
        FROM texts LEFT JOIN told USING (r)"""
