"""Licence scans over a positional index of rare tokens.

A template is the text of a licence, a notice or a phrase as words; each has mandatory key phrases. The inverse
document frequency of every template word is counted over all documents. A template's ``ANCHORS``
rarest words (each at one place; of a short one, the rarer half) index it: where one of them stands in a document, its posting gives the place at which
the template would begin. The postings of a template are intersected by that place: it is a candidate where at least
``AGREE`` of its anchors agree, all of them if it has fewer. A candidate is then verified: every key phrase has
to stand word for word at most ``SLACK`` words from its place, and the weight of the template words in their places is the score.
A template found in this way gives its label, and templates that tie give theirs all. The plain phrases are templates of which
all words are anchors and which have to stand as they are, so every place where one stands is found.

Nulls and edge cases: a null or empty text has no words and no labels; long texts are scanned whole;
repeated rows and null ids are scanned like any other; an empty table gives no rows; other columns
are ignored. Memory holds one batch of texts; what reaches the driver is a count for each template word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM, table, text_bytes

#: Anchors of a template, those that have to agree, words that a key phrase may be off, and the share of its weight that a template needs.
ANCHORS, AGREE, SLACK, ENOUGH = 6, 2, 12, 0.5
#: Plain phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""
_GPL = """is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
more details."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You
can obtain one at http://mozilla.org/MPL/2.0/."""
#: Texts and notices of public licences as label, text, key phrases.
NOTICES = [
    ("mit", _MIT, ("hereby granted, free of charge", "merge, publish, distribute, sublicense")),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("hereby granted, free of charge", "person obtaining a copy of this software")),
    ("mit", "released under the MIT License", ("the MIT License",)),
    ("mit", "licensed under the MIT License", ("the MIT License",)),
    ("mit", "SPDX-License-Identifier: MIT", ("License-Identifier: MIT",)),
    ("apache", _APACHE, ("Apache License, Version 2.0",)),
    ("apache", "licensed under the Apache License, Version 2.0", ("Apache License, Version 2",)),
    ("apache", "SPDX-License-Identifier: Apache-2.0", ("License-Identifier: Apache",)),
    ("gpl", _GPL, ("GNU General Public License",)),
    ("gpl", "licensed under the GNU General Public License, version 3", ("GNU General Public License",)),
    ("gpl", "free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", ("GNU General Public License",)),
    ("gpl", "SPDX-License-Identifier: GPL-3.0", ("License-Identifier: GPL",)),
    ("lgpl", _GPL.replace("General", "Lesser General"), ("GNU Lesser General Public License",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("GNU Lesser General Public License",)),
    ("agpl", _GPL.replace("General", "Affero General"), ("GNU Affero General Public License",)),
    ("agpl", "under the terms of the GNU Affero General Public License", ("GNU Affero General Public License",)),
    ("bsd", _BSD, ("source and binary forms", "Redistributions of source code must retain")),
    ("bsd", f"{_BSD} {_BSD3}", ("source and binary forms", "Neither the name of the")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("source and binary forms",)),
    ("isc", _ISC, ("with or without fee",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("zlib", _ZLIB, ("held liable for any damages", "must not be misrepresented")),
    ("boost", _BOOST, ("free of charge, to any person or organization",)),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ("Boost Software License",)),
    ("mpl", _MPL, ("Mozilla Public License",)),
    ("mpl", "subject to the terms of the Mozilla Public License", ("Mozilla Public License",)),
    ("epl", "made available under the terms of the Eclipse Public License", ("Eclipse Public License",)),
    ("unlicense", _UNLICENSE, ("free and unencumbered software",)),
    ("unlicense", "free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("wtfpl", "Do What The Fuck You Want To Public License", ("you want to public license",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("cc-by", "licensed under CC BY 4.0", ("CC BY 4",)),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution 4",)),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ("CC BY-NC",)),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("Creative Commons Attribution-NonCommercial",)),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ("CC BY-SA",)),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("Creative Commons Attribution-ShareAlike",)),
]


def normal(text: str) -> list[bytes]:
    return text.encode().translate(ALNUM).split()


def place(words: list[bytes], phrase: list[bytes]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


class Template:
    def __init__(self, label: str, text: str, keys: tuple[str, ...], plain: bool, idf: dict[bytes, float]):
        self.label, self.plain, self.words = label, plain, normal(text)
        self.keys = [(place(self.words, k), k) for k in map(normal, keys)]
        self.weight = [idf.get(w, 1.0) for w in self.words]
        self.whole = sum(self.weight)
        first = {w: i for i, w in reversed(list(enumerate(self.words)))}  # a word indexes its first place
        self.anchors = sorted(first.values(), key=lambda i: (-self.weight[i], i))[: None if plain else min(ANCHORS, max(AGREE, (len(self.words) + 1) // 2))]
        self.agree = len(self.anchors) if plain else min(AGREE, len(self.anchors))

    def score(self, words: list[bytes], start: int) -> float:
        """The share of the template's weight that stands in its place from ``start`` on; 0 if a key phrase is missing."""
        slack = 0 if self.plain else SLACK
        for at, key in self.keys:
            near = range(max(0, start + at - slack), start + at + slack + 1)
            if not any(words[k : k + len(key)] == key for k in near):
                return 0.0
        low, high = max(0, -start), min(len(self.words), len(words) - start)
        met = sum(w for w, own, t in zip(self.weight[low:high], self.words[low:high], words[start + low : start + high], strict=True) if own == t)
        return min(1.0, met / self.whole)


class Index:
    """Templates by their rarest words; ``idf`` maps a word to its weight."""

    def __init__(self, idf: dict[bytes, float]):
        entries = [(label, p, (p,), True) for p, label in PHRASES.items()] + [(*n, False) for n in NOTICES]
        self.templates = [Template(*e, idf) for e in entries]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, template in enumerate(self.templates):
            for i in template.anchors:
                self.postings.setdefault(template.words[i], []).append((t, i))
        self.rare = frozenset(self.postings)

    def candidates(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, start) where enough postings of the template meet."""
        met: Counter = Counter()
        for p, w in enumerate(words):
            if w in self.rare:
                met.update([(t, p - i) for t, i in self.postings[w]])
        return [k for k, n in met.items() if n >= self.templates[k[0]].agree]

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, str, str, float]:
        base, plain_labels, labels, best = [], set(), set(), 0.0
        if len(self.rare.intersection(words)) > 1:
            for t, start in self.candidates(words):
                template = self.templates[t]
                score = template.score(words, start)
                if template.plain and score:
                    base.append(start)
                    plain_labels.add(template.label)
                    best = 1.0
                elif score >= ENOUGH:
                    labels.add(template.label)
                    best = max(best, score)
        return len(base), min(base, default=None), max(base, default=None), ",".join(sorted(plain_labels)), ",".join(sorted(labels | plain_labels)), best


def rarity(docs: DataFrame, text_col: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of the template words over all rows."""
    vocabulary = frozenset(w for t in [*PHRASES, *(n[1] for n in NOTICES)] for w in normal(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in text_bytes(b.column(0)):
                seen.update(vocabulary.intersection(t.translate(ALNUM).split()))
                seen[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    counted = docs.select(text_col).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    n = {r["w"].encode(): r["n"] for r in counted.collect()}
    return {w: 1 + math.log((1 + n.get(b"", 0)) / (1 + n.get(w, 0))) for w in vocabulary}


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row."""
    idf = rarity(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            if not b.num_rows:
                continue
            found = [(len(w), *index.scan(w)) for t in text_bytes(b.column(1)) for w in [t.translate(ALNUM).split()]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_licenses": op2_licenses}
ORACLE_SQL: dict[str, str] = {}
