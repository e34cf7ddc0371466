"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along paths.

A file's text is cut into units (lines, and sentences in them); units, and windows of consecutive ones, are passages, so that
wrapped headers are compared whole. A passage is compared with every template passage by the cosine of their TF-IDF
vectors: document frequencies of the templates' terms are counted over all files, terms that no template has weigh as if one
file had them. Comment marks are no terms. A file with a passage of ``threshold`` or more has that passage's licence, and one
with an SPDX line that of the line; a file that is for the most part such passages, or one named as a licence file, is a licence
file and gives its licence to its directory. Every other file takes the licence of the nearest directory above it that has one.

A cosine of c needs shared terms with c squared of the template's squared weight. So a passage has one of the fewest, heaviest
terms of a template that have more than the rest of it: windows are taken around these terms alone, up to twice the terms of
the longest template. Units are compared at any length. Before any window is compared, the terms of the whole text, and then those
of all windows around a unit, must have that share of some template's squared weight; which terms are frequent does not matter.

Null and empty texts have no passage, and inherit; null paths stand at the root. "All rights reserved" counts only in a file
without another licence. Ties go to the higher cosine, then the licence's name, then the passage's place; of licence files in
one directory the one with the higher cosine counts, then the smaller licence name. Repeated ids count once. Texts are taken whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.llm.common import keyed, slices, texts
from cratewise.session import fixed

THRESHOLD = 0.75
#: Share of a file's characters that passages of its licence must have for a licence file.
MOSTLY = 0.5

# Passages that name a licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    # Standard headers, whole texts of the short licences, titles of the long ones.
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    *((name, f"This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
      for name, what, colon, kind, version in (("GPL-3.0", "program", ":", "", 3), ("GPL-2.0", "program", ";", "", 2), ("LGPL-3.0", "library", ":", "Lesser ", 3), ("AGPL-3.0", "program", ":", "Affero ", 3))),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
_SPDX = re.compile(r"SPDX-License-Identifier:\s*\(?([A-Za-z0-9.+-]*[A-Za-z0-9])")
_NAMED = r"(?i)(^|/)((un)?licen[cs]e|copying)([.-][^/]*)?$"
_PASSAGES = re.compile(r"\n|(?<=[^\W\d_][.!?;])\s+")
#: Lines of comments: a source file that is little more than its header is not a licence file.
_COMMENT = re.compile(r"\s*(#|//|/\*|\*|--|;|%|<!--)")
_SPLIT = r"[^a-z0-9]+"


def terms(text: str) -> Counter:
    return Counter(t for t in re.split(_SPLIT, text.lower()) if t)


class Scanner:
    """Compares texts with the templates. weights: of template_weights; idf: of the templates' terms; rest: of all others."""

    def __init__(self, weights: list[tuple[int, str, str, float]], idf: dict[str, float], rest: float, threshold: float):
        self.idf, self.rest, self.threshold = idf, rest, threshold
        self.names = [name for name, _ in TEMPLATES]
        self.most = 2 * max(sum(terms(text).values()) for _, text in TEMPLATES)
        self.vectors: dict[str, np.ndarray] = {}
        by: list[list[tuple[float, str]]] = [[] for _ in TEMPLATES]
        for k, _, t, w in weights:
            self.vectors.setdefault(t, np.zeros(len(TEMPLATES)))[k] = w
            by[k].append((w, t))
        self.telling = set()
        for one in by:
            left = 1 - threshold**2 + 1e-9
            for w, t in sorted(one, reverse=True):
                self.telling.add(t)
                left -= w * w
                if left < 0:
                    break

    def own(self, text: str) -> tuple[str, float, int] | None:
        """(licence, cosine, characters of its passages), or None."""
        spdx = _SPDX.search(text)
        if not spdx and not self.within_reach(set(re.split(_SPLIT, text.lower()))):
            return None
        units = _PASSAGES.split(text)
        bags = [terms(u) for u in units]
        near = [k for k, bag in enumerate(bags) if not self.telling.isdisjoint(bag)]
        found: list[tuple[float, str, int, int]] = []
        sizes = [sum(bag.values()) for bag in bags]
        starts = set()
        for k in near:
            if not self.within_reach(self._around(bags, sizes, k)):
                continue
            first, n = k, sizes[k]
            while first >= 0 and (first == k or n <= self.most):
                starts.add(first)
                first -= 1
                n += sizes[first] if first >= 0 else 0
        for first in sorted(starts):
            if bags[first]:
                self._windows(bags, sizes, first, found)
        if spdx:
            name = re.sub(r"(-only|-or-later|\+)$", "", spdx[1])
            return name, 1.0, self._size(units, self._spans(found, name))
        if not found:
            return None
        score, name, _, _ = min(found, key=lambda f: (f[1] == "Proprietary", -f[0], f[1], f[2], f[3]))
        return name, score, self._size(units, self._spans(found, name))

    def within_reach(self, have: set[str]) -> bool:
        """Whether a passage of such terms alone can reach the threshold for a template: by Cauchy-Schwarz its cosine is at most
        the length of the template's part that it shares."""
        shared = [self.vectors[t] for t in have if t in self.vectors]
        return bool(shared) and bool((np.square(shared).sum(axis=0) >= self.threshold**2 - 1e-9).any())

    def _around(self, bags: list[Counter], sizes: list[int], k: int) -> set[str]:
        """The terms of all windows that hold unit k."""
        have = set(bags[k])
        for step in (-1, 1):
            at, n = k + step, sizes[k]
            while 0 <= at < len(bags) and (n := n + sizes[at]) <= self.most:
                have |= bags[at].keys()
                at += step
        return have

    @staticmethod
    def _size(units: list[str], spans: list[tuple[int, int]]) -> int:
        counted = [len(units[k]) for a, b in spans for k in range(a, b) if not _COMMENT.match(units[k])]
        return sum(counted) + max(len(counted) - 1, 0)

    @staticmethod
    def _spans(found: list[tuple[float, str, int, int]], name: str) -> list[tuple[int, int]]:
        """Disjoint spans of units that the passages of a licence cover."""
        out: list[tuple[int, int]] = []
        for a, b in sorted((a, b) for _, n, a, b in found if n == name):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def _windows(self, bags: list[Counter], sizes: list[int], first: int, found: list[tuple[float, str, int, int]]) -> None:
        held: dict[str, int] = {}
        square, length, dots = 0.0, 0, np.zeros(len(self.names))
        for last in range(first, len(bags)):
            length += sizes[last]
            if last > first and length > self.most:
                return
            for t, n in bags[last].items():
                before = held.get(t, 0)
                held[t] = before + n
                idf = self.idf.get(t, self.rest)
                square += idf * idf * n * (n + 2 * before)
                if t in self.vectors:
                    dots += idf * n * self.vectors[t]
            if not bags[last]:
                continue
            scores = dots / math.sqrt(square)
            for k in np.flatnonzero(scores >= self.threshold - 1e-9):
                if (score := round(float(scores[k]), 9)) >= self.threshold:
                    found.append((score, self.names[k], first, last + 1))


def template_weights(frequency: dict[str, int], files: int) -> list[tuple[int, str, str, float]]:
    """(template number, licence, term, weight): TF-IDF vectors of unit length."""
    out = []
    for k, (licence, text) in enumerate(TEMPLATES):
        weight = {t: n * math.log((1 + files) / (1 + frequency.get(t, 0)) * math.e) for t, n in terms(text).items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        out += [(k, licence, t, w / norm) for t, w in weight.items()]
    return out


def parent(path: Column) -> Column:
    """The directory of a path; empty for the root."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def own_licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, score, size): the best passage of each file that has one of ``threshold`` or more; size: characters of all of that licence's, comments left out."""
    spark = files.sparkSession
    vocabulary = sorted({t for _, text in TEMPLATES for t in terms(text)})
    words = F.array_intersect(F.split(F.lower("text"), _SPLIT), F.array(*map(F.lit, vocabulary)))
    frequency = {r.term: r["count"] for r in files.select(F.explode(words).alias("term")).groupBy("term").count().collect()}  # one row a template term
    n = files.count()
    idf = {t: math.log((1 + n) / (1 + frequency.get(t, 0)) * math.e) for t in vocabulary}
    sent = spark.sparkContext.broadcast(Scanner(template_weights(frequency, n), idf, math.log((1 + n) / 2 * math.e), threshold))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(i, *own) for i, text in zip(batch.column("doc_id").to_pylist(), texts(batch)) if (own := sent.value.own(text))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.string(), pa.float64(), pa.int64()))], ["doc_id", "licence", "score", "size"])

    return files.select("doc_id", "text").mapInArrow(task, "doc_id long, licence string, score double, size long")


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, licence, via, score, directory) of each file. ``files``: doc_id, path, text. via: header, licence file,
    inherited, or null without a licence; directory: where an inherited licence comes from."""
    files = keyed(files, "doc_id", path="string", text="string").withColumn("path", F.coalesce("path", F.lit("")))
    own = fixed(own_licences(files.select("doc_id", "text"), threshold))
    placed = files.select("doc_id", "path", F.coalesce(F.char_length("text"), F.lit(0)).alias("whole"), parent(F.col("path")).alias("directory"))
    marked = placed.join(own, "doc_id", "left").withColumn("file", F.coalesce((F.col("size") >= MOSTLY * F.col("whole")) | (F.col("licence").isNotNull() & F.col("path").rlike(_NAMED)), F.lit(False)))
    marked = fixed(marked)
    given = marked.where("file").groupBy("directory").agg(F.min_by("licence", F.struct(-F.col("score"), F.col("licence"))).alias("given"))
    directories = marked.select("directory").distinct()
    parts = F.split("directory", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    steps = directories.select("directory", F.posexplode(above).alias("depth", "ancestor"))
    nearest = steps.join(given.withColumnRenamed("directory", "ancestor"), "ancestor").groupBy("directory").agg(F.max_by(F.struct("given", "ancestor"), "depth").alias("up"))
    out = marked.join(nearest, "directory", "left")
    via = F.when(F.col("file"), "licence file").when(F.col("licence").isNotNull(), "header").when(F.col("up").isNotNull(), "inherited")
    return out.select("doc_id", "path", F.coalesce("licence", "up.given").alias("licence"), via.alias("via"), "score", F.when(F.col("licence").isNull(), F.col("up.ancestor")).alias("directory"))
