"""License scans: headers and licence files by sparse TF-IDF cosine, then inheritance along directories.

A header is a window of consecutive words, over line breaks, as long as a template: every window
of every text is compared with the notice templates, so neither wrapped notices nor words before and
after them matter. Words are weighted by inverse line frequency, counted over all lines of all files.
A window without any of a template's heavy words cannot reach the threshold: the rest of the
template's weight alone gives a smaller cosine. So texts without heavy words are skipped, and the
others are screened by sliding sums, which bound a window's cosine from above.

A licence file is one whose whole text has the cosine ``FILE_COSINE`` or more with a full text or
notice of a license; it speaks for its directory. A file without a license of its own inherits
that of its nearest ancestor directory: directories are few, so each gets its nearest licensed
ancestor by a join on ancestor paths first, and files join their directory.

Defined results: NULL and empty texts have no license of their own; a NULL path is in no
directory; of several notices in a file the one with the most matched weight (cosine times the
template's length as a vector) counts, ties to the earlier template and window; of several licence
files in a directory the one with the greatest cosine, ties to the smallest path; repeated rows give
a row each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_words, slices, stage, text_or_empty

MIN_COSINE = 0.8
FILE_COSINE = 0.7

#: License names and the notices that announce them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("Proprietary", "All rights reserved"),
]

#: Whole texts, as licence files and long headers hold them.
FULL_TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE."""),
    ("BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
        PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
        NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License along
        with this program. If not, see https://www.gnu.org/licenses/"""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
]


class Matcher:
    """Template vectors under given line frequencies."""

    def __init__(
        self, templates: list[tuple[str, str]], frequency: dict[bytes, int], lines: int,
        full: list[tuple[str, str]] = (),
    ) -> None:
        self.names = [name for name, _ in templates]
        texts = [plain_words(text) for _, text in templates]
        others = [plain_words(text) for _, text in full]
        self.index = {w: i for i, w in enumerate(sorted(set().union(*texts, *others)))}
        idf = [math.log((lines + 1) / (frequency.get(w, 0) + 1)) + 0.01 for w in self.index]
        #: Weights of template words; the last is that of all other words.
        self.idf = np.array([*idf, math.log(lines + 1) + 0.01])
        self.lengths = [len(t) for t in texts]
        self.vectors, self.norms, self.heavy = [], [], []
        for words in texts:
            vector, norm = self._unit(words)
            self.vectors.append(vector)
            self.norms.append(norm)
            rest, heavy = 1.0, []
            for i in np.lexsort((np.arange(len(vector)), -vector)).tolist():
                if rest < MIN_COSINE**2:
                    break
                heavy.append(i)
                rest -= vector[i] ** 2
            self.heavy.append(np.array(heavy))
        self.any_heavy = set(np.concatenate(self.heavy).tolist())
        self.files = [(n, v) for n, v in zip(self.names, self.vectors, strict=True)]
        self.files += [(name, self._unit(words)[0]) for (name, _), words in zip(full, others, strict=True)]

    def _unit(self, words: list[bytes]) -> tuple[np.ndarray, float]:
        vector = np.zeros(len(self.idf))
        for w, c in Counter(words).items():
            vector[self.index[w]] = c * self.idf[self.index[w]]
        norm = float(np.sqrt((vector**2).sum()))
        return vector / norm, norm

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Places of words among the template words; others have the last place."""
        return np.fromiter((self.index.get(w, len(self.index)) for w in words), np.int64, len(words))

    def cosine(self, words: list[bytes], ids: np.ndarray, template: np.ndarray) -> float:
        """Cosine of a text's own vector, every other word being a word of its own."""
        square = dot = 0.0
        for w, c in Counter(words).items():
            i = self.index.get(w, len(self.index))
            x = c * self.idf[i]
            square += x * x
            dot += x * template[i]
        return min(1.0, float(dot / math.sqrt(square))) if square else 0.0

    def windows(self, words: list[bytes], ids: np.ndarray) -> list[tuple[int, int, float]]:
        """(template, first word, cosine) of each template's nearest window that is near enough."""
        found = []
        present = set(np.unique(ids).tolist())
        if self.any_heavy.isdisjoint(present):
            return found
        weight = self.idf[ids]
        square = np.concatenate([[0.0], np.cumsum(weight * weight)])
        n = len(ids)
        for t, (length, heavy) in enumerate(zip(self.lengths, self.heavy, strict=True)):
            if present.isdisjoint(heavy.tolist()):
                continue
            dots = np.concatenate([[0.0], np.cumsum(weight * self.vectors[t][ids])])
            # Windows that begin before the text or end after it are shorter.
            start = np.arange(1 - length, n)
            first, last = np.maximum(start, 0), np.minimum(start + length, n)
            # Repeated words make the true length greater, so this is an upper bound.
            bound = (dots[last] - dots[first]) / np.sqrt(np.maximum(square[last] - square[first], 1e-300))
            best = None
            for at in np.flatnonzero(bound >= MIN_COSINE - 1e-9):
                if best is not None and bound[at] <= best[1]:
                    continue
                part = slice(first[at], last[at])
                value = self.cosine(words[part], ids[part], self.vectors[t])
                if value >= MIN_COSINE and (best is None or value > best[1]):
                    best = (int(first[at]), value)
            if best:
                found.append((t, *best))
        return found

    def file(self, words: list[bytes], ids: np.ndarray) -> tuple[str, float]:
        """The license whose full text or notice is nearest to a whole text."""
        values = [(self.cosine(words, ids, v), -k, name) for k, (name, v) in enumerate(self.files)]
        best = max(values)
        return best[2], best[0]


def _count(words: set[bytes]):
    """Lines per template word, and at NULL all lines; one set of rows per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lines = Counter(), 0
        for whole in batches:
            for batch in slices(whole):
                for text in batch.column(0).to_pylist():
                    for line in text.split("\n"):
                        lines += 1
                        counts.update(words.intersection(plain_words(line)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *counts], pa.binary()), pa.array([lines, *counts.values()], pa.int64())],
            ["word", "n"],
        )

    return run


def _scan(templates, full, frequency: dict[bytes, int], lines: int):
    def one(matcher: Matcher, text: str) -> tuple:
        words, starts = [], []
        for line in text.split("\n"):
            starts.append(len(words))
            words += plain_words(line)
        ids = matcher.ids(words)
        found = matcher.windows(words, ids)
        if not found:
            return None, None, None, 0.0
        t, first, cosine = max(found, key=lambda f: (f[2] * matcher.norms[f[0]], -f[0], -f[1]))
        name, whole = matcher.file(words, ids)
        own, speaks = matcher.names[t], whole >= FILE_COSINE
        return (
            name if speaks else own, cosine, int(np.searchsorted(starts, first, side="right")) - 1,
            whole,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, frequency, lines, full)
        for whole in batches:
            for batch in slices(whole):
                rows = [one(matcher, t) for t in batch.column(2).to_pylist()]
                own = [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.string(), pa.float64(), pa.int32(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *own],
                    ["id", "path", "own_license", "cosine", "line", "file_cosine"],
                )

    return run


def scan(
    files: DataFrame, key: str, path: Column, text: str = "text", templates=TEMPLATES, full=FULL_TEXTS
) -> DataFrame:
    """(id, path, own_license, cosine, line, file_cosine), one row per file.

    ``cosine`` is that of the nearest header, ``file_cosine`` that of the whole text.
    """
    rows = files.select(F.col(key).alias("id"), path.cast("string").alias("path"), text_or_empty(text).alias("text"))
    words = set().union(*(plain_words(t) for _, t in [*templates, *full]))
    counted = rows.select("text").mapInArrow(_count(words), "word binary, n long")
    # At most one row per template word.
    counts = {
        r["word"] if r["word"] is None else bytes(r["word"]): r["n"]
        for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    }
    lines = counts.pop(None, 0) or 0
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(
        _scan(templates, full, counts, lines),
        f"id {kind}, path string, own_license string, cosine double, line int, file_cosine double",
    )


def directory(path: Column) -> Column:
    """Directory of a path; the empty string is the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds license, origin (own, inherited or none) and the directory it comes from."""
    files = stage(scanned.withColumn("dir", directory(F.col("path"))), "scanned")
    licensed = files.filter(
        F.col("own_license").isNotNull() & F.col("dir").isNotNull() & (F.col("file_cosine") >= FILE_COSINE)
    ).groupBy("dir").agg(
        F.min_by("own_license", F.struct(-F.col("file_cosine"), "path", "own_license")).alias("dir_license")
    )
    # Every directory with all its ancestors, nearest first by length.
    dirs = files.filter(F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = dirs.select(
        "dir",
        F.explode(
            F.concat(
                F.array(F.lit("")),
                F.transform(
                    F.sequence(F.lit(1), F.size(parts)),
                    lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
                ),
            )
        ).alias("ancestor"),
    ).distinct()
    nearest = ancestors.join(
        licensed.select(F.col("dir").alias("ancestor"), "dir_license"), "ancestor"
    ).groupBy("dir").agg(
        F.max_by(F.struct("ancestor", "dir_license"), F.length("ancestor")).alias("near")
    )
    own = F.col("own_license").isNotNull()
    return files.join(nearest, "dir", "left").select(
        "id", "path", F.coalesce("own_license", "near.dir_license").alias("license"),
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("near.ancestor")).alias("from_dir"), "cosine", "line", "file_cosine",
    )
