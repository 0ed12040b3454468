"""Licence scan: a trained passage classifier, confirmed by comparison with templates (operator 3).

Texts are cut into passages at sentence ends and blank lines; a line end alone cuts nothing, as notices
are wrapped. A passage is looked at whole, if it isn't over LONG words, and in overlapping windows of the
sizes in SCALES; windows of one family that touch are one finding. Only windows that hold a 2-gram of some
template are judged, as no other could be confirmed. A softmax regression over sparse word 1- and 2-grams
gives each window a family or `unknown`. It is trained in the driver on the templates below, with
words dropped, changed and added, against ordinary passages. Its probabilities are calibrated by a
temperature that is fitted out of fold, on templates whose copies the fold's model hasn't seen. A family
is reported if its probability reaches ACCEPT, a template of it shares enough of its word 2-grams with
the window, and no other family's template shares more; a template of few words must be there in full, and one of two words asks for more probability.

Words are hashed on the UTF-8 bytes of a whole slice of texts; only hashes of the vocabulary are
looked at one by one.

Edge cases: null and empty texts have no passages; a text without sentence ends is one passage, however
long, in many windows; equal texts give equal rows; of families that are equally likely the first in
order is taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import arrays

UNKNOWN = "unknown"
ACCEPT, SIMILAR = 0.4, 0.6
#: The probability that a template of one 2-gram asks for, as two words may stand side by side by chance.
SURE = 0.9
#: 2-grams that a similarity is taken of at least, so that a few common words are no licence.
LEAST_GRAMS = 4
#: Words of a passage that is looked at whole; sizes of windows, words between their starts, and words that a passage must exceed.
LONG = 64
SCALES = ((48, 16, 64), (12, 4, 16), (5, 2, 8))
FOLDS = 3

# Public licence notices and characteristic sentences, by family.
TEMPLATES = {
    "apache": ("Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.", "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions.", "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License.", "This project is released under the Apache 2.0 license.", "Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "License: Apache-2.0"),
    "mit": ("The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.", "Released under the MIT License.", "Licensed under the MIT license.", "This software is distributed under the terms of the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "MIT License", "License: MIT", "SPDX-License-Identifier: MIT", "The MIT License (MIT)"),
    "bsd": ("This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.", "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages, including, but not limited to, procurement of substitute goods or services, loss of use, data, or profits, or business interruption, however caused and on any theory of liability.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Use of this source code is governed by a BSD-style license.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "License: BSD-3-Clause"),
    "gpl": ("The GNU General Public License is a free, copyleft license for software and other kinds of works.", "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice.", "SPDX-License-Identifier: GPL-2.0-or-later", "License: GPL-2.0", "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "Licensed under the GPL version 2 or later.", "Released under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later", "License: GPL-3.0"),
    "lgpl": ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.", "SPDX-License-Identifier: LGPL-3.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 2.1.", "You should have received a copy of the GNU Lesser General Public License along with this library.", "Released under the LGPL version 3.", "SPDX-License-Identifier: LGPL-2.1"),
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "Licensed under the AGPL version 3.", "SPDX-License-Identifier: AGPL-3.0"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "License: MPL-2.0"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Published under the Creative Commons Attribution license."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Published under the Creative Commons Attribution-NoDerivatives license."),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Published under the Creative Commons Attribution-NonCommercial-NoDerivatives license."),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Published under the Creative Commons Attribution-NonCommercial-ShareAlike license."),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.", "Licensed under the Eclipse Public License, version 1.0.", "The accompanying program is provided under the terms of this Eclipse Public License.", "SPDX-License-Identifier: EPL-2.0", "License: EPL-2.0"),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "Licensed under the zlib License.", "SPDX-License-Identifier: Zlib"),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.", "SPDX-License-Identifier: BSL-1.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Free for non-commercial use under CC BY-NC 4.0."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.", "This work is dedicated to the public domain under CC0.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "proprietary": ("All rights reserved; no part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.", "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.", "Copyright the company, all rights reserved.", "All rights reserved."),
}
ORDINARY = (
    "The driver renewed her license at the office on Monday.", "A fishing licence costs ten pounds a year.", "The committee granted permission to build on the land.", "He was free to copy the notes from the board.", "The general public was not admitted to the hearing.", "Version 3 of the plan was published last week.",
    "The software crashed twice during the demonstration.", "Its distribution across the region is uneven.", "The warranty on the car ends in May.", "They worked under the terms of an old agreement.", "A copy of the letter is kept in the archive.", "The following conditions were met by the end of the year.",
    "We can use this file for the next meeting.", "The creative arts were common in the town.", "The foundation published its report on free schools.", "Source and binary stars were observed with the telescope.", "In compliance with the law, the shop closed at noon.", "The name of the holder was not on the card.", "Public transport is free on Sundays.", "The patient gave written permission before the operation.",
    "the of and in to a is was on it for", "of the on and in or the", "4.0 and 2.0 are both numbers", "by and under the in of", "She bought bread, milk and eggs at the market.", "It rained all day and the river rose.", "The library opens at nine and closes at six.", "Attribution of the painting to the master is doubtful.", "The MIT campus lies on the river.", "Apache helicopters flew over the valley.", "The mozilla was a monster in the film.", "The affected rights of workers were discussed.",
)

STRIP = np.zeros(256, bool)
STRIP[list(b".,;:!?()\"'[]")] = True
ENDS = np.zeros(256, bool)
ENDS[list(b".!?")] = True


def _passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word start, word end, document, passage) of every word, and its two-gram-ready hash."""
    start, end, doc = arrays.words(data, off)
    if not len(start):
        return start, end, doc, start, np.zeros(0, np.uint64)
    newline = np.concatenate([[0], np.cumsum(data == ord("\n"))])
    cut = np.ones(len(start), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (newline[start[1:]] > newline[end[:-1]] + 1) | ENDS[data[end[:-1] - 1]]
    a, b = start.copy(), end.copy()
    for _ in range(4):
        b -= (b - a > 1) & STRIP[data[b - 1]]
        a += (b - a > 1) & STRIP[data[a]]
    return start, end, doc, np.cumsum(cut) - 1, arrays.word_hashes(arrays.LOWER[data], a, b)


def _bigrams(word: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, passage) of neighbouring words of one passage."""
    same = np.flatnonzero(passage[1:] == passage[:-1])
    return arrays.mix(word[same] * arrays.BASES[0] + word[same + 1]), passage[same]


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, 2-gram hashes) of a text taken as one passage."""
    data, off = arrays.utf8(pa.array([text]))
    *_, word = _passages(data, off)
    return word, _bigrams(word, np.zeros(len(word), np.int64))[0]


def windows(passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, one past the last) of each window, in order."""
    first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(passage)))
    begins, stops = [first[size <= LONG]], [(first + size)[size <= LONG]]
    for width, step, over in SCALES:
        count = np.where(size > over, -(-(size - width) // step) + 1, 0)
        begin = np.repeat(first, count) + step * arrays.spread(np.zeros(len(first), np.int64), count)
        begins.append(begin)
        stops.append(np.minimum(begin + width, np.repeat(first + size, count)))
    begin, stop = np.concatenate(begins), np.concatenate(stops)
    order = np.lexsort((-stop, begin))
    return begin[order], stop[order]


class Scanner:
    """The trained classifier and the templates' 2-grams."""

    def __init__(self, seed: int = 3, copies: int = 8, rounds: int = 150) -> None:
        rng = random.Random(seed)
        self.families = [UNKNOWN, *TEMPLATES]
        ordinary = [w for t in ORDINARY for w in t.split()]
        rows: list[tuple[str, int, int]] = []  # text, family, fold: all copies of a template are of one fold
        for y, family in enumerate(self.families):
            for place, t in enumerate(ORDINARY if y == 0 else TEMPLATES[family]):
                rows.append((t, y, place % FOLDS))
                for _ in range(copies):
                    w = [x for x in t.split() if rng.random() > 0.08]
                    for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
                        w.insert(rng.choice((0, len(w))), rng.choice(ordinary))
                    rows.append((" ".join(w), y, place % FOLDS))
        for place, t in enumerate(t for ts in TEMPLATES.values() for t in ts):  # loose words of a licence are no licence
            w = t.split()
            rows.append((" ".join(rng.sample(w, max(1, len(w) // 4)) + rng.sample(ordinary, 8)), 0, place % FOLDS))
        hashed = [np.concatenate(_hashed(t)) for t, _, _ in rows]
        of_templates = [np.concatenate(_hashed(t)) for ts in (*TEMPLATES.values(), ORDINARY) for t in ts]
        self.vocabulary = np.unique(np.concatenate(of_templates))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        x = np.zeros((len(rows), len(self.vocabulary) + 2), np.float32)  # a fixed number of rows
        for i, h in enumerate(hashed):
            at = self.place(h)
            known = at[at >= 0]
            np.add.at(x[i], known, 1.0)
            x[i, -2:] = self.dense(np.array([len(known)]), np.array([len(h)]))[0]
            x[i, :-2] /= np.sqrt(max(1, len(h)))
        y, fold = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        logits = np.zeros((len(rows), len(self.families)))
        for f in range(FOLDS):
            logits[fold == f] = x[fold == f] @ self.fit(x[fold != f], y[fold != f], rounds)
        scale = np.geomspace(0.1, 4, 49)
        loss = [-np.log(self._softmax(logits * s)[np.arange(len(y)), y] + 1e-12).mean() for s in scale]
        self.scale = float(scale[int(np.argmin(loss))])
        self.held_accuracy = float((logits.argmax(1) == y).mean())
        self.weight = self.fit(x, y, rounds)
        self.templates = {f: [np.unique(_hashed(t)[1]) for t in ts] for f, ts in TEMPLATES.items()}
        self.telling = np.zeros(len(self.vocabulary), bool)  # 2-grams of templates
        self.telling[self.place(np.unique(np.concatenate([t for ts in self.templates.values() for t in ts])))] = True

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int) -> np.ndarray:
        """Weights of a softmax regression, by gradient ascent with momentum."""
        gold = np.eye(len(self.families), dtype=np.float32)[y]
        weight, moment = np.zeros((x.shape[1], gold.shape[1]), np.float32), np.float32(0)
        for _ in range(rounds):
            moment = 0.9 * moment + x.T @ (gold - self._softmax(x @ weight)) / len(x) - 1e-4 * weight
            weight = weight + 2.0 * moment
        return weight

    def place(self, h: np.ndarray) -> np.ndarray:
        """Each hash's place in the vocabulary, or -1."""
        out = np.full(len(h), -1, np.int64)
        likely = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[likely]), len(self.vocabulary) - 1)
        ok = self.vocabulary[at] == h[likely]
        out[likely[ok]] = at[ok]
        return out

    @staticmethod
    def dense(known: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.stack([known / np.maximum(1, total), np.ones(len(total))], 1)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def similarity(self, family: str, grams: np.ndarray, sure: float = 1.0) -> float:
        """The largest share of the shorter's 2-grams that a template of the family has in common with a window of the family's probability `sure`."""
        grams, out = np.unique(grams), 0.0
        for t in self.templates[family]:
            if len(t) == 1 and sure < SURE:
                continue
            shared = len(np.intersect1d(grams, t, assume_unique=True))
            out = max(out, float(shared == len(t)) if len(t) < LEAST_GRAMS else shared / max(LEAST_GRAMS, min(len(grams), len(t))))
        return out

    def contradicted(self, family: str, near: float, grams: np.ndarray) -> bool:
        """Whether a template of another family fits better, as a licence's name often stands within another's."""
        return any(self.similarity(f, grams, 0.0) > near for f in self.families[1:] if f != family)

    def scan(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[int, str, int, int, float, float]]]:
        """(passages of each document, findings: document, family, start, end in bytes, probability, similarity)."""
        start, end, doc, passage, word = _passages(data, off)
        docs = len(off) - 1
        if not len(word):
            return np.zeros(docs, np.int64), []
        opens = np.concatenate([[True], passage[1:] != passage[:-1]])
        per_doc = np.bincount(doc[opens], minlength=docs)
        same = np.append(passage[1:] == passage[:-1], False)
        two = np.zeros(len(word), np.uint64)
        two[:-1] = arrays.mix(word[:-1] * arrays.BASES[0] + word[1:])
        at_two = np.where(same, self.place(two), -1)
        hit = np.flatnonzero((at_two >= 0) & self.telling[at_two])
        begin, stop = windows(passage)
        some = np.searchsorted(hit, begin) < np.searchsorted(hit, stop - 1)
        begin, stop = begin[some], stop[some]
        if not len(begin):
            return per_doc, []
        grams = 2 * (stop - begin) - 1
        known, logits = np.zeros(len(begin), np.int64), np.zeros((len(begin), len(self.families)))
        for at, last in ((self.place(word), 0), (at_two, 1)):  # words, then 2-grams, which need the next word too
            hit = np.flatnonzero(at >= 0)
            lo, hi = np.searchsorted(hit, begin), np.searchsorted(hit, stop - last)
            count = np.maximum(0, hi - lo)
            of = np.repeat(np.arange(len(begin)), count)
            np.add.at(logits, of, self.weight[at[hit[arrays.spread(lo, count)]]] / np.sqrt(grams[of])[:, None])
            known += count
        p = self._softmax((logits + self.dense(known, grams) @ self.weight[-2:]) * self.scale)
        best = p[:, 1:].argmax(1) + 1
        out: list[tuple[int, str, int, int, float, float]] = []
        before = (-1, "")
        for i in np.flatnonzero(p[np.arange(len(begin)), best] >= ACCEPT).tolist():
            a, b = int(begin[i]), int(stop[i])
            family, sure = self.families[best[i]], float(p[i, best[i]])
            own = two[a:b][same[a:b]][: b - a - 1]
            near = self.similarity(family, own, sure)
            if near >= SIMILAR and not self.contradicted(family, near, own):
                if before == (int(passage[a]), family) and start[a] <= out[-1][3]:  # a window that touches the last
                    d, f, s, e, q, m = out[-1]
                    out[-1] = d, f, s, max(e, int(end[b - 1])), max(q, sure), max(m, near)
                else:
                    out.append((int(doc[a]), family, int(start[a]), int(end[b - 1]), sure, near))
                before = (int(passage[a]), family)
        return per_doc, _outermost(out)


def _outermost(found: list[tuple[int, str, int, int, float, float]]) -> list[tuple[int, str, int, int, float, float]]:
    """Findings but those that overlap a likelier one of another family that fits as well: a licence's name within another's."""
    of: dict[int, list] = {}
    for x in found:
        of.setdefault(x[0], []).append(x)
    within = lambda x, y: y[1] != x[1] and y[2] < x[3] and x[2] < y[3] and y[4] > x[4] and y[5] >= x[5]
    return [x for x in found if not any(within(x, y) for y in of[x[0]])]


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_passages, found: array of (family, start, end in code points, probability, similarity)."""
    scanner = scanner or Scanner()
    kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.sliced(batches):
            data, off = arrays.utf8(batch.column("text"))
            count, found = scanner.scan(data, off)
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for d, family, s, e, p, near in found:
                lo = int(off[d])
                points = lambda q: int(((data[lo:q] & 0xC0) != 0x80).sum())  # noqa: E731, B023
                rows[d].append({"family": family, "start": points(s), "end": points(e), "probability": p, "similarity": near})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(rows, kind)], ["doc_id", "n_passages", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_passages long, found array<struct<family:string,start:long,end:long,probability:double,similarity:double>>")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",")
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_passages", F.size("found").cast("long").alias("n_licences"), families.alias("families"), spans.alias("spans"))
