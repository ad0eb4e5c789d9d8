"""License notices in documents.

Every template's word k-grams are winnowed: of each window of neighbouring k-grams the one with the
least hash is kept. The kept ones form an inverted index, which all k-grams of a document are looked
up in. e edits leave some (m - e) / (e + 1) words of a template of m in one piece; k and the window
are chosen so that such a piece always holds a kept gram, and no notice is missed. A hit names a template and a diagonal; the whole template is then aligned word by word in a
band around it, which gives the coverage (1 - edits / words) and the span of the text it covers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelflow.llm.align import banded_edits
from kestrelflow.llm.common import WordHasher, not_letter, sequences, shared, small_batches, span_hashes, steps, utf8

#: Public license notices and texts.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "MIT-line": "Released under the MIT License.",
    "MIT-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce
        the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
        other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
        from any source distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize
        copyright laws, the author or authors of this software dedicate any and all copyright interest in the software
        to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
        heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present
        and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    "LGPL-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
        (at your option) any later version.""",
    "AGPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""",
    "GPL-warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details.""",
    "CC0-1.0-line": """To the extent possible under law, the author has waived all copyright and related or neighboring rights
        to this work.""",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


class TemplateIndex:
    """Winnowed k-grams of the templates, by k. `kept` has (k, gram) -> postings as sorted arrays for each k."""

    def __init__(self, templates: Mapping[str, str], most_k: int = 3, coverage: float = 0.8):
        hasher = WordHasher(not_letter())
        self.names, words = sorted(templates), []
        found: dict[int, list[tuple]] = {}
        for n, name in enumerate(self.names):
            data = np.frombuffer(templates[name].encode(), np.uint8)
            own, _, first = hasher.words(data, np.array([0, len(data)]))
            words.append(own)
            edits = int(len(own) * (1 - coverage) + 1e-9)
            piece = min(most_k + 1, -(-(len(own) - edits) // (edits + 1)))  # words that stay together for sure
            k = min(most_k, piece)
            if k < 1:
                continue
            window, runs = piece - k + 1, sequences(own, first, k)[0]
            kept = {int(i + np.argmin(runs[i : i + window])) for i in range(max(1, len(runs) - window + 1))}
            found.setdefault(k, []).extend((runs[i], n, i) for i in kept)
        self.size = np.array([len(w) for w in words], np.int64)
        self.first = np.append(0, np.cumsum(self.size))
        self.words = np.concatenate([*words, np.zeros(1, np.uint64)])
        self.edits = (self.size * (1 - coverage) + 1e-9).astype(np.int64)
        self.kept = {}
        for k, entries in sorted(found.items()):
            every, owner, at = (np.array(x, t) for x, t in zip(zip(*sorted(entries), strict=True), (np.uint64, np.int64, np.int64), strict=True))
            gram, start = np.unique(every, return_index=True)
            self.kept[k] = gram, np.append(start, len(every)), owner, at

    def candidates(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (text, template, diagonal) of all kept grams in the texts."""
        found = [np.zeros((0, 3), np.int64)]
        for k, (gram, posting, owner, at) in self.kept.items():
            runs, begin = sequences(words, first, k)
            place = np.minimum(np.searchsorted(gram, runs), len(gram) - 1)
            hit = np.flatnonzero(gram[place] == runs)
            row = np.searchsorted(begin, hit, "right") - 1
            place, position = place[hit], hit - begin[row]
            times = posting[place + 1] - posting[place]
            which = np.repeat(np.arange(len(hit)), times)
            entry = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(posting[place], times)
            found.append(np.unique(np.stack([row[which], owner[entry], position[which] - at[entry]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def scan(self, data: np.ndarray, offsets: np.ndarray, hasher: WordHasher):
        """(row, template, edits, start, end) of each notice, start and end in bytes from the text's first."""
        starts, lengths, first = hasher.spans(data, offsets)
        words = span_hashes(hasher.folded[data], starts, lengths)
        row, item, diagonal = self.candidates(words, first).T
        k = self.edits[item]
        edits, start, end = banded_edits(words, first, row, diagonal - k, 2 * k + 1, self.words, self.first[item], self.size[item])
        good = np.flatnonzero(edits <= k)
        row, item, edits, start, end = (x[good] for x in (row, item, edits, start, end))
        kept = apart(row * len(self.names) + item, edits, start, end)
        row, item, edits, start, end = (x[kept] for x in (row, item, edits, start, end))
        last = first[row] + np.maximum(end, start + 1) - 1
        left, right = starts[first[row] + start], starts[last] + lengths[last]
        return row, item, edits, left - offsets[row], right - offsets[row]


def apart(group: np.ndarray, edits: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places of the spans that stay, where a span gives way to overlapping ones of its group with fewer edits (or before it)."""
    taken: dict[int, list[tuple[int, int]]] = {}
    kept = []
    for r in np.lexsort((end, start, edits, group)).tolist():
        spans, own = taken.setdefault(int(group[r]), []), (int(start[r]), int(end[r]))
        at = bisect_left(spans, own)
        if (at == 0 or spans[at - 1][1] <= own[0]) and (at == len(spans) or own[1] <= spans[at][0]):
            spans.insert(at, own)  # the spans of a group never overlap, so its neighbours tell
            kept.append(r)
    kept = np.array(kept, np.int64)
    return kept[np.lexsort((start[kept], group[kept]))]


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """(doc_id, license, words, edits, coverage, start, end): each notice that covers enough of a template.

    Words are runs of letters and digits, A-Z as a-z. start and end are characters of the text.
    Several places of one template are several rows; overlapping ones count once, by fewest edits. A
    null text has no notice. All rows of docs are scanned whole, repeated rows each; doc_id may be
    null, other columns are ignored. The index holds the given templates only and is broadcast.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    index = shared(docs.sparkSession, TemplateIndex(templates, coverage=coverage))

    def run(batches):
        own, hasher = index(), WordHasher(not_letter())
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in steps(offsets):
                piece, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                row, item, edits, start, end = own.scan(piece, at, hasher)
                lead = np.append(0, np.cumsum((piece & 0xC0) != 0x80))
                start, end = (lead[at[row] + x] - lead[at[row]] for x in (start, end))
                size = own.size[item]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row + i)), pa.array([own.names[x] for x in item], pa.string()), pa.array(size),
                     pa.array(edits), pa.array(1 - edits / np.maximum(size, 1)), pa.array(start), pa.array(end)],
                    ["doc_id", "license", "words", "edits", "coverage", "start", "end"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).mapInArrow(run, f"doc_id {kind}, license string, words long, edits long, coverage double, start long, end long")
