"""License scans by template markup.

A template is license wording with markup: ``<<opt>> ... <</opt>>`` around words that may be left out (they may hold
others), and ``<<var m-n>>`` for m to n words of any kind. It compiles to an automaton over words; a place in a text is
accepted when the mandatory wording matches exactly, word by word. The longest accepted span at a start counts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WORD_BYTES


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    base: bool = False


#: Whole licenses and notices in their public wording, with what may differ marked; fixed values.
AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement in no event shall the <<var 1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
    "connection with the software or the use or other dealings in the software"
)
WHOLE = (
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>>the software<</opt>> to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in "
        "all copies or substantial portions of the software " + AS_IS,
    ),
    Template(
        "isc-text",
        "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and <<var 1-8>> disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall <<var 1-8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
        "profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    Template(
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<</opt>> redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<opt>><<opt>>3<</opt>> neither the name of <<var 1-12>> "
        "nor the names of <<var 1-4>> may be used to endorse or promote products derived from this software without specific prior written permission<</opt>> this software is provided by "
        "<<var 1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no "
        "event shall <<var 1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising "
        "in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    Template(
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the <<var 1-4>> be held liable for any damages arising from the use of this software permission is "
        "granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<opt>>1<</opt>> "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product "
        "documentation would be appreciated but is not required <<opt>>2<</opt>> altered source versions must be plainly marked as such and must not be misrepresented as being the original "
        "software <<opt>>3<</opt>> this notice may not be removed or altered from any source distribution",
    ),
    Template(
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a "
        "compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all "
        "copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law " + AS_IS,
    ),
    Template(
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses "
        "license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu <<opt>>lesser<</opt>> general public license as published by the free software foundation "
        "either version <<var 1-2>> of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose see the gnu <<opt>>lesser<</opt>> general public license for more details <<opt>>you should have received a copy of "
        "the gnu <<opt>>lesser<</opt>> general public license along with this program if not see <<opt>>https<</opt>> <<opt>>http<</opt>> www gnu org licenses<</opt>>",
    ),
)

TEMPLATES = (
    *WHOLE,
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("cc-by-nc-4.0", "licensed under <<opt>>the<</opt>> <<opt>>creative commons<</opt>> cc by nc 4 0 <<opt>>license<</opt>>"),
    Template("gpl-3.0", "licensed under the <<opt>>gnu<</opt>> general public license <<opt>>version<</opt>> 3 <<opt>>0<</opt>>"),
    Template("apache-2.0", "licensed under the apache license <<opt>>version<</opt>> 2 0"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("copyright", "copyright <<opt>>c<</opt>> <<var 1-8>> all rights reserved"),
    Template("spdx", "spdx license identifier <<var 1-1>>"),
    Template("gpl-2.0", "<<opt>>gnu<</opt>> general public license <<opt>>as published by the free software foundation <<opt>>either<</opt>><</opt>> version 2 <<opt>>of the license <<opt>>or at your option any later version<</opt>><</opt>>"),
    Template("lgpl", "gnu <<var 1-1>> general public license <<opt>>as published by the free software foundation<</opt>>"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license <<opt>>v<</opt>> <<opt>>version<</opt>> 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("warranty", "the software is provided as is without warranty of any kind <<opt>>express or implied<</opt>>"),
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters and digits and of all beyond ASCII."""
    return (text or b"").translate(WORD_BYTES).split()


class TokenAutomaton:
    """States 0..n over template elements; an element is a word, or None for any word. Longer texts cost each start
    no more than the template's own length."""

    def __init__(self, markup: str):
        self.words: list[bytes | None] = []
        self.skips: dict[int, list[int]] = defaultdict(list)  # from an element to those one may go on at without it
        opened: list[int] = []
        for part in re.findall(r"<<.*?>>|[^\s<]+", markup):
            if part == "<<opt>>":
                opened.append(len(self.words))
            elif part == "<</opt>>":
                self.skips[opened.pop()].append(len(self.words))
            elif m := re.fullmatch(r"<<var (\d+)-(\d+)>>", part):
                low, high = map(int, m.groups())
                at, end = len(self.words), len(self.words) + high
                self.words += [None] * high
                for k in range(at + low, end):
                    self.skips[k].append(end)
            else:
                self.words.append(part.encode())
        self.n = len(self.words)
        begin = self._closed({0})
        self.first = sorted({self.words[s] for s in begin if s < self.n}, key=str)
        if opened or None in self.first or self.n in begin:
            raise ValueError(f"a template must begin with a word, and close what it opens: {markup}")

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.skips.get(todo.pop(), ()):
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def accept(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted span that starts at word ``at``; -1 if none."""
        states, best = self._closed({0}), -1
        for i in range(at, len(words)):
            w = words[i]
            states = self._closed({s + 1 for s in states if s < self.n and self.words[s] in (None, w)})
            if not states:
                break
            if self.n in states:
                best = i + 1
        return best


def scan(words: list[bytes], starts: dict[bytes, list[tuple[int, TokenAutomaton]]]) -> list[tuple[int, int, int]]:
    """(start, end, template number) of every accepted place."""
    out = []
    for i, w in enumerate(words):
        if w in starts:
            out += [(i, end, k) for k, a in starts[w] if (end := a.accept(words, i)) > 0]
    return out


REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    n_base counts all places of base templates, first_word and last_word are their least and greatest start (null
    without). labels are distinct, sorted and comma-joined. score is the share of the words inside accepted
    places. Null and empty texts have no words, score 0 and no labels. Rows are independent: nothing is shuffled,
    repeated rows give repeated rows, an empty table none, and other columns are not read.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *REPORT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = defaultdict(list)
        for k, t in enumerate(templates):
            a = TokenAutomaton(t.markup)
            for w in a.first:
                starts[w].append((k, a))
        starts = dict(starts)
        for b in batches:
            rows = []
            for text in b.column(1).cast(pa.binary()):
                words = words_of(text.as_py())
                found = scan(words, starts)
                base = [x for x in found if templates[x[2]].base]
                covered = {i for s, e, _ in found for i in range(s, e)}
                rows.append(
                    (
                        len(words),
                        len(base),
                        min((s for s, *_ in base), default=None),
                        max((s for s, *_ in base), default=None),
                        ",".join(sorted({templates[k].label for *_, k in base})),
                        ",".join(sorted({templates[k].label for *_, k in found})),
                        len(covered) / len(words) if words else 0.0,
                        [{"label": templates[k].label, "start": s, "end": e} for s, e, k in found],
                    )
                )
            if not rows:
                continue
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), ARROW)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


ARROW = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
