"""License scans by template-markup matching.

A template is wording with two marks: [[...]] may be missing, {{a-b}} stands for a to b words of any kind. It is compiled into an
automaton over words; a text is accepted where the mandatory wording stands exactly, from some word on. Automata only run where a
template's first word stands. Besides, fixed phrases are counted wherever their words stand consecutively.

Full licence texts are templates of their whole mandatory wording: a text that lacks a later condition or the disclaimer doesn't get
their label. The opening clause of such a text is a template of its own with a label of its own (``…-opening``).

Null texts are empty. A text without any match has empty label strings, null first_word and last_word, and score 0; else its score
is the highest of what it has: a phrase 0.5, an opening 0.75, a notice or a whole licence text 1. Repeated rows are scanned each;
other columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches
from .words import ALNUM, Words, blocks, words_of

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_AS_IS = "in no event shall {{1-12}} be liable for any"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution {} this software is provided by {{{{1-12}}}} as is and any express or implied "
    "warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {{{{1-12}}}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
    "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
    "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if "
    "advised of the possibility of such damage"
)

# Wording of common licence notices and texts, in lower case without marks, by label, with the score of a match.
TEMPLATES = [
    ("apache-2.0", 1.0, "licensed under [[the terms of]] the apache license [[version]] 2 0"),
    ("mit", 1.0, "[[is]] released under the mit license"),
    ("mit", 1.0, "licensed under the mit license"),
    (
        "mit-text",
        1.0,
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
        "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of "
        "the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        f"merchantability fitness for a particular purpose and noninfringement {_AS_IS} claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("mit-opening", 0.75, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {{0-3}} to deal in the software without restriction"),
    ("bsd-2-text", 1.0, _BSD.format("")),
    ("bsd-3-text", 1.0, _BSD.format("[[3]] neither the name of {{1-12}} nor the names of [[its]] contributors may be used to endorse or promote products derived from this software without specific prior written permission")),
    ("bsd-opening", 0.75, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "isc-text",
        1.0,
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and {{1-12}} disclaims all warranties with regard "
        f"to this software including all implied warranties of merchantability and fitness {_AS_IS} special direct indirect or consequential damages or "
        "any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising "
        "out of or in connection with the use or performance of this software",
    ),
    ("isc-opening", 0.75, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "apache-2.0-header",
        1.0,
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at {{1-8}} license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language "
        "governing permissions and limitations under the license",
    ),
    (
        "gpl-header",
        1.0,
        "this program is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] general public license as published by "
        "the free software foundation either version {{1-1}} of the license or [[at your option]] any later version",
    ),
    ("cc-by", 1.0, "licensed under [[a]] [[creative commons]] cc by [[license]] {{0-1}} 0"),
    ("cc-by-nc", 1.0, "licensed under [[a]] [[creative commons]] cc by nc [[license]] {{0-1}} 0"),
    ("cc-by-sa", 1.0, "licensed under [[a]] [[creative commons]] cc by sa [[license]] {{0-1}} 0"),
    ("cc-by", 1.0, "licensed under a creative commons attribution {{0-3}} license"),
    ("gpl-notice", 1.0, "licensed under [[the terms of]] the gnu [[lesser]] general public license [[as published by the free software foundation]] [[either]] version {{1-1}}"),
    ("mpl-2.0", 1.0, "subject to the terms of the mozilla public license v 2 0"),
    ("rights-notice", 1.0, "copyright {{1-8}} all rights reserved"),
]

FOUND = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double>"
_PART = re.compile(r"\[\[(.*?)\]\]|\{\{(\d+)-(\d+)\}\}|(\S+)")


class Automaton:
    """States 0..n of one template; ``steps[s]`` are (word or None for any word, next state), ``skips[s]`` need no word."""

    def __init__(self, label: str, score: float, template: str):
        self.label, self.score, self.steps, self.skips = label, score, [[]], [[]]
        for optional, least, most, word in _PART.findall(template):
            if word:
                self._word(word.encode())
            elif optional:
                before = len(self.steps) - 1
                for w in optional.split():
                    self._word(w.encode())
                self.skips[before].append(len(self.steps) - 1)
            else:
                for k in range(int(most)):
                    here = len(self.steps) - 1
                    self._word(None)
                    if k >= int(least):
                        self.skips[here].append(-1)
                end = len(self.steps) - 1
                self.skips = [[end if x == -1 else x for x in s] for s in self.skips]
        self.end = len(self.steps) - 1
        self.first = {w for s in self._closed({0}) for w, _ in self.steps[s]}
        if None in self.first or self.end in self._closed({0}):
            raise ValueError(f"template {template!r} must begin with wording")

    def _word(self, word: bytes | None) -> None:
        self.steps[-1].append((word, len(self.steps)))
        self.steps.append([])
        self.skips.append([])

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for n in self.skips[todo.pop()]:
                if n not in out:
                    out.add(n)
                    todo.append(n)
        return out

    def accepts(self, w: Words, at: int, stop: int) -> bool:
        states = self._closed({0})
        while at < stop:
            word = w.word(at)
            states = self._closed({n for s in states for x, n in self.steps[s] if x is None or x == word})
            if self.end in states:
                return True
            if not states:
                return False
            at += 1
        return False


def _hash(words: str) -> np.ndarray:
    raw = np.frombuffer(words.encode(), np.uint8)
    w = words_of(raw, np.array([0, len(raw)]), ALNUM)
    return w.windows(len(w.starts))[0] if len(w.starts) > 1 else w.hashes


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, float, str]] = TEMPLATES):
        self.phrases = [(p.split(), label, _hash(p)[0]) for p, label in phrases.items()]
        self.automata = [Automaton(*t) for t in templates]
        self.by_first: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for word in a.first:
                self.by_first.setdefault(word, []).append(a)
        self.first = np.sort(np.array([_hash(x.decode())[0] for x in self.by_first], np.uint64))

    def column(self, texts: pa.Array) -> pa.Array:
        out: list[tuple] = []
        for _, _, data, offsets in blocks(texts):
            w = words_of(data, offsets, ALNUM)
            rows, owner = len(offsets) - 1, w.owner()
            starts: list[list[int]] = [[] for _ in range(rows)]
            base: list[set[str]] = [set() for _ in range(rows)]
            more: list[dict[str, float]] = [{} for _ in range(rows)]
            windows = {}
            for phrase, label, h in self.phrases:
                n = len(phrase)
                got, whole = windows.setdefault(n, w.windows(n)) if n > 1 else (w.hashes, np.ones(len(w.starts), bool))
                for i in np.flatnonzero(whole & (got == h)).tolist():
                    if [w.word(k).decode() for k in range(i, i + n)] == phrase:
                        starts[owner[i]].append(i - int(w.first[owner[i]]))
                        base[owner[i]].add(label)
            at = np.searchsorted(self.first, w.hashes)
            for i in np.flatnonzero(self.first[np.minimum(at, len(self.first) - 1)] == w.hashes).tolist():
                row = int(owner[i])
                for a in self.by_first.get(w.word(i), ()):
                    if more[row].get(a.label, 0.0) < a.score and a.accepts(w, i, int(w.first[row + 1])):
                        more[row][a.label] = a.score
            n_words = np.diff(w.first).tolist()
            for k in range(rows):
                s = starts[k]
                out.append((n_words[k], len(s), min(s) if s else None, max(s) if s else None, ",".join(sorted(base[k])), ",".join(sorted(base[k] | more[k].keys())), max([*more[k].values(), 0.5 if s else 0.0])))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scanner(**options):
    """A Column function text -> FOUND."""
    bounded_batches()
    held = Scanner(**options)
    return F.arrow_udf(lambda texts: held.column(texts), FOUND)


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id and FOUND's columns."""
    found = scanner(**options)
    return docs.select("doc_id", found(F.col("text")).alias("f")).select("doc_id", "f.*")
