"""License scans by template-markup matching.

Templates mark optional wording with <<optional>>...<</optional>>, replaceable regions with
<<any:N>> (up to N words) and alternatives with <<a|b|c>>. They are compiled to automata over
words; a text is labelled where an automaton gets from a start to its end, so that all mandatory
wording stands there exactly, in order, with nothing but what the markup allows between it.
Automata start only at places where the first words of the template stand.

Base phrases are counted apart from that, at every place where their words stand in a row.
Words are runs of ASCII letters (in lower case), digits and all characters beyond ASCII.

score: 1 if a template is accepted, else 0.5 if a base phrase occurs, else 0.

Cases: a template without mandatory wording is an error; null counts as empty, and has no words, labels or places; repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty table; any length of text
is scanned whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, slices

#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public license texts and notices, as templates by label.
TEMPLATES = {
    "apache-2.0": [
        "<<licensed|released|distributed>> under the <<optional>>terms of the <</optional>>apache license <<optional>>version <</optional>>2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http<<optional>>s<</optional>> www apache org licenses license 2 0",
    ],
    "mit": [
        "<<licensed|released|distributed>> under the <<optional>>terms of the <</optional>>mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph <</optional>>shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<any:12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "isc": [
        "permission to use copy modify and <<optional>>or <</optional>>distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1 <</optional>>redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>>2 <</optional>>redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "gpl-3.0": [
        "<<licensed|released|distributed>> under the <<optional>>terms of the <</optional>>gnu general public license <<optional>>as published by the free software foundation <</optional>><<optional>>either <</optional>>version 3",
        "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or <<optional>>at your option <</optional>>any later version",
    ],
    "gpl-2.0": [
        "under the <<optional>>terms of the <</optional>>gnu general public license <<optional>>as published by the free software foundation <</optional>><<optional>>either <</optional>>version 2",
    ],
    "cc-by-4.0": [
        "licensed under <<optional>>a <</optional>><<cc by|creative commons attribution>> 4 0 <<optional>>international license<</optional>>",
    ],
    "cc-by-sa-4.0": [
        "licensed under <<optional>>a <</optional>><<cc by sa|creative commons attribution sharealike>> 4 0 <<optional>>international license<</optional>>",
    ],
    "cc-by-nc-4.0": [
        "licensed under <<optional>>a <</optional>><<cc by nc|creative commons attribution noncommercial>> 4 0 <<optional>>international license<</optional>>",
    ],
    "cc0-1.0": ["<<cc0|creative commons zero>> 1 0 universal <<optional>>public domain dedication<</optional>>"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "lgpl": ["under the <<optional>>terms of the <</optional>>gnu lesser general public license <<optional>>as published by the free software foundation <</optional>><<optional>>either <</optional>>version <<2 1|3>>"],
    "agpl-3.0": ["under the <<optional>>terms of the <</optional>>gnu affero general public license <<optional>>as published by the free software foundation <</optional>><<optional>>either <</optional>>version 3"],
    "bsl-1.0": ["distributed under the boost software license version 1 0"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

#: Lower case for A-Z; ASCII that is no letter or digit becomes a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class TokenAutomaton:
    """A template as states 0..end; each state has word edges, and `skip` edges that take no word."""

    def __init__(self, template: str):
        self.edges: list[dict[bytes | None, set[int]]] = []
        self.skips: list[set[int]] = []
        at = self._state()
        opened = []
        for part in re.split(r"(<<[^>]*>>)", template):
            if part == "<<optional>>":
                opened.append(at)
            elif part == "<</optional>>":
                end = self._state()
                self.skips[at].add(end)
                self.skips[opened.pop()].add(end)
                at = end
            elif part.startswith("<<any:"):
                end = self._state()
                for _ in range(int(part[6:-2])):
                    self.skips[at].add(end)
                    at = self._edge(at, None)
                self.skips[at].add(end)
                at = end
            elif part.startswith("<<"):
                end = self._state()
                for choice in part[2:-2].split("|"):
                    self.skips[self._chain(at, choice)].add(end)
                at = end
            else:
                at = self._chain(at, part)
        self.end = at
        self.first = self._starts()

    def _state(self) -> int:
        self.edges.append({})
        self.skips.append(set())
        return len(self.edges) - 1

    def _edge(self, at: int, word: bytes | None) -> int:
        to = self._state()
        self.edges[at].setdefault(word, set()).add(to)
        return to

    def _chain(self, at: int, text: str) -> int:
        for w in words(text):
            at = self._edge(at, w)
        return at

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.skips[todo.pop()] - seen:
                seen.add(to)
                todo.append(to)
        return seen

    def _starts(self) -> set[bytes]:
        """What a match can begin with, blanks around: pairs of words, or one word where any may follow or none needs to.

        Words that a replaceable region takes at the start are left out: the match without them is one too.
        """
        begin = self._closed({0})
        if self.end in begin:
            raise ValueError("a template needs mandatory wording")
        out = set()
        for w, to in [(w, to) for s in begin for w, to in self.edges[s].items() if w is not None]:
            after = self._closed(to)
            second = {v for s in after for v in self.edges[s]}
            out |= {b" " + w + b" "} if self.end in after or None in second else {b" " + w + b" " + v + b" " for v in second}
        if self.end in self._closed({to for s in begin for to in self.edges[s].get(None, ())}):
            raise ValueError("a template needs mandatory wording")
        return out

    def accepts(self, own: list[bytes], at: int) -> bool:
        states = self._closed({0})
        while self.end not in states:
            if at == len(own) or not states:
                return False
            w = own[at]
            states = self._closed({to for s in states for key in (w, None) for to in self.edges[s].get(key, ())})
            at += 1
        return True


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions at which a phrase (with a blank on either side) stands; joined has a blank on either side too."""
    out, at, counted, n = [], joined.find(phrase), 0, 0
    while at >= 0:
        n += joined.count(b" ", counted, at)
        counted = at
        out.append(n)
        at = joined.find(phrase, at + 1)
    return out


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, base: dict[str, str] = BASE):
        self.base = [(b" " + p.encode() + b" ", len(p.split()), label) for p, label in base.items()]
        self.automata = [(label, TokenAutomaton(t)) for label, many in templates.items() for t in many]
        self.starts: dict[bytes, list[tuple[str, TokenAutomaton]]] = {}
        for label, automaton in self.automata:
            for s in automaton.first:
                self.starts.setdefault(s, []).append((label, automaton))

    def __call__(self, text: str | None) -> tuple:
        own = words(text)
        joined = b" " + b" ".join(own) + b" "
        firsts, lasts, labels, n = [], [], set(), 0
        for phrase, size, label in self.base:
            if at := _places(joined, phrase):
                n += len(at)
                firsts.append(at[0])
                lasts.append(at[-1])
                labels.add(label)
        more = set()
        for start, those in self.starts.items():
            if start in joined:
                for at in _places(joined, start):
                    more.update(label for label, automaton in those if label not in more and automaton.accepts(own, at))
        score = 1.0 if more else 0.5 if labels else 0.0
        join = lambda x: ",".join(sorted(x))
        return len(own), n, min(firsts, default=None), max(lasts, default=None), join(labels), join(labels | more), score


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of docs."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        scan = Scanner(templates, base)
        for batch in slices(batches, "text"):
            cols = list(zip(*map(scan, column(batch, "text").to_pylist())))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
