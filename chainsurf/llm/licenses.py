"""Licence scans by template markup: optional and replaceable regions, mandatory words.

A template is plain words with ``<<opt>> ... <</opt>>`` (may be missing; holds words,
replaceable and further optional regions) and ``<<var a b>>`` (any a to b words).  It
compiles to a token automaton that accepts a place of a text if the mandatory words stand
there exactly.  Its first two words are mandatory; they find the starts, and the automaton
runs from there.  Starts and base phrases are found by 64-bit names of words and confirmed
by the words themselves.

Defined cases: null and empty texts have no words, no labels and score 0; overlapping
places all count; repeated rows each get a result; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import NOT_PLAIN, Words, slices

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates and their labels, as public licence notices word them.
TEMPLATES = [
    ("licensed under <<opt>> the <</opt>> cc by nc <<opt>> 4 0 <</opt>>", "cc-by-nc-4.0"),
    ("licensed under <<opt>> the <</opt>> cc by 4 0", "cc-by-4.0"),
    ("licensed under <<opt>> the <</opt>> apache license <<opt>> version <</opt>> 2 0", "apache-2.0"),
    ("released under <<opt>> the <</opt>> mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("this work is licensed under <<opt>> the <</opt>> <<opt>> gnu <</opt>> general public license <<opt>> version <</opt>> 3", "gpl-3.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("copyright c <<var 1 8>> all rights reserved", "copyright-reserved"),
    # whole texts
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>> the software <</opt>> "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "<<opt>> including the next paragraph <</opt>> shall be included in all copies or substantial portions of the software "
        "<<opt>> the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the <<opt>> authors or copyright holders <</opt>> <<opt>> <<var 1 12>> <</opt>> be liable <</opt>>",
        "mit-text",
    ),
    (
        "permission to use copy modify and <<opt>> or <</opt>> distribute this software for any purpose with or without fee is hereby granted "
        "<<opt>> provided that the above copyright notice and this permission notice appear in all copies <</opt>> the software is provided as is and <<var 1 8>> disclaims all warranties "
        "with regard to this software including all implied warranties of merchantability and fitness",
        "isc-text",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<opt>> 1 <</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<opt>> 2 <</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "<<opt>> <<opt>> 3 <</opt>> neither the name of <<var 1 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission <</opt>> "
        "this software is provided by <<var 1 12>> as is",
        "bsd-text",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu <<opt>> <<var 1 1>> <</opt>> general public license as published by the free software foundation "
        "<<opt>> either <</opt>> version <<var 1 2>> of the license <<opt>> or at your option any later version <</opt>>",
        "gnu-notice",
    ),
]


def parts(template: str) -> list[tuple]:
    """[("word", w), ("opt", parts), ("var", a, b), ...]."""
    levels: list[list[tuple]] = [[]]
    for t in re.findall(r"<<[^>]*>>|[^\s<]+", template):
        if t == "<<opt>>":
            levels.append([])
        elif t == "<</opt>>":
            inside = levels.pop()
            if not levels:
                raise ValueError(f"a region ends that has not begun: {template}")
            levels[-1].append(("opt", inside))
        elif t.startswith("<<var"):
            a, b = t[5:-2].split()
            levels[-1].append(("var", int(a), int(b)))
        else:
            levels[-1].append(("word", t))
    if len(levels) > 1 or [p[0] for p in levels[0][:2]] != ["word", "word"]:
        raise ValueError(f"a template starts with two mandatory words and closes its regions: {template}")
    return levels[0]


class Automaton:
    """States 0..n; ``step[s]``: (word or None for any, next state); ``skip[s]``: states reached without a word."""

    def __init__(self, template: str):
        self.step: list[list[tuple[bytes | None, int]]] = [[]]
        self.skip: list[list[int]] = [[]]
        self._compile(parts(template))
        self.end = len(self.step) - 1
        self.longest = self.end

    def _compile(self, some: list[tuple]) -> None:
        for p in some:
            start = len(self.step) - 1
            if p[0] == "word":
                self._add(p[1].encode())
            elif p[0] == "opt":
                self._compile(p[1])
                self.skip[start].append(len(self.step) - 1)
            else:
                places = [start]
                for _ in range(p[2]):
                    self._add(None)
                    places.append(len(self.step) - 1)
                for s in places[p[1]:-1]:
                    self.skip[s].append(places[-1])

    def _add(self, word: bytes | None) -> None:
        self.step[-1].append((word, len(self.step)))
        self.step.append([])
        self.skip.append([])

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes]) -> int:
        """The number of leading words of the shortest accepted place, or 0."""
        now = self._closed({0})
        for i, w in enumerate(words):
            now = self._closed({to for s in now for want, to in self.step[s] if want is None or want == w})
            if self.end in now:
                return i + 1
            if not now:
                return 0
        return 0


def pattern(template: str) -> str:
    """The same template as a regular expression over `` word word ... word ``."""

    def of(some: list[tuple]) -> str:
        return "".join(f" {p[1]}" if p[0] == "word" else f"({of(p[1])})?" if p[0] == "opt" else f"( [^ ]+){{{p[1]},{p[2]}}}" for p in some)

    return of(parts(template)) + " "


def _names(phrase: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(phrase).encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), apart=NOT_PLAIN).hashes()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = [(_names(k.split()), k.encode().split(), v) for k, v in PHRASES.items()]
    machines = [(Automaton(t), _names(t.split()[:2]), label) for t, label in TEMPLATES]
    for batch in batches:
        for at, to, data, offsets in slices(batch.column(1)):
            words = Words(data, offsets, lower=True, apart=NOT_PLAIN)
            names, n = words.hashes(), words.n
            count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            plain: list[set] = [set() for _ in range(n)]
            more: list[set] = [set() for _ in range(n)]
            for want, phrase, label in base:
                k = len(want)
                if len(names) < k:
                    continue
                hit = words.doc[: len(names) - k + 1] == words.doc[k - 1:]
                for j in range(k):
                    hit &= names[j:len(names) - k + 1 + j] == want[j]
                places = np.array([i for i in np.flatnonzero(hit).tolist() if [words.word(i + j) for j in range(k)] == phrase], np.int64)
                d = words.doc[places]
                np.add.at(count, d, 1)
                np.minimum.at(first, d, places - words.first[d])
                np.maximum.at(last, d, places - words.first[d])
                for x in np.unique(d):
                    plain[x].add(label)
            for machine, want, label in machines:
                for i in np.flatnonzero((names[:-1] == want[0]) & (names[1:] == want[1])):
                    d = words.doc[i]
                    stop = min(i + machine.longest, words.first[d + 1])
                    if label not in more[d] and machine.accepts([words.word(j) for j in range(i, stop)]):
                        more[d].add(label)
            none = last < 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, to - at),
                    pa.array(words.count),
                    pa.array(count),
                    pa.array(first, mask=none),
                    pa.array(last.astype(np.int64), mask=none),
                    pa.array([",".join(sorted(x)) for x in plain], pa.string()),
                    pa.array([",".join(sorted(x | y)) for x, y in zip(plain, more, strict=True)], pa.string()),
                    pa.array([1.0 if y else 0.5 if x else 0.0 for x, y in zip(plain, more, strict=True)], pa.float64()),
                ],
                ["k", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    score: 1 if a template is accepted, 0.5 if only a base phrase stands there, else 0.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("_text"))
    out = rows.mapInArrow(_scan, "k long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("k", key)
