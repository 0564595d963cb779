import re

import pytest

from chainsurf.llm import licenses

TEXTS = {
    1: "Code. Licensed under CC BY-NC 4.0. End",
    2: "licensed UNDER the cc by",
    3: "This work is licensed under the GNU General Public License, version 3.",
    4: "All rights reserved. all-rights reserved; All Rights Reserved",
    5: "Copyright (c) 2020 Some One. All rights reserved.",
    6: "Copyright (c) All rights reserved.",
    7: "Licensed under the Apache License 2.0",
    8: "Released under the MIT Licence.",
    9: None,
    10: "",
    11: "cc\nby éa CC, BY",
    12: "released under mit license",
}


def brute(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    places, base, more = [], set(), set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for template, label in licenses.TEMPLATES:
        if re.search(licenses.pattern(template), " " + " ".join(w) + " "):
            more.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if more else 0.5 if base else 0.0


def test_against_plain_search(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in TEXTS.items()], "doc_id long, text string, labels string")
    got = {x.doc_id: tuple(x)[1:] for x in licenses.scan(docs).collect()}
    assert got == {k: brute(t) for k, t in TEXTS.items()}
    assert got[5][5] == "copyright-reserved,reserved" and got[6][5] == "reserved" and got[1][5] == "cc-by,cc-by-nc-4.0"


def test_automaton():
    a = licenses.Automaton("x y <<opt>> o p <</opt>> <<var 1 3>> z")
    accepts = lambda t: bool(a.accepts([w.encode() for w in t.split()]))
    assert accepts("x y q z") and accepts("x y o p q r s z") and accepts("x y o p z") and accepts("x y q r s z more")
    assert not accepts("x y z") and not accepts("x y q r s t z") and not accepts("x q z")
    with pytest.raises(ValueError):
        licenses.Automaton("<<opt>> a <</opt>> b")


def test_nested_regions():
    a = licenses.Automaton("x y <<opt>> o <<opt>> p <<var 1 2>> <</opt>> q <</opt>> z")
    accepts = lambda t: bool(a.accepts([w.encode() for w in t.split()]))
    assert accepts("x y z") and accepts("x y o q z") and accepts("x y o p 1 q z") and accepts("x y o p 1 2 q z")
    assert not accepts("x y o z") and not accepts("x y o p q z") and not accepts("x y o p 1 2 3 q z")
    for bad in ("x y <<opt>> z", "x y z <</opt>>"):
        with pytest.raises(ValueError):
            licenses.parts(bad)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""


def test_whole_texts(spark):
    docs = {1: MIT, 2: "x " + MIT.upper(), 3: MIT.replace("sublicense", "sub license"), 4: MIT[:-12]}
    got = {x.doc_id: x.labels for x in licenses.scan(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == {1: "mit,mit-text", 2: "mit,mit-text", 3: "mit", 4: "mit"}


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
