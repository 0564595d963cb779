"""Texts that repeat themselves, nulls and ties against the SQL twins; texts longer than one slice of the kernels against what is planted in them."""

import random

import duckdb
import pandas as pd
import pytest

from chainsurf.llm import decontaminate, licenses, substrings
from chainsurf.llm.oracles import ORACLES
from chainsurf.llm.queries import QUERIES
from chainsurf.llm.tokens import SLICE_BYTES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14))
    body = lambda n: " ".join(word() for _ in range(n))
    long, passage = body(90_000), body(70)
    assert len(long) > SLICE_BYTES
    rows = [
        (2, body(100) + " " + passage + " " + body(40)),
        (4, "a b " * 200), (5, "a b " * 130 + "c"), (6, "x " * 300), (7, "x " * 60),  # periodic
        (8, " ".join("a b c d e f g".split() * 30)), (9, passage), (10, passage),
        (11, ""), (12, None), (13, " \n\t "), (14, body(49)), (15, body(50)),
        (18, "\n".join([body(9)] * 40)),
    ]
    frame = pd.DataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], columns=["doc_id", "text", "lang", "source", "n_chars"])
    folder = tmp_path_factory.mktemp("long")
    spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(folder / "documents.parquet"))
    half = " ".join(long.split()[:45_000])
    longs = [(1, long + " licensed under CC BY ."), (2, passage), (3, half + " " + passage + long[len(half):]), (16, "é ü " * 400_000), (17, "w" * (SLICE_BYTES + 5))]
    return str(folder), longs, passage


@pytest.mark.parametrize("name", ["op3_license_scans", "op4_recompression", "op5_bottom_k_near_duplicates", "op6_quality_rules", "op10_rendezvous_sharding"])
def test_against_sql(spark, tables, name):
    folder, _, _ = tables
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    cols = sorted(names)
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == cols
    assert sorted((tuple(x[c] for c in cols) for x in got.collect()), key=str) == sorted((tuple(x[names.index(c)] for c in cols) for x in want.fetchall()), key=str)


def test_texts_longer_than_a_slice(spark, tables):
    _, longs, passage = tables
    docs = spark.createDataFrame(longs, "doc_id long, text string").repartition(2)
    items = spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string")
    found = {(x.doc_id, x.item_id): (x.start, x.words, x.similarity) for x in decontaminate.find(docs, items).collect()}
    assert found == {(2, 1): (0, 70, 1.0), (3, 1): (45_000, 70, 1.0)}
    marks = {x.doc_id: (x.n_words, x.first_word, x.base_labels) for x in licenses.scan(docs).collect()}
    assert marks[1] == (90_004, 90_002, "cc-by") and marks[16] == (800_000, None, "") and marks[17][0] == 1
    gone = {x.doc_id: (x.n_words, x.n_removed) for x in substrings.repeats(docs).collect()}
    assert gone == {1: (90_005, 0), 2: (70, 0), 3: (90_070, 90_070), 16: (800_000, 0), 17: (1, 0)}
