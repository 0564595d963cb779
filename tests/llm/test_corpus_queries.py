"""Every query with a SQL twin, on the smallest tables; the pipeline on planted documents."""

import random
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from chainsurf.llm.oracles import ORACLES
from chainsurf.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "labels", "benchmark", "conversations", "embeddings"]
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() >= 1


def test_pipeline_on_planted_documents(spark, tmp_path):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 8))) for _ in range(900)]
    body = lambda n: " ".join(r.choice(vocab) + ("." if i % 9 == 8 else "") for i in range(n))
    passage, item = body(70), body(30)
    clean = {i: body(120) for i in range(40)}
    rows = dict(clean)
    rows[50] = " ".join(w + "###" for w in body(120).split())  # rejected by the rules
    rows[51] = rows[3] + " extra"  # near copy of 3
    rows[52] = rows[4]  # copy of 4
    rows[53] = body(40) + " " + passage + " " + body(40)
    rows[54] = body(60) + "\n" + passage + " " + body(60)  # loses the passage
    rows[55] = body(50) + " " + item + " " + body(50)  # holds a benchmark item
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert set(texts) == set(clean) | {53, 54}
    assert all(texts[k] == t for k, t in clean.items()) and texts[53] == rows[53]
    assert texts[54].split() == [w for w in rows[54].split()[:60]] + rows[54].split()[130:]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == set(texts) and all(x.round_trip and x.n_pieces > 0 for x in out)
