import hashlib
import math
import zlib

from chainsurf.llm import sharding


def brute(key, weights):
    def draw(i, w):
        bits = int(hashlib.md5(f"{'null' if key is None else key}:{i}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52) / w

    return min((draw(i, w), i) for i, w in enumerate(weights))[1]


def test_law_slots_and_growth(spark):
    rows = [(i, f"text {i % 50}" if i % 9 else None, 1) for i in range(3000)] + [(7, "same", 1)] * 40 + [(None, "é", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5)
    got = sharding.assign(docs, [1.0] * 16).collect()
    assert len(got) == len(rows)
    places = {}
    for x in got:
        assert x.shard == brute(x.doc_id, [1.0] * 16) and x.grown_shard == brute(x.doc_id, [1.0] * 17)
        assert x.grown_shard in (x.shard, 16) and x.law == "key"
        places.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    want = sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in rows)
    assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == want


def test_weights(spark):
    keys = spark.range(20000)
    counts = {x.s: x["count"] for x in keys.select(sharding.choose(keys.id, [1.0, 3.0]).alias("s")).groupBy("s").count().collect()}
    assert 2.7 < counts[1] / counts[0] < 3.3


def test_write_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t") for i in range(50)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "s"), [1.0] * 4)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert {x.doc_id: x.shard for x in back} == {i: brute(i, [1.0] * 4) for i in range(50)}
    assert sharding.assign(docs.limit(0), [1.0] * 16).count() == 0
