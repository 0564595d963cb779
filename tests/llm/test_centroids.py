import hashlib
import math
import random

from chainsurf.llm import centroids as c

SCHEMA = "vec_id long, embedding array<double>"


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{' ' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda x: (name(x[0]), x[1]))[:k]]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    nearest = lambda v: min((far(v, m), j) for j, m in enumerate(centers))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        mine = [[v for (_, v), a in zip(kept, at, strict=True) if a == j] for j in range(len(centers))]
        centers = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else old for m, old in zip(mine, centers, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, j in found if j == q) for q in range(len(centers))]
    return sorted(((i, j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def rows_of(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(1)
    vec = lambda: [r.choice((-1.0, -0.51, 0.0, 0.25, 3.3)) + r.random() for _ in range(64)]
    rows = [(i, vec()) for i in range(300)]
    rows += [(5, rows[5][1]), (None, vec()), *[(900 + i, rows[7][1]) for i in range(100)]]  # repeated ids, a null one, many equal vectors
    rows += [(1000, None), (1001, []), (1002, vec()[:63]), (1003, [*vec()[:63], None]), (1004, [*vec()[:63], math.nan]), (1005, [*vec()[:63], -math.inf]), (1006, [*vec(), 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS cluster", "0 AS vec", "0 AS distance").repartition(4)
    assert rows_of(c.cluster(df)) == plain_clusters(rows)


def test_few_and_no_vectors(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert rows_of(c.cluster(spark.createDataFrame(few, SCHEMA))) == plain_clusters(few)
    assert c.cluster(spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0
    assert c.cluster(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_components_are_exact(spark):
    r = random.Random(2)
    rows = [(i, [r.choice((-1.0, 1.0)) * 1e6 + r.random() for _ in range(64)]) for i in range(40)]
    rows += [(50, [1e8] * 64)]  # 6.4e9, squared beyond 2^32 but within a long
    assert rows_of(c.cluster(spark.createDataFrame(rows, SCHEMA))) == plain_clusters(rows)
    huge = [(1, [1e30] * 64), (2, [-1e30] * 64), *[(i + 3, [0.0] * 64) for i in range(20)]]
    got = {x.vec_id: x for x in c.cluster(spark.createDataFrame(huge, SCHEMA)).collect()}
    assert len(got) == 22 and max(x.distance for x in got.values()) <= (1 << 63) - 1


def test_floats(spark):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(64)]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    back = [(x.vec_id, x.embedding) for x in df.collect()]
    assert rows_of(c.cluster(df)) == plain_clusters(back)
