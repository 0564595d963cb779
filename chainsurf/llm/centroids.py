"""Centroid clustering of whole-number vectors by scalar lookup tables.

In each round a task tabulates, for every dimension and every whole number that occurs
there, the squared differences to the centroids; the distances of its vectors are rows
gathered from these tables and summed.  The centroids (k x 64 numbers) and the sums that
come back (k x 64, folded by task and then by Spark) are all that ever leaves a task.

Kept are vectors of exactly ``DIMENSIONS`` components, none null or not finite; null
vectors and others go.  Fewer kept vectors than k give fewer centroids, none give no
rows.  Repeated ids tie at the start and are told apart by their components; a null id is
named by one space.  Components are exact up to ``LIMIT`` on either side and cut to it
beyond; distances and inertias that no long can hold stand as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors whose numbers stay below this have distances within 63 bits; others are reckoned with Python's whole numbers.
_NARROW = 1 << 27
LIMIT = 10**28
_MOST = (1 << 63) - 1


def kept_vectors(vectors: DataFrame, column: str = "embedding", by: str = "vec_id") -> DataFrame:
    """(vec_id, vec) of the rows whose vector is complete and finite, as doubles."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(by).alias("vec_id"), F.col(column).cast("array<double>").alias("vec")).filter((F.size("vec") == DIMENSIONS) & finite)


def whole_numbers(components: pa.Array) -> np.ndarray:
    """(n, DIMENSIONS) of floor(SCALE * x): 64-bit numbers, or Python's where these could overflow."""
    x = components.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIMENSIONS)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(SCALE * x), -float(LIMIT), float(LIMIT))
    if not len(x) or np.abs(x).max() < _NARROW:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], dtype=object)


def distances(numbers: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(n, k) squared distances, gathered from one table for each dimension."""
    if centroids.dtype == object:
        numbers = numbers.astype(object)
    total = np.zeros((len(numbers), len(centroids)), dtype=np.result_type(numbers, centroids))
    for d in range(numbers.shape[1]):
        occurring, place = np.unique(numbers[:, d], return_inverse=True)
        table = (occurring[:, None] - centroids[None, :, d]) ** 2
        total += table[place]
    return total


def _as_array(centroids: list[list[int]]) -> np.ndarray:
    wide = max(abs(x) for c in centroids for x in c) >= _NARROW
    return np.array(centroids, dtype=object if wide else np.int64)


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return whole_numbers(batch.column("vec").flatten())


def first_centroids(kept: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    """The k kept vectors with the smallest hashes of their ids, as whole numbers; k rows reach the driver."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(" "))), 256)
    rows = kept.select(name.alias("name"), "vec").orderBy("name", "vec").limit(k).collect()
    return [[int(x) for x in whole_numbers(pa.array(r.vec, pa.float64()))[0]] for r in rows]


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every non-empty centroid becomes the floor of its vectors' mean."""
    held = _as_array(centroids)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = [0] * len(held), [[0] * DIMENSIONS for _ in held]
        for batch in batches:
            numbers = _numbers(batch)
            nearest = distances(numbers, held).argmin(axis=1)
            for c in np.unique(nearest):
                mine = numbers[nearest == c]
                count[c] += len(mine)
                sums[c] = [a + int(b) for a, b in zip(sums[c], mine.sum(axis=0), strict=True)]
        some = [c for c, n in enumerate(count) if n]
        yield pa.RecordBatch.from_pydict({"cluster": some, "n": [count[c] for c in some], "sums": [[str(x) for x in sums[c]] for c in some]}, pa.schema({"cluster": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.string())}))

    parts = kept.select("vec").mapInArrow(fold, "cluster int, n long, sums array<string>")
    each = [F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(DIMENSIONS)]
    out = list(centroids)
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():  # k rows at most
        out[row.cluster] = [int(row[f"s{d}"]) // row.n for d in range(DIMENSIONS)]
    return out


def assigned(kept: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every kept vector; of equally near centroids the smaller number."""
    held = _as_array(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(_numbers(batch), held)
            nearest = far.argmin(axis=1)
            best = [min(int(x), _MOST) for x in far[np.arange(len(far)), nearest]]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nearest, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(assign, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(vectors: DataFrame, column: str = "embedding", by: str = "vec_id", k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Inertias are sums of distances, over the cluster and over all; the last column names
    the final centroid.  The k inertias and names are the only table that is broadcast.
    """
    spark, kept = vectors.sparkSession, kept_vectors(vectors, column, by)
    centroids, kind = first_centroids(kept, k), kept.schema["vec_id"].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    rows = stored(assigned(kept, centroids), "clusters")
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), _MOST)
    named = [(c, min(sums.get(c, 0), _MOST), total, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
