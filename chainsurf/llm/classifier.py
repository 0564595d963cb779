"""Quality scores from preference pairs: a Bradley-Terry model over text features.

A document labelled good is preferred over one labelled bad; P(a before b) is
``sigmoid(w . (f(a) - f(b)))``, and w minimises the logistic loss on the feature
differences of many such pairs.  The threshold is a quantile: the share of bad labels
among the training rows gives the quantile of their raw scores that maps to
``THRESHOLD``; a logistic curve around it turns raw scores into 0..1.

Fitting uses a bounded sample, ``max_rows``: the labelled training rows whose hashed ids
are smallest (of rows that repeat an id, by label and text), and ``PAIRS`` pairs drawn from
them.  Scoring reads every whole text.  Features depend on the text alone.

Defined cases: null and empty texts have all features 0 and get a score; rows with a
null id are scored and count as not held out; null labels are not used; repeated label
rows weigh as often as they occur; without labels of both kinds all scores are 0.5;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import Words, combine, slices

THRESHOLD, MAX_ROWS, PAIRS, STEPS_DOWN, RIDGE = 0.3, 20_000, 60_000, 400, 1e-3
FEATURES = ("log_words", "symbols", "marked", "capitals", "digits", "stops", "commas", "bangs", "same_next", "repeats", "word_size", "bars", "beyond_ascii", "lines")

_CLASS = {
    "symbols": b"#*$%&|<>",
    "capitals": bytes(range(65, 91)),
    "digits": b"0123456789",
    "stops": b".",
    "commas": b",",
    "bangs": b"!",
    "bars": b"|",
    "beyond_ascii": bytes(range(128, 256)),
    "lines": b"\n",
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASS.items()}


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text of a slice."""
    words = Words(data, offsets)
    n, count = words.n, np.maximum(words.count, 1).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    per_byte = {k: np.bincount(owner[t[data]], minlength=n) / size for k, t in _TABLES.items()}
    names = words.hashes()
    same = np.zeros(len(names), bool)
    same[1:] = (names[1:] == names[:-1]) & (words.doc[1:] == words.doc[:-1])
    marked = _TABLES["symbols"][data[words.end - 1]] if len(names) else np.zeros(0, bool)
    repeats = np.zeros(n)
    if len(names) >= 3:
        g = combine(combine(names[:-2], names[1:-1]), names[2:])
        d = words.doc[:-2]
        g, d = g[d == words.doc[2:]], d[d == words.doc[2:]]
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
        again = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
        repeats = np.bincount(d[1:][again], minlength=n) / count
    long_ = np.bincount(words.doc, weights=words.end - words.start, minlength=n)
    columns = {
        "log_words": np.log1p(words.count) / 10,
        "marked": np.bincount(words.doc[marked], minlength=n) / count,
        "same_next": np.bincount(words.doc[same], minlength=n) / count,
        "repeats": repeats,
        "word_size": long_ / count / 10,
    } | per_byte
    return np.stack([columns[k] for k in FEATURES], axis=1)


def train(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> dict:
    """Weights, centre and scale of the score, from feature rows x with labels y (0 or 1)."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return {"w": np.zeros(x.shape[1]), "mid": 0.0, "scale": 0.0}
    r = np.random.default_rng(seed)
    diff = good[r.integers(0, len(good), pairs)] - bad[r.integers(0, len(bad), pairs)]
    spread = diff.std(axis=0) + 1e-9
    diff = diff / spread
    w, step = np.zeros(x.shape[1]), 1.0
    for _ in range(STEPS_DOWN):  # gradient descent on log(1 + exp(-w . diff))
        p = 1 / (1 + np.exp(np.clip(diff @ w, -50, 50)))
        w += step * (diff.T @ p / len(diff) - RIDGE * w)
    w = w / spread
    raw = x @ w
    mid = float(np.quantile(raw, np.mean(y == 0)))
    return {"w": w, "mid": mid, "scale": float(4 / (raw.std() + 1e-9))}


def score(x: np.ndarray, model: dict, threshold: float = THRESHOLD) -> np.ndarray:
    """0..1, above ``threshold`` from the quantile on; 0.5 for a model without preferences."""
    if not model["scale"]:
        return np.full(len(x), 0.5)
    z = (x @ model["w"] - model["mid"]) * model["scale"] + np.log(threshold / (1 - threshold))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _each(fn, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in slices(batch.column(batch.num_columns - 1)):
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[:-1]), fn(features(data, offsets))], names)

    return run


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> dict:
    """A model from the labelled rows that are not held out, at most ``max_rows`` of them."""
    chosen = labels.select(F.col(key), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    chosen = chosen.orderBy(F.xxhash64(key), key, "y").limit(max_rows)
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(chosen), key)
    rows = rows.select(F.xxhash64(key).alias("h"), F.col(key).cast("string").alias("k"), "y", F.xxhash64("_text").alias("t"), "_text")
    to_list = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
    rows = rows.mapInArrow(_each(to_list, ["h", "k", "y", "t", "f"]), "h long, k string, y int, t long, f array<double>")
    found = rows.orderBy("h", "k", "y", "t").limit(max_rows).select("y", "f").collect()  # ids may repeat among the texts
    found.sort(key=lambda r: (r["f"], r["y"]))
    x = np.array([r["f"] for r in found], dtype=float).reshape(-1, len(FEATURES))
    return train(x, np.array([r["y"] for r in found], dtype=int))


def judge(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) for each row of ``docs``."""
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("_text"))
    scored = rows.mapInArrow(_each(lambda x: pa.array(score(x, model, threshold)), ["k", "score"]), "k long, score double")
    return scored.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
