import math
import random
import re
import zlib

import numpy as np

from chainsurf.llm import classifier


def corpus(n=400):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(30, 90))]
        bad = i % 6 == 0
        text = " ".join(w + ("###" if bad and r.random() < 0.7 else "." if r.random() < 0.1 else "") for w in words)
        rows.append((i, text, 0.5))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(900, None, 0.0), (901, "", 0.0), (None, "a b", 0.0)], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = classifier.fit(docs, marks)
    got = classifier.judge(docs, model).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows) + 3 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    unseen = [(by[i].predicted, q) for i, q, _ in labels if by[i].held_out]
    assert np.mean([a == b for a, b in unseen]) > 0.95
    assert by[None].held_out is False
    # the fit is bounded and repeatable, whatever the order of rows
    again = classifier.fit(docs.orderBy("text"), marks.orderBy("doc_id"))
    assert np.allclose(model["w"], again["w"])


def test_one_kind_of_label_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {x.score for x in classifier.judge(docs, classifier.fit(docs, marks)).collect()} == {0.5}
    none = docs.limit(0)
    assert classifier.judge(none, classifier.fit(none, marks.limit(0))).count() == 0


def brute_features(t):
    data, w = t.encode(), re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
    share = lambda chars: sum(b in chars for b in data) / max(len(data), 1)
    n, grams = max(len(w), 1), [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    return {
        "log_words": math.log1p(len(w)) / 10, "marked": sum(x[-1] in b"#*$%&|<>" for x in w) / n, "same_next": sum(a == b for a, b in zip(w, w[1:])) / n,
        "repeats": (len(grams) - len(set(grams))) / n, "word_size": sum(map(len, w)) / n / 10, "symbols": share(b"#*$%&|<>"), "capitals": share(bytes(range(65, 91))), "digits": share(b"0123456789"),
        "stops": share(b"."), "commas": share(b","), "bangs": share(b"!"), "bars": share(b"|"), "beyond_ascii": share(bytes(range(128, 256))), "lines": share(b"\n"),
    }


def test_features_against_plain_python():
    texts = ["", "a", "One two, two. ### $x$ é\n\nA B C A B C A B C!", "x " * 50, "été | 12 34.5 | <b>", "\n\t "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got = classifier.features(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    for t, row in zip(texts, got, strict=True):
        want = brute_features(t)
        assert np.allclose(row, [want[k] for k in classifier.FEATURES], atol=1e-12), t


def test_weights_minimise_the_pairwise_loss():
    """The fitted weights against plain gradient sums over the same kind of pairs, and moved weights."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, (200, 3)), r.normal(0.6, 1, (200, 3))])
    y = np.repeat([0, 1], 200)
    model = classifier.train(x, y, pairs=4000)
    draw = np.random.default_rng(7)  # the same pairs again
    pairs = [(a, b) for a, b in zip(x[y == 1][draw.integers(0, 200, 4000)].tolist(), x[y == 0][draw.integers(0, 200, 4000)].tolist(), strict=True)]
    spread = [np.std([a[j] - b[j] for a, b in pairs]) for j in range(3)]

    def loss(w):
        each = [sum(w[j] * (a[j] - b[j]) for j in range(3)) for a, b in pairs]
        return sum(math.log1p(math.exp(-z)) for z in each) / len(each) + classifier.RIDGE / 2 * sum((w[j] * spread[j]) ** 2 for j in range(3))

    best = loss(model["w"])
    for j in range(3):
        for step in (-0.02, 0.02):
            moved = model["w"].copy()
            moved[j] += step
            assert loss(moved) > best
    low = np.mean(x @ model["w"] < model["mid"])
    assert abs(low - 0.5) < 0.01  # the quantile of the share of bad labels


def test_fit_takes_a_bounded_sample_in_a_fixed_order(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} " + "#" * (i % 3)) for i in range(400)], "doc_id long, text string")  # ids repeat
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a = classifier.fit(docs.repartition(3), marks, max_rows=60)
    b = classifier.fit(docs.orderBy("text"), marks.repartition(4), max_rows=60)
    assert np.array_equal(a["w"], b["w"])
