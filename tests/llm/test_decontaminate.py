import random
import re
from collections import Counter

import numpy as np

from chainsurf.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def bag(w, k):
    k = min(k, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if k else Counter()


def brute(docs, items):
    out = []
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            if not v or not w:
                continue
            n, best = min(len(v), len(w)), None
            for s in range(len(w) - n + 1):
                x, y = w[s:s + n], v
                k = min(5, len(v))
                a = Counter(tuple(x[j:j + k]) for j in range(len(x) - k + 1))
                b = bag(y, 5)
                shared, every = sum((a & b).values()), sum((a | b).values())
                if 5 * shared >= 4 * every and (best is None or shared / every > best[0] + 1e-12):
                    best = (shared / every, s, n)
            if best:
                out.append((d, i, round(best[0], 9), best[1], best[2]))
    return sorted(out, key=str)


def cases(seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 5, 8, 20, 40, 60])))) for i in range(30)]
    docs = []
    for d in range(120):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 150))]
        for _ in range(r.randrange(3)):
            x = items[r.randrange(30)][1].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                at = r.choice([0, len(x) - 1, r.randrange(len(x))])
                x[at] = r.choice(vocab)
            if r.random() < 0.3:
                x.insert(r.randrange(len(x)), "zz")
            at = r.randrange(len(w) + 1)
            w[at:at] = [y.upper() if r.random() < 0.5 else y + "," for y in x]
        docs.append((d, " ".join(w)))
    return docs + [(900, None), (901, ""), (902, items[3][1][:-3])], items + [(50, None), (51, ""), (52, "v1 v2 v1 v2 v1 v2 v1 v2 v1 v2")]


def test_against_all_windows(spark, monkeypatch):
    docs, items = cases(5)
    left = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = sorted(((x.doc_id, x.item_id, round(x.similarity, 9), x.start, x.words) for x in decontaminate.find(left, right).collect()), key=str)
    assert got == want and len(want) > 30
    monkeypatch.setattr(decontaminate, "LISTED", 2)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 1 << 9)
    few = sorted(((x.doc_id, x.item_id, round(x.similarity, 9), x.start, x.words) for x in decontaminate.find(left, right).collect()), key=str)
    assert few == want
    kept = decontaminate.clean(left, right)
    assert kept.columns == ["doc_id", "text", "item_id"]
    assert {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - {x[0] for x in want}


def test_index_finds_all_within_the_radius():
    r = np.random.default_rng(2)
    prints = r.integers(0, 1 << 63, (300, 8)).astype(np.uint64) | (r.integers(0, 2, (300, 8)).astype(np.uint64) << np.uint64(63))
    radius = 200  # some unrelated prints lie within it
    index = decontaminate.MultiIndex(prints, radius)
    for q in prints[:20] ^ np.uint64(0b1011):
        assert set(index.near(q).tolist()) == {i for i, p in enumerate(prints) if sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(p, q)) <= radius}


def item_pairs(n, seed=4):
    """Texts of 5 to 60 words and a changed copy each."""
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(40)]
    for _ in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(5, 61))]
        if r.random() < 0.2:
            w = (w[:6] * 12)[: r.randrange(10, 61)]  # heavy shingles
        x = list(w)
        for _ in range(r.choice([1, 1, 2])):
            x[r.choice([0, 1, len(x) - 1, len(x) - 2])] = r.choice(vocab)
        yield decontaminate.Item(" ".join(w)), decontaminate.Item(" ".join(x))


def test_the_radius_holds_all_similar_pairs_and_the_index_drops_others():
    pairs = list(item_pairs(3000))
    similar = 0
    for a, b in pairs:
        shared, every = sum((a.bag & b.bag).values()), sum((a.bag | b.bag).values())
        if 5 * shared >= 4 * every:
            similar += 1
            assert len(decontaminate.MultiIndex(a.print[None]).near(b.print)) == 1
    assert similar > 800
    index = decontaminate.MultiIndex(np.stack([a.print for a, _ in pairs]))
    passed = sum(len(index.near(b.print)) for _, b in pairs[:200])
    assert passed <= 200 * 6  # of 600,000: each with itself, and few chance neighbours among the short


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.find(docs, none).count() == 0
    assert decontaminate.clean(docs, none).count() == 1


def test_clean_goes_by_rows(spark):
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(1, "before " + item + " after"), (1, "a clean text"), (None, item), (None, "clean too"), (2, "clean"), (3, item), (3, item), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = decontaminate.clean(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[1], rows[3], rows[4], rows[7]]))
