import hashlib
import random

from chainsurf.llm import substrings

W = substrings.WINDOW


def brute(rows):
    """(doc_id, n_words, n_removed, sha) by comparing all windows of all documents."""
    words = [(k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, w in words:
        if k is not None:
            for i in range(len(w) - W + 1):
                x = tuple(w[i:i + W])
                first[x] = min(first.get(x, k), k)
    out = []
    for k, w in words:
        gone = [False] * len(w)
        if k is not None:
            for i in range(len(w) - W + 1):
                if first[tuple(w[i:i + W])] < k:
                    gone[i:i + W] = [True] * W
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    r = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "Délta", "x", "y"]
    big = [f"w{i}" for i in range(500)]
    passage = [r.choice(big) for _ in range(60)]
    long_one = [r.choice(big) for _ in range(400)]
    out = []
    for i in range(40):
        kind = r.randrange(9)
        body = [r.choice(big) for _ in range(r.randrange(0, 120))]
        if kind == 0:
            body = [r.choice(vocab)] * r.randrange(40, 130)
        elif kind == 1:
            body = [vocab[0], vocab[1]] * r.randrange(20, 60) + body
        elif kind == 2:
            body = body[:20] + passage + body[20:]
        elif kind == 3:
            at = r.randrange(300)
            body += long_one[at:at + r.randrange(45, 100)]
        elif kind == 4:
            body = list(long_one)
            body[r.randrange(400)] = "edited"
        elif kind == 5:
            body = [r.choice(vocab[:2]) for _ in range(150)]
        elif kind == 8:
            body = big[: r.randrange(3, 10)] * r.randrange(10, 40) + body[:30]
        elif kind == 6 and out:
            body = out[r.randrange(len(out))][1].split()
        out.append((r.randrange(30) if r.random() < 0.2 else 100 + i, r.choice([" ", "\n", "\t "]).join(body)))
    return out + [(None, " ".join(long_one)), (5, None), (6, ""), (7, "one"), (100, " ".join(long_one)), (100, " ".join(long_one))]


def test_against_all_windows(spark):
    for seed in (1, 2):
        rows = texts(seed)
        docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, row int").repartition(3)
        got = sorted((tuple(x) for x in substrings.repeats(docs).collect()), key=str)
        want = brute(rows)
        assert [x for x in got if x not in want] == [x for x in want if x not in got]


def test_empty_table_and_removal(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.repeats(none).count() == 0
    shared = " ".join(f"s{i}" for i in range(55))
    docs = spark.createDataFrame([(1, f"one {shared}", "a"), (2, f"two\n{shared} end", "b"), (3, f"{shared}", "c"), (4, None, "d")], "doc_id long, text string, a string")
    got = {x.doc_id: (x.text, x.a) for x in substrings.remove_repeats(docs).collect()}
    assert got == {1: (f"one {shared}", "a"), 2: ("two end", "b"), 3: ("", "c"), 4: (None, "d")}


def test_equal_words_get_equal_symbols():
    import numpy as np

    r = np.random.default_rng(3)
    core = r.integers(0, 1 << 60, 80).astype(np.uint64)
    seen = []
    for _ in range(2):
        names = np.concatenate([r.integers(0, 1 << 60, 30).astype(np.uint64), core, r.integers(0, 1 << 60, 30).astype(np.uint64)])
        name, lo, hi, _ = substrings.recompress(names, np.zeros(len(names), np.int64))
        seen.append({(int(n), int(a)) for n, a, b in zip(name, lo, hi) if a >= 30 and b <= 110})
    assert seen[0] == seen[1] and len(seen[0]) >= 3


def symbols_of(text):
    import numpy as np

    from chainsurf.llm.tokens import Words

    data = np.frombuffer(text.encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]))
    return words, substrings.recompress(words.hashes(), words.doc)[0]


def test_repeated_groups_of_words_fold():
    for group in (["x"], ["a", "b"], ["a", "b", "c"], list("abcdefg")):
        words, top = symbols_of(" ".join(group * 200))
        assert len(words.start) == 200 * len(group) and len(top) <= 12


def test_window_names_are_those_of_the_words():
    words, _ = symbols_of(" ".join(["q"] + [f"w{i % 30}" for i in range(200)]))
    for which in (0, 1):
        h = substrings.window_names(words, W, which).tolist()
        assert len(h) == 152 and len(set(h)) == 31 and h[1] == h[31] == h[61]
    short, _ = symbols_of("one two")
    assert len(substrings.window_names(short, W)) == 0
