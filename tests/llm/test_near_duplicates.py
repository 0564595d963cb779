import random

from chainsurf.llm import near_duplicates


def brute(rows, size, percent):
    sets = []
    for k, t in rows:
        w = [x.lower() for x in (t or "").split()]
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            best[root(i)] = min(best.get(root(i), k), k)
    return sorted((k, len(s), best.get(root(i), k)) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def texts(seed, crowd=0):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocab) for _ in range(r.choice([4, 9, 12, 30, 80, 200]))] for _ in range(25)]
    line = [r.choice(vocab) for _ in range(14)]
    out = []
    for i in range(150):
        w = list(base[r.randrange(3) if i < crowd else r.randrange(25)])
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            at = r.randrange(len(w))
            w[at] = r.choice(vocab) if r.random() < 0.7 else w[at].upper()
        if r.random() < 0.3:
            w = line + w
        out.append((i, " ".join(w)))
    return out + [(500, None), (501, ""), (502, "One two"), (503, "one TWO"), (504, "two one"), (505, "single")]


def test_against_all_pairs(spark):
    for seed, size, percent, crowd in ((1, 3, 85, 0), (2, 3, 85, 120), (3, 5, 80, 60)):
        rows = texts(seed, crowd)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = near_duplicates.groups(docs, size=size, percent=percent).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(rows, size, percent)
        assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_long_lists_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "RARE", 3)
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    monkeypatch.setattr(near_duplicates, "CHUNK", 5)
    for seed in (4, 5):
        rows = texts(seed, 130)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = near_duplicates.groups(docs).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(rows, 3, 85)


def family(n, edits, seed=3, words=400):
    r = random.Random(seed)
    root = [f"v{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(root)
        for at in r.sample(range(words), edits(i)):
            w[at] = f"e{r.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out


def test_a_large_family_costs_in_proportion(spark, monkeypatch):
    """Copies that are linked to their root need no blocks, and each is compared a few times only."""
    rows = family(300, lambda i: 4 if i else 0)
    seen = []
    verified = near_duplicates._verified
    monkeypatch.setattr(near_duplicates, "_verified", lambda tasks, *more: seen.append(tasks.count()) or verified(tasks, *more))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates.groups(docs).collect()
    assert {x.component_id for x in got} == {0} and len(got) == 300
    assert seen[0] <= 300 * 2.5 and seen[1] == 0


def test_a_family_whose_copies_are_not_linked_to_its_root(spark):
    """Chains and islands within one family: links outside the core are found by the blocks."""
    rows = family(120, lambda i: 3 + i % 14)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates.groups(docs).collect()
    want = brute(rows, 3, 85)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == want and len({c for _, _, c in want}) > 1


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates.groups(none).count() == 0
    text = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(3, text, 1), (3, text, 1), (1, text + " b", 2), (None, text, 3), (None, "alone here now", 4)], "doc_id long, text string, component_id int")
    got = near_duplicates.groups(docs).collect()
    assert sorted((str(x.doc_id), str(x.component_id), x.kept) for x in got) == [("1", "1", True), ("3", "1", False), ("3", "1", False), ("None", "1", None), ("None", "None", None)]
    twice = spark.createDataFrame([(1, text), (1, text), (1, "another text here"), (2, text)], "doc_id long, text string")
    assert sorted((x.doc_id, x.component_id, x.kept) for x in near_duplicates.groups(twice).collect()) == [(1, 1, True)] * 3 + [(2, 1, False)]
    assert near_duplicates.one_of_each(docs).columns == docs.columns


def test_copy_with_few_keys_of_a_large_family_is_met(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "RARE", 3)
    root = list(range(1, 65))  # of 320 shingles; the copy lacks 26 of the first 60, and 0.8 of all are left
    copy = list(range(1, 9)) + list(range(10, 61, 2)) + list(range(61, 91))
    rows = [(i, 320, root) for i in range(1, 7)] + [(9, 256, copy)]
    nodes = spark.createDataFrame(rows, "node long, n long, sketch array<long>")
    members, crowded = near_duplicates._listed(nodes, 80)
    assert {x.node for x in crowded.collect()} == {1, 2, 3, 4, 5, 6, 9}
    # six of the sets are whole in long lists, the seventh has 40 rare shingles that no other has
    whole = [(i, k) for i in range(1, 7) for k in range(320)] + [(9, k) for k in [*range(216), *range(900, 940)]]
    every = near_duplicates._lists(spark.createDataFrame(whole, "node long, key long"), "test")
    stars, dense = near_duplicates._stars(members, crowded, every, 80)
    assert {x.node: x.slack for x in dense.collect()} == {**dict.fromkeys(range(1, 7), 20 * 320), 9: 20 * 256 - 180 * 39}
    assert {(x.x, x.y) for x in stars.collect()} == {(6, y) for y in (1, 2, 3, 4, 5, 9)}


def test_one_row_of_each_component(spark):
    r = random.Random(9)
    a, b, c = (" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(r.randrange(900)) for _ in range(60)) for _ in range(3))
    rows = [
        (1, a), (1, a), (1, a.upper()), (2, a + " more"),  # equal rows, an equal set and a near copy: one stays
        (3, b), (4, c), (4, b + " tail"),  # an id with two texts: the copy of 3 goes
        (None, "one alone " + " ".join(map(str, range(40)))), (None, a + " end"), (None, b + " end"),
        (None, "x y z " + " ".join(map(str, range(100, 140)))), (None, "x y z " + " ".join(map(str, range(100, 140)))),
        (None, None), (7, ""), (7, ""), (None, " \t\n"),
    ]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, lang string").repartition(3)
    out = near_duplicates.one_of_each(docs)
    got = [(x.doc_id, x.text) for x in out.collect()]
    assert out.columns == docs.columns
    one = [t for k, t in got if k == 1]
    assert len(one) == 1 and one[0] in (a, a.upper())
    want = [(3, b), (4, c), rows[7], rows[10], rows[12], rows[13], rows[14], rows[15]]
    assert sorted((x for x in got if x[0] != 1), key=str) == sorted(want, key=str)
    flags = near_duplicates.groups(docs, size=5, percent=80).filter("kept").collect()
    assert {x.doc_id for x in flags} == {1, 3, 4, 7}
