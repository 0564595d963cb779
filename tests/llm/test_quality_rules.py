import re
from collections import Counter

from chainsurf.llm import quality_rules

GOOD = "The quick brown fox jumps over the lazy dog near a river bank, and then rests. "


def long_good(i):
    """80 words of five letters, with commas and full stops as prose has them."""
    word = lambda j: f"w{'abcdefghij'[(i * j) % 10]}{'klmnopqrst'[j % 10]}{'uvwxyz'[(i + j) % 6]}{'abcdefghij'[(j // 7) % 10]}"
    return " ".join(word(j) + ("." if j % 10 == 9 else "," if j % 16 == 4 else "") for j in range(80))


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    twice = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice)


TEXTS = [None, "", " \n\t", "one", "a b c a b c", "x x x x x x", GOOD * 3, "é# *\n\né# *\nlast", "a b c\x0bd", "line\nline\n line\n" * 5, "\U0001f600 | <b>"]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int").select("doc_id", "text")
    got = {x.doc_id: x for x in quality_rules.judge(docs).collect()}
    for i, t in enumerate(TEXTS):
        x = got[i]
        n = brute(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == n, t
        assert x.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (x.base_failed and x.kept)


def test_votes_learn(spark):
    rows = [(i, long_good(i)) for i in range(60)] + [(100 + i, re.sub(r" ", "### ", long_good(i))) for i in range(15)] + [(200 + i, long_good(i).upper().replace(" ", "!! ")) for i in range(10)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, vote_symbols string")
    judged = {x.doc_id: x.kept for x in quality_rules.judge(docs.drop("vote_symbols")).collect()}
    assert all(judged[k] for k in range(60)) and not any(judged[k] for k in judged if 100 <= k < 200)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {k for k, v in judged.items() if v}


NAMES = list(quality_rules.RULES)


def patterns(spark, rows):
    """rows: (n, {rule: vote}); other rules that can vote good do so."""
    full = [(n, *[v.get(k, 1 if quality_rules.RULES[k][1] else 0) for k in NAMES]) for n, v in rows]
    return full, spark.createDataFrame(full, "n long, " + ", ".join(f"vote_{k} int" for k in NAMES))


#: Many good texts on which one of the weak rules errs; junk on which strong rules and several weak ones agree.
SEEN = [(9000, {}), (300, {"stops": -1}), (300, {"commas": -1}), (200, {"commas": 0}), (40, {"lines": -1}), (500, {"symbols": -1, "lengths": -1}), (300, {"shouting": -1, "stops": -1, "commas": -1}), (400, {"repeats": -1, "lines": -1, "commas": -1, "stops": -1}), (3, {"stops": -1, "commas": -1, "lines": -1})]


def test_estimates_equal_brute_force(spark):
    full, table = patterns(spark, SEEN)
    got = quality_rules.fit(table)
    # expectation maximisation over single numbers, in plain Python
    rate = quality_rules.PRIOR_GOOD
    share = {(y, k, v): x for k, rule in quality_rules.RULES.items() for y in (0, 1) for v, x in zip((-1, 0, 1), rule[2 + y])}
    extra, start = quality_rules.PRIOR_TEXTS, dict(share)
    for rounds in range(1, quality_rules.ROUNDS + 1):
        q = []
        for _, *vs in full:
            good, bad = rate, 1 - rate
            for k, v in zip(NAMES, vs, strict=True):
                good, bad = good * share[1, k, v], bad * share[0, k, v]
            q.append(good / (good + bad))
        size = {1: sum(r[0] * x for r, x in zip(full, q, strict=True)), 0: sum(r[0] * (1 - x) for r, x in zip(full, q, strict=True))}
        for y, k, v in share:
            hit = sum(r[0] * (x if y else 1 - x) for r, x in zip(full, q, strict=True) if r[1 + NAMES.index(k)] == v)
            share[y, k, v] = (hit + extra * start[y, k, v]) / (size[y] + extra)
        before, rate = rate, (size[1] + extra * quality_rules.PRIOR_GOOD) / (sum(size.values()) + extra)
        if abs(rate - before) < quality_rules.SETTLED:
            break
    assert got["rounds"] == rounds < quality_rules.ROUNDS and abs(got["good"] - rate) < 1e-9
    for i, (k, v) in enumerate(quality_rules.CELLS, 1):
        assert abs(got["on_bad"][i] - share[0, k, v]) < 1e-9 and abs(got["on_good"][i] - share[1, k, v]) < 1e-9


def test_the_posterior_decides_not_single_votes(spark):
    full, table = patterns(spark, SEEN)
    p = quality_rules.fit(table)
    judged = table.selectExpr(*[f"vote_{k}" for k in NAMES], quality_rules.posterior_sql(p["w"]) + " >= 0.5 AS kept").collect()
    judged = {tuple(r)[:-1]: r.kept for r in judged}
    kept = [judged[r[1:]] for r in full]
    # one weak rule against a text does not reject it, three of them together do
    assert kept[:5] == [True] * 5 and kept[5:] == [False] * 4
    # a rule that errs often on good texts weighs less than one that does not
    right = quality_rules.accuracies(p)
    assert right["stops"] < right["symbols"] and right["commas"] < right["shouting"]


def test_accuracies_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep(none).count() == 0
    p = quality_rules.fit(patterns(spark, [])[1])
    assert p["good"] == quality_rules.PRIOR_GOOD and all(0.5 < a <= 1 for a in quality_rules.accuracies(p).values())
