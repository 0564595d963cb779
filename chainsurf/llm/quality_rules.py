"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a text; some rules never vote
good.  Expectation maximisation over the table of vote patterns (at most 3 ** 3 * 2 ** 4
rows) estimates how often each rule votes so on good and on bad texts, hence its
accuracy, and the posterior probability that a text is good replaces all-must-pass
filtering: one vote of a rule that often errs on good texts does not reject a text,
several of them together do.  The estimates start from ``RULES``' own shares, which count
as ``PRIOR_TEXTS`` texts only, and the rounds end when the share of good texts settles.

Defined cases: a null text counts as empty; an empty text has zero counts and
fails the base test; repeated rows each get the same result; extra columns are
ignored by ``judge`` and kept by ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, stored

WORD = r"[^\x20\x09-\x0D]+"

#: rule: bad if, good if (or never), over the columns of ``measure``; then the shares of votes
#: (bad, none, good) that are taken to fall on bad texts and on good ones before any text is seen.
RULES = {
    "symbols": ("100 * n_symbols > 3 * word_chars", None, (0.4, 0.6), (0.002, 0.998)),
    "shouting": ("100 * n_capitals > 20 * word_chars OR 10 * n_bangs > n_words", None, (0.4, 0.6), (0.002, 0.998)),
    "repeats": ("100 * n_repeat_words > 30 * n_words", None, (0.4, 0.6), (0.002, 0.998)),
    "lines": ("100 * n_dup_lines > 20 * n_lines", None, (0.3, 0.7), (0.02, 0.98)),
    "stops": ("100 * n_stops < 5 * n_words OR 100 * n_stops > 14 * n_words", "100 * n_stops BETWEEN 6 * n_words AND 12 * n_words", (0.4, 0.2, 0.4), (0.1, 0.1, 0.8)),
    "commas": ("100 * n_commas < 3 * n_words OR 100 * n_commas > 10 * n_words", "100 * n_commas BETWEEN 4 * n_words AND 8 * n_words", (0.4, 0.2, 0.4), (0.1, 0.1, 0.8)),
    "lengths": ("10 * word_chars < 42 * n_words OR 10 * word_chars > 62 * n_words", "10 * word_chars BETWEEN 46 * n_words AND 56 * n_words", (0.4, 0.2, 0.4), (0.05, 0.05, 0.9)),
}
PRIOR_GOOD, PRIOR_TEXTS, ROUNDS, SETTLED = 0.85, 200, 24, 1e-4
#: Every vote that a rule can give, in a fixed order.
CELLS = [(k, v) for k, (_, good, _, _) in RULES.items() for v in ((-1, 0, 1) if good else (-1, 0))]


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeat_words(words: Column) -> Column:
    """How many of the words lie in 3-word windows that the array holds twice or more."""

    def covered(names: Column) -> Column:
        ranked = F.sort_array(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = let(ranked, lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    def of(w: Column) -> Column:
        names = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(names, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))

    return let(words, of)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules use, all bigint."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]", "")) > 0)
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    per_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return docs.withColumns({"_w": counts, "_l": per_line}).select(
        *docs.columns,
        F.col("_w.n_words").cast("bigint").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        _count(t, "#*$%&|<>").cast("bigint").alias("n_symbols"),
        F.col("_l.n_dup_lines").cast("bigint").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").cast("bigint").alias("n_repeat_words"),
        F.col("_l.n_lines").cast("bigint").alias("n_lines"),
        _count(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("bigint").alias("n_capitals"),
        _count(t, "!").cast("bigint").alias("n_bangs"),
        _count(t, ".").cast("bigint").alias("n_stops"),
        _count(t, ",").cast("bigint").alias("n_commas"),
    )


def votes(counts: DataFrame) -> DataFrame:
    """One int column vote_<rule> for each rule: -1, 0 or 1."""
    return counts.withColumns({f"vote_{k}": F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good or 'false'} THEN 1 ELSE 0 END") for k, (bad, good, _, _) in RULES.items()})


def prior(side: int) -> list[float]:
    """The shares of ``RULES`` on bad (0) or good (1) texts, in the order of ``CELLS``."""
    return [x for rule in RULES.values() for x in rule[2 + side]]


def weights(good: float, on_bad: list[float], on_good: list[float]) -> list[float]:
    """The log odds of a good text without votes, then what each vote of ``CELLS`` adds to them."""
    return [math.log(good / (1 - good)), *(math.log(b / a) for a, b in zip(on_bad, on_good, strict=True))]


def posterior_sql(w: list[float]) -> str:
    """P(good | votes) as SQL text, from ``weights``."""
    return f"1 / (1 + exp(-({w[0]!r}" + "".join(f" + CASE WHEN vote_{k} = {v} THEN {x!r} ELSE 0 END" for (k, v), x in zip(CELLS, w[1:], strict=True)) + ")))"


def fit(patterns: DataFrame, rounds: int = ROUNDS, settled: float = SETTLED) -> dict:
    """Expectation maximisation over the vote patterns (votes, n), as one aggregation.

    The patterns become one array (its length is bounded by the votes there are), and the
    rounds fold it: {'good', 'w', 'on_bad', 'on_good', 'rounds'}.  An empty table gives the prior.
    """
    start = weights(PRIOR_GOOD, prior(0), prior(1))
    doubles = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    zero, pseudo_bad, pseudo_good = (doubles(x) for x in ([0.0] * len(start), [1 - PRIOR_GOOD, *prior(0)], [PRIOR_GOOD, *prior(1)]))
    hot = F.array(F.lit(1.0), *[F.when(F.col(f"vote_{k}") == v, 1.0).otherwise(0.0) for k, v in CELLS])
    held = patterns.agg(F.sort_array(F.collect_list(F.struct(hot.alias("hot"), F.col("n").cast("double").alias("n")))).alias("seen"))
    add = lambda sums, x, n: F.zip_with(sums, x["hot"], lambda s, h: s + h * n)
    held = held.withColumn("every", F.aggregate("seen", zero, lambda s, x: add(s, x, x["n"])))

    def share(sums: Column, pseudo: Column) -> Column:
        """Shares of the votes, from their sums over a class and the prior's texts; the class's own size comes first."""
        extra = F.lit(float(PRIOR_TEXTS))
        return F.zip_with(sums, pseudo, lambda s, p: (s + extra * p) / (sums[0] + extra))

    def round_(state: Column) -> Column:
        q = lambda x: 1 / (1 + F.exp(-F.aggregate(F.zip_with(x["hot"], state["w"], lambda h, w: h * w), F.lit(0.0), lambda a, b: a + b)))
        good = F.aggregate(F.transform("seen", lambda x: F.struct(x["hot"].alias("hot"), (x["n"] * q(x)).alias("n"))), zero, lambda s, x: add(s, x, x["n"]))
        sums = let(good, lambda g: F.struct(g.alias("good"), F.zip_with("every", g, lambda a, b: a - b).alias("bad")))

        def updated(both: Column) -> Column:
            rate = (both["good"][0] + PRIOR_TEXTS * PRIOR_GOOD) / (F.col("every")[0] + PRIOR_TEXTS)
            on_bad, on_good = share(both["bad"], pseudo_bad), share(both["good"], pseudo_good)
            w = F.transform(F.zip_with(on_bad, on_good, lambda a, b: F.log(b / a)), lambda x, i: F.when(i == 0, F.log(rate / (1 - rate))).otherwise(x))
            return F.struct(rate.alias("good"), w.alias("w"), on_bad.alias("on_bad"), on_good.alias("on_good"), F.abs(rate - state["good"]).alias("change"), (state["rounds"] + 1).alias("rounds"))

        return let(sums, updated)

    first = F.struct(F.lit(PRIOR_GOOD).alias("good"), doubles(start).alias("w"), doubles([0.0, *prior(0)]).alias("on_bad"), doubles([0.0, *prior(1)]).alias("on_good"), F.lit(1.0).alias("change"), F.lit(0).alias("rounds"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda state, _: F.when(state["change"] < settled, state).otherwise(round_(state)))
    return held.select(folded.alias("p")).first()["p"].asDict()


def accuracies(p: dict) -> dict[str, float]:
    """P(a rule's vote is right | it votes), for each rule."""
    out = {}
    for k in RULES:
        at = {v: i for i, (name, v) in enumerate(CELLS, 1) if name == k}
        right, wrong = (1 - p["good"]) * p["on_bad"][at[-1]], p["good"] * p["on_good"][at[-1]]
        if 1 in at:
            right, wrong = right + p["good"] * p["on_good"][at[1]], wrong + (1 - p["good"]) * p["on_bad"][at[1]]
        out[k] = right / (right + wrong)
    return out


def _fitted(counted: DataFrame) -> dict:
    return fit(counted.groupBy(*[f"vote_{k}" for k in RULES]).agg(F.count(F.lit(1)).alias("n")))


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, counts, votes, base_failed, p_good, kept) for each row of ``docs``."""
    counted = stored(votes(measure(docs.select(key, text), text).drop(text)), "quality-votes")
    return counted.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("p_good", F.expr(posterior_sql(_fitted(counted)["w"]))).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is judged good, with their own columns."""
    row = F.struct(*docs.columns).alias("_row")  # under one name, so that no column clashes with a count
    counted = votes(measure(docs.select(row, F.col(text).alias("_t")), "_t").drop("_t"))
    counted = stored(counted, "quality-votes")  # filters on the counts would otherwise compute them again for each use
    return counted.filter(f"NOT ({BASE_FAILED}) AND {posterior_sql(_fitted(counted)['w'])} >= {threshold}").select("_row.*")
