import hashlib
import itertools
import random
import zlib

from chainsurf.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_repair(rows):
    """(cost, audit) by all states, row by row; ``rows`` are (initial, fault)."""
    best = {"": (0, "")}

    def inserted(at):
        for _ in range(3):
            for q, (cost, path) in list(at.items()):
                to = "u" if q != "u" else "a"
                at[to] = min(at.get(to, (1 << 40, "")), (cost + 5, path + "I"))
        return at

    for initial, fault in rows:
        out = {}
        for q, (cost, path) in inserted(best).items():
            moves = [(q, 2, "D")]
            if fault != 1:
                extra = 5 if fault == 2 else 0
                if (q, initial) in NEXT:
                    moves.append((NEXT[q, initial], extra, "K"))
                moves.append(("u" if q != "u" else "a", extra + 1, "R"))
            for to, more, edit in moves:
                out[to] = min(out.get(to, (1 << 40, "")), (cost + more, path + edit))
        best = out
    return min(v for q, v in inserted(best).items() if q in ("", "a"))


def codes(rows):
    return bytes(4 * "saux".index(i) + f for i, f in rows)


def test_search_against_all_states():
    kinds = [(i, f) for i in "saux" for f in (0, 1, 2)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert c.repair(codes(rows)) == plain_repair(rows), rows
    r = random.Random(3)
    for _ in range(150):
        rows = [(r.choice("suauaauax"), r.choice((0, 0, 0, 0, 1, 2))) for _ in range(r.randrange(4, 40))]
        assert c.repair(codes(rows)) == plain_repair(rows), rows


def test_blocks_of_long_conversations():
    r = random.Random(4)
    for n in (c.BLOCK - 1, c.BLOCK, c.BLOCK + 1, 3 * c.BLOCK, 700):
        rows = [("ua"[k % 2] if r.random() < 0.8 else r.choice("suax"), r.choice((0, 0, 0, 0, 0, 1, 2))) for k in range(n)]
        assert c.repair(codes(rows)) == plain_repair(rows)


def plain_audit(rows):
    damaged = {}
    for conv, turn, role, text in rows:
        mine = damaged.setdefault(conv, [])
        one = lambda v: " " if v is None else v
        kind, role, text = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20, one(role), one(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, mine in damaged.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in mine]
        rows = [(i if i and i in "sau" else "x", {"": 0, "truncated": 2}.get(f, 1)) for i, f in zip(initials, faults, strict=True)]
        cost, audit = plain_repair(rows)
        turns = [t for t, _, _ in mine if t is not None]
        said, state, at = [], "", 0
        for edit in audit:
            to = "u" if state != "u" else "a"
            name = "user" if to == "u" else "assistant"
            if edit == "I":
                said, state = [*said, name + ":"], to
                continue
            _, role, text = mine[at]
            at += 1
            if edit == "K":
                said, state = [*said, f"{role}:{text}"], NEXT[state, role[0]]
            elif edit == "R":
                said, state = [*said, f"{name}:{text}"], to
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    texts = ["Hi.", "Hello there!", "Why?", "no end", "", " \n", "Yes. \t", "é?", "x" * 200_000 + "."]
    rows = []
    for conv in [None, -1, *range(60)]:
        for k in range(r.choice((1, 2, 5, 9, 150 if conv == 7 else 6))):
            turn = r.choice((k, k, k, k + 40, None))
            role = r.choice(("user", "assistant")) if r.random() < 0.2 else ("user", "assistant")[k % 2]
            rows.append((conv, turn, r.choice((role, role, role, "system", "", None, "Élan")), r.choice((*texts, None))))
    rows += rows[:40]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS _phase", "2 AS copies", "3 AS _fault")
    got = {x[0]: tuple(x[1:]) for x in c.repaired(df.repartition(5)).collect()}
    assert got == plain_audit(rows)


def test_empty_table_and_one_exchange(spark):
    out = c.repaired(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[-1] == "repaired_sha256"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
