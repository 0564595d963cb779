import hashlib
import random
import time

import numpy as np
import pytest

from chainsurf.llm import pieces

TEXTS = ["Hello world", "  two  spaces ", "line\nend\n\n next", " ", "\n", "", None, "a", "é ñ 😀\t\x00", "▁mark ▁", "thndthathe ouninging", "x" * 300, "thatthing thatthing"]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load()


def every(model, word):
    """(score, ids) of all segmentations."""
    if not word:
        return [(0, [])]
    out = []
    for k in range(1, len(word) + 1):
        found = model.texts.get(word[:k])
        first = [(int(found[1]), [found[0]])] if found else [(model.unknown, [model.byte_ids[b] for b in word[:1].encode()])] if k == 1 else []
        out += [(s + t, ids + more) for s, ids in first for t, more in every(model, word[k:])]
    return out


def test_nbest_against_all_segmentations(model):
    r = random.Random(1)
    words = [pieces.MARK + "".join(r.choice(["th", "e", "a", "ing", "n", "é", "\x01", "on"]) for _ in range(r.randrange(1, 5))) for _ in range(40)]
    for word, (ids, score, loss) in zip(words, model.solve(words)):
        want = sorted(every(model, word), key=lambda x: (-x[0], x[1]))
        assert model.nbest(word, 5) == want[:5]
        assert score == want[0][0] and (score, ids) in want
        assert loss == (want[0][0] - want[1][0] if len(want) > 1 else -1)


def test_texts(spark, model):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_pieces int").repartition(2)
    got = {x.doc_id: x for x in pieces.encode(docs).collect()}
    again = {x.doc_id: x for x in pieces.encode_digest(docs).collect()}
    for i, t in enumerate(TEXTS):
        whole = pieces.MARK + (t or "").replace(pieces.MARK, pieces.OWN_MARK).replace(" ", pieces.MARK) if t else ""
        best = model.nbest(whole, 3) if len(whole) < 60 else None
        x = got[i]
        assert model.decode(x.ids) == (t or "")
        assert x.n_pieces == len(x.ids) and x.score == x.scores[0]
        if best:
            assert x.scores == [float(s) for s, _ in best]
        y = again[i]
        assert y.round_trip and y.scores == x.scores
        assert y.ids_sha256 == hashlib.sha256(np.array(x.ids, "<i4").tobytes()).hexdigest()
    back = {x.doc_id: x.text for x in pieces.decode(pieces.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    assert pieces.encode_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_all_n_segmentations(spark, model):
    r = random.Random(3)
    texts = [t for t in TEXTS if not t or len(t) < 60] + [" ".join(r.choice(["the", "an", "xxx", "tha", "=======", "é\x01", "on"]) for _ in range(r.randrange(1, 7))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    again = {x.doc_id: x for x in pieces.encode_digest(docs, n=4).collect()}
    for x in pieces.encode(docs, n=4).collect():
        t = texts[x.doc_id] or ""
        whole = pieces.MARK + t.replace(pieces.MARK, pieces.OWN_MARK).replace(" ", pieces.MARK) if t else ""
        assert list(zip(x.scores, x.nbest_ids)) == model.nbest(whole, 4)
        if len(whole) < 12 and pieces.OWN_MARK not in whole:
            assert list(zip(x.scores, x.nbest_ids)) == sorted(every(model, whole), key=lambda y: (-y[0], y[1]))[:4]
        assert x.ids == x.nbest_ids[0] and all(model.decode(ids) == t for ids in x.nbest_ids)
        assert again[x.doc_id].round_trip and again[x.doc_id].nbest_sha256 == [hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() for ids in x.nbest_ids]


def test_runs_of_spaces_over_the_full_vocabulary(spark, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    least = min(sp.get_score(i) for i in ids if sp.get_score(i) > pieces.LEAST)
    full = pieces.Pieces({sp.id_to_piece(i): (i, max(sp.get_score(i), least)) for i in ids}, model.byte_ids)
    assert "▁▁▁▁" in full.texts
    r = random.Random(5)
    texts = ["x    return", "a  b", "  a", "   ", "\n  ", "a  ", " \n\n   b", "    ", "", "  a \n", "def f:\n" + " " * 37 + "x  =  1" + " " * 21, "\n", " "]
    texts += ["".join(r.choice(["a", "re", " ", "  ", "    ", "\n"]) for _ in range(r.randrange(1, 9))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {x.doc_id: x for x in pieces.encode(docs, n=4).collect()}
    again = {x.doc_id: x for x in pieces.encode_digest(docs, n=4).collect()}
    for i, t in enumerate(texts):
        whole = (pieces.MARK + t).replace(" ", pieces.MARK) if t else ""
        found = list(zip(got[i].scores, got[i].nbest_ids))
        assert found == full.nbest(whole, 4)
        if len(whole) < 13:
            assert found == sorted(every(full, whole), key=lambda y: (-y[0], y[1]))[:4]
        assert again[i].round_trip and again[i].scores == got[i].scores
    assert got[0].score == -33047 and [sp.id_to_piece(i) for i in got[0].ids] == ["▁x", "▁▁▁▁", "re", "turn"]


def test_scores_that_are_not_whole():
    """Pieces with log probabilities, made up here: sums and ties stay exact."""
    r = random.Random(6)
    made = {pieces.MARK: (256, -1.0)}
    for i in range(60):
        made["".join(r.choice("aeinorst") for _ in range(r.randrange(1, 4)))] = (300 + i, -r.randrange(1, 1 << 12) / 256)
    model = pieces.Pieces(made, list(range(256)))
    assert model.scale == 256
    for word in ("".join(r.choice("aeinorstx") for _ in range(r.randrange(1, 9))) for _ in range(60)):
        want = sorted(every(model, word), key=lambda x: (-x[0], x[1]))[:4]
        assert model.nbest(word, 4) == want
        (ids, score, loss), = model.solve([word])
        assert (score, ids) == want[0] and loss == (want[0][0] - want[1][0] if len(want) > 1 else -1)
    by_score = pieces.Pieces({pieces.MARK: (256, -1.0), "a": (257, -2.75), "b": (258, -2.75), "ab": (259, -5.625)}, list(range(256)))
    assert by_score.nbest("ab", 2) == [(-44, [257, 258]), (-45, [259])] and by_score.scale == 8


def test_long_runs_of_equal_scores(model):
    """Ties are many in a ruler; each node is extended n times only, and both ways to solve a word agree."""
    word = pieces.MARK + "=" * 3000
    began = time.time()
    found = model.nbest(word, 3)
    assert time.time() - began < 20 and len(found) == 3
    assert all(model.decode(ids) == word[1:] for _, ids in found)
    for w in (pieces.MARK + "=" * 300, pieces.MARK + "thatthing" * 40, "xyzzy" * 50):
        ids, size, score, loss = model._solve([w], len(w))
        two = model.nbest(w, 2)
        assert (score[0], ids.tolist()) == two[0] and loss[0] == two[0][0] - two[1][0] and size[0] == len(ids)


def test_pipeline_rows_rebuild_the_corpus(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = corpus_pipeline.encoded(spark, docs, "")
    assert {x.doc_id: x.text for x in pieces.decode(out).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert all(x.round_trip for x in out.collect())


def test_long_unspaced_text_needs_bounded_memory(model):
    import tracemalloc

    r = random.Random(8)
    word = pieces.MARK + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40_000))
    tracemalloc.start()
    found = model.paths(word, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(word)
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True) and len({ids.tobytes() for _, ids in found}) == 3
    assert all(model.decode(ids.tolist()) == word[1:] for _, ids in found)
    ids, score, loss = model.solve([word])[0]
    assert (score, score - loss) == (found[0][0], found[1][0]) and ids == found[0][1].tolist()


def test_searches_under_a_bound_lose_nothing(model):
    r = random.Random(21)
    for _ in range(150):
        word = "".join(r.choice(["a", "b", "=", "an", "th", "\x01", "é"]) for _ in range(r.randrange(0, 9)))[:9]
        want = sorted(every(model, word), key=lambda x: (-x[0], x[1]))
        for n in (1, 2, 3, 30):
            assert model.nbest(word, n) == want[:n]
