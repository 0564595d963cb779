import itertools
import random

import numpy as np

from chainsurf.llm import main_text as m

SCHEMA = "page_id long, url string, html string"


def texts(page):
    return [b[0] for b in m.blocks(page)]


def kept(page):
    """The article of a page without a host around it."""
    found = list(m.blocks(page))
    return m.section_texts([("\n".join(b[0] for b in found), "".join(chr(48 + 4 * b[1] + 2 * b[2] + b[3]) for b in found))])[0]


def test_blocks():
    assert texts("<p>a<br>b\n <b>c</p>d<div>e &lt;&amp;amp; &eacute; f</div>") == ["a b c", "d", "e <&amp; é f"]
    assert texts("a < b & c <3") == ["a < b & c <3"]
    assert texts('<script>"</p>"</script>x<style>y</style><!-- z --><textarea><p>q</textarea>') == ["x"]
    assert texts("<p>cut <a href='x") == ["cut"] and texts("<p>x<!-- open") == ["x"] and texts("<script>open") == []
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("") == [] and texts(" \n ") == [] and texts("<p></p>") == []
    assert texts('<p title="a>b">x<p title=it\'s>y') == ["x", "y"]


def test_named_parts_go():
    page = """<body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <main><article><header><h1>Title</h1><p>by me</p></header><p>One <b>two</b>.<aside>Also read</aside><p>Three <span class="ad">buy</span> four.
    <form><input><label>Mail</label></form><section id="comments"><article class="comment"><p>First!</article></section></article></main>
    <div class="sidebar"><p>Side</div><footer>&copy; us</footer>"""
    assert kept(page) == "Title\n\nOne two.\n\nThree\n\nfour."
    assert kept("<article><p>x<nav><a>n</a></nav><p hidden>h<p>y<div role=dialog>d</div></article>z") == "x\n\ny"
    assert kept("<div><p>no article is marked<div class=menu>m</div></div>") == "no article is marked"


def test_deep_and_broken_markup_takes_linear_time():
    for s in ("<" * 50_000, "<p>" * 20_000, "<b>" * 50_000, "<div>" * 30_000 + "</p>" * 30_000, "<a>" * 30_000 + "</a>" * 30_000, '<a b="' * 30_000, "<!--" * 30_000, "<i class=ad>" * 3_000):
        list(m.blocks(s + "end"))


def test_spread_against_brute_force():
    r = random.Random(6)
    for _ in range(30):
        n_pages = r.randrange(1, 6)
        pages = [[r.randrange(3) for _ in range(r.randrange(0, 30))] for _ in range(n_pages)]
        content = [r.randrange(n_pages) for _ in range(n_pages)]
        holders = {}
        for p, c in zip(pages, content, strict=True):
            for i in range(len(p) - m.DEPTH + 1):
                holders.setdefault(tuple(p[i:i + m.DEPTH]), set()).add(c)
        want = [len(holders[tuple(p[i:i + m.DEPTH])]) if i + m.DEPTH <= len(p) else 0 for p in pages for i in range(len(p))]
        tokens = np.array(list(itertools.chain(*pages)), dtype=np.int64)
        of = np.repeat(np.arange(n_pages), [len(p) for p in pages])
        got = m.host_spread(tokens, of, np.array(content, dtype=np.int64)[of])
        assert got.tolist() == want


def test_boilerplate_without_any_helpful_markup(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    body = lambda n: " ".join(word() for _ in range(n))
    banner, foot = body(12), body(25)
    articles = [[body(40), body(30)] for _ in range(9)]
    articles[8] = articles[7]  # the same article at two places
    page = lambda a: f"<div>{banner}</div><div><div>{a[0]}</div><div>{a[1]}</div></div><div>{foot}</div>"
    rows = [(i, f"https://h.example.com/{i}", page(a)) for i, a in enumerate(articles)]
    rows += [(20, "https://other.example.com/", page(articles[0])), (21, None, None), (None, "https://h.example.com/x", ""), (22, "no host", "<p>t")]
    marked = "".join(f"<p>{body(20)}" for _ in range(3))
    same = body(15)  # in all articles of a host, and in no other place
    rows += [(40 + i, f"http://Marked.example.com/{i}", f"<div>{foot}</div><article><p>{body(50)}<p>{same}{marked if i < 2 else ''}</article>") for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS host", "1 AS texts", "2 AS _part").repartition(3)
    got = {x.page_id: x.text for x in m.extract(df).collect()}
    assert len(got) == len(rows)
    for i, a in enumerate(articles):
        assert got[i] == "\n\n".join(a)
    assert got[20] == "\n\n".join([banner, *articles[0], foot])  # one page of a host tells nothing
    assert got[21] == "" and got[None] == "" and got[22] == "t"
    for i in range(6):
        assert foot not in got[40 + i] and same not in got[40 + i] and len(got[40 + i].split()) >= 50
    again = {x.page_id: (x.text, x.n_chars, x.url) for x in m.extract(df.repartition(7)).collect()}
    assert {k: v[0] for k, v in again.items()} == got and all(v[1] == len(v[0]) for v in again.values())


def test_crowded_host_and_long_page(spark):
    text = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, "http://a.example.com/1", f"<article><p>{text}</article>")] + [(i, f"http://a.example.com/{i}", f"<article><h1>t{i}</h1><p>same text</article>") for i in range(2, 400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert m._crowded(df).first().n_parts > 1
    got = {x.page_id: x.text for x in m.extract(df).collect()}
    assert got[1] == text and got[2] == "t2\n\nsame text" and len(got) == 399
    assert m.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_host_is_counted_whole_however_it_is_dealt_and_cut(spark, monkeypatch):
    r = random.Random(8)
    body = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    banners = [body(12) for _ in range(4)]  # on 24, 12, 8 and 6 of 25 distinct pages; below a fifth of them on fewer than 5
    rare, same = body(12), body(14)
    rows = []
    for i in range(25):
        tops = [b for k, b in enumerate(banners, 1) if i and i % k == 0] + [rare] * (i < 4)
        rows.append((i, f"http://h.example.com/{i}", "".join(f"<div>{t}</div>" for t in tops) + f"<div>{body(30)}</div>"))
    rows += [(100 + i, f"http://h.example.com/again/{i}", rows[i % 3][2]) for i in range(40)]  # copies count once
    rows += [(200 + i, f"http://m.example.com/{i}", f"<article><p>{body(20)}<p>{same if i < 7 else body(14)}<p>{body(9)}</article>") for i in range(11)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = None
    for part, section in ((m.PART, m.SECTION), (500, m.SECTION), (2_000, 1), (m.PART, 700), (300, 900)):
        monkeypatch.setattr(m, "PART", part)
        assert (m._crowded(df).count() > 0) == (part < 1 << 18)
        monkeypatch.setattr(m, "SECTION", section)
        got = {x.page_id: x.text for x in m.extract(df.repartition(3)).collect()}
        want = got if want is None else want
        assert got == want
    assert not any(b in t for b in banners for t in want.values()) and sum(rare in want[i] for i in range(25)) == 4
    assert all(want[100 + i] == want[i % 3] for i in range(40)) and not any(same in t for t in want.values())
    # other hosts, however large, change nothing
    more = spark.createDataFrame([(1000 + i, f"http://other{i}.example.com/", "<p>" + body(40)) for i in range(50)], SCHEMA)
    assert {x.page_id: x.text for x in m.extract(df.unionByName(more)).collect() if x.page_id < 1000} == want
