"""The main text of web pages, by host suffix arrays.

A page is cut into blocks of text; each block knows whether its markup calls it
something else than the article (menus, footers, forms, adverts, comments, ...), whether it
stands in a marked article or main part, and whether most of it is links.  The pages of a
host are then laid end to end as one stream of words and block bounds, and the sorted
suffixes of the stream (prefix doubling, down to ``DEPTH`` tokens) bring equal strings of
``DEPTH`` tokens together.  Strings that many distinct articles of the host come with are its
boilerplate: outside a marked article the words they cover are taken out and the unique
runs stay; inside, only blocks that are covered whole, and by strings of most articles, go.
Blocks that their markup names go in any case, as do blocks beside a marked article.

Strings are counted over the whole host, however large it or the table is.  Of pages with
the same article one counts, that of the smallest hash.  Pages are exchanged once, by host
and, for hosts with more than a 4,096th of all bytes (4,096 at most, so their table may be
broadcast), by a hash of the article, so that equal articles meet.  Three passes read that
exchange.  The first sorts suffixes section by section (``SECTION`` bytes of pages that
count) and reports strings of a fifth of a section's articles: a string of a fifth of the
host's is reported by one section at least, and what sections don't report is bounded, so
that few candidates stay.  The second counts these in every section, the third takes the
boilerplate out.  How a host is dealt and cut decides who counts, not what comes out.
Between sections a string goes by 64 bits.

A page that is covered for the most part is a copy, not boilerplate, and loses nothing
inside its article.  Null html and pages without any text give an empty text; null urls
share one host.  Equal pages of a host give equal texts; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, stored

DEPTH = 8
SECTION, PART, HOSTS = 1 << 20, 1 << 18, 4096
#: (least articles, least share of a host's articles) that make a string boilerplate, beside and in a marked article.
OUTSIDE, INSIDE = (3, 0.2), (4, 0.6)

BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Elements, roles and words of classes and ids that are never part of an article.
NOT_TEXT = RAW | frozenset("aside audio button canvas datalist dialog footer form head map math menu nav noscript object select svg template video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar widget widgets".split()
)
#: A start tag of the key ends an open element of the values.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""")
_PART = re.compile(r"[^a-z0-9]+")


class _Element:
    """An open element: its tag, and what holds for the text in it."""

    __slots__ = ("tag", "named", "header", "heading", "level", "link")

    def __init__(self, tag: str, inside: _Element | None, attributes: str):
        self.tag = tag
        self.named = self.header = self.heading = self.link = False
        self.level = 0
        if inside is not None:
            self.named, self.header, self.heading, self.level, self.link = inside.says()
        said = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        role = said.get("role", "").lower()
        words = set(_PART.split((said.get("class", "") + " " + said.get("id", "")).lower())) if said else set()
        self.link = self.link or tag == "a"
        self.heading = self.heading or tag in HEADINGS
        if tag in NOT_TEXT or role in ROLES or attributes and _HIDDEN.search(attributes) or said.get("aria-hidden") == "true":
            self.named = True
        elif tag not in ("html", "body", "main") and words & NAMES:
            self.named = True
        elif tag == "header" or "header" in words and tag not in HEADINGS and tag not in ("html", "body", "main", "article"):
            self.header = True
        elif tag == "article" or said.get("itemprop") == "articleBody":
            self.level = 2
        elif tag == "main" or role == "main":
            self.level = max(self.level, 1)

    def says(self) -> tuple[bool, bool, bool, int, bool]:
        return self.named, self.header, self.heading, self.level, self.link


def _said_end(page: str, tag: str, at: int) -> int:
    """Where the end tag of an element of raw text begins."""
    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
    return found.start() if found else len(page)


def blocks(page: str) -> Iterator[tuple[str, int, bool, bool]]:
    """(text, level, named, mostly links) of the blocks of a page that hold text.

    Level 2 is an article, 1 a main part, 0 the rest.  Of a page header inside an article
    only headings count.  Broken markup ends what has to end: an unclosed tag or comment
    reaches to the end of the page.
    """
    stack: list[_Element] = []
    opened: Counter[str] = Counter()  # elements on the stack, and with "+" those left off it, as they change nothing
    words: list[str] = []
    n_linked = 0
    top: _Element | None = None
    about = (0, False)

    def shut(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    def closed():
        nonlocal n_linked, words
        text = "".join(words).split()
        out = None
        if text:
            out = (" ".join(text), about[0], about[1], 2 * n_linked >= len(text))
        words, n_linked = [], 0
        return out

    def heard(text: str):
        """Text in the open element; a change of what it is starts a new block."""
        nonlocal about, n_linked
        if "&" in text:
            text = html.unescape(text)
        level, named, link = (top.level, top.named, top.link) if top is not None else (0, False, False)
        if top is not None and top.header and not (level == 2 and top.heading):
            named = True
        done = None
        if (level, named) != about:
            if not text.strip():
                words.append(text)
                return None
            done, about = closed(), (level, named)
        words.append(text)
        if link:
            n_linked += len(text.split())
        return done

    at, n = 0, len(page)
    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            open_ = n
        if open_ > at:
            done = heard(page[at:open_])
            if done:
                yield done
        if open_ == n:
            break
        after = page[open_ + 1:open_ + 2]
        if not (after.isascii() and (after.isalpha() or after in ("/", "!", "?"))) or after == "":
            done = heard("<")
            if done:
                yield done
            at = open_ + 1
            continue
        found = _TAG.match(page, open_) if after not in ("!", "?") else None
        if found is None:
            if page.startswith("<!--", open_):
                end = page.find("-->", open_ + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", open_)
                at = n if end < 0 else end + 1
            continue
        at = found.end()
        tag = found[2].lower()
        if tag == "br":
            words.append(" ")
            continue
        breaks = tag in BLOCK
        if breaks:
            done = closed()
            if done:
                yield done
        if found[1]:
            if opened["+" + tag]:
                opened["+" + tag] -= 1
            elif opened[tag]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        shut(i)
                        break
                    if not breaks and stack[i].tag in BLOCK:
                        break
        elif tag not in VOID:
            ended = ENDS.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                was = stack[i].tag
                if was in ended or was == "p" and breaks:
                    shut(i)
                    break
                if was in BLOCK and was != "p":
                    break
            element = _Element(tag, stack[-1] if stack else None, found[3])
            if tag in RAW:
                at = _said_end(page, tag, at)  # the end tag is read as any other; nothing is open under this name
                words.append(" ")
                continue
            if not breaks and stack and element.says() == stack[-1].says():
                opened["+" + tag] += 1
                continue
            stack.append(element)
            opened[tag] += 1
        top = stack[-1] if stack else None
    done = closed()
    if done:
        yield done


def host_spread(tokens: np.ndarray, page: np.ndarray, content: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each place, in how many distinct contents the ``depth`` tokens from there occur.

    The suffixes of the stream are sorted by their first 1, 2, 4, ... tokens; a string that
    would leave its page counts for nothing (0).
    """
    n = len(tokens)
    rank, reach = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while reach < depth:
        step = min(reach, depth - reach)
        later = np.zeros(n, dtype=np.int64)
        later[:n - step] = rank[step:] + 1
        key = rank * np.int64(n + 2) + later
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, dtype=bool)
        fresh[:1] = True
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh) - 1
        reach += step
    whole = np.zeros(n, dtype=bool)
    if n >= depth:
        whole[:n - depth + 1] = page[:n - depth + 1] == page[depth - 1:]
    at = np.flatnonzero(whole)
    order = at[np.lexsort((content[at], rank[at]))]
    r, c = rank[order], content[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    spread = np.bincount(r, weights=fresh, minlength=1).astype(np.int64) if len(r) else np.zeros(1, np.int64)
    out = np.zeros(n, dtype=np.int64)
    out[order] = spread[r]
    return out


def covered(starts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The places that lie within ``depth`` tokens from a marked start."""
    edge = np.zeros(len(starts) + depth, dtype=np.int64)
    edge[:len(starts)] += starts
    edge[depth:] -= starts
    return np.cumsum(edge)[:len(starts)] > 0


class Laid:
    """Pages as one stream of tokens; a page is its block texts and their marks, one line and one character a block."""

    def __init__(self, pages: list[tuple[str, str]]):
        self.split = [(t.split("\n") if m else [], [ord(c) - 48 for c in m]) for t, m in pages]
        self.names: dict[str, int] = {"\n": 0}
        names, tokens, page = self.names, [], []
        for i, (texts, _) in enumerate(self.split):
            before = len(tokens)
            for t in texts:
                tokens.append(0)
                tokens.extend([names.setdefault(w, len(names)) for w in t.split(" ")])
            page.append(np.full(len(tokens) - before, i, dtype=np.int64))
        self.tokens = np.array(tokens, dtype=np.int64)
        self.page = np.concatenate(page) if page else np.zeros(0, np.int64)

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of strings of ``DEPTH`` tokens that stay in their page, and their 64-bit names: the same in all tasks."""
        n = max(len(self.tokens) - DEPTH + 1, 0)
        word = np.array([_name(w) for w in self.names], dtype=np.int64).view(np.uint64)[self.tokens]
        name = np.zeros(n, dtype=np.uint64)
        for i in range(DEPTH):
            name = name * np.uint64(0x9E3779B97F4A7C15) + word[i:n + i]
        at = np.flatnonzero(self.page[:n] == self.page[DEPTH - 1:]) if n else np.zeros(0, np.int64)
        return at, name[at].view(np.int64)


def _name(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def article(texts: list[str], marks: list[int]) -> str:
    """The blocks of a page's article, before boilerplate is taken out."""
    root = _root(texts, marks)
    return "\n".join(t for t, m in zip(texts, marks, strict=True) if m >> 2 >= root and not m & 2)


def section_strings(pages: list[tuple[str, str]], whole: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """(names, in how many pages, least number of pages) of the strings that a section of distinct articles reports.

    These are its share of what may be boilerplate of the host; a section that is the
    ``whole`` host leaves out what can't be.
    """
    laid = Laid(pages)
    least = max(math.ceil(OUTSIDE[1] * len(pages) - 1e-9), OUTSIDE[0] if whole else 1)
    at, names = laid.strings()
    spread = host_spread(laid.tokens, laid.page, laid.page)[at]
    found, first = np.unique(names[spread >= least], return_index=True)
    return found, spread[spread >= least][first], least


def section_counts(pages: list[tuple[str, str]], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the sorted ``wanted`` names that occur, with the number of pages that hold them."""
    laid = Laid(pages)
    at, names = laid.strings()
    here = _within(names, wanted)
    name, page = names[here], laid.page[at[here]]
    order = np.lexsort((page, name))
    name, page = name[order], page[order]
    fresh = np.ones(len(name), dtype=bool)
    fresh[1:] = (name[1:] != name[:-1]) | (page[1:] != page[:-1])
    return np.unique(name[fresh], return_counts=True)


def _within(names: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which names are in a sorted table?"""
    if not len(table):
        return np.zeros(len(names), dtype=bool)
    return table[np.minimum(np.searchsorted(table, names), len(table) - 1)] == names


def section_texts(pages: list[tuple[str, str]], boilerplate: tuple[np.ndarray, np.ndarray] | None = None) -> list[str]:
    """The main texts of pages, by the sorted names of the host's boilerplate beside and in a marked article; if not given, the pages are a host."""
    laid = Laid(pages)
    if boilerplate is None:
        contents: dict[str, int] = {}
        content = np.array([contents.setdefault(article(*x), len(contents)) for x in laid.split], dtype=np.int64)
        spread = host_spread(laid.tokens, laid.page, content[laid.page])
        outside, inside = (covered(spread >= max(least, share * len(contents))) for least, share in (OUTSIDE, INSIDE))
    else:
        at, names = laid.strings()
        outside, inside = (np.zeros(len(laid.tokens), dtype=bool) for _ in boilerplate)
        for starts, table in zip((outside, inside), boilerplate, strict=True):
            starts[at] = _within(names, table)
        outside, inside = covered(outside), covered(inside)
    out, at = [], 0
    for texts, marks in laid.split:
        root, kept, whole, mine, theirs = _root(texts, marks), [], [], 0, 0
        for t, m in zip(texts, marks, strict=True):
            words = t.split(" ")
            here = slice(at + 1, at + 1 + len(words))
            at += 1 + len(words)
            if m & 2 or m >> 2 < root:
                continue
            if root:
                mine, theirs = mine + len(words), theirs + int(inside[here].sum())
                kept.append(t)
                whole.append(bool(inside[here].all()))
            elif m & 1:
                continue
            else:
                unique = [w for w, c in zip(words, outside[here], strict=True) if not c]
                if 2 * len(unique) >= len(words):  # what is left of a block is a run of its own; bits of boilerplate go with it
                    kept.append(t if len(unique) + DEPTH > len(words) else " ".join(unique))
                    whole.append(False)
        copy = 2 * theirs > mine
        out.append("\n\n".join(t for t, w in zip(kept, whole, strict=True) if copy or not w))
    return out


def _root(texts: list[str], marks: list[int]) -> int:
    """The level whose blocks are the page's article: marked articles if they hold half of the main part, else the main part, else all."""
    size = [0, 0, 0]
    for t, m in zip(texts, marks, strict=True):
        if not m & 2:
            size[m >> 2] += len(t)
    if size[2] and size[2] >= size[1]:
        return 2
    return 1 if size[1] + size[2] else 0


def _host(url: str):
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_extract(F.col(url), r"(?s)://(.*)", 1), "/", 1)).otherwise("")
    return F.lower(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^?#]*", 0))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, texts, marks, content) of each page; one line of ``texts`` and one character of ``marks`` is a block, ``content`` a hash of the article."""
    rows = pages.select("page_id", "url", _host("url").alias("host"), "html")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks, contents = [], [], []
            for page in batch.column("html"):
                found = list(blocks(page.as_py() or ""))
                texts.append("\n".join(b[0] for b in found))
                marks.append("".join(chr(48 + 4 * level + 2 * named + links) for _, level, named, links in found))
                contents.append(_name(article([b[0] for b in found], [4 * level + 2 * named + links for _, level, named, links in found])))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(texts, pa.string()), pa.array(marks, pa.string()), pa.array(contents, pa.int64())], ["page_id", "url", "host", "texts", "marks", "content"])

    return rows.mapInArrow(read, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, host string, texts string, marks string, content long")


def _crowded(pages: DataFrame) -> DataFrame:
    """(host, n_parts) of the hosts with more than a share of all bytes, at most ``HOSTS`` rows: how the work is dealt, no matter for its results."""
    sizes = stored(pages.select(_host("url").alias("host"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).groupBy("host").agg(F.sum("n").alias("n")), "hosts")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    most = max(PART, total // HOSTS)
    found = [(r.host, -(-r.n // most)) for r in sizes.filter(F.col("n") > most).collect()]
    discard(sizes)
    return pages.sparkSession.createDataFrame(found, "host string, n_parts long")


def _frequent(counts: DataFrame) -> DataFrame:
    """(host, name, n, articles) of strings in at least the least share of a host's articles, from sections' counts.

    A section says (host, name, n, least): a string is in n of its articles, and strings
    that it doesn't name in fewer than ``least``.  Its row without a name counts its articles.
    """
    rows = counts.groupBy("host", "name").agg(F.sum("n").alias("n"), F.sum(F.col("least") - 1).alias("unsaid"))
    host, total = Window.partitionBy("host"), F.col("name").isNull()
    rows = rows.withColumns({"articles": F.max(F.when(total, F.col("n"))).over(host), "slack": F.max(F.when(total, F.col("unsaid"))).over(host)})
    most = F.col("n") - F.col("unsaid") + F.col("slack")
    return rows.filter(~total & (most >= F.greatest(F.lit(OUTSIDE[0]), OUTSIDE[1] * F.col("articles")))).select("host", "name", "n", "articles")


def _sections(batches: Iterator[pa.RecordBatch], all_pages: bool) -> Iterator[tuple[dict, list[dict], bool]]:
    """(first row of the part, the next rows, are these all of the part?) in sections of ``SECTION`` bytes; either all pages or the first of each article."""
    key, head, held, size, content, cut = None, None, [], 0, None, False
    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["host"], row["_part"]):
                if held:
                    yield head, held, not cut
                key, head, held, size, content, cut = (row["host"], row["_part"]), row, [], 0, None, False
            if not all_pages and row["content"] == content:
                continue
            if held and size > SECTION:
                cut = True
                yield head, held, False
                held, size = [], 0
            content = row["content"]
            held.append(row)
            size += len(row["texts"])
    if held:
        yield head, held, not cut


_COUNTS = pa.schema([("host", pa.string()), ("name", pa.int64()), ("n", pa.int64()), ("least", pa.int64())])


def _said(host: str, names: np.ndarray, counts: np.ndarray, n_pages: int, least: int) -> pa.RecordBatch:
    """A section's counts, and last that of its articles."""
    rows = len(names) + 1
    return pa.RecordBatch.from_arrays([pa.array([host] * rows, pa.string()), pa.array([*names.tolist(), None], pa.int64()), pa.array([*counts.tolist(), n_pages], pa.int64()), pa.array([least] * rows, pa.int64())], schema=_COUNTS)


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for head, rows, alone in _sections(batches, False):
        names, counts, least = section_strings([(r["texts"], r["marks"]) for r in rows], alone and head["n_parts"] == 1)
        yield _said(head["host"], names, counts, len(rows), least)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for head, rows, _ in _sections(batches, False):
        wanted = np.sort(np.array(head["beside"] or [], dtype=np.int64))
        names, counts = section_counts([(r["texts"], r["marks"]) for r in rows], wanted) if len(wanted) else (wanted, wanted)
        yield _said(head["host"], names, counts, len(rows), 1)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, its blocks joined by an empty line."""
    crowded = F.broadcast(_crowded(pages))
    part, order = ["host", "_part"], ["content", "_name", "page_id", "texts", "marks"]
    dealt = parsed(pages).join(crowded, "host", "left").withColumns({"_name": F.xxhash64("url", "page_id"), "n_parts": F.coalesce("n_parts", F.lit(1))})
    dealt = dealt.withColumn("_part", F.pmod("content", "n_parts")).repartition(*part)
    rows = dealt.withColumn("_first", F.row_number().over(Window.partitionBy(*part).orderBy(*order)) == 1)

    def told(names: DataFrame) -> DataFrame:
        """The rows, the first of each part with the names of its host: of one string in ``beside``, and in ``within`` if most articles have it."""
        most = F.col("n") >= F.greatest(F.lit(INSIDE[0]), INSIDE[1] * F.col("articles"))
        by_host = names.groupBy("host").agg(F.collect_list("name").alias("beside"), F.collect_list(F.when(most, F.col("name"))).alias("within"))
        spread = by_host.join(crowded, "host", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("n_parts", F.lit(1)) - 1)))
        spread = spread.select(F.col("host").alias("_h"), F.col("_part").alias("_p"), "beside", "within")
        same = (F.col("host") == F.col("_h")) & (F.col("_part") == F.col("_p")) & F.col("_first")
        return rows.join(spread.hint("merge"), same, "left").drop("_h", "_p").sortWithinPartitions(*part, F.desc("_first"), *order)

    maybe = _frequent(rows.sortWithinPartitions(*part, *order).mapInArrow(_reported, "host string, name long, n long, least long"))
    sure = _frequent(told(maybe).mapInArrow(_counted, "host string, name long, n long, least long"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("page_id").type
                yield batch

        for head, held, _ in _sections(seen(), True):
            boilerplate = tuple(np.sort(np.array(head[c] or [], dtype=np.int64)) for c in ("beside", "within"))
            distinct = list({(r["texts"], r["marks"]): None for r in held})
            found = dict(zip(distinct, section_texts(distinct, boilerplate), strict=True))
            texts = [found[r["texts"], r["marks"]] for r in held]
            yield pa.RecordBatch.from_arrays([pa.array([r["page_id"] for r in held], kind), pa.array([r["url"] for r in held], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return told(sure).mapInArrow(clean, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
