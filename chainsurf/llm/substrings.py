"""Exact removal of long repeated word passages, by recompression.

Rounds of run naming and pair naming turn each text into a few symbols, once for each
text.  A name is a 64-bit fingerprint of its parts (a run: symbol and length; a pair: left
and right), and whether two neighbours pair is a bit of each name; so every task gives
equal word sequences the same interior symbols, without any table of names.  Runs are
named between the rounds of pairs and after them, so that a group of words that a text
repeats folds to one symbol too.  Each symbol knows its context: the words that settle it.  A 50-word window that contains the context of a
symbol contains that symbol in every text; hence a window can repeat only if all its
symbols occur in several documents.  Spark groups the top symbols of all documents
(one round over names), which reveals the candidate passages; their windows are then
compared by two 64-bit names, grouped by Spark again, which verifies them; the two come
from independent names of the words, so equal pairs are equal windows but for a chance of
2^-128 or so.  Windows that
contain no settled symbol (long runs) are always candidates, so nothing is lost.

A whole text whose word sequence equals that of a smaller document is one symbol and is
settled by its 128-bit name alone.

Defined cases: null and empty texts have no words; texts under 50 words lose nothing; a
null id is never smaller than another, so such rows lose nothing; rows that repeat an
id are separate documents of equal rank and never remove each other's words; an empty
table gives an empty result; extra columns are ignored by ``repeats`` and kept by
``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, maybe_present, presence, stored
from .tokens import Words, combine, mix, slices

WINDOW = 50
STEPS, CAP = "RPPPRPPPR", 14
FILTER = 1 << 18  # rows of the filter over shared symbols
_FAR = 1 << 40
_SAT = 4095
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_EMPTY = hashlib.sha256(b"").hexdigest()


def recompress(names: np.ndarray, doc: np.ndarray, steps: str = STEPS, cap: int = CAP):
    """(name, lo, hi, doc) of the symbols after the rounds ``steps``: R names runs, P names pairs.

    ``lo:hi`` is a symbol's context among all words given; beyond an end of its text it
    reaches ``_FAR`` away.  ``cap`` bounds the words of a pair.
    """
    n = len(names)
    name, size, lo, hi, d = names, np.ones(n, np.int64), np.arange(n), np.arange(1, n + 1), doc
    for level, kind in enumerate(steps):
        m = len(name)
        if m == 0:
            break
        same = np.zeros(m + 1, bool)
        same[1:m] = d[1:] == d[:-1]
        before, after = np.full(m, -_FAR), np.full(m, _FAR)
        before[1:][same[1:m]] = lo[:-1][same[1:m]]
        after[:-1][same[1:m]] = hi[1:][same[1:m]]
        if kind == "R":
            free = 2 * size <= cap
            joined = np.zeros(m, bool)
            joined[1:] = (name[1:] == name[:-1]) & same[1:m] & free[1:]
            head = np.flatnonzero(~joined)
            length = np.diff(np.append(head, m))
            tail, run, open_ = head + length - 1, length > 1, free[head]
            named = name[head]
            named[run] = combine(name[head[run]], length[run].astype(np.uint64), 1)
            lo = np.where(open_, np.minimum(lo[head], before[head]), lo[head])
            hi = np.where(open_, np.maximum(hi[tail], after[tail]), hi[head])
            name, size, d = named, size[head] * length, d[head]
        else:
            right = (mix(name + np.uint64(level * 1000003 + 1)) & np.uint64(1)).astype(bool)
            pair = np.zeros(m, bool)
            pair[:-1] = ~right[:-1] & right[1:] & same[1:m] & (size[:-1] + size[1:] <= cap)
            second = np.zeros(m, bool)
            second[1:] = pair[:-1]
            free = size < cap  # only these look at a neighbour before they stay alone
            new_lo = np.where(free & right & ~second, np.minimum(lo, before), lo)
            new_hi = np.where(free & ~right & ~pair, np.maximum(hi, after), hi)
            i = np.flatnonzero(pair)
            new_lo[i], new_hi[i] = np.minimum(lo[i], lo[i + 1]), np.maximum(hi[i], hi[i + 1])
            named, sized = name.copy(), size.copy()
            named[i] = combine(name[i], name[i + 1], 2)
            sized[i] += size[i + 1]
            name, size, lo, hi, d = (x[~second] for x in (named, sized, new_lo, new_hi, d))
    return name, lo, hi, d


def settled(names: np.ndarray, words: Words, window: int):
    """The symbols whose context fits a window: (name, doc, packed), and the open gaps (doc, from, to).

    ``packed`` holds a symbol's place in its own text and the distance to its neighbours'
    far ends; ``from:to`` are words of the text between symbols that hold a whole window.
    """
    name, lo, hi, d = recompress(names, words.doc)
    fits = (hi - lo <= window) & (lo >= 0)
    name, d = name[fits], d[fits]
    lo, hi = lo[fits] - words.first[d], hi[fits] - words.first[d]
    m = len(name)
    same = np.zeros(m + 1, bool)
    same[1:m] = d[1:] == d[:-1]
    prev_lo, next_hi = np.full(m, -1), words.count[d] + 1
    prev_lo[1:][same[1:m]] = lo[:-1][same[1:m]]
    next_hi[:-1][same[1:m]] = hi[1:][same[1:m]]
    packed = (lo << 24) | (np.minimum(next_hi - lo, _SAT) << 12) | (_SAT - np.minimum(lo - prev_lo, _SAT))  # sorts as the symbols stand, ties too
    last = np.flatnonzero(~same[1:]) if m else np.zeros(0, np.int64)
    bare = np.setdiff1d(np.flatnonzero(words.count >= window), d)
    gap_doc = np.concatenate([d, d[last], bare])
    gap_from = np.concatenate([prev_lo + 1, lo[last] + 1, np.zeros(len(bare), np.int64)])
    gap_to = np.concatenate([hi - 1, words.count[d[last]], words.count[bare]])
    wide = gap_to - gap_from >= window
    return name, d, packed, gap_doc[wide], gap_from[wide], gap_to[wide]


def chains(packed: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges around maximal stretches of neighbouring shared symbols (``packed`` of one text)."""
    packed = np.unique(packed)
    lo, gn, gp = packed >> 24, (packed >> 12) & _SAT, _SAT - (packed & _SAT)
    linked = np.zeros(len(lo), bool)
    linked[1:] = (gp[1:] < _SAT) & (lo[1:] - gp[1:] == lo[:-1])
    head = np.flatnonzero(~linked)
    tail = np.append(head[1:], len(lo)) - 1
    return [(int(a), int(b)) for a, b in zip(lo[head] - gp[head] + 1, lo[tail] + gn[tail] - 1, strict=True)]


def window_names(words: Words, window: int, which: int = 0) -> np.ndarray:
    """A 64-bit name of each window of the words (polynomial, by prefix sums); names 0 and 1 have independent names of words."""
    names = words.hashes(which)
    n = len(names)
    if n < window:
        return np.zeros(0, np.uint64)
    up = np.multiply.accumulate(np.full(n, np.uint64(_BASES[which])))
    down = np.multiply.accumulate(np.full(n, np.uint64(pow(_BASES[which], -1, 1 << 64))))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * up, dtype=np.uint64)])
    return mix((sums[window:] - sums[:-window]) * down[: n - window + 1])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Values in order of ``owner`` (0..n-1) as one list per owner."""
    order = np.argsort(owner, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order]))


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n_words, a, b, sha, open, symbols, packed) of each text: its 128-bit name, open gaps and settled symbols."""
    for batch in batches:
        for at, to, data, offsets in slices(batch.column(2)):
            words = Words(data, offsets)
            names = words.hashes()
            name, d, packed, gd, gf, gt = settled(names, words, WINDOW)
            a, b, sha = [], [], []
            for k in range(words.n):
                own = data[offsets[k]:offsets[k + 1]].tobytes().split()
                digest = hashlib.sha256(b" ".join(own))
                sha.append(digest.hexdigest())
                a.append(int.from_bytes(digest.digest()[:8], "big", signed=True))
                b.append(int.from_bytes(digest.digest()[8:16], "big", signed=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(words.count), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string()), _lists((gf << 32) | gt, gd, words.n), _lists(_signed(name), d, words.n), _lists(packed, d, words.n)],
                ["row", "doc_id", "n_words", "a", "b", "sha", "open", "symbols", "packed"],
            )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, ranges) of the texts that have candidate windows."""
    for batch in batches:
        rows, ids, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for row, key, gaps, hits in zip(rows, ids, batch.column(2), batch.column(3), strict=True):
            found = {(g >> 32, g & 0xFFFFFFFF) for g in (gaps.as_py() or [])}
            if hits.is_valid:
                found |= {(a, b) for a, b in chains(hits.values.to_numpy(zero_copy_only=False)) if b - a >= WINDOW}
            if found:
                out.append((row, key, [(a << 32) | b for a, b in sorted(found)]))
        if out:
            r, k, v = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(v, pa.list_(pa.int64()))], ["row", "doc_id", "ranges"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id, row) of each text's distinct candidate windows."""
    for batch in batches:
        rows, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ranges = batch.column(2)
        for at, to, data, offsets in slices(batch.column(3)):
            words = Words(data, offsets)
            h1, h2 = window_names(words, WINDOW), window_names(words, WINDOW, 1)
            delta = np.zeros(len(words.doc) + 2, np.int64)
            for k in range(at, to):
                packed = ranges[k].values.to_numpy(zero_copy_only=False)
                base, n = words.first[k - at], words.count[k - at]
                a, b = packed >> 32, np.minimum(packed & 0xFFFFFFFF, n) - WINDOW + 1
                ok = b > a
                np.add.at(delta, base + a[ok], 1)
                np.add.at(delta, base + b[ok], -1)
            pick = np.flatnonzero(np.cumsum(delta)[: len(h1)] > 0)
            _, one = np.unique(np.stack([h1[pick], words.doc[pick].astype(np.uint64)]), axis=1, return_index=True) if len(pick) else (0, np.zeros(0, np.int64))
            pick = pick[one]
            d = at + words.doc[pick]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(h1[pick])), pa.array(_signed(h2[pick])), pa.array(ids[d]), pa.array(rows[d])], ["h1", "h2", "doc_id", "row"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n_removed, sha, kept) of the texts that lose words."""
    for batch in batches:
        names = batch.column(2)
        out = []
        for at, to, data, offsets in slices(batch.column(3)):
            words = Words(data, offsets)
            h1 = _signed(window_names(words, WINDOW))
            for k in range(at, to):
                first, n = words.first[k - at], words.count[k - at]
                own = h1[first:max(first, first + n - WINDOW + 1)]
                hit = np.isin(own, names[k].values.to_numpy(zero_copy_only=False))
                delta = np.zeros(n + 1, np.int64)
                delta[: len(own)] += hit
                delta[WINDOW:WINDOW + len(own)] -= hit
                gone = np.cumsum(delta)[:n] > 0
                text = data[offsets[k - at]:offsets[k - at + 1]].tobytes().split()
                kept = b" ".join([w for w, x in zip(text, gone.tolist(), strict=True) if not x])
                out.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        if out:
            r, i, n, s, t = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.string()), pa.array(t, pa.string())], ["row", "doc_id", "n_removed", "cut_sha", "cut_text"])


def _found(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The base table with ``copy``, and (row, doc_id, n_removed, cut_sha, cut_text) of texts that lose some words.

    ``row`` is a hash of id and text; with the id itself it names a row (rows equal in both are alike).
    """
    name = ["row", "doc_id"]
    rows = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    plain = stored(rows.mapInArrow(_base, "row long, doc_id long, n_words long, a long, b long, sha string, open array<long>, symbols array<long>, packed array<long>"), "substring-base")
    least = plain.filter(f"n_words >= {WINDOW} AND doc_id IS NOT NULL").groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    least = stored(least, "substring-least")  # a table of its own, like those below: a hot key's side of its join can be split
    base = plain.join(least, ["a", "b"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("a", "b", "least", "symbols", "packed")
    base = stored(base, "substring-copies")

    known = rows.filter("doc_id IS NOT NULL")
    named = plain.filter("doc_id IS NOT NULL")
    symbols = named.select(*name, F.inline(F.arrays_zip(F.col("symbols").alias("symbol"), F.col("packed").alias("packed"))))
    shared = named.select("doc_id", F.explode("symbols").alias("symbol")).groupBy("symbol").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("symbol")
    shared = stored(shared, "substring-shared")
    some = maybe_present(symbols, "symbol", presence(shared, FILTER), FILTER)  # most symbols occur once: they need no shuffle
    hits = some.join(shared, "symbol").groupBy(*name).agg(F.collect_set("packed").alias("hits"))
    live = base.filter(f"NOT copy AND n_words >= {WINDOW} AND doc_id IS NOT NULL").select(*name, "open")
    ranges = stored(live.join(hits, name, "left").mapInArrow(_ranges, "row long, doc_id long, ranges array<long>").dropDuplicates(name), "substring-ranges")

    near = maybe_present(known, "row", presence(ranges.select("row")))
    windows = stored(ranges.join(near, name).select(*name, "ranges", "text").mapInArrow(_windows, "h1 long, h2 long, doc_id long, row long"), "substring-windows")
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    first = stored(first, "substring-first")
    later = windows.join(first, ["h1", "h2"]).filter("doc_id > least").groupBy(*name).agg(F.collect_set("h1").alias("names"))
    later = stored(later, "substring-repeats")
    discard(plain, least, shared, ranges, windows, first)

    near = maybe_present(known, "row", presence(later.select("row")))
    cut = later.join(near, name).select(*name, "names", "text").mapInArrow(_cut, "row long, doc_id long, n_removed long, cut_sha string, cut_text string")
    return base, cut.dropDuplicates(name)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) for each row of ``docs``."""
    base, cut = _found(docs, key, text)
    return base.join(cut.drop("cut_text"), ["row", "doc_id"], "left").select(
        F.col("doc_id").alias(key),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated words cut out of the texts; a text that loses none stays as it is.

    A text that loses words becomes its kept words, joined by one space.
    """
    base, cut = _found(docs, key, text)
    name = ["row", "doc_id"]
    change = base.filter("copy").select(*name, F.lit("").alias("cut")).unionByName(cut.select(*name, F.col("cut_text").alias("cut")))
    change = stored(change.dropDuplicates(name), "substring-cuts")
    # the row's own columns under one name, so that none clashes
    marked = docs.select(F.struct(*docs.columns).alias("all"), F.xxhash64(key, text).alias("row"), F.col(key).cast("bigint").alias("doc_id"))
    kept = maybe_present(marked, "row", presence(change.select("row")), present=False)  # these need no shuffle
    rest = maybe_present(marked, "row", presence(change.select("row"))).join(change, name, "left")
    new = F.coalesce("cut", f"all.{text}")
    return kept.select("all.*").unionByName(rest.select(*[new.alias(text) if c == text else F.col(f"all.`{c}`") for c in docs.columns]))
