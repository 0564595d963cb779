"""Benchmark decontamination: item-sized windows, SimHash, exact verification.

A window of a document has as many words as an item (or is the whole document, if that
is shorter).  Windows whose weighted shingle multiset is at least ``SIMILARITY`` similar
to an item's are found so; a shingle weighs as often as it occurs:

1. Of each item only its rarest shingles, more than the fifth that a similar window may
   lack, are looked for.  A presence filter of fixed size lets the documents' tasks pick
   possible hits; one join of hits and rare shingles names the items that each document
   may hold.  No task sees all items, and each item costs the same whatever their number.
2. Windows of these documents with too few shingles of their items go (an exact bound);
   the others get a SimHash of ``BITS`` bits.
3. Items of the window's size are looked up in a multi-index: prints within ``RADIUS`` bits
   differ in at most ``RADIUS`` // 8 bits of some 64-bit block, so only items with such a
   block are measured whole.
4. The exact weighted Jaccard similarity decides.

At similarity 0.8 a bit differs with probability 1/4 at most (two shingles of equal weight
that cancel, and a third), 128 of 512 bits with deviation 9.8; the radius stands six
deviations above.  Unrelated prints differ in 256 with deviation 11.3 and lie outside.

Defined cases: null and empty texts and items match nothing; items of fewer words than a
shingle are one shingle; among windows of equal similarity the first is reported;
repeated documents are all reported, equal items once, an item's text under each id; null ids
are carried; empty tables give an empty result; extra columns are ignored by ``find`` and
kept by ``clean``, which goes by id and text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import maybe_present, presence, scratch, stored, text_hash
from .tokens import NOT_PLAIN, Words, combine, mix, slices

SIZE, SIMILARITY, BITS, RADIUS = 5, (4, 5), 512, 187
FILTER_BITS, LISTED, STARTS, CACHED = 1 << 24, 256, 2048, 2000
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_BLOCKS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64))


def shingles(names: np.ndarray, size: int) -> np.ndarray:
    """Names of the runs of ``size`` words; of the whole, if it has fewer words."""
    size = min(size, len(names))
    out = names.copy()
    for j in range(1, size):
        out = combine(out[: len(names) - j], names[j:], j)
    return out if size else out[:0]


def signs(grams: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the ``BITS`` bits of each shingle's hash, block by block."""
    return np.where(mix(grams[:, None] ^ _BLOCKS)[:, :, None] & _BITS, np.int32(1), np.int32(-1)).reshape(len(grams), BITS)


def pack(sums: np.ndarray) -> np.ndarray:
    """The fingerprints of rows of ``BITS`` sums: a row of 64-bit blocks each."""
    return np.bitwise_or.reduce(np.where(sums.reshape(len(sums), BITS // 64, 64) > 0, _BITS, np.uint64(0)), axis=-1)


class MultiIndex:
    """Fingerprints by their blocks."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.blocks = [np.ascontiguousarray(x) for x in prints.T]

    def near(self, fingerprint: np.ndarray) -> np.ndarray:
        """All prints within the radius: those that are near in some block, then by the whole distance."""
        some = np.zeros(len(self.prints), bool)
        for block, mine in zip(self.blocks, fingerprint, strict=True):
            some |= np.bitwise_count(block ^ mine) <= self.radius // len(self.blocks)
        some = np.flatnonzero(some)
        return some[np.bitwise_count(self.prints[some] ^ fingerprint).sum(axis=1) <= self.radius]


class Item:
    """An item's number of words, shingles with their counts, and fingerprint."""

    def __init__(self, text: str | None, size: int = SIZE):
        data = np.frombuffer((text or "").encode(), np.uint8)
        names = Words(data, np.array([0, len(data)]), lower=True, apart=NOT_PLAIN).hashes()
        grams = shingles(names, size)
        self.words, self.grams, self.bag = len(names), np.unique(grams), Counter(grams.tolist())
        self.print = pack(signs(grams).sum(axis=0)[None])[0]


def search(names: np.ndarray, items: list[Item], size: int = SIZE, similarity: tuple[int, int] = SIMILARITY, radius: int = RADIUS) -> dict[int, tuple[int, int, int, int]]:
    """Place of an item -> (shared, all, start, words) of its best window in one document.

    Windows are fingerprinted ``STARTS`` at a time, so that long texts need bounded memory.
    """
    num, den = similarity
    best: dict[int, tuple[int, int, int, int]] = {}
    by_size: dict[int, list[int]] = {}
    for i, item in enumerate(items):
        by_size.setdefault(item.words, []).append(i)
    for n, mine in sorted(by_size.items()):
        width, k = min(n, len(names)), min(size, n)
        if not n or width < k:
            continue
        g = shingles(names, k)
        m, target = width - k + 1, n - k + 1
        least = -(-num * (m + target) // (num + den))  # shared shingles that the similarity needs
        total = np.concatenate([[0], np.cumsum(np.isin(g, np.concatenate([items[i].grams for i in mine])))])
        starts = np.flatnonzero(total[m:] - total[:-m] >= least)
        index = MultiIndex(np.stack([items[i].print for i in mine]), radius)
        while len(starts):
            few = starts[: np.searchsorted(starts, starts[0] + STARTS)]
            starts = starts[len(few):]
            base, stop = few[0], few[-1] + m
            sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(g[base:stop]), axis=0, dtype=np.int32)])
            for s, p in zip(few.tolist(), pack(sums[few - base + m] - sums[few - base]), strict=True):
                bag = None
                for at in index.near(p).tolist():
                    item = mine[at]
                    bag = bag if bag is not None else Counter(g[s:s + m].tolist())
                    shared = sum((bag & items[item].bag).values())
                    every = m + target - shared
                    if den * shared >= num * every and (item not in best or shared * best[item][1] > best[item][0] * every):
                        best[item] = (shared, every, s, width)
    return best


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, words, gram, n) of the shingles of (item, text) rows."""
    for batch in batches:
        for at, text in enumerate(batch.column(1).to_pylist()):
            item = Item(text)
            if item.words:
                n = len(item.bag)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[at].as_py()] * n, pa.int64()), pa.array([item.words] * n, pa.int64()), pa.array(np.array(list(item.bag), np.uint64).view(np.int64)), pa.array(list(item.bag.values()), pa.int64())], ["item", "words", "gram", "n"])


def _spots(bits: int):
    """(slot, bits): where a filter of so many bits has the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)
            yield pa.RecordBatch.from_arrays([pa.array((spot >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (spot & np.uint64(63))).view(np.int64))], ["slot", "bits"])

    return run


def _filter(grams: DataFrame) -> np.ndarray:
    """A presence filter of ``FILTER_BITS`` bits over the shingles; it has that size whatever their number is."""
    rows = grams.mapInArrow(_spots(FILTER_BITS), "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _hits(shared, sizes: list[int]):
    """(k, h, gram): the shingles of each document that may be an item's rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for at, _, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, lower=True, apart=NOT_PLAIN)
                names = words.hashes()
                for size in sizes:
                    if len(names) < size:
                        continue
                    g = shingles(names, size)
                    spot = g % np.uint64(64 * len(bits))
                    found = np.flatnonzero(bits[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1))
                    found = found[words.doc[found] == words.doc[found + size - 1]]
                    if len(found):
                        doc, gram = np.unique(np.stack([words.doc[found].astype(np.uint64), g[found]]), axis=1)
                        doc = pa.array(doc.astype(np.int64) + at)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(2).take(doc), pa.array(gram.view(np.int64))], ["k", "h", "gram"])

    return run


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, h, text, items) to the matches of each document with its items (id, text)."""
    known: dict[str, Item] = {}
    for batch in batches:
        out = []
        for at, _, data, offsets in slices(batch.column(2)):
            words = Words(data, offsets, lower=True, apart=NOT_PLAIN)
            names = words.hashes()
            for d in range(words.n):
                k, h, listed = batch.column(0)[at + d].as_py(), batch.column(1)[at + d].as_py(), batch.column(3)[at + d].as_py()
                if len(known) > CACHED:
                    known.clear()
                for x in listed:
                    if x["t"] not in known:
                        known[x["t"]] = Item(x["t"])
                found = search(names[words.first[d]:words.first[d + 1]], [known[x["t"]] for x in listed])
                out += [(k, h, listed[i]["i"], a / b, s, w) for i, (a, b, s, w) in sorted(found.items())]
        if out:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["k", "h", "item_id", "similarity", "start", "words"])


def rare_grams(items: DataFrame) -> DataFrame:
    """(item, words, gram) of (item, text): of each item its rarest shingles that together weigh more than a similar window may lack."""
    every = stored(items.mapInArrow(_item_grams, "item long, words long, gram long, n long"), "leak-grams")
    often = every.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    num, den = SIMILARITY
    own = Window.partitionBy("item").orderBy("often", "gram")
    before = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighed = every.join(often, "gram").withColumn("before", before).withColumn("all", F.sum("n").over(Window.partitionBy("item")))
    return weighed.filter(f"{den} * before <= {den - num} * all").select("item", "words", "gram")


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, similarity, start, words): for each document and item that match, the best window.

    ``start`` and ``words`` count the document's words.
    """
    return _found(docs, items, key, text, item_key, item_text).drop("h").withColumnRenamed("k", key)


def _found(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """``find`` with the id as k and the hash of the text as h."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("_text"), text_hash(text).alias("h"))
    with scratch(spark) as keep:
        named = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).distinct()
        named = stored(named.withColumn("item", F.xxhash64("i", "t")), "leak-items")
        rare = stored(rare_grams(named.select("item", "t")), "leak-rare")
        sizes = sorted({SIZE, *(r[0] for r in rare.filter(f"words < {SIZE}").select("words").distinct().collect())})
        bits = spark.sparkContext.broadcast(_filter(rare.select("gram")))
        hits = stored(rows.mapInArrow(_hits(bits, sizes), "k long, h long, gram long"), "leak-hits")
        pairs = stored(hits.join(rare.select("gram", "item"), "gram").select("k", "h", "item").distinct(), "leak-pairs")
        # a document with many items is searched in several tasks, each with some LISTED of them
        many = pairs.groupBy("k", "h").agg(F.ceil(F.count(F.lit(1)) / LISTED).cast("long").alias("parts"))
        same = F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.h") == F.col("b.h"))
        dealt = pairs.alias("a").join(many.alias("b"), same).select("a.k", "a.h", "a.item", F.pmod(F.col("a.item"), F.col("b.parts")).alias("part"))
        listed = dealt.join(named, "item").groupBy("k", "h", "part").agg(F.collect_list(F.struct("i", "t")).alias("items"))
        listed = keep(stored(listed.select("k", "h", "items"), "leak-listed"))
    held = maybe_present(rows, "h", presence(listed.select("h")))
    both = held.alias("a").join(listed.alias("b"), same).select("a.k", "a.h", "a._text", "b.items")
    return both.mapInArrow(_searched, "k long, h long, item_id long, similarity double, start long, words long")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item."""
    hit = _found(docs, items, key, text, item_key, item_text).select(F.col("k").alias("_hit"), F.col("h").alias("_hash")).distinct()
    return docs.join(hit, docs[key].cast("bigint").eqNullSafe(hit["_hit"]) & (text_hash(text) == hit["_hash"]), "left_anti")
