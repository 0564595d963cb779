"""Near-duplicate groups by bottom-k sketches of one hash function.

1. Each text's distinct word shingles are hashed once; the ``SKETCH`` smallest values are
   its sketch.  Texts with equal sets are one node.
2. Inverted lists: neighbouring retained values form keys.  Lists of at most ``RARE``
   nodes generate pairs and their overlaps.
3. Longer lists are never paired.  A node with ``ENOUGH`` keys outside them meets its
   partners in short lists.  The others are crowded: they are listed again, under all their
   shingles, and the short ones of these lists generate pairs too.  A crowded node with more
   rare shingles than a linked partner can lack meets all its partners there.
4. What remains is dense, such as a family of thousands of near copies.  In each long list
   the node with the most frequent and fewest rare shingles stands for the family, and the
   others are paired with it alone.
5. Union-sketch estimates drop pairs ``DEVIATIONS`` below the threshold.  Then exact
   Jaccard similarities of full sets decide: first of each node with its stars and its
   smallest partner, and, once these links are joined to components, of the pairs whose
   ends still lie in different ones.  Dense nodes outside their family's largest component
   are compared with the family's dense nodes in blocks of bounded size.  Two that share
   no rare shingle can be linked only if their frequent ones outweigh the rare ones of
   both (``slack``), so much edited copies meet only the least edited.
6. Connected components over the links name each text's smallest document; of its rows
   the one with the smallest text hash is kept, and of equal rows only one.

A family whose members are linked to the node that stands for it thus costs work in
proportion to its size, whatever that is.

Defined cases: texts without words and null texts are empty sets, linked with nothing;
a text of fewer words than a shingle is one shingle; rows that repeat an id are judged
by their own text; a null id never names a component that has another id; ``groups`` calls
every row kept whose id is its component's, and ``one_of_each`` keeps exactly one row of
each component, also of null and of repeated ids; extra columns are ignored by ``groups``
and kept by ``one_of_each``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, maybe_present, presence, scratch, stored, text_hash
from .tokens import Words, combine, mix, slices

SKETCH, RARE, ENOUGH, OVERLAPS, DEVIATIONS = 64, 40, 54, 2, 6
BLOCK, CHUNK, BLOCK_SHINGLES, COLUMNS, STEP = 96, 48, 1_000_000, 8192, 0.02


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray, Words]:
    """(shingle, doc): the distinct shingles of each text of a slice, in order of doc and value."""
    words = Words(data, offsets, lower=True)
    names = words.hashes()
    n = len(names)
    grams = names.copy()
    for j in range(1, size):
        grams = combine(grams[: n - j], names[j:], j) if n > j else grams[:0]
    d = words.doc[: len(grams)]
    whole = d == words.doc[size - 1:] if len(grams) else np.zeros(0, bool)
    grams, d = grams[whole], d[whole]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        alone = []
        for k in short:
            w = names[words.first[k]:words.first[k + 1]]
            turned = mix(w * np.arange(3, 2 * len(w) + 3, 2, dtype=np.uint64))
            alone.append(mix(np.bitwise_xor.reduce(turned, keepdims=True) + np.uint64(len(w)))[0])
        grams, d = np.concatenate([grams, np.array(alone, np.uint64)]), np.concatenate([d, short])
    order = np.lexsort((grams, d))
    grams, d = grams[order], d[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (d[1:] != d[:-1])
    return grams[new], d[new], words


def _node_names(grams: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, name) of each text's set."""
    size = np.bincount(d, minlength=n)
    sums = np.zeros(n, np.uint64)
    if len(grams):
        start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        sums[d[start]] = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)
    return size, mix(sums + size.astype(np.uint64)).view(np.int64)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in slices(batch.column(1)):
                grams, d, words = shingle_sets(data, offsets, size)
                n, name = _node_names(grams, d, words.n)
                begin = np.cumsum(n) - n
                first = np.flatnonzero(np.arange(len(grams)) - begin[d] < SKETCH)
                ends = np.concatenate([[0], np.cumsum(np.minimum(n, SKETCH))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[first].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(2).slice(at, to - at), pa.array(n), pa.array(name), lists], ["doc_id", "h", "n", "node", "sketch"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                grams, d, words = shingle_sets(data, offsets, size)
                n, name = _node_names(grams, d, words.n)
                ends = np.concatenate([[0], np.cumsum(n * 8)]).astype(np.int64)
                blob = pa.Array.from_buffers(pa.large_binary(), words.n, [None, pa.py_buffer(ends), pa.py_buffer(grams.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(name), blob], ["node", "grams"])

    return run


def _estimates(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = percent / 100
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                a, b = (x[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (left, right))
                both = np.sort(np.concatenate([a, b]))
                again = both[1:] == both[:-1]
                new = np.concatenate([[True], ~again])
                k = min(SKETCH, int(new.sum()))
                shared = int(again[: np.flatnonzero(new)[k] - 1 if k < new.sum() else None].sum())
                keep[i] = shared >= t * k - DEVIATIONS * (t * (1 - t) * k) ** 0.5 - 1
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["x", "y"])

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, col, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column, use, width = np.cumsum(seen > 1) - 1, seen[col] > 1, int((seen > 1).sum())
    owner, col = owner[use], column[col[use]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    common = np.zeros((n, n), np.float32)
    for a in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(col, [a, a + COLUMNS])
        dense = np.zeros((n, min(COLUMNS, width - a)), np.float32)
        dense[owner[lo:hi], col[lo:hi] - a] = 1
        common += dense @ dense.T
    return common.astype(np.int64)


def _links(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Exact similarities between the two sides of a task (within the one side, if there is no other); links that span."""
        rows = rows.sort_values("side", kind="stable")
        sets = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
        node, side = rows["node"].to_numpy(), rows["side"].to_numpy()
        size, n = np.array([len(x) for x in sets]), len(sets)
        if (side == 0).sum() == 1 and n > 1:  # one set against the others
            begin = np.cumsum(size[1:]) - size[1:]
            common = np.add.reduceat(np.isin(np.concatenate(sets[1:]), sets[0]).astype(np.int64), begin)
            linked = 100 * common >= percent * (size[0] + size[1:] - common)
            return pd.DataFrame({"x": np.full(int(linked.sum()), node[0]), "y": node[1:][linked]})
        common = _common(sets)
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        if side.min() != side.max():
            linked &= side[:, None] != side[None, :]
        i, j = np.nonzero(np.triu(linked, 1))
        top = np.arange(n)

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            top[max(root(x), root(y))] = min(root(x), root(y))
        ends = np.array([root(x) for x in range(n)])
        out = np.flatnonzero(ends != np.arange(n))
        return pd.DataFrame({"x": node[ends[out]], "y": node[out]})

    return run


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, least): the smallest node that each node of the edges (x, y) reaches.

    Each round takes the least label of the neighbours, then the label's own label; rounds
    end when no label changes.  All rounds are joins and aggregations of distributed tables.
    """
    both = stored(edges.select("x", "y").union(edges.select("y", "x")).distinct(), what + "-edges")
    labels = held = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("least")), what)
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("least").alias("near"))
        near = labels.join(near, "node").select("node", F.col("least").alias("was"), F.least("least", "near").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("least").alias("on"))
        new = stored(near.join(jump, "least").select("node", "was", F.least("least", "on").alias("least")), what)
        discard(held)
        held, labels = new, new.drop("was")
        if new.filter("least <> was").isEmpty():
            discard(both)
            labels._folder = new._folder
            return labels


def _sketched(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("_text"), text_hash(text).alias("h"))
    return stored(rows.mapInArrow(_sketches(size), "doc_id long, h long, n long, node long, sketch array<long>"), "near-sketches")


def _lists(rows: DataFrame, what: str) -> DataFrame:
    """(node, key, c) of the lists that two nodes or more share, with their lengths."""
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = stored(shared, what + "-keys")  # a table of its own: a hot key's side of the join can be split
    out = stored(rows.join(shared, "key"), what)
    discard(shared)
    return out


def _overlapping(members: DataFrame) -> DataFrame:
    """Pairs (x, y) of the short lists that meet ``OVERLAPS`` times or more."""
    short = members.filter(f"c <= {RARE}").select("key", "node")
    pairs = short.withColumnRenamed("node", "x").join(short.withColumnRenamed("node", "y"), "key").filter("x < y")
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("overlaps")).filter(f"overlaps >= {OVERLAPS}").select("x", "y")


def _rated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and union sketches allow a link."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("sketch").alias("s" + c))
    both = pairs.join(side("x"), "x").join(side("y"), "y").filter(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    return both.select("x", "y", "sx", "sy").mapInArrow(_estimates(percent), "x long, y long")


def _listed(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(lists of keys, crowded nodes) of nodes (node, n, sketch)."""
    least = -(-percent // (100 - percent))  # smaller sets link with equal sets only
    listed = nodes.filter(f"n >= {least}")
    keys = F.expr("transform(sequence(0, size(sketch) - 2), i -> xxhash64(sketch[i], sketch[i + 1]))")
    members = _lists(listed.select("node", F.explode(keys).alias("key")), "near-lists")
    in_long = members.filter(f"c > {RARE}").groupBy("node").agg(F.count(F.lit(1)).alias("in_long")).join(listed, "node")
    return members, stored(in_long.filter(f"size(sketch) - 1 - in_long < {ENOUGH}").select("node", "n"), "near-crowded")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, key) of the shingles of (node, grams) rows."""
    for batch in batches:
        for at in range(batch.num_rows):
            key = np.frombuffer(batch.column(1)[at].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), batch.column(0)[at].as_py())), pa.array(key)], ["node", "key"])


def _stars(members: DataFrame, crowded: DataFrame, every: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(stars (x, y), dense (node, slack)): each dense node y with the heads x of its long lists.

    ``every`` holds the lists of all shingles of the crowded nodes.  ``slack`` is what the
    frequent shingles have over: of two linked nodes that share no rare one it sums to 0 or more.
    """
    frequent = every.filter(f"c > {RARE}").groupBy("node").agg(F.count(F.lit(1)).alias("frequent"))
    rare = crowded.join(frequent, "node").withColumn("rare", F.col("n") - F.col("frequent"))
    dense = rare.filter(f"100 * (rare - {OVERLAPS}) < {100 - percent} * n")
    dense = stored(dense.select("node", F.expr(f"{100 - percent} * n - {100 + percent} * greatest(0, rare - {OVERLAPS - 1})").alias("slack"), F.expr("frequent - rare").alias("likeness")), "near-dense")
    inside = stored(members.filter(f"c > {RARE}").select("key", "node").join(dense, "node"), "near-long-lists")
    heads = stored(inside.groupBy("key").agg(F.max_by("node", F.struct("likeness", "node")).alias("x")), "near-heads")
    stars = inside.select("key", "node").join(heads, "key").filter("x <> node").select("x", F.col("node").alias("y")).distinct()
    return stored(stars, "near-stars"), dense.drop("likeness")


def _chunks(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(p, q, i, side, node): tasks of one node x each with a bounded number of its partners y."""
    sized = pairs.join(nodes.select(F.col("node").alias("y"), "n"), "y")
    many = sized.groupBy("x").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    many = stored(many, "near-hubs")  # a table of its own, so that a hub's pairs can be split
    cut = pairs.join(many, "x").withColumn("i", F.pmod(F.xxhash64("y"), F.col("parts")))
    ones = many.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.lit(0).alias("side"), F.col("x").alias("node"))
    rows = cut.select("x", "i", F.lit(1).alias("side"), F.col("y").alias("node")).union(ones)
    return rows.select(F.col("x").alias("p"), F.lit(-1).cast("long").alias("q"), "i", "side", "node")


def _blocks(family: DataFrame, percent: int) -> DataFrame:
    """(p, q, i, side, node): pairs of blocks of families (node, least, n, slack, part), part naming the component so far.

    A family's largest part is its core; the blocks of the others meet each other and the
    core's, as far as their sizes and slacks allow a link.  The core's blocks don't meet.
    """
    ratio = 100 / percent
    core = family.groupBy("least", "part").agg(F.count(F.lit(1)).alias("m")).groupBy("least").agg(F.max_by("part", "m").alias("core"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    # classes: z of size, a of slack for each shingle in steps, r whether outside the core
    placed = family.join(core, "least").withColumn("z", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(ratio)))).cast("long")).withColumn("r", (F.col("part") != F.col("core")).cast("int"))
    placed = placed.withColumn("a", F.floor(F.col("slack") / F.col("n") / F.lit(100 * STEP)).cast("long"))
    room = F.greatest(F.lit(2.0), F.least(F.lit(float(BLOCK)), F.lit(float(BLOCK_SHINGLES)) / F.pow(F.lit(ratio), F.col("z") + 1)))
    kinds = placed.groupBy("least", "z", "a", "r").agg(F.count(F.lit(1)).alias("m")).withColumn("s", F.ceil(F.col("m") / room).cast("long"))
    kinds = kinds.groupBy("least").agg(F.collect_list(F.struct("z", "a", "r", "s")).alias("kinds"))  # few for each size class

    def may_link(k: Column) -> Column:
        mine, other = F.col("a") + 1, k["a"] + 1  # the classes' upper ends
        outweighs = lambda x, y: (x > 0) | (y * 100 >= -x * percent)  # noqa: E731  sizes differ by the threshold at most
        return (F.abs(k["z"] - F.col("z")) <= 1) & ((k["r"] == 1) | (F.col("r") == 1)) & outweighs(mine, other) & outweighs(other, mine)

    code = lambda z, a, r, i: ((z * 2 + r) * 4096 + a + 2048) * (1 << 32) + i
    own = F.get(F.filter("kinds", lambda k: (k["z"] == F.col("z")) & (k["a"] == F.col("a")) & (k["r"] == F.col("r"))), F.lit(0))["s"]
    mine = code(F.col("z"), F.col("a"), F.col("r"), F.pmod(F.xxhash64("node"), own))
    others = F.flatten(F.transform(F.filter("kinds", may_link), lambda k: F.transform(F.sequence(F.lit(0).cast("long"), k["s"] - 1), lambda i: code(k["z"], k["a"], k["r"], i))))
    met = placed.join(kinds, "least").select("node", "least", mine.alias("b"), F.explode(others).alias("o"))
    # the same two blocks are named alike from both; a block that meets itself has one side
    return met.select(F.col("least").alias("p"), F.least("b", "o").alias("q"), F.greatest("b", "o").alias("i"), (F.col("b") > F.col("o")).cast("int").alias("side"), "node")


def _verified(tasks: DataFrame, sets: DataFrame, percent: int, what: str) -> DataFrame:
    """The links (x, y) that the tasks find by exact similarity."""
    return stored(tasks.join(sets, "node").groupBy("p", "q", "i").applyInPandas(_links(percent), "x long, y long"), what)


def _linked(docs: DataFrame, nodes: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(node, least): the component of each node that has a link."""
    members, crowded = _listed(nodes, percent)
    short = stored(_rated(_overlapping(members), nodes, percent), "near-short-pairs")
    needed = short.select(F.col("x").alias("node")).union(short.select("y")).union(crowded.select("node")).distinct()
    needed = stored(needed.join(nodes.select("node", "id"), "node"), "near-needed")
    texts = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(-1)).alias("_h"), F.col(text).alias("_text"))
    texts = maybe_present(texts, "_h", presence(needed.select(F.coalesce("id", F.lit(-1)).alias("id")))).select("_text")
    sets = stored(texts.mapInArrow(_sets(size), "node long, grams binary").join(needed.select("node"), "node").dropDuplicates(["node"]), "near-sets")

    every = _lists(sets.join(crowded.select("node"), "node", "left_semi").mapInArrow(_grams, "node long, key long"), "near-shingles")
    all_stars, dense = _stars(members, crowded, every, percent)
    stars = stored(_rated(all_stars, nodes, percent), "near-rated-stars")
    pairs = stored(short.union(_rated(_overlapping(every), nodes, percent)).distinct(), "near-pairs")
    first = stored(pairs.groupBy("y").agg(F.min("x").alias("x")).select("x", "y").union(stars).distinct(), "near-first")
    joined = components(_verified(_chunks(first, nodes), sets, percent, "near-first-links"), "near-parts")

    label = lambda c: joined.select(F.col("node").alias(c), F.col("least").alias("l" + c))
    apart = pairs.join(label("x"), "x", "left").join(label("y"), "y", "left").filter("coalesce(lx, x) <> coalesce(ly, y)").select("x", "y").join(first, ["x", "y"], "left_anti")
    family = components(all_stars, "near-families").join(nodes.select("node", "n"), "node").join(dense, "node").join(joined.withColumnRenamed("least", "part"), "node", "left")
    family = stored(family.select("node", "least", "n", "slack", F.coalesce("part", "node").alias("part")), "near-family")
    tasks = _chunks(stored(apart, "near-apart"), nodes).union(_blocks(family, percent))
    more = _verified(tasks, sets, percent, "near-more-links")
    discard(members, every, sets, short, needed, first, pairs)
    return components(joined.select(F.col("least").alias("x"), F.col("node").alias("y")).filter("x <> y").union(more), "near-components")


def _judged(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(doc_id, h, n, m, component_id, kept) of the m rows with the same id and text; kept goes for one of them, if n > 0."""
    sketched = _sketched(docs, key, text, size)
    nodes = sketched.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("id"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes, "near-nodes")
    with scratch(docs.sparkSession) as keep:
        linked = keep(_linked(docs, nodes, key, text, size, percent))
    ids = nodes.select("node", "id", "row").join(linked, "node", "left").select("node", "id", "row", F.coalesce("least", "node").alias("part"))
    part_ids = ids.groupBy("part").agg(F.min("id").alias("component_id"), F.min("row").alias("row"))
    named = ids.select("node", "part").join(part_ids, "part").select("node", "component_id", "row")
    return (
        sketched.groupBy("doc_id", "h", "n", "node")
        .agg(F.count(F.lit(1)).alias("m"))
        .join(named, "node", "left")
        .select(
            "doc_id", "h", "n", "m",
            F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            ((F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("h") == F.col("row.h")))).alias("kept"),
        )
    )


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``; kept is key = component_id, so true of every row with that id and null without one."""
    judged = _judged(docs, key, text, size, percent)
    each = judged.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    return each.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, of its smallest document; by default five-word shingles and 0.8."""
    kept = _judged(docs, key, text, size, percent).filter("kept AND n > 0")
    names = ["_id", "_null", "_hash"]
    row = {"_id": F.coalesce(F.col(key).cast("bigint"), F.lit(0)), "_null": F.col(key).cast("bigint").isNull(), "_hash": text_hash(text)}
    kept = kept.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.col("h").alias("_hash"))
    one = docs.withColumns(row).join(kept, names, "left_semi").dropDuplicates(names).select(docs.columns)
    return one.unionByName(docs.filter(~F.coalesce(F.col(text).rlike("[^\\x09-\\x0D\\x20]"), F.lit(False))))  # texts without words stand alone
