"""SentencePiece encoding and decoding with exact N-best segmentation.

The lattice of a text has its character positions as nodes and the vocabulary's pieces
as edges; a segmentation's score is the sum of its pieces' scores.  A character without
a piece falls back to its UTF-8 bytes, at ten below the lowest score.  A space belongs
to the piece after it, as in the model, or to a piece of several spaces.  Hence no edge
crosses the start of a run of spaces or a line end, and a text's lattice is a chain of
word lattices, each a word with the whole run of spaces before it (or a run before a
line end): its best path joins the words' best paths, and its N best differ from it only
in the N - 1 words whose second path loses least.  A model with pieces that cross these
places is refused.

Word lattices of a slice are solved together: forward and backward Viterbi scores give
each word's best path and the loss of its second (the best path through any edge off
the best one).  ``nbest`` then finds the N best of those few words by a backward A-star
search whose heuristic, the forward Viterbi score of a node, is exact; a node is extended
N times at most, so equal scores cost no more than others.  The N - 1 cheapest ways to
leave one best path bound the losses that the search keeps, and its nodes and tails are
numbers in arrays: some tens of bytes for each character of a word, however long.  Their ids
are put into the best path, which gives all N segmentations of the text.

Decoding joins the pieces' bytes and drops the leading space; it gives the very text,
also for texts that hold the mark U+2581 (encoded as bytes) or control characters.

Defined cases: null and empty texts have no pieces, score 0 and no second path; equal
scores are ordered by the ids of the whole text; repeated rows each get a result; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .tokens import Words, mix, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
OWN_MARK = "\ud800"  # stands for the mark as a text's own character; no valid text holds it
LEAST = -1e8  # a score below this marks a piece that merges never make; it counts as the lowest above
CACHED, LISTS, NONE, CELLS, LONG = 500_000, 100_000, -(1 << 60), 1 << 21, 2000

_CUT = np.zeros(256, bool)
_CUT[[10, 32]] = True
_K = np.uint64(0x9E3779B97F4A7C15)


def _next(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code.astype(np.uint64)) * _K
    return h ^ (h >> np.uint64(29))


def _fallback(char: str) -> bytes:
    return (MARK if char == OWN_MARK else char).encode()


def _first_byte(code: np.ndarray) -> np.ndarray:
    """The first UTF-8 byte of each character's fallback."""
    c = np.where(code == ord(OWN_MARK), ord(MARK), code).astype(np.int64)
    return np.select([c < 0x80, c < 0x800, c < 0x10000], [c, 0xC0 | c >> 6, 0xE0 | c >> 12], 0xF0 | c >> 18)


class Pieces:
    """The vocabulary as plain tables: made on the driver, shipped to the tasks.

    Scores are whole multiples of 1 / ``scale``, so that sums and ties are exact; ``scale`` is
    1 for the given model and the least power of two for one with log probabilities.
    """

    def __init__(self, texts: dict[str, tuple[int, float]], byte_ids: list[int]):
        given = np.array([s for _, s in texts.values()], float)
        self.scale = 1
        while (given * self.scale % 1).any():
            self.scale *= 2
            if np.abs(given).max() * self.scale >= 1 << 36:
                raise ValueError("the scores are no multiples of a power of two that leaves room for their sums")
        texts = {t: (i, int(s * self.scale)) for t, (i, s) in texts.items()}
        self.texts, self.byte_ids = texts, byte_ids
        self.unknown = min(s for _, s in texts.values()) - 10 * self.scale
        self.longest = max(map(len, texts))
        top = max([i for i, _ in texts.values()] + byte_ids) + 1
        spelled: list[bytes] = [b""] * top
        for t, (i, _) in texts.items():
            spelled[i] = t.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            spelled[i] = bytes([b])
        self.spelled = spelled
        self.size = np.array([len(x) for x in spelled])
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.tables, prefixes = [], [set() for _ in range(self.longest + 1)]
        for t in texts:
            for k in range(1, len(t) + 1):
                prefixes[k].add(t[:k])
        self.heads = frozenset().union(*prefixes)
        for k in range(1, self.longest + 1):  # by length: hashes of all prefixes, with id and score where one is a piece
            group = sorted(prefixes[k])
            h = np.zeros(len(group), np.uint64)
            codes = np.array([[ord(c) for c in t] for t in group], np.uint64).reshape(len(group), k)
            for j in range(k):
                h = _next(h, codes[:, j])
            order = np.argsort(h)
            found = [texts.get(group[x], (-1, NONE)) for x in order]
            self.tables.append((h[order], np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)))

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        texts = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if crossing := [p for p in texts if MARK in p.lstrip(MARK) or "\n" in p[:-1] or "\n" in p[1:]]:
            raise ValueError(f"{len(crossing)} pieces cross the start of a word or a line end, such as {crossing[0]!r}")
        least = min(s for _, s in texts.values() if s > LEAST)
        texts = {p: (i, max(s, least)) for p, (i, s) in texts.items()}
        return cls(texts, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def solve(self, words: list[str]) -> list[tuple[list[int], int, int]]:
        """(best ids, its score, loss of the second path or -1), times ``scale``, of each word lattice; words begin with marks or not."""
        flat, size, score, loss = self.solved(words)
        return [(x.tolist(), a, b) for x, a, b in zip(np.split(flat, np.cumsum(size)[:-1]), score.tolist(), loss.tolist(), strict=True)] if words else []

    def solved(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``solve`` as arrays: ids one word after the other, their number, score and loss of each word."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at, found = 0, []
        while at < len(order):
            if len(words[order[at]]) > LONG:  # a column for each of its characters would hold one number
                two = self.paths(words[order[at]], 2)
                found.append((two[0][1], np.array([len(two[0][1])]), np.array([two[0][0]]), np.array([two[0][0] - two[1][0] if len(two) > 1 else -1])))
                at += 1
                continue
            to, room = at, 0
            while to < len(order) and to - at < 4096:
                width = len(words[order[to]])
                if to > at and ((to - at + 1) * width * self.longest > CELLS or width > 2 * len(words[order[at]]) + 4) or width > LONG:
                    break
                to, room = to + 1, width
            found.append(self._solve([words[i] for i in order[at:to]], room))
            at = to
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        flat, size, score, loss = (np.concatenate(x) for x in zip(*found, strict=True))
        back = np.argsort(np.array(order), kind="stable")
        begin = (np.cumsum(size) - size)[back]
        size = size[back]
        return flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(flat))], size, score[back], loss[back]

    def _solve(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``solved`` for words of similar length: places are rows, words are columns and stand at the end."""
        m = len(words)
        size = np.array([len(w) for w in words])
        pad = width - size
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(m), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + pad[word]
        code = np.zeros((width, m), np.uint64)
        code[place, word] = flat
        edges, w, c, lead = [], word, place, None
        h = np.zeros(len(w), np.uint64)
        for k in range(1, min(self.longest, width) + 1):  # edges of k characters, from starts that still are a prefix
            inside = c + k <= width
            w, c, h = w[inside], c[inside], h[inside]
            h = _next(h, code[c + k - 1, w])
            names, ids, scores = self.tables[k - 1]
            spot = np.minimum(np.searchsorted(names, h), len(names) - 1)
            alive = names[spot] == h
            w, c, h, spot = w[alive], c[alive], h[alive], spot[alive]
            score, piece = np.full((width, m), NONE), np.full((width, m), -1)
            score[c, w], piece[c, w] = scores[spot], ids[spot]
            if k == 1:
                lone = np.zeros((width, m), bool)
                lone[place, word] = True
                lone &= score == NONE
                score[lone] = self.unknown
                lead = np.where(lone, np.array(self.byte_ids)[_first_byte(code)], piece)
            edges.append((score, piece))
            if not len(w):
                break
        f, b = np.full((width + 1, m), NONE), np.full((width + 1, m), NONE)
        step = np.zeros((width, m), np.int64)
        f[pad, np.arange(m)] = 0
        b[width] = 0
        for e in range(1, width + 1):
            for k in range(1, min(len(edges), e) + 1):
                np.maximum(f[e], f[e - k] + edges[k - 1][0][e - k], out=f[e])
        for s in range(width - 1, -1, -1):  # edges from one node have different first ids, so the least one gives the least ids of equal scores
            least = np.zeros(m, np.int64)
            for k in range(1, min(len(edges), width - s) + 1):
                v, i = b[s + k] + edges[k - 1][0][s], (lead if k == 1 else edges[k - 1][1])[s]
                better = (v > b[s]) | ((v == b[s]) & (i < least) & (v > NONE))
                np.copyto(b[s], v, where=better)
                np.copyto(least, i, where=better)
                np.copyto(step[s], k, where=better)
        best = f[width]
        used = [np.zeros((width, m), bool) for _ in edges]
        at, steps = pad.copy(), []
        live = np.flatnonzero(at < width)
        while len(live):  # the next piece of all words that are not at their end
            s = at[live]
            k = step[s, live]
            piece = np.full(len(live), -1)
            for kk in np.unique(k).tolist():
                mine = k == kk
                piece[mine] = edges[kk - 1][1][s[mine], live[mine]]
                used[kk - 1][s[mine], live[mine]] = True
            steps.append((live, piece, code[s, live]))
            at[live] = s + k
            live = live[s + k < width]
        loss = np.full(m, 1 << 60)
        for k, (score, _) in enumerate(edges, 1):
            n = width - k + 1
            through = f[:n] + score[:n] + b[k:k + n]
            np.minimum(loss, np.where(used[k - 1][:n] | (through < NONE // 2), 1 << 60, best - through).min(axis=0), out=loss)
        of, ids, char = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(of, kind="stable")
        of, ids, char = of[order], ids[order], char[order]
        lone = np.flatnonzero(ids < 0)
        if len(lone):  # characters without a piece become bytes
            spelled = [_fallback(chr(c)) for c in char[lone].tolist()]
            many = np.ones(len(ids), np.int64)
            many[lone] = [len(x) for x in spelled]
            of, ids = np.repeat(of, many), np.repeat(ids, many)
            ids[ids < 0] = [self.byte_ids[x] for y in spelled for x in y]
        return ids, np.bincount(of, minlength=m), best, np.where(loss < 1 << 60, loss, -1)

    def nbest(self, word: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best segmentations (score, ids) of a word or text with marks, best first, equal scores by their ids.  Scores are times ``scale``."""
        return [(score, ids.tolist()) for score, ids in self.paths(word, n)]

    def _into(self, word: str, e: int) -> Iterator[tuple[int, int, int]]:
        """(start, id, score) of the edges that end at place e."""
        for s in range(max(0, e - self.longest), e):
            if found := self.texts.get(word[s:e]):
                yield s, *found
            elif s == e - 1:
                yield s, self.byte_ids[_fallback(word[s])[0]], self.unknown

    def _forward(self, word: str) -> array:
        """The best score of a path to each place."""
        size = len(word)
        best = array("q", [NONE]) * (size + 1)
        best[0] = 0
        for s in range(size):
            here = best[s]
            for e in range(s + 1, min(size, s + self.longest) + 1):
                text = word[s:e]
                found = self.texts.get(text)
                if found or e == s + 1:
                    v = here + (found[1] if found else self.unknown)
                    if v > best[e]:
                        best[e] = v
                if text not in self.heads:
                    break
        return best

    def _bound(self, word: str, n: int, best: array) -> int:
        """A loss that n segmentations do not exceed: a best path and the n - 1 least losses of those that first leave it, from the end, by some other edge."""
        least: list[int] = []  # negative, the greatest loss first
        e = len(word)
        while e:
            back = -1
            for s, _, v in self._into(word, e):
                loss = best[e] - best[s] - v
                if back < 0 and not loss:
                    back = s
                elif len(least) < n - 1:
                    heapq.heappush(least, -loss)
                elif least and loss < -least[0]:
                    heapq.heapreplace(least, -loss)
            e = back
        return -least[0] if least and len(least) == n - 1 else 0 if n == 1 else 1 << 62

    def paths(self, word: str, n: int) -> list[tuple[int, np.ndarray]]:
        """``nbest`` with ids as arrays.

        Forward Viterbi scores are the exact cost of what lies before a node; so a search from
        the end that always extends the tail with the least loss meets the segmentations in
        order.  Of equal losses the tail that begins further back goes first, then that with the
        lesser ids; so a node meets its tails in their final order, and the n first are enough.
        """
        size, best = len(word), self._forward(word)
        bound = self._bound(word, n, best)
        tails = array("i", [0]) * (size + 1)  # their number at each node
        begin, first, rest = array("i"), array("i"), array("i")  # of each tail: its node, first id and the tail after that
        heap = [(0, -size, -1, 0, 0, -1)]  # (loss, minus node, first id, rank of the rest, node of the rest, the rest)
        ends = []
        while heap and len(ends) < n:
            loss, node, i, _, _, after = heapq.heappop(heap)
            node, rank = -node, tails[-node]
            if rank >= n:
                continue
            mine = len(rest)
            tails[node] += 1
            begin.append(node)
            first.append(i)
            rest.append(after)
            if not node:
                ends.append((mine, loss))
                continue
            for s, i, v in self._into(word, node):
                more = loss + best[node] - best[s] - v
                if more <= bound and tails[s] < n:
                    heapq.heappush(heap, (more, -s, i, rank, node, mine))
        out = []
        for tail, loss in ends:
            ids = array("i")
            while rest[tail] >= 0:
                s, e = begin[tail], begin[rest[tail]]
                if word[s:e] in self.texts:
                    ids.append(first[tail])
                else:
                    ids.extend(self.byte_ids[x] for x in _fallback(word[s]))
                tail = rest[tail]
            out.append((best[size] - loss, np.array(ids, np.int32)))
        return out

    def decode(self, ids) -> str:
        return b"".join(self.spelled[i] for i in ids)[1:].decode("utf-8", "surrogatepass")


class Encoder:
    """Encodes slices; keeps the solved words of a task's process, at most ``CACHED`` of them."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.lists: dict[tuple[int, int], tuple[list[tuple[int, int, bytes]], bool, bool]] = {}
        self.ids = np.zeros(0, np.int32)
        self.start = self.size = self.score = self.loss = np.zeros(0, np.int64)

    def _learn(self, keys: list[int], words: list[str]) -> None:
        ids, size, score, loss = self.pieces.solved(words)
        n = len(self.start)
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.size, self.score, self.loss = (np.concatenate(x) for x in ((self.size, size), (self.score, score), (self.loss, loss)))

    def _list(self, key: int, word: str, n: int) -> tuple[list[tuple[int, int, bytes]], bool, bool]:
        """A word's n best as (loss, rank by ids, ids), whether the second has the greater ids, and whether all spell the same."""
        if (key, n) not in self.lists:
            if len(self.lists) > LISTS:
                self.lists.clear()
            found = self.pieces.paths(word, n)
            order = [ids.astype(">i4").tobytes() for _, ids in found]  # sorts as the ids
            rank = {i: r for r, i in enumerate(sorted(range(len(found)), key=order.__getitem__))}
            same = len({b"".join(self.pieces.spelled[i] for i in ids) for _, ids in found}) == 1
            self.lists[key, n] = [(found[0][0] - s, rank[i], ids.astype("<i4").tobytes()) for i, (s, ids) in enumerate(found)], order[1] > order[0], same
        return self.lists[key, n]

    def encode(self, data: np.ndarray, offsets: np.ndarray, n: int):
        """(ids, pieces per text, score, others, alike) of the texts of a slice.

        ``others`` holds the 2nd..n-th segmentation of each text: its loss, and what to put
        into the best path's ids as (from, to, ids).  ``alike`` says that all spell the same.
        """
        words = Words(data, offsets, apart=_CUT)
        own = np.repeat(np.arange(words.n), np.diff(offsets))
        solid = np.concatenate([[0], np.maximum.accumulate(np.where(data != 32, np.arange(1, len(data) + 1), 0))])

        def spaces(at: np.ndarray, d: np.ndarray) -> np.ndarray:
            """Spaces just before a place of text d, with the one that stands before each text."""
            begin = np.maximum(solid[at], offsets[d])
            return at - begin + (begin == offsets[d])

        w = words.start
        line = np.flatnonzero(data == 10)
        full = np.flatnonzero(np.diff(offsets) > 0)
        many, before, tail = spaces(w, words.doc), spaces(line, own[line]), spaces(offsets[full + 1], full)
        led, ended = before > 0, tail > 0  # runs of spaces that end with a line or the text
        key = words.hashes() ^ mix(many)
        runs = np.concatenate([tail[ended], before[led]])
        keys = np.concatenate([runs.astype(np.uint64) << np.uint64(8), key, np.full(len(line), 10, np.uint64)])
        place = np.concatenate([offsets[full[ended] + 1] * 2 - 1, line[led] * 2 - 1, w * 2, line * 2])
        ref = np.concatenate([np.full(len(runs), -1), np.arange(len(w)), np.full(len(line), -1)])
        doc = np.concatenate([full[ended], own[line[led]], words.doc, own[line]])
        order = np.argsort(place, kind="stable")
        keys, ref, doc = keys[order], ref[order], doc[order]
        unique, index, inverse = np.unique(keys, return_index=True, return_inverse=True)

        text = data.tobytes().decode("utf-8", "surrogatepass").replace(MARK, OWN_MARK)
        char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
        heads, tails, lead = char[words.start].tolist(), char[words.end].tolist(), many.tolist()
        firsts = ref[index].tolist()

        def spell(u: int) -> str:
            r = firsts[u]
            if r < 0:
                return MARK * (int(unique[u]) >> 8) or "\n"
            return MARK * lead[r] + text[heads[r]:tails[r]]

        if len(self.known) > CACHED:
            self.reset()
        listed = unique.tolist()
        missing = [i for i, k in enumerate(listed) if k not in self.known]
        if missing:
            self._learn([listed[i] for i in missing], [spell(i) for i in missing])
        known = self.known
        unit = np.array([known[k] for k in listed], np.int64)[inverse] if listed else np.zeros(0, np.int64)
        size = self.size[unit]
        total = int(size.sum())
        flat = self.ids[np.repeat(self.start[unit] - (np.cumsum(size) - size), size) + np.arange(total)]
        per = np.bincount(doc, weights=size, minlength=words.n).astype(np.int64)
        score = np.zeros(words.n, np.int64)
        np.add.at(score, doc, self.score[unit])
        others: list[list[tuple[int, list[tuple[int, int, bytes]]]]] = [[] for _ in range(words.n)]
        alike = np.ones(words.n, bool)
        if n > 1:
            loss, begin = self.loss[unit], np.cumsum(size) - size
            can = np.flatnonzero(loss >= 0)
            can = can[np.lexsort((loss[can], doc[can]))]
            head = np.searchsorted(doc[can], doc[can])
            last = np.minimum(head + n - 2, np.searchsorted(doc[can], doc[can], side="right") - 1)
            can = can[loss[can] <= loss[can[last]]]  # with all that lose as much as the last one needed
            up = loss[can] == 0  # the best has the least ids of its score
            tied = np.flatnonzero(~up)
            kinds, kind = np.unique(inverse[can[tied]], return_inverse=True)
            up[tied] = np.array([self._list(listed[u], spell(u), n)[1] for u in kinds.tolist()], bool)[kind]
            # of equal losses, lesser ids first: an early place for a word that they make less, a late one for others
            can = can[np.lexsort((np.where(up, -can, can), up, loss[can], doc[can]))]
            rank = np.arange(len(can)) - np.searchsorted(doc[can], doc[can])
            can = np.sort(can[rank < n - 1])
            can = can[np.argsort(doc[can], kind="stable")]
            for d, units in zip(*self._by_doc(doc[can], can), strict=True):
                sums: list[tuple[int, tuple[int, ...], tuple[int, ...]]] = [(0, (), ())]
                each = []
                for u in units:
                    ranked, _, same = self._list(listed[inverse[u]], spell(int(inverse[u])), n)
                    each.append(ranked)
                    alike[d] &= same
                    sums = heapq.nsmallest(n, ((a + x, (*r, y), (*c, i)) for a, r, c in sums for i, (x, y, _) in enumerate(ranked)))
                at = [(int(begin[u]), int(begin[u] + size[u])) for u in units]
                others[d] = [(a, [(*at[j], each[j][i][2]) for j, i in enumerate(c) if i]) for a, _, c in sums[1:]]
        return flat, per, score, others, alike

    @staticmethod
    def _by_doc(doc: np.ndarray, units: np.ndarray):
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        return doc[at].tolist(), [x.tolist() for x in np.split(units, at[1:])] if len(doc) else []

    def spelled(self, flat: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bytes per text) of encoded texts, each with the space that stands before it."""
        p = self.pieces
        size = p.size[flat]
        out = p.flat[np.repeat(p.at[flat] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        ends = np.concatenate([[0], np.cumsum(size)])
        cuts = np.concatenate([[0], np.cumsum(per)])
        return out, np.diff(ends[cuts])


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    if shared.value is not getattr(_ENCODERS.get(0), "pieces", None):
        _ENCODERS[0] = Encoder(shared.value)
    return _ENCODERS[0]


def _put(ids: memoryview, a: int, b: int, new) -> bytes:
    """The ids from a to b with some stretches replaced, as little-endian 32-bit integers."""
    out = []
    for x, y, other in new:
        out += [ids[4 * a:4 * x], other]
        a = y
    return b"".join([*out, ids[4 * a:4 * b]])


def _ends(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _run(shared, n: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        encoder = _encoder(shared)
        scale = encoder.pieces.scale
        for batch in batches:
            for at, to, data, offsets in slices(batch.column(1)):
                flat, per, score, others, alike = encoder.encode(data, offsets, n)
                ends = np.concatenate([[0], np.cumsum(per)])
                first = [batch.column(0).slice(at, to - at), pa.array(per), pa.array(score / scale)]
                scores = pa.array([[(s - x) / scale for x in [0, *(loss for loss, _ in more)]] for s, more in zip(score, others, strict=True)], pa.list_(pa.float64()))
                ids = memoryview(flat.astype("<i4").tobytes())
                every = [[_put(ids, a, b, ()), *(_put(ids, a, b, new) for _, new in more)] for a, b, more in zip(ends[:-1].tolist(), ends[1:].tolist(), others, strict=True)]
                text, size = encoder.spelled(flat, per)
                lead = np.cumsum(size) - size
                filled = size > 0
                body = np.ones(len(text), bool)
                body[lead[filled]] = False
                whole = np.array_equal(size - filled, np.diff(offsets)) and np.array_equal(text[body], data)
                back = [same and (whole or text[a + f:a + s].tobytes() == data[x:y].tobytes()) for a, s, f, x, y, same in zip(lead, size, filled, offsets[:-1], offsets[1:], alike.tolist(), strict=True)]
                if not digest:
                    inner = pa.ListArray.from_arrays(pa.array(_ends([len(x) // 4 for row in every for x in row])), pa.array(np.frombuffer(b"".join(x for row in every for x in row), "<i4")))
                    nbest = pa.ListArray.from_arrays(pa.array(_ends([len(row) for row in every])), inner)
                    yield pa.RecordBatch.from_arrays([*first, scores, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)), nbest, pa.array(back, pa.bool_())], ["k", "n_pieces", "score", "scores", "ids", "nbest_ids", "round_trip"])
                    continue
                sums = [[hashlib.sha256(x).hexdigest() for x in row] for row in every]
                yield pa.RecordBatch.from_arrays([*first, scores, pa.array([x[0] for x in sums], pa.string()), pa.array(sums, pa.list_(pa.string())), pa.array(back, pa.bool_())], ["k", "n_pieces", "score", "scores", "ids_sha256", "nbest_sha256", "round_trip"])

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, model: str = MODEL) -> DataFrame:
    """(key, n_pieces, score, scores of the n best, ids array<int>, nbest_ids array<array<int>>, round_trip) for each row of ``docs``.

    ``nbest_ids`` holds the n best segmentations in the order of ``scores``; ``ids`` is the first.
    round_trip says that decoding each gives the very text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("_text"))
    return rows.mapInArrow(_run(shared, n, False), "k long, n_pieces long, score double, scores array<double>, ids array<int>, nbest_ids array<array<int>>, round_trip boolean").withColumnRenamed("k", key)


def encode_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, model: str = MODEL) -> DataFrame:
    """(key, n_pieces, score, scores, ids_sha256, nbest_sha256, round_trip): ``encode``, then ``decode`` in the same task.

    ids_sha256 is over the ids as little-endian 32-bit integers, nbest_sha256 has one for
    each of the n best segmentations; round_trip says that decoding each gives the very text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("_text"))
    return rows.mapInArrow(_run(shared, n, True), "k long, n_pieces long, score double, scores array<double>, ids_sha256 string, nbest_sha256 array<string>, round_trip boolean").withColumnRenamed("k", key)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its ids, in place of a column of that name; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))
    encoded = encoded if out == ids else encoded.drop(out)
    schema = StructType([*encoded.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return encoded.mapInArrow(run, schema)
