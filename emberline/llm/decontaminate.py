"""Benchmark decontamination: the q-gram lemma in diagonal bands proposes regions, banded alignment confirms them."""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .memory import let_go
from .text import as_text, byte_slices

Q = 8
_P = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4)]
FILTER_BITS = 23
SLICE = 2 << 20  # bytes of text that are searched together


def codes(text: str) -> np.ndarray:
    """Code points with A-Z lowered and ASCII white space as a space; one for each character, so places stay."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    c[(c >= 65) & (c <= 90)] += 32
    c[(c >= 9) & (c <= 13)] = 32
    return c


def qgrams(c: np.ndarray) -> np.ndarray:
    """Hashes of all runs of eight codes, by doubling: pairs, fours, eights."""
    h = c.astype(np.uint64) + np.uint64(1)
    for step, p in zip((1, 2, 4), _P, strict=True):
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] + h[step:] * p
    return h


def budget(n: int, rate: float) -> tuple[int, int]:
    """Edits allowed in n characters, and the q-grams that a region within them still shares: n + 1 - q (e + 1)."""
    e = min(int(n * rate), (n + 1) // Q - 1)
    return max(e, 0), n + 1 - Q * (max(e, 0) + 1)


def align(pattern: np.ndarray, text: np.ndarray, most: int, low: int, high: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of ``text`` nearest to ``pattern``, if within ``most`` edits, in a band of diagonals.

    Only cells with low <= place in text - place in pattern <= high are filled, one row of the band a character.
    """
    m, unit, none = len(text), len(text) + 1, np.int64(1) << np.int64(60)
    at = np.arange(low, high + 1)
    steps = np.arange(len(at)) * unit
    padded = np.full(max(m, high + len(pattern)) - min(low, 0) + 2, -1, np.int64)
    first = 1 - min(low, 0)
    padded[first : first + m] = text
    # edits and start in one number, so that the least edits win and then the latest start
    best = np.where((at >= 0) & (at <= m), m - at, none)
    for i, c in enumerate(pattern.tolist(), 1):
        last, end = best, at + i
        best = last + (padded[first + end[0] - 1 : first + end[-1]] != c) * unit
        best[:-1] = np.minimum(best[:-1], last[1:] + unit)
        best = np.minimum.accumulate(best - steps) + steps
        best[(end < 0) | (end > m)] = none
        if best.min() // unit > most:
            return None
    k = int((best // unit).argmin())
    return int(best[k] // unit), m - int(best[k] % unit), int(at[k]) + len(pattern)


def _below(y: np.ndarray, r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the pairs 0 <= u < r, 0 <= v < n have u + v < y."""
    corner = lambda z: np.maximum(z, 0) * (np.maximum(z, 0) + 1) // 2
    return corner(y) - corner(y - r) - corner(y - n) + corner(y - r - n)


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` counts that many rows: whose row it is, and its number there."""
    whose = np.repeat(np.arange(len(n)), n)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n)


@dataclasses.dataclass
class Index:
    """Q-grams of a block of benchmark items, as runs of places that hold the same one (of one letter, say)."""

    ids: list
    items: list[np.ndarray]
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    run: np.ndarray
    rate: float
    window: int

    @classmethod
    def of(cls, rows: list[tuple[int, str]], rate: float, window: int) -> Index:
        kept = [(i, codes(t)) for i, t in rows if t and len(t) >= Q]
        grams = [qgrams(c) for _, c in kept]
        keys = np.concatenate([np.zeros(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(kept)), [len(g) for g in grams]) if kept else np.zeros(0, int)
        place = np.concatenate([np.zeros(0, int), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(keys, kind="stable")
        keys, item, place = keys[order], item[order], place[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), (keys[1:] != keys[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1))))
        run = np.diff(np.append(first, len(keys)))
        return cls([i for i, _ in kept], [c for _, c in kept], keys[first], item[first].astype(np.int32), place[first].astype(np.int32), run.astype(np.int32), rate, window)

    def prepare(self) -> None:
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[self._slot(self.keys)] = True
        self.distinct, self.first = np.unique(self.keys, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.keys)))
        self.sorted = np.repeat(np.arange(len(self.distinct)), self.count) * max(len(self.items), 1) + self.item
        n = np.array([min(len(c), self.window) for c in self.items], np.int64)
        both = [budget(int(k), self.rate) for k in n]
        self.size, self.edits, self.need = n, np.array([b[0] for b in both], np.int64), np.array([b[1] for b in both], np.int64)
        self.longest = max(map(len, self.items), default=0)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def _shared(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of places of a q-gram that the block has: first place, which distinct q-gram, places."""
        at = np.flatnonzero(self.bits[self._slot(h)])
        if not len(at) or not len(self.distinct):
            return (np.zeros(0, np.int64),) * 3
        k = np.minimum(np.searchsorted(self.distinct, h[at]), len(self.distinct) - 1)
        same = self.distinct[k] == h[at]
        at, k = at[same], k[same]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(at), 1), bool), (at[1:] != at[:-1] + 1) | (k[1:] != k[:-1]))))
        return at[first], k[first], np.diff(np.append(first, len(at)))

    def search(self, texts: list[str], most: int = 1 << 18) -> list[tuple[int, int, int, int, int, int, int]]:
        """(text, item, item start, text start, text end, edits, shared q-grams) of the best region of each pair that has one.

        Bands of about ``most`` pairs of runs are counted at once: of several texts, or of one text and some of the items.
        """
        if not texts:
            return []
        cs = [codes(t) for t in texts]
        starts = np.concatenate(([0], np.cumsum([len(c) + 1 for c in cs])))
        h = qgrams(np.concatenate([np.append(c, 0).astype(np.uint32) for c in cs]))
        at, k, run = self._shared(h)
        text = np.searchsorted(starts, at, "right") - 1
        total = np.bincount(text, self.count[k] * (1 + run // 2), len(cs)) if len(at) else np.zeros(len(cs))
        out, first = [], 0
        while first < len(cs):
            last = max(first + 1, int(np.searchsorted(np.cumsum(total[first:]), most, "right")) + first)
            a, b = np.searchsorted(text, (first, last))
            if a < b:
                few = len(self.items)
                if total[first:last].sum() > most:  # one text: as many items at once as it has bands for
                    few = max(1, most // (len(cs[first]) + self.longest + 2))
                for low in range(0, len(self.items), few):
                    proposed = self._bands(starts, text[a:b], at[a:b], k[a:b], run[a:b], low, low + few, most)
                    for (t, i), bands in proposed.items():
                        if best := self._best(cs[t], h[starts[t] : max(starts[t + 1] - Q, starts[t])], i, bands):
                            out.append((t, i, *best))
            first = last
        return out

    def _bands(self, starts, text, at, k, run, low: int, high: int, most: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """By text and item of low <= item < high the bands that have enough shared q-grams: how many, and keys that end in shift and band."""
        items = max(len(self.items), 1)
        first = np.searchsorted(self.sorted, k * items + low)
        n = np.searchsorted(self.sorted, k * items + min(high, items)) - first
        some = n > 0
        text, at, run, first, n = (x[some] for x in (text, at, run, first, n))
        part = np.cumsum(n + n * run // 2) // most  # rows of one part are spread together
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
            if not len(rows):
                continue
            whose, number = _spread(n[rows])
            x, y = rows[whose], first[rows][whose] + number
            item, own, other = self.item[y].astype(np.int64), self.run[y].astype(np.int64), run[x]
            lowest = at[x] - starts[text[x]] - self.place[y] - own + 1 + self.longest
            half = self.edits[item] + 1
            new_keys, new_counts = [keys], [counts]
            for shift in (0, 1):
                band = (lowest + shift * half) // (2 * half)
                z, number = _spread((lowest + own + other - 2 + shift * half) // (2 * half) - band + 1)
                band = band[z] + number
                edge = band * 2 * half[z] - shift * half[z] - lowest[z]
                new_counts.append(_below(edge + 2 * half[z], other[z], own[z]) - _below(edge, other[z], own[z]))
                new_keys.append(((text[x][z] * items + item[z]) * 2 + shift) << np.int64(32) | band)
            keys, inverse = np.unique(np.concatenate(new_keys), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate(new_counts), len(keys)).astype(np.int64)
        pair = keys >> np.int64(33)
        full = counts >= self.need[pair % items] if len(keys) else np.zeros(0, bool)
        pair, counts, keys = (x[full] for x in (pair, counts, keys))
        order = np.lexsort((keys, -counts, pair))
        edge = np.append(np.flatnonzero(np.diff(pair[order], prepend=-1)), len(order))
        return {divmod(int(pair[order[a]]), items): (counts[order[a:b]], keys[order[a:b]]) for a, b in itertools.pairwise(edge)}

    def _best(self, c: np.ndarray, grams: np.ndarray, i: int, bands: tuple[np.ndarray, np.ndarray]):
        """The region with the fewest edits among the bands, the fullest first; stretches of text that read alike are aligned once."""
        half, e, own = int(self.edits[i]) + 1, int(self.edits[i]), qgrams(self.items[i])
        best, known = None, {}
        for count, key in zip(*bands, strict=True):
            shift, band = int(key) >> 32 & 1, int(key) & 0xFFFFFFFF
            low = band * 2 * half - shift * half - self.longest  # the band's first diagonal
            first, last = max(0, low - e), min(len(c), low + 2 * half + len(self.items[i]) + e)
            key = (low - first, c[first:last].tobytes())
            if key not in known:
                place, at = self._hits(own, grams[first : max(last - Q + 1, first)], low - first, 2 * half)
                known[key] = self._confirm(c[first:last], i, place, at) if len(place) else None
            got = known[key]
            if got and (best is None or got[3] < best[3]):
                best = (got[0], first + got[1], first + got[2], got[3], int(count))
            if best and best[3] == 0:
                break
        return best

    @staticmethod
    def _hits(own: np.ndarray, grams: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of equal q-grams in item and text on the diagonals from ``low`` on."""
        places, ats = [], []
        for d in range(low, low + width):
            a, b = max(0, -d), min(len(own), len(grams) - d)
            if a < b:
                p = np.flatnonzero(own[a:b] == grams[a + d : b + d]) + a
                places.append(p)
                ats.append(p + d)
        return (np.concatenate(places), np.concatenate(ats)) if places else (np.zeros(0, int),) * 2

    def _confirm(self, c: np.ndarray, i: int, place: np.ndarray, at: np.ndarray):
        """Align the item's windows that share enough q-grams in this band, the fullest first."""
        n, e, need, item = int(self.size[i]), int(self.edits[i]), int(self.need[i]), self.items[i]
        seen = np.bincount(np.unique(place), minlength=len(item) + 1)[: len(item) + 1]
        total = np.concatenate(([0], np.cumsum(seen)))
        a = np.arange(len(item) - n + 1)
        shared = total[a + n - Q + 1] - total[a]
        low, high = int((at - place).min()) - e, int((at - place).max()) + e
        for w in a[np.argsort(-shared, kind="stable")]:
            if shared[w] < need:
                return None
            first, last = max(0, int(w) + low), min(len(c), int(w) + n + high)
            if got := align(item[w : w + n], c[first:last], e, int(w) + low - first, int(w) + high - first):
                return int(w), first + got[1], first + got[2], got[0]
        return None


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int):
    """Blocks of the query set of at most ``most`` characters (or one longer item), read in a stream; whether more follow."""
    block, size = [], 0
    for i, t in benchmark.select(F.col(item_col).cast("long"), text_col).dropDuplicates().orderBy(F.col(item_col)).toLocalIterator():
        if block and size + len(t or "") > most:
            yield block, True
            block, size = [], 0
        block.append((i, t))
        size += len(t or "")
    yield block, False


FOUND = "doc_id long, item_id long, item_start int, doc_start int, doc_end int, edits int, shared int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, window: int = 100, block_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Pairs of document and benchmark item that share a region.

    A region is ``window`` characters of the item (the whole item if shorter) that some part of the document matches
    within ``rate`` edits a character, and no more than the q-gram lemma leaves a q-gram for; letter case of A-Z and
    kinds of ASCII white space do not count. By the lemma a region of n characters within e edits shares
    n + 1 - 8 (e + 1) of its 8-grams, and they lie within e diagonals, so in one of two overlapping bands of 2 (e + 1);
    bands with that many are aligned. One row a pair: places (code points, end exclusive), ``edits``, ``shared`` 8-grams.

    The benchmark is the query set: it passes through the driver in blocks of ``block_chars`` characters, each against
    all documents; of several blocks only one is held at a time, as the pairs of all but the last are stored. Rows that
    share an id or have none, and repeated rows, give their own pairs; an item given twice counts once. Items shorter
    than 8 characters or null match nothing, null texts are empty, and so is the result of an empty table. Nothing of
    the documents is shuffled.
    """
    rows, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), None
    for block, more in _blocks(benchmark, item_col, "text", block_chars):
        part = rows.mapInArrow(_finder(Index.of(block, rate, window)), FOUND)
        part = stored(part, "leaks") if more else part
        out = part if out is None else out.unionByName(part)
    return out


def _finder(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        index.prepare()
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE):
                ids, found = part.column(0).to_pylist(), index.search(as_text(part.column(1)))
                cols = list(zip(*((ids[t], index.ids[i], *rest) for t, i, *rest in found), strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), *[pa.int32()] * 5), strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, window: int = 100, block_chars: int = 2_000_000, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows whose text shares no region (:func:`find_leaks`) with any benchmark item, all columns as they are.

    Each row is judged by its own text, so ids and repeated rows play no part. Between two blocks of the benchmark what
    is left is stored.
    """
    at = docs.columns.index(text_col)
    for block, more in _blocks(benchmark, item_col, "text", block_chars):
        docs = docs.mapInArrow(_dropper(Index.of(block, rate, window), at), docs.schema)
        docs = stored(docs, "clean") if more else docs
    return docs


def _dropper(index: Index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        index.prepare()
        for batch in batches:
            for part in byte_slices(batch, at, SLICE):
                keep = np.ones(part.num_rows, bool)
                keep[[x[0] for x in index.search(as_text(part.column(at)))]] = False
                yield part.filter(pa.array(keep))

    return run
