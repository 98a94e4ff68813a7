"""Suffix-array dedup: bytes covered by strings of ``width`` bytes that also start elsewhere, by blockwise suffix sorting.

Suffixes need an order only down to ``width`` bytes. A difference cover D modulo v has, for any two residues, an offset
below v that takes both into D, so of two suffixes that agree for ``width`` bytes some cover samples, at one offset
below v, agree for h = ``width`` - v + 1.

1. The cover samples (places whose residue is in D, 12 of 133) of all distinct texts are ranked by their first h bytes.
   Only ranks that occur twice matter: a suffix without such a sample within v places ties with none.
2. Long ties are resolved by these ranks, without text: samples p, p + v and p + 2 v together rank p to h + 2 v bytes.
   Where such a rank occurs twice, the v + 2 suffixes from p on are settled, at all its places; one place leads.
3. The suffixes left open are sorted bucket by bucket, by the first ``width`` bytes, with those of leading places.

Which of two different strings comes first plays no part, so buckets and order go by 64-bit fingerprints of prefixes,
two polynomials in prime fields. Samples keep 40 bits and the bucket's number, which adds bits as the corpus and with it
the number of buckets grows: they only admit and settle (the latter by three at once); what is sorted in the end keeps 64.
A bucket is one group of packed arrays, so a task holds ``bucket_bytes`` of text's share at once. Ranks that occur twice
within a task's share of the input are known there, and one row of each goes on, so a passage that a third of all
texts hold gives a bucket one row a task. Equal texts are one text with a count.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .memory import let_go
from .text import as_bytes, byte_slices, mix, named_apart

#: Prime fields of fingerprints with their bases. Modulo a power of two, unlike strings of a simple law (Thue and Morse's
#: letters and the same with both letters changed) have one polynomial, whatever the base.
FIELDS = ((4294967291, 0xA0761D65), (4294967279, 0x78BD642F))
CHUNK = 1 << 20  # bytes of a text whose prefix sums are held at once
FLUSH = 1 << 20  # entries that a task packs at once
PACK = "bucket int, known boolean, a binary, b binary, page binary, count binary, place binary, value binary"
TEXT = "a long, b int, open binary, sure binary, lead binary"


def difference_cover(order: int) -> tuple[int, np.ndarray]:
    """(v, D): residues modulo v = order**2 + order + 1 of which each difference but 0 occurs once (Singer; prime order).

    D holds the exponents i of a root of a cubic over the field of ``order`` elements for which its power i lies in a plane.
    """
    v = order * order + order + 1
    for a, b, c in itertools.product(range(order), range(order), range(1, order)):
        x, inside = (0, 0, 1), []
        for i in range(v):
            if x[0] == 0:
                inside.append(i)
            x = (x[1] + a * x[0]) % order, (x[2] + b * x[0]) % order, c * x[0] % order
        if len(inside) == order + 1 and len({(p - q) % v for p in inside for q in inside}) == v:
            return v, np.array(inside)
    raise ValueError(f"no cover of order {order}; it must be prime")


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each field its base's powers from 0 to n - 1 and their inverses."""

    def ascend(base: int, prime: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate((out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)))
        return out[:n].copy()

    return [(ascend(base, prime), ascend(pow(base, -1, prime), prime)) for prime, base in FIELDS]


def prefixes(text: bytes, places: np.ndarray, length: int, powers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """64-bit fingerprints of the ``length`` bytes from each of ``places`` (ascending); the text is summed chunk by chunk.

    They are two polynomials over the bytes in prime fields of 32 bits. A sum has CHUNK + ``length`` terms below 2**40, so
    it stays below 2**64 and is taken modulo the prime at the places only.
    """
    out, data = np.empty(len(places), np.uint64), np.frombuffer(text, np.uint8)
    for start in range(0, max(len(data) - length, 0) + 1, CHUNK):
        i, j = np.searchsorted(places, (start, start + CHUNK))
        if i < j:
            part, at, both = data[start : start + CHUNK + length].astype(np.uint64), places[i:j] - start, []
            for (prime, _), (up, down) in zip(FIELDS, powers, strict=True):
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part * up[: len(part)], out=total[1:])
                both.append((total[at + length] - total[at]) % np.uint64(prime) * down[at] % np.uint64(prime))
            out[i:j] = both[0] << np.uint64(32) | both[1]
    return mix(out)


class Entries:
    """Places of texts with values, in columns: text key (a, b), place, value, and whether it is known to occur twice."""

    KINDS = (np.uint64, np.uint32, np.uint64, np.uint64, bool)

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, a: int, b: int, place: np.ndarray, value: np.ndarray, sure: bool = False) -> None:
        n = len(place)
        self.parts.append((np.full(n, a, np.uint64), np.full(n, b, np.uint32), place.astype(np.uint64), value, np.full(n, sure)))
        self.size += n

    def take(self) -> list[np.ndarray]:
        parts, self.parts, self.size = self.parts, [], 0
        return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(zip(*parts) if parts else [()] * 5, self.KINDS, strict=True)]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it (the first does)."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _row(bucket: int, known: bool, a, b, place, value) -> tuple:
    """One packed row of entries in the order of text and place: runs of one text and 64 K places, 16 bits a place."""
    page = (place >> np.uint64(16)).astype(np.uint32)
    first = np.flatnonzero(_changes(a, b, page))
    count = np.diff(np.append(first, len(a))).astype(np.uint32)
    return (bucket, known, *(x.tobytes() for x in (a[first], b[first], page[first], count, place.astype(np.uint16), value)))


def _unpack(table: pa.Table | pa.RecordBatch, value_kind) -> list[np.ndarray]:
    columns = [b"".join(table.column(c).to_pylist()) for c in ("a", "b", "page", "count", "place")]
    a, b, page, count = (np.frombuffer(x, k) for x, k in zip(columns, (np.uint64, np.uint32, np.uint32, np.uint32)))
    place = np.repeat(page.astype(np.uint64) << np.uint64(16), count) + np.frombuffer(columns[4], np.uint16)
    return [np.repeat(a, count), np.repeat(b, count), place, np.frombuffer(b"".join(table.column("value").to_pylist()), value_kind)]


RANK = np.dtype([("low", "<u4"), ("high", "u1")])  # 40 bits beside the bucket's number


def _batch(rows: list[tuple], schema: str = PACK) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    return ((value >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


def _routed(entries: list[np.ndarray], buckets: int, short: bool) -> Iterator[tuple]:
    """Rows for the buckets of the values; values that several entries of this share have are known to occur twice.

    So are values of entries that come as known. A known value sends one of its entries to its bucket, marked; those of
    its entries that did not come as known go on as they are (``known`` rows, which hold ranks of 64 bits and go to the
    buckets of their texts).
    """
    a, b, place, value, sure = entries
    if short:
        value = (_bucket(value, buckets) << np.uint64(40)) | (value & np.uint64((1 << 40) - 1))
    order = np.lexsort((place, b, a, value))
    a, b, place, value, sure = (x[order] for x in (a, b, place, value, sure))
    once = _changes(value, a, b, place)
    a, b, place, value, sure = (x[once] for x in (a, b, place, value, sure))
    first = _changes(value)
    known = ~first
    known[:-1] |= ~first[1:]
    run = np.cumsum(first) - 1
    known |= (np.bincount(run, sure) > 0)[run]
    at = value >> np.uint64(40) if short else _bucket(value, buckets)
    for marked in (False, True):
        pick = np.flatnonzero(first & (known == marked))
        pick = pick[np.lexsort((place[pick], b[pick], a[pick], at[pick]))]
        edge = np.searchsorted(at[pick], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edge)):
            p = pick[edge[k] : edge[k + 1]]
            v = value[p]
            if short:
                packed = np.empty(len(p), RANK)
                packed["low"], packed["high"] = v & np.uint64(0xFFFFFFFF), (v >> np.uint64(32)) & np.uint64(0xFF)
                v = packed
            yield _row(-1 - int(k) if marked else int(k), False, a[p], b[p], place[p], v)
    known &= ~sure
    yield from _to_texts(a[known], b[known], place[known], value[known], buckets)


def _to_texts(a, b, place, value, buckets: int) -> Iterator[tuple]:
    """``known`` rows, one for each bucket of texts."""
    home = _bucket(mix(a), buckets)
    order = np.lexsort((place, b, a, home))
    edge = np.searchsorted(home[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edge)):
        p = order[edge[k] : edge[k + 1]]
        yield _row(int(k), True, a[p], b[p], place[p], value[p])


def _occur_twice(packs: DataFrame, buckets: int, short: bool, leads: bool = False) -> DataFrame:
    """The entries whose values occur at two places at least, as ``known`` rows by bucket of texts.

    With ``leads``, the values returned say which entry is the first of its value: 1, others have anything else.
    """

    def sort_bucket(table: pa.Table) -> pa.Table:
        let_go()
        known = table.filter(table.column("known"))
        open_ = table.filter(pa.compute.invert(table.column("known")))
        out = [known.cast(_batch([]).schema)] if len(known) else []
        marks = np.asarray(pa.compute.less(open_.column("bucket"), 0))
        if len(open_):
            bucket = open_.column("bucket")[0].as_py()
            bucket = bucket if bucket >= 0 else -1 - bucket
            parts = [_unpack(open_.filter(pa.array(m)), RANK if short else np.uint64) for m in (~marks, marks)]
            plain, marked = len(parts[0][0]), len(parts[1][0])
            a, b, place, value = (np.concatenate(c) for c in zip(*parts))
            if short:
                value = (np.uint64(bucket) << np.uint64(40)) | (value["high"].astype(np.uint64) << np.uint64(32)) | value["low"]
            mark = np.concatenate((np.zeros(plain, bool), np.ones(marked, bool)))
            order = np.argsort(value, kind="stable")
            new = np.flatnonzero(_changes(value[order]))
            size = np.diff(np.append(new, len(order)))
            tied = np.repeat(size > 1, size) | mark[order]
            order = order[tied]  # what occurs once needs no further look
            # Entries of one place of one text, from copies of the text in several shares, are one.
            order = order[np.lexsort((place[order], b[order], a[order], value[order]))]
            a, b, place, value, mark = (x[order] for x in (a, b, place, value, mark))
            whole = _changes(value, a, b, place)
            run = np.cumsum(_changes(value)) - 1 if len(value) else np.zeros(0, int)
            twice = (np.bincount(run, whole) > 1) | (np.bincount(run, mark) > 0) if len(value) else np.zeros(0, bool)
            keep = whole & twice[run] & ~mark if len(value) else whole
            if leads:
                lead = _changes(value) if len(value) else whole
                keep, value = keep | lead & twice[run] if len(value) else whole, lead.astype(np.uint64)
            rows = list(_to_texts(a[keep], b[keep], place[keep], value[keep], buckets))
            if rows:
                out.append(pa.Table.from_batches([_batch(rows)]))
        return pa.concat_tables(out) if out else pa.Table.from_batches([_batch([])])

    # Known rows pass through with the bucket of their texts' number.
    group = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    return packs.groupBy(group.alias("group")).applyInArrow(sort_bucket, PACK)


def _by_text(table: pa.Table, leads: bool = False) -> Iterator[tuple]:
    """(a, b, places, values) of each text, places ascending and each once; with ``leads`` those with value 1 alone."""
    a, b, place, value = _unpack(table, np.uint64)
    if leads:
        a, b, place, value = (x[value == 1] for x in (a, b, place, value))
    order = np.lexsort((place, b, a))
    a, b, place, value = (x[order] for x in (a, b, place, value))
    once = _changes(a, b, place)
    a, b, place, value = (x[once] for x in (a, b, place, value))
    edge = np.append(np.flatnonzero(_changes(a, b)), len(a)) if len(a) else [0]
    for i, j in itertools.pairwise(edge):
        yield a[i], b[i], place[i:j].astype(np.int64), value[i:j]


def _join_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open spans whose starts and ends both ascend."""
    if not len(start):
        return start, end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:] - 1, len(end) - 1)]


def _without(start, end, lo, hi) -> np.ndarray:
    """The places of the spans (start, end) outside the spans (lo, hi), as an array of spans."""
    edge = np.concatenate((start, end, lo, hi))
    step = np.repeat([2, -2, -1, 1], [len(start), len(end), len(lo), len(hi)])
    order = np.argsort(edge, kind="stable")
    edge, level = edge[order], np.cumsum(step[order])
    inside = np.flatnonzero((level[:-1] == 2) & (edge[1:] > edge[:-1])) if len(edge) else np.zeros(0, int)
    return np.stack((edge[inside], edge[inside + 1]), 1).astype("<i8")


def _shared_texts(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(a, b, text) of texts of ``width`` bytes and more."""
    text = F.col(text_col)
    return docs.select(F.xxhash64(text).alias("a"), F.hash(text).alias("b"), text.alias("text")).where(F.octet_length("text") >= width)


def _each_once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(a, b, row) with rows of a text that came before in this share of the input left out."""
    seen = set()
    for batch in batches:
        for rows in byte_slices(batch, 2):
            for i, (a, b, text) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), as_bytes(rows.column(2)), strict=True)):
                if (a, b) not in seen:
                    seen.add((a, b))
                    yield a & (1 << 64) - 1, b & (1 << 32) - 1, text, rows, i


def _flushed(entries: Entries, buckets: int, short: bool, last: bool = False) -> Iterator[pa.RecordBatch]:
    if entries.size > FLUSH or (last and entries.size):
        for row in _routed(entries.take(), buckets, short):
            yield _batch([row])


def _repeats(docs: DataFrame, width: int = 400, order: int = 11, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows as (doc_id, a, b, n_bytes, whole) with ``spans`` and ``kept_sha256``; a and b are hashes of the text."""
    v, cover = difference_cover(order)
    if 2 * v > width + 1:
        raise ValueError("the cover's period may be half of the width at most")
    depth = width - v + 1
    inside = np.zeros(v, bool)
    inside[cover] = True
    scratch = Scratch(docs.sparkSession, "suffixes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    heads = scratch.keep(bare.select("doc_id", F.xxhash64("text").alias("a"), F.hash("text").alias("b"), F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("whole")), "heads")
    total = heads.where(F.col("n_bytes") >= width).agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    texts = _shared_texts(bare, "text", width)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        entries, powers = Entries(), _powers(CHUNK + width + 1)
        for a, b, body, _, _ in _each_once(batches):
            n = len(body) - depth + 1
            places = (np.arange(0, n, v)[:, None] + cover).ravel()
            places = places[places < n]
            entries.add(a, b, places, prefixes(body, places, depth, powers))
            yield from _flushed(entries, buckets, True)
        yield from _flushed(entries, buckets, True, last=True)

    def long_ties(table: pa.Table) -> pa.Table:
        """Ranks to depth + 2 v bytes of the samples whose next two at distance v are repeated too."""
        let_go()
        entries = Entries()
        for a, b, place, rank in _by_text(table):
            at = [np.searchsorted(place, place + k * v) for k in (1, 2)]
            ok = np.logical_and.reduce([place[np.minimum(x, len(place) - 1)] == place + k * v for k, x in zip((1, 2), at, strict=True)])
            if ok.any():
                value = rank[ok]
                for x in at:
                    value = mix(mix(value) + rank[x[ok]])
                entries.add(a, b, place[ok], value)
        rows = list(_routed(entries.take(), buckets, False)) if entries.size else []
        return pa.Table.from_batches([_batch(rows)])

    def open_places(table: pa.Table) -> pa.Table:
        """Of each text the spans of suffixes that are open, of those that are settled, and of the latter's leads."""
        let_go()
        sure = np.asarray(table.column("sure"))
        ties = table.filter(pa.array(sure))
        settled, leads = ({(a, b): place for a, b, place, _ in _by_text(ties, leads=x)} for x in (False, True))
        rows, none = [], np.zeros(0, np.int64)
        for a, b, place, _ in _by_text(table.filter(pa.array(~sure))):
            near = _join_spans(np.maximum(place - v + 1, 0), place + 1)
            sure, lead = (_join_spans(at, at + depth + 2 * v - width + 1) for at in (x.get((a, b), none) for x in (settled, leads)))
            rows.append((int(a.view(np.int64)), int(b.view(np.int32)), _without(*near, *sure).tobytes(), *(np.stack(x, 1).astype("<i8").tobytes() for x in (sure, lead))))
        return pa.Table.from_batches([_batch(rows, TEXT)])

    samples = scratch.keep(_occur_twice(texts.mapInArrow(sample, PACK), buckets, True), "samples")
    ties = _occur_twice(samples.groupBy("bucket").applyInArrow(long_ties, PACK), buckets, False, leads=True)
    both = samples.withColumn("sure", F.lit(False)).unionByName(ties.withColumn("sure", F.lit(True)))
    places = scratch.keep(both.groupBy("bucket").applyInArrow(open_places, TEXT), "places")
    scratch.drop(samples)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        last, rows = None, []
        for *_, held, i in _each_once(batches):
            if held is not last and rows:
                yield last.take(pa.array(rows))
                rows = []
            last = held
            rows.append(i)
        if rows:
            yield last.take(pa.array(rows))

    joined = texts.mapInArrow(once, "a long, b int, text string").join(places, ["a", "b"]).select("a", "b", "text", "open", "lead", "sure")
    held = scratch.keep(joined, "texts")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        entries, powers = Entries(), _powers(CHUNK + width + 1)
        for a, b, body, rows, i in _each_once(batches):
            for sure, column in ((False, 3), (True, 4)):
                spans = np.minimum(np.frombuffer(rows.column(column)[i].as_py(), "<i8").reshape(-1, 2), len(body) - width + 1)
                for start in range(0, len(body), CHUNK):  # a long text is flushed on the way
                    cut = np.clip(spans, start, start + CHUNK)
                    at = [np.arange(*s) for s in cut[cut[:, 1] > cut[:, 0]]]
                    if at:
                        at = np.concatenate(at)
                        entries.add(a, b, at, prefixes(body, at, width, powers), sure)
                        yield from _flushed(entries, buckets, False)
        yield from _flushed(entries, buckets, False, last=True)

    def found(table: pa.Table) -> pa.Table:
        let_go()
        rows = [(int(a.view(np.int64)), int(b.view(np.int32)), np.stack(_join_spans(place, place + 1), 1).astype("<i8").tobytes()) for a, b, place, _ in _by_text(table)]
        return pa.Table.from_batches([_batch(rows, "a long, b int, starts binary")])

    repeated = _occur_twice(held.mapInArrow(suffixes, PACK), buckets, False)
    starts = scratch.keep(repeated.groupBy("bucket").applyInArrow(found, "a long, b int, starts binary"), "starts")
    copies = scratch.keep(heads.where(F.col("n_bytes") >= width).groupBy("a", "b").agg(F.count("*").alias("copies")).where("copies > 1").drop("copies"), "copies")
    single = held.join(copies, ["a", "b"], "left_anti").join(starts, ["a", "b"], "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for rows in byte_slices(batch, 2):
                out = []
                for body, sure, some in zip(as_bytes(rows.column(2)), rows.column(3).to_pylist(), rows.column(4).to_pylist(), strict=True):
                    s = np.concatenate([np.frombuffer(x or b"", "<i8").reshape(-1, 2) for x in (sure, some)])
                    s = s[np.argsort(s[:, 0], kind="stable")]
                    spans = np.stack(_join_spans(s[:, 0], np.minimum(np.maximum.accumulate(s[:, 1]) + width - 1, len(body))), 1) if len(s) else s
                    edge = [0, *spans.ravel().tolist(), len(body)]
                    sha = hashlib.sha256()
                    for i, j in zip(edge[::2], edge[1::2], strict=True):
                        sha.update(body[i:j])
                    out.append(([{"start": i, "end": j} for i, j in spans.tolist()], sha.hexdigest()))
                spans, shas = zip(*out, strict=True) if out else ((), ())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(spans, span), pa.array(shas, pa.string())], ["a", "b", "spans", "sha"])

    kind = "a long, b int, spans array<struct<start: long, end: long>>, sha string"
    parted = scratch.keep(single.select("a", "b", "text", "sure", "starts").mapInArrow(cut_out, kind).where("size(spans) > 0"), "spans")
    scratch.drop(held, places, starts)
    # One join alone, and no grouping before it: then Spark deals the rows of a text with very many copies to several tasks.
    rows = heads.join(parted.unionByName(copies.withColumn("copied", F.lit(True)), allowMissingColumns=True), ["a", "b"], "left")
    copied = F.col("copied").isNotNull()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(copied, whole).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<start: long, end: long>>)")))
    sha = F.when(copied, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("sha", "whole"))
    return rows.select("doc_id", "a", "b", "n_bytes", spans.alias("spans"), sha.alias("kept_sha256"))


def repeated_spans(docs: DataFrame, width: int = 400, order: int = 11, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What every text repeats: ``doc_id``, ``n_bytes``, ``spans``, ``kept_sha256``.

    A byte is removed if a string of ``width`` bytes that covers it also starts at another place, of the same text
    (overlaps count) or of another row's. ``spans`` are the maximal removed runs in bytes of the UTF-8 text (start, end
    exclusive); the digest is of the bytes that stay. Null texts are empty; texts below ``width`` bytes lose nothing,
    nor do they take part. Rows are told apart by position only, so null and repeated ids are rows like any other;
    equal texts repeat each other whole. Further columns play no part; an empty table gives an empty result. The cover
    has order**2 + order + 1 residues, which may be half of ``width`` at most; any such prime gives the same result.
    """
    return _repeats(docs, width, order, bucket_bytes, id_col, text_col).drop("a", "b")


def without_repeats(docs: DataFrame, width: int = 400, order: int = 11, bucket_bytes: int = 16 << 20, text_col: str = "text") -> DataFrame:
    """``docs`` as they are with the bytes that stay of each text as ``kept`` (binary; a cut may fall inside a character).

    If ``docs`` has a column of that name, the new one is ``kept_``, and so on.
    """
    key = [named_apart(docs.columns, n) for n in ("_a", "_b", "_spans")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    spans = _repeats(docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")), width, order, bucket_bytes, "doc_id", "text").where("size(spans) > 0")
    spans = spans.groupBy(F.col("a").alias(key[0]), F.col("b").alias(key[1])).agg(F.first("spans").alias(key[2]))
    rows = docs.withColumns({key[0]: F.xxhash64(text), key[1]: F.hash(text)}).join(spans, key[:2], "left")
    body, n = text.cast("binary"), F.octet_length(text)
    edge = F.coalesce(F.col(key[2]), F.expr("cast(array() as array<struct<start: long, end: long>>)"))
    start = F.concat(F.array(F.lit(0).cast("long")), F.transform(edge, lambda s: s["end"]))
    end = F.concat(F.transform(edge, lambda s: s["start"]), F.array(n.cast("long")))
    parts = F.transform(F.arrays_zip(start.alias("s"), end.alias("e")), lambda x: F.hex(F.substring(body, (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int"))))
    return rows.withColumn(named_apart(docs.columns, "kept"), F.unhex(F.array_join(parts, ""))).drop(*key)


def removal_digest(spans: DataFrame) -> DataFrame:
    """Per document how many bytes and runs go: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: The rule as it reads: all strings of 400 bytes, those that start at two places, bytes that one covers.
REMOVAL_SQL = """
with rows_ as (select row_number() over () as i, doc_id, encode(coalesce(text, '')) as body from documents),
starts as (select i, unnest(range(octet_length(body) - 399)) as p, body from rows_ where octet_length(body) >= 400),
hashed as (select i, p, sha256(body[p + 1 : p + 400]) as h from starts),
twice as (select h from hashed group by h having count(*) > 1),
hit as (select i, p, lag(p) over (partition by i order by p) as before from hashed where h in (select h from twice)),
runs as (select i, p, sum(case when before is null or p > before + 400 then 1 else 0 end) over (partition by i order by p) as run from hit),
spans as (select i, run, min(p) as lo, max(p) + 400 as hi from runs group by i, run),
gaps as (select i, lo, hi, coalesce(lag(hi) over (partition by i order by lo), 0) as last from spans),
ends as (select i, count(*) as n_spans, sum(hi - lo) as n_removed, max(hi) as hi from spans group by i),
stay as (select g.i, string_agg(case when g.lo > g.last then hex(body[g.last + 1 : g.lo]) else '' end, '' order by g.lo) as front from gaps g join rows_ r on r.i = g.i group by g.i)
select doc_id, cast(octet_length(body) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  case when n_spans is null then sha256(body) else sha256(unhex(front || case when e.hi < octet_length(body) then hex(body[e.hi + 1 : octet_length(body)]) else '' end)) end as kept_sha256
from rows_ r left join ends e on e.i = r.i left join stay s on s.i = r.i
"""
