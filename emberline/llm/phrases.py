"""Collocations: phrases that occur more often than the parts they consist of, from sorted suffix pointers.

1. A task turns its share of the input into suffix pointers, a word's place with the words after it in the same piece,
   down to the longest phrase. Equal ones are counted there, so a frequent phrase sends one row a task.
2. Suffixes are routed by their two leading words to buckets, so a leading word that a third of all places hold is
   spread. Words themselves are counted in buckets of their own.
3. A bucket is sorted by multikey quicksort: three-way partitions by one word, the equal part going on with the next
   word; its size is the phrase's count. Partitions below the least count are abandoned, with all that they hold.
4. Scores and the drop of phrases inside longer ones are joins of what is left, by the words' 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .memory import let_go
from .text import as_bytes, as_text, byte_slices, mix

_rng = np.random.default_rng(13)
BYTE = _rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]  # letters A-Z count as a-z
PIECE, GAP = np.zeros(256, bool), np.zeros(256, bool)
PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True
GAP[list(b" \t")] = True
BASE = 0xD1342543DE82EF95
CHUNK = 1 << 20  # bytes whose prefix sums are held at once
FLUSH = 6 << 20  # bytes of text that a task turns into suffixes at once, or one longer text
SMALL = 1 << 15  # partitions up to this are finished by one sort of all words
PACK = "kind int, bucket int, lang string, keys array<binary>, sizes array<binary>, words binary"
FOUND = "lang string, words array<long>, a long, word string"


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes (not 0), from prefix sums chunk by chunk."""
    inverse = pow(BASE, -1, 1 << 64)
    up, down = (np.full(CHUNK + 1, b, np.uint64) for b in (BASE, inverse))
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    at_start, at_end = np.zeros(len(starts), np.uint64), np.zeros(len(ends), np.uint64)
    back, carry = np.zeros(len(starts), np.uint64), np.uint64(0)
    for c in range(0, len(data) + 1, CHUNK):
        part = data[c : c + CHUNK]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[part] * up[: len(part)])))
        total = carry + total * np.uint64(pow(BASE, c, 1 << 64))
        for at, out in ((starts, at_start), (ends, at_end)):
            i, j = np.searchsorted(at, (c, c + CHUNK))
            out[i:j] = total[at[i:j] - c]
            if out is at_start:
                back[i:j] = down[at[i:j] - c] * np.uint64(pow(inverse, c, 1 << 64))
        carry = total[-1]
    h = mix((at_end - at_start) * back + (ends - starts).astype(np.uint64) * np.uint64(0x9E6C63D0876A9A47))
    h[h == 0] = 1
    return h


def suffixes(texts: list[bytes], depth: int) -> tuple[list[np.ndarray], bytes, np.ndarray, np.ndarray]:
    """Columns of the ``depth`` words from every word on (0: the piece ends before), the bytes, and the words' places in them."""
    body = b"\n".join(texts) + b"\n"
    data = np.frombuffer(body, np.uint8)
    edge = np.diff(np.concatenate(([True], PIECE[data] | GAP[data])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    piece = np.searchsorted(np.flatnonzero(PIECE[data]), starts)
    columns = [_hashes(data, starts, ends)]
    for k in range(1, depth):
        column = np.zeros(len(starts), np.uint64)
        column[:-k] = np.where(piece[k:] == piece[:-k], columns[0][k:], np.uint64(0))
        columns.append(column)
    return columns, body, starts, ends


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _small(x: np.ndarray) -> bytes:
    """Numbers in the fewest bytes each, behind a letter for their type."""
    kind = np.min_scalar_type(x.max() if len(x) else 0)
    return kind.char.encode() + x.astype(kind).tobytes()


def _numbers(b: bytes) -> np.ndarray:
    return np.frombuffer(b[1:], b[:1].decode()).astype(np.int64)


def _tree(columns: list[np.ndarray], count: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Sorted distinct rows as a tree of words by depth, with each node's number of children (leaves: their count)."""
    firsts = [np.flatnonzero(_changes(columns[: j + 1])) for j in range(len(columns))]
    sizes = [np.diff(np.append(np.searchsorted(deeper, first), len(deeper))) for first, deeper in zip(firsts, firsts[1:], strict=False)]
    return [c[f].tobytes() for c, f in zip(columns, firsts, strict=True)], [_small(s) for s in (*sizes, count)]


def _leaves(keys: list[bytes], sizes: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    columns: list[np.ndarray] = []
    for k, key in enumerate(keys):
        if k:
            n = _numbers(sizes[k - 1])
            columns = [np.repeat(c, n) for c in columns]
        columns.append(np.frombuffer(key, np.uint64))
    return columns, _numbers(sizes[-1])


def equal_partitions(columns: list[np.ndarray], weight: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of rows, the first word first: (depth, rows, sizes) of the equal partitions.

    ``rows`` holds one row of each partition of rows that agree in ``depth`` words, none of them 0, and whose weights
    sum to ``least`` at least. Smaller partitions are abandoned: nothing in them is sorted further.
    """
    work = [(np.arange(len(weight)), 0)]
    while work:
        rows, depth = work.pop()
        if depth == len(columns) or not len(rows) or weight[rows].sum() < least:
            continue
        if len(rows) <= SMALL:
            yield from _finish(columns, weight, rows, depth, least)
            continue
        key = columns[depth][rows]
        pivot = np.sort(key[:: max(1, len(key) // 9)][:9])[4]
        same = rows[key == pivot]
        work += [(rows[key < pivot], depth), (rows[key > pivot], depth), (same, depth + 1)]
        if pivot and (size := weight[same].sum()) >= least:
            yield depth + 1, same[:1], np.array([size])
        else:
            work.pop()


def _finish(columns, weight, rows, depth, least) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The equal partitions of few rows, all segments of a depth at once."""
    segment = np.zeros(len(rows), np.int64)
    for d in range(depth, len(columns)):
        rows, segment = (x[columns[d][rows] != 0] for x in (rows, segment))
        if not len(rows):
            return
        key = columns[d][rows]
        order = np.lexsort((key, segment))
        rows, segment, key = rows[order], segment[order], key[order]
        new = _changes([segment, key])
        first = np.flatnonzero(new)
        size = np.add.reduceat(weight[rows], first)
        keep = size >= least
        if keep.any():
            yield d + 1, rows[first[keep]], size[keep]
        number = np.cumsum(new) - 1
        stay = keep[number]
        rows, segment = rows[stay], number[stay]


def _row(kind: int, bucket: int, lang: str, keys: list[bytes], sizes: list[bytes], words: bytes | None) -> pa.RecordBatch:
    columns = [pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([lang]), *(pa.array([x], pa.list_(pa.binary())) for x in (keys, sizes)), pa.array([words], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PACK.split(", ")])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _packed(lang: str, texts: list[bytes], depth: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets of words (kind 0) and of suffixes of two words and more (kind 1)."""
    columns, body, starts, ends = suffixes(texts, depth)
    if not len(starts):
        return
    lead = columns[0]
    order = np.lexsort((lead, _bucket(lead, buckets)))
    first = np.flatnonzero(_changes([lead[order]]))
    one, count = order[first], np.diff(np.append(first, len(order)))
    edge = np.searchsorted(_bucket(lead[one], buckets), np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edge)):
        i, j = edge[k], edge[k + 1]
        words = b"\n".join([body[s:e] for s, e in zip(starts[one[i:j]].tolist(), ends[one[i:j]].tolist(), strict=True)]).lower()
        yield _row(0, int(k), lang, [lead[one[i:j]].tobytes()], [_small(count[i:j])], words)
    many = columns[1] != 0
    columns = [c[many] for c in columns]
    if not len(columns[0]):
        return
    at = _bucket(mix(mix(columns[0]) + columns[1]), buckets)
    order = np.lexsort((*columns[::-1], at))
    at, columns = at[order], [c[order] for c in columns]
    first = np.flatnonzero(_changes(columns))
    count, at, columns = np.diff(np.append(first, len(at))), at[first], [c[first] for c in columns]
    edge = np.searchsorted(at, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edge)):
        i, j = edge[k], edge[k + 1]
        yield _row(1, int(k), lang, *_tree([c[i:j] for c in columns], count[i:j]), None)


def _found(langs: list, words: list, a: list, word: list) -> pa.Table:
    kinds = (pa.string(), pa.list_(pa.int64()), pa.int64(), pa.string())
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip((langs, words, a, word), kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])


def phrase_counts(docs: DataFrame, max_words: int = 3, least: int = 10, bucket_bytes: int = 16 << 20, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Occurrences of words and phrases of up to ``max_words`` (2 at least): ``lang``, ``words`` (hashes), ``a``, ``word``.

    Texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and tabs, A-Z lowered; a phrase
    lies within one piece, and occurrences may overlap. Rows with ``words`` empty give in ``a`` a part of its language's
    number of words; single words and phrases are there from ``least`` occurrences on, single words with the ``word``.
    A null language is ``und``, a null text empty; other columns play no part.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for part in byte_slices(batch, 1, FLUSH):
                for lang, text in zip(as_text(part.column(0)), as_bytes(part.column(1)), strict=True):
                    held.setdefault(lang, []).append(text)
                    size += len(text) + 1
                if size > FLUSH:
                    for lang, texts in held.items():
                        yield from _packed(lang, texts, max_words, buckets)
                    held, size = {}, 0
        for lang, texts in held.items():
            yield from _packed(lang, texts, max_words, buckets)

    def count(table: pa.Table) -> pa.Table:
        let_go()
        rows: dict[str, list[int]] = {}
        for i, lang in enumerate(table.column("lang").to_pylist()):
            rows.setdefault(lang, []).append(i)
        single = table.column("kind")[0].as_py() == 0
        out = []
        for lang, at in rows.items():
            part = table.take(pa.array(at))
            leaves = [_leaves(k, s) for k, s in zip(part.column("keys").to_pylist(), part.column("sizes").to_pylist(), strict=True)]
            columns = [np.concatenate(c) for c in zip(*(c for c, _ in leaves), strict=True)]
            weight = np.concatenate([w for _, w in leaves])
            if single:
                words = b"\n".join(part.column("words").to_pylist()).split(b"\n")
                out.append(_found([lang], [[]], [int(weight.sum())], [None]))
            for depth, one, size in equal_partitions(columns, weight, least):
                keys = np.stack([c[one].view(np.int64) for c in columns[:depth]], 1)
                if single:
                    out.append(_found([lang] * len(one), list(keys), size.tolist(), [words[i].decode(errors="replace") for i in one.tolist()]))
                elif depth > 1:
                    out.append(_found([lang] * len(one), list(keys), size.tolist(), [None] * len(one)))
        return pa.concat_tables(out) if out else _found([], [], [], [])

    return rows.mapInArrow(pack, PACK).groupBy("kind", "bucket").applyInArrow(count, FOUND)


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000, bucket_bytes: int = 16 << 20, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Candidates are phrases of 2 to ``max_words`` words with a >= ``least`` occurrences (:func:`phrase_counts`). A cut into
    a first part with l and a rest with r occurrences scores floor(1000000 a a / (l r)), in decimals of 38 digits; a
    candidate has its lowest-scoring cut, of equal ones the first. It goes if a longer candidate that holds its words in a
    row has 100 * occurrences >= ``inside_percent`` * a, whether that one goes or not. Order is by score and a, largest
    first, then by the phrase's UTF-8 bytes. ``n`` counts all words of the language. Languages without candidates, and
    empty tables, have no rows.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    found = scratch.keep(phrase_counts(docs, max_words, least, bucket_bytes, lang_col, text_col), "found")
    size, key = F.size("words"), ["lang", "words"]
    totals = found.where(size == 0).groupBy("lang").agg(F.sum("a").alias("n"))
    phrases = found.where(size > 1).select("lang", "words", "a")
    part = lambda name, n: found.where((size > 0) & (size < max_words)).select("lang", F.col("words").alias(name), F.col("a").alias(n))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumn("left", F.slice("words", F.lit(1), F.col("k"))).withColumn("right", F.slice("words", F.col("k") + 1, size))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("1000000 * cast(a as decimal(18)) * cast(a as decimal(18)) div (cast(l as decimal(18)) * cast(r as decimal(18)))")
    best = scored.groupBy("lang", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    spots = F.expr(f"flatten(transform(sequence(2, {max_words} - 1), n -> transform(sequence(1, greatest(size(words) - n + 1, 1)), i -> slice(words, i, n))))" if max_words > 2 else "cast(array() as array<array<bigint>>)")
    holds = phrases.where(size > 2).select("lang", "a", size.alias("n"), F.explode(spots).alias("words")).where(size < F.col("n"))
    holds = holds.groupBy(*key).agg(F.max("a").alias("most"))
    kept = best.join(holds, key, "left").where(F.expr(f"most is null or 100 * most < {inside_percent} * a"))
    kept = kept.select("lang", "words", "a", "cut.l", "cut.r", "cut.score")
    # Each salt's first rows, ties and all, hold the language's first; no task gets all phrases of a language.
    salted = kept.withColumn("place", F.rank().over(Window.partitionBy("lang", F.pmod(F.hash("words"), F.lit(64))).orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    first = salted.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    for i in range(max_words):
        word = found.where(size == 1).select(F.col("lang"), F.col("words")[0].alias(f"h{i}"), F.col("word").alias(f"w{i}"))
        first = first.withColumn(f"h{i}", F.get("words", F.lit(i))).join(word, ["lang", f"h{i}"], "left").drop(f"h{i}")
    named = first.withColumn("phrase", F.concat_ws(" ", *(f"w{i}" for i in range(max_words))))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
lists as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
runs as (select lang, k, unnest([w[i : i + k - 1] for i in range(1, len(w) - k + 2)]) as ws from lists, (values (1), (2), (3)) as t(k)),
f as materialized (select lang, k, array_to_string(ws, ' ') as phrase, any_value(ws) as ws, count(*) as a from runs group by lang, k, array_to_string(ws, ' ')),
total as (select lang, sum(a) as n from f where k = 1 group by lang),
cand as (select * from f where k > 1 and a >= 10),
parts as (select lang, phrase, k, a, j, array_to_string(ws[1 : j], ' ') as front, array_to_string(ws[j + 1 : k], ' ') as rest from cand, (values (1), (2)) as t(j) where j < k),
cuts as (select c.lang, c.phrase, c.k, c.a, j, l.a as l, r.a as r, (1000000::hugeint * c.a * c.a) // (l.a::hugeint * r.a) as score
  from parts c join f l on l.lang = c.lang and l.phrase = c.front join f r on r.lang = c.lang and r.phrase = c.rest),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
holds as (select lang, phrase, max(a) as most from (select lang, a, array_to_string(ws[1 : 2], ' ') as phrase from cand where k = 3 union all select lang, a, array_to_string(ws[2 : 3], ' ') from cand where k = 3) group by lang, phrase),
kept as (select b.* from best b left join holds h on h.lang = b.lang and h.phrase = b.phrase and b.k = 2 where h.most is null or 100 * h.most < 50 * b.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from kept join total using (lang) qualify rank <= 2000
"""
