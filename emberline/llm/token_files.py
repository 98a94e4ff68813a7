"""Token-ID output: patched frame-of-reference blocks in segment files, and their reader."""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut, shared_path
from .memory import Pieces, held
from .text import as_text, byte_slices

BLOCK, MAGIC = 256, b"PFR1"
#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HEAD = struct.Struct("<4sIQ")  # magic, blocks, ids


MEMORY = 400 << 20  # bytes of codes that a worker remembers
SLICE = 4 << 20  # bytes of text that are encoded together


class Encoder:
    """The tokenizers library over whole texts, each distinct piece once (:class:`~.memory.Pieces`)."""

    def __init__(self, path: str, pattern: str = PATTERN, most: int = MEMORY, joined: int = 500):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tok, self.joined = Tokenizer.from_file(path), joined
        added = [re.escape(a.content) for a in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added) or "(?!)").search
        vocabulary = self.tok.get_vocab(True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.spaced[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True
        self.matches = regex.compile(pattern).findall
        self.encode = Pieces(self._words, self._codes, most).encode

    def _words(self, piece: str) -> list[str]:
        """The pattern's matches of a piece of Latin letters; others stay whole, as does all that holds an added token."""
        if piece[1:].isalpha() or not (piece.isascii() or max(piece, default="") < "\u02b0") or self.special(piece):
            return [piece]
        return self.matches(piece) or [piece]

    def _codes(self, words: list[str]) -> list[bytes]:
        """Ids of words. Those whose only space is in front go to the library in joined lines, cut at tokens that begin with a space."""
        line = [i for i, w in enumerate(words) if w[:1] == " " and (w[1:].isalpha() or " " not in w[1:] and len(w) > 1 and not w[1].isspace() and not self.special(w))]
        own = sorted(set(range(len(words))).difference(line))
        out: list = [None] * len(words)
        for i, e in zip(own, self.tok.encode_batch_fast([words[i] for i in own], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        groups = [line[i : i + self.joined] for i in range(0, len(line), self.joined)]
        for group, e in zip(groups, self.tok.encode_batch_fast(["".join([words[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
            if len(cuts) != len(group) + 1:
                raise ValueError("a token bridges two words")
            raw, ends = ids.tobytes(), (cuts * 4).tolist()
            for i, first, last in zip(group, ends, ends[1:], strict=False):
                out[i] = raw[first:last]
        return out


def encoder(path: str) -> Encoder:
    return held(("tokenizers", path), lambda: Encoder(path))


def _bits(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(v.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray, percentile: int = 90) -> bytes:
    """A segment: header; per block its start in the body, minimum, width and number of exceptions; the body.

    A block holds 256 ids less their minimum, packed at the bit width that ``percentile`` per cent of them fit in;
    the others keep their low bits there and have place and high bits in the block's exception list.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.zeros(blocks * BLOCK, np.uint32)
    v[:n] = ids
    if n:
        v[n:] = ids[-1]
    v = v.reshape(blocks, BLOCK)
    low = v.min(axis=1) if n else np.zeros(0, np.uint32)
    v = v - low[:, None]
    k = (BLOCK - 1) * percentile // 100
    width = _bits(np.partition(v, k, axis=1)[:, k]) if n else np.zeros(0, np.int64)
    out = v > ((np.int64(1) << width) - 1).astype(np.uint32)[:, None]
    n_out = out.sum(axis=1)
    size = width * (BLOCK // 8) + n_out * 5
    starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    body = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            lanes = (v[rows] & np.uint32((1 << int(w)) - 1)).reshape(-1, 64).T.astype(np.uint64, order="C")
            words = np.zeros((int(w), lanes.shape[1]), np.uint64)
            for j in range(64):
                k, off = divmod(j * int(w), 64)
                words[k] |= lanes[j] << np.uint64(off)
                if off + w > 64:
                    words[k + 1] |= lanes[j] >> np.uint64(64 - off)
            raw = words.T.copy().astype("<u8").view(np.uint8).reshape(len(rows), -1)
            body[(starts[rows][:, None] + np.arange(raw.shape[1])).ravel()] = raw.ravel()
    at, place = np.nonzero(out)
    if len(at):
        rank = np.arange(len(at)) - np.concatenate(([0], np.cumsum(n_out)))[at]
        base = starts[at] + width[at] * (BLOCK // 8)
        body[base + rank] = place
        high = (v[at, place].astype(np.uint64) >> width[at].astype(np.uint64)).astype("<u4").view(np.uint8).reshape(-1, 4)
        body[((base + n_out[at] + rank * 4)[:, None] + np.arange(4)).ravel()] = high.ravel()
    return HEAD.pack(MAGIC, blocks, n) + starts[:-1].astype("<u8").tobytes() + low.astype("<u4").tobytes() + width.astype("u1").tobytes() + n_out.astype("<u2").tobytes() + body.tobytes()


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all by default); the index of block starts makes any range readable alone."""
    magic, blocks, n = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at, index = HEAD.size, []
    for kind, size in (("<u8", 8), ("<u4", 4), ("u1", 1), ("<u2", 2)):
        index.append(np.frombuffer(data, kind, blocks, at)[first:last])
        at += size * blocks
    starts, low, width, n_out = (x.astype(np.int64) for x in index)
    body = np.frombuffer(data, np.uint8, offset=at)
    v = np.zeros((len(starts), BLOCK), np.uint64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            raw = body[starts[rows][:, None] + np.arange(int(w) * (BLOCK // 8))]
            words = raw.view("<u8").reshape(-1, int(w)).T.copy()
            lanes, mask = np.zeros((64, words.shape[1]), np.uint64), np.uint64((1 << int(w)) - 1)
            for j in range(64):
                k, off = divmod(j * int(w), 64)
                lanes[j] = words[k] >> np.uint64(off)
                if off + w > 64:
                    lanes[j] |= words[k + 1] << np.uint64(64 - off)
                lanes[j] &= mask
            v[rows] = lanes.T.reshape(len(rows), BLOCK)
    at = np.repeat(np.arange(len(starts)), n_out)
    if len(at):
        rank = np.arange(len(at)) - np.concatenate(([0], np.cumsum(n_out)))[at]
        base = starts[at] + width[at] * (BLOCK // 8)
        place = body[base + rank]
        high = body[(base + n_out[at] + rank * 4)[:, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.uint64)
        v[at, place] += high << width[at].astype(np.uint64)
    ids = (v + low.astype(np.uint64)[:, None]).ravel().astype("<u4")
    return ids[: n - first * BLOCK] if last is None or last >= blocks else ids


SEGMENT = "part int, segment int, ids_before long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, percentile: int = 90, segment_ids: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Encode every whole text, append ``end_id``, and write the ids as segments in ascending id order; gives the folder.

    Rows are dealt by ranges of the id; each task encodes its range and writes segments of about ``segment_ids`` ids
    (whole documents; the last may exceed it) through Spark's committer, so a lost task leaves no half file. A row of a
    file is one segment: where it stands (part, segment, ids before it in its part), its documents' ids and lengths,
    and the packed payload. Null texts are empty (just the end id); null ids come first, equal ids by their text; an
    empty table makes no segments.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        docs, sizes, held, total, before, segment = [], [], [], 0, 0, 0
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

        def flush():
            payload = pack(np.frombuffer(b"".join(held), "<u4"), percentile)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, segment, before, docs, sizes, payload), types, strict=True)], SEGMENT.replace(" array<long>", "").replace(" int", "").replace(" long", "").replace(" binary", "").split(", "))

        for batch in batches:
            for rows in byte_slices(batch, 1, SLICE):
                for i, ids in zip(rows.column(0).to_pylist(), enc.encode(as_text(rows.column(1))), strict=True):
                    ids += end
                    docs.append(i)
                    sizes.append(len(ids) // 4)
                    held.append(ids)
                    total += len(ids) // 4
                    if total >= segment_ids:
                        yield flush()
                        segment, before = segment + 1, before + total
                        docs, sizes, held, total = [], [], [], 0
        if docs:
            yield flush()

    path = path or shared_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    rows.mapInArrow(encode, SEGMENT).write.option("compression", "uncompressed").parquet(path)
    return path


def read_token_files(spark, path: str) -> DataFrame:
    """Read segments back: per document ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Where a part starts is a running sum over one row a part; the payloads are read once and never shuffled.
    """
    files = spark.read.schema(SEGMENT).parquet(path)
    parts = cut(files.select("part", "ids_before", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, sizes, payload in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids = unpack(payload.as_py())
                n = np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(n)
                crcs = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs.as_py(), pa.int64()), pa.array(start.as_py() + ends - n, pa.int64()), pa.array(n), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(offsets), "part").select((F.col("part_start") + F.col("ids_before")).alias("start"), "doc_ids", "doc_tokens", "payload")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
