"""Byte-level BPE in DuckDB: a recursive query contracts token pairs, an ordered aggregation decodes; one database a task."""

from __future__ import annotations

import base64
import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import Pieces, held
from .text import as_text, byte_slices, slices

LONG = 64  # bytes from which a word's contractions go on in many places at once
SLICE = 3 << 20  # bytes of text that are encoded together
MEMORY = 448 << 20  # bytes of codes that a worker remembers, unless the caller says less

#: Each step joins neighbouring tokens of a word (key: word << 16 | position) to the merge table and contracts the word's
#: leftmost pair of least rank; words without a pair drop out, and a word's last step is its encoding.
STEPS = """
WITH RECURSIVE state(step, wp, tok) AS (
  SELECT 0, (w::BIGINT << 16) + pos, tok FROM word_tokens
  UNION ALL
  (WITH best AS (
    SELECT s.wp >> 16 AS w, min((m.merged::BIGINT << 16) + (s.wp & 65535)) AS pair
    FROM state s JOIN state n ON n.wp = s.wp + 1 JOIN merges m ON m.lr = (s.tok::BIGINT << 32) + n.tok GROUP BY 1)
  SELECT step + 1, wp - ((wp & 65535) > (pair & 65535))::INT, CASE WHEN (wp & 65535) = (pair & 65535) THEN (pair >> 16)::INT ELSE tok END
  FROM state s JOIN best ON best.w = s.wp >> 16 WHERE (wp & 65535) <> (pair & 65535) + 1)
)
SELECT (s.wp >> 16)::INT AS w, s.tok
FROM state s JOIN (SELECT wp >> 16 AS w, max(step) AS last FROM state GROUP BY 1) f ON f.w = s.wp >> 16 AND s.step = f.last ORDER BY s.wp
"""

#: For long words, whose pairs are contracted wherever that is the same as leftmost and least rank first. A pair of the
#: least rank among those within {reach} tokens is such a place: all contractions before its own lie farther off, and to
#: change its tokens one would have to grow into a token over more than {reach} bytes, which no token of the vocabulary
#: that occurs in the words has. In a run of overlapping pairs of one rank every second one goes, if the run's first is
#: such a place. Where a contraction makes a pair of lower rank (early), that pair comes next, so the places to its right
#: in the run or within reach wait. At most {steps} steps a run, as a recursion keeps the rows of all its steps.
LONG_STEPS = """
WITH RECURSIVE state(step, w, pos, tok) AS (
  SELECT 0, w, pos, tok FROM word_tokens
  UNION ALL
  SELECT step + 1, w, pos, CASE WHEN take THEN rank ELSE tok END
  FROM (
    SELECT *, lag(take) OVER (PARTITION BY w ORDER BY pos) AS gone
    FROM (
      SELECT *, hit AND start % 2 = 1 AND (nth - start // 2) % 2 = 0 AND coalesce(last_early < least(start // 2, nth - {reach}), true) AS take
      FROM (
        SELECT *, max(CASE WHEN rank IS DISTINCT FROM before THEN nth * 2 + hit::INT END) OVER (o ROWS UNBOUNDED PRECEDING) AS start,
          max(CASE WHEN hit AND early THEN nth END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_early
        FROM (
          SELECT *, coalesce(rank = least, false) AS hit
          FROM (
            SELECT *, row_number() OVER o AS nth, lag(rank) OVER o AS before,
              min(rank) OVER (o ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS least, count(rank) OVER (PARTITION BY w) AS pairs
            FROM (
              SELECT s.step, s.w, s.pos, s.tok, m.merged AS rank, coalesce(least(a.merged, b.merged, c.merged) < m.merged, false) AS early
              FROM (SELECT *, lead(tok) OVER o AS nxt, lead(tok, 2) OVER o AS after, lag(tok) OVER o AS prior FROM state WINDOW o AS (PARTITION BY w ORDER BY pos)) s
              LEFT JOIN merges m ON m.lr = (s.tok::BIGINT << 32) + s.nxt
              LEFT JOIN lower_merges a ON a.lr = (m.merged::BIGINT << 32) + s.after
              LEFT JOIN lower_merges b ON b.lr = (s.prior::BIGINT << 32) + m.merged
              LEFT JOIN lower_merges c ON c.lr = (m.merged::BIGINT << 32) + m.merged
            )
            WINDOW o AS (PARTITION BY w ORDER BY pos)
          )
          WHERE pairs > 0
        )
        WINDOW o AS (PARTITION BY w ORDER BY pos)
      )
    )
  )
  WHERE NOT coalesce(gone, false) AND step < {steps}
)
SELECT w, tok FROM (SELECT *, max(step) OVER (PARTITION BY w) AS last FROM state) WHERE step = last ORDER BY w, pos
"""

#: Token bytes as Latin-1 characters, put together in order.
DECODE = "SELECT t.d, string_agg(v.piece, '' ORDER BY t.pos) AS text FROM doc_tokens t JOIN vocabulary v ON v.id = t.id GROUP BY t.d"


class Codec:
    """Encodes and decodes with one in-memory DuckDB of one thread, which spills to Spark's local folder beyond 100 MB."""

    def __init__(self, path: str, pattern: str, words: int = 40_000, most: int = MEMORY, rows: int = 400_000):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = self.ranks
        l, r, m = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    l.append(a), r.append(b), m.append(rank)
        l, r, m = (np.array(x, np.int32) for x in (l, r, m))
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.spill = tempfile.mkdtemp(prefix="duckdb-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "100MB", "temp_directory": self.spill})
        self._table("merges", {"lr": (l.astype(np.int64) << 32) + r, "merged": m})
        self.db.execute("CREATE TABLE lower_merges AS SELECT * FROM merges WHERE merged < greatest(lr >> 32, lr & 4294967295)")
        self._table("vocabulary", {"id": np.array(list(ranks.values()), np.int32), "piece": [t.decode("latin-1") for t in ranks]})
        self.split, self.words, self.rows = regex.compile(pattern).findall, words, rows
        self.reach = None
        self.encode = Pieces(self._cut, self._contract, most).encode

    def __del__(self):
        self.db.close()
        shutil.rmtree(self.spill, ignore_errors=True)

    def _table(self, name: str, columns: dict) -> None:
        rows = pa.table(columns)  # noqa: F841  (DuckDB reads it by its name)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows")

    def _run(self, tokens: np.ndarray, size: np.ndarray, query: str) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, one after another, and their number by word, before and after a query."""
        w = np.repeat(np.arange(len(size), dtype=np.int32), size)
        pos = (np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        self._table("word_tokens", {"w": w, "pos": pos, "tok": tokens})
        got = self.db.sql(query).to_arrow_table()
        return got.column("tok").to_numpy(), np.bincount(got.column("w").to_numpy(), minlength=len(size))

    def _cut(self, piece: str) -> list[str]:
        """The pattern's matches; a space and letters are one."""
        return [piece] if piece[:1] == " " and piece[1:].isalpha() else self.split(piece)

    def _contract(self, words: list[str]) -> list[bytes]:
        """Ids of words, in blocks that bound the database's memory."""
        raw = [w.encode() for w in words]
        out: list = [None] * len(words)
        long = [i for i, b in enumerate(raw) if len(b) > LONG]
        short = [i for i, b in enumerate(raw) if len(b) <= LONG] if long else list(range(len(raw)))
        for first in range(0, len(short), self.words):
            self._put(out, short[first : first + self.words], *self._run(*self._bytes([raw[i] for i in short[first : first + self.words]]), STEPS))
        for first, last in slices([raw[i] for i in long], self.rows // 8):
            self._put(out, long[first:last], *self._long([raw[i] for i in long[first:last]]))
        return out

    def _bytes(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.single[np.frombuffer(b"".join(raw), np.uint8)], np.fromiter(map(len, raw), np.int64, len(raw))

    @staticmethod
    def _put(out: list, at: list[int], tokens: np.ndarray, size: np.ndarray) -> None:
        data, ends = tokens.astype("<u4").tobytes(), [0, *(np.cumsum(size) * 4).tolist()]
        for i, a, b in zip(at, ends, ends[1:], strict=False):
            out[i] = data[a:b]

    def _long(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Long words, contracted until none gets shorter; each run of the recursion keeps about ``rows`` rows."""
        if self.reach is None:
            self.reach = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for token in self.ranks:
                self.reach.add_word(token.decode("latin-1"))
            self.reach.make_automaton()
        reach = max(n for b in raw for _, n in self.reach.iter(b.decode("latin-1")))
        tokens, size = self._bytes(raw)
        open_ = np.ones(len(size), bool)
        while open_.any():
            of = np.repeat(open_, size)
            steps = int(np.clip(self.rows // max(int(of.sum()), 1), 1, 24))
            part, n = self._run(tokens[of], size[open_], LONG_STEPS.format(reach=reach, steps=steps))
            now = size.copy()
            now[open_] = n
            merged = np.empty(int(now.sum()), np.int32)
            merged[np.repeat(open_, now)] = part
            merged[~np.repeat(open_, now)] = tokens[~of]
            open_, tokens, size = now < size, merged, now
        return tokens, size

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id sequence, in blocks of about ``rows`` ids."""
        out = [b""] * len(ids)
        for first, last in slices(ids, self.rows):
            size = np.array([len(x) for x in ids[first:last]], np.int64)
            d = np.repeat(np.arange(first, last, dtype=np.int32), size)
            pos = (np.arange(len(d)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            self._table("doc_tokens", {"d": d, "pos": pos, "id": np.concatenate(ids[first:last]).astype(np.int32)})
            for k, text in self.db.execute(DECODE).fetchall():
                out[k] = text.encode("latin-1")
        return out


def codec(path: str, pattern: str, memory: int = MEMORY) -> Codec:
    """Kept for the tasks of one Python worker."""
    return held(("duckdb", path, pattern, memory), lambda: Codec(path, pattern, most=memory))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", memory: int = MEMORY) -> DataFrame:
    """Add ``ids_col`` (array<int>) with the BPE ids of every whole text; a null text has no ids. Other columns stay; one of that name is replaced."""
    if ids_col == text_col:
        raise ValueError("the ids need a column of their own")
    docs = docs.drop(ids_col)
    at, kinds = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, memory)
        for batch in batches:
            for rows in byte_slices(batch, at, SLICE):
                ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in c.encode(as_text(rows.column(at)))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, ids], [*rows.schema.names, ids_col])

    return docs.mapInArrow(run, T.StructType(list(kinds.fields)).add(ids_col, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """Add ``bytes_col`` (binary): the bytes that the ids stand for; null ids give no bytes. Unknown ids are an error.

    Other columns stay; one named ``bytes_col`` is replaced, so it must not be ``ids_col``.
    """
    if bytes_col == ids_col:
        raise ValueError("the bytes need a column of their own")
    docs = docs.drop(bytes_col)
    at = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                rows = batch.slice(first, 500)
                ids = [np.array(x or [], np.int64) for x in rows.column(at).to_pylist()]
                if any(len(x) and not 0 <= x.max() < len(c.ranks) for x in ids):
                    raise ValueError("an id is not in the vocabulary")
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(c.decode(ids), pa.binary())], [*rows.schema.names, bytes_col])

    return docs.mapInArrow(run, T.StructType(list(docs.schema.fields)).add(bytes_col, T.BinaryType()))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """Encode every whole text, decode the ids, and give digests: ``doc_id``, ``n_tokens``, ``ids_sha256`` (ids as
    little-endian 32-bit integers), ``decoded_sha256``; with ``keep_ids`` the ids too, as ``token_ids``. Null and empty
    texts have no tokens; rows that share an id or have none give a row each. Nothing is shuffled. ``memory`` bounds what
    a Python worker remembers of words it has encoded: less memory, more work.
    """
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path, pattern, memory), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for rows in byte_slices(batch, 1, SLICE):
                ids = c.encode(as_text(rows.column(1)))
                tokens = [np.frombuffer(x, "<u4") for x in ids]
                columns = [rows.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, c.decode(tokens)), pa.string())]
                if keep_ids:
                    columns.append(pa.array([x.view("<i4") for x in tokens], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in fields.split(", ")])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, fields)
