"""Sharding: a Feistel permutation with cycle walking over global row numbers. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut

PRIME = 2147483647
#: Fixed multipliers of the rounds; the seed is added to the keys.
ROUND_KEYS = (916191069, 1823776453, 402653189, 1610612741)
MULTIPLIERS = (48271, 69621)
BUCKETS, ROWS = 4096, 1_000_000  # least number of buckets that rows are numbered in, and rows a bucket beyond it


def number_rows(df: DataFrame, key: str, tie: list[str], buckets: int = BUCKETS, name: str = "row_number") -> DataFrame:
    """Add gapless global row numbers from 0 that depend on the rows alone, not on how they are partitioned.

    A row's bucket is a hash of ``key`` and the first tie column; numbers count bucket after bucket, and by key and
    ties inside. Only a window within a bucket sorts rows; one row a bucket makes the offsets, so no task sees the
    whole table. Rows equal in key and all ties share out their numbers in any order. Null keys count as -1.
    """
    spread = (F.pmod(F.coalesce(F.col(key), F.lit(-1)), F.lit(PRIME)) * MULTIPLIERS[0] + F.coalesce(F.col(tie[0]), F.lit(0)) * MULTIPLIERS[1]) % PRIME
    rows = df.withColumn("_bucket", (spread % buckets).cast("int"))
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first(), *tie)
    numbered = rows.withColumn("_in", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(F.broadcast(offsets), "_bucket").withColumn(name, F.col("_offset") + F.col("_in")).drop("_bucket", "_offset", "_in")


def domain(n: int) -> tuple[int, int]:
    """The sides of the smallest near-square grid with at least n cells."""
    a = 1
    while a * a < n:
        a += max(1, int(n**0.5) - a)
    return a, max(1, -(-n // a))


def permute(x: str, n: int, seed: int = 0) -> Column:
    """The place of column 0 <= x < n after a seeded permutation of 0 .. n-1.

    Four Feistel rounds move x on a grid of a * b >= n cells, turn by turn shifting its row by a hash of its column and
    the reverse. A place beyond n walks on along its cycle until it is below n. At most a - 1 cells are beyond, so the
    walk ends within as many steps; 64 are tried at first, and a row that needs more (a chance below 1e-100) takes them.
    """
    a, b = domain(n)
    hashed = f"((({{v}} * {MULTIPLIERS[0]} + k.key) % {PRIME}) * {MULTIPLIERS[1]} + k.key) % {PRIME}"
    rounds = ", ".join(f"named_struct('flip', {'true' if i % 2 else 'false'}, 'key', {(key + seed * 7919) % PRIME}L)" for i, key in enumerate(ROUND_KEYS))
    once = (
        f"aggregate(array({rounds}), named_struct('l', v div {b}L, 'r', v % {b}L), "
        f"(s, k) -> if(k.flip, named_struct('l', s.l, 'r', (s.r + {hashed.format(v='s.l')}) % {b}L), named_struct('l', (s.l + {hashed.format(v='s.r')}) % {a}L, 'r', s.r)), "
        f"s -> s.l * {b}L + s.r)"
    )
    beyond = a * b - n + 1
    walk = lambda start, steps: f"aggregate(sequence(1L, {steps}), {start}, (v, i) -> if(v < {n}L, v, {once}))"
    walked = walk(f"transform(array({x}), v -> {once})[0]", f"{min(64, beyond)}L")
    return F.expr(f"transform(array({walked}), w -> if(w < {n}L, w, {walk('w', f'{beyond}L + w - w')}))[0]")  # the second length is no constant, so it is made where it is needed


def shuffle_shards(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows to shards 0 .. shards-1 in a reproducible shuffled order, by the law `rows`.

    Place p of the permuted row number gives shard p mod shards and slot p div shards: counts differ by one at most,
    slots have no gaps, and both can be computed from the row number alone. Returns the id, ``size`` (UTF-8 bytes plus
    1; a null text has none), ``text_crc32`` (0 for null and empty), ``law``, ``shard``, ``slot`` and ``grown_shard``
    (null: this law moves rows when a shard is added). Null ids come first, equal ids are told apart by crc and size;
    an empty table gives an empty result. The text is read once; what is numbered is 24 bytes a row.
    """
    small = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    small = cut(small)
    n = small.count()
    rows = number_rows(small, "doc_id", ["text_crc32", "size"], max(BUCKETS, n // ROWS), name="_number")
    placed = rows.withColumn("_place", permute("_number", n, seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"), F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shards_sql(shards: int = 8, seed: int = 17) -> str:
    """The same in DuckDB: crc32 byte by byte from a table made by its rule, the rounds as columns, the walk recursive."""
    k = [(x + seed * 7919) % PRIME for x in ROUND_KEYS]
    f = lambda v, key: f"((({v} * {MULTIPLIERS[0]} + {key}) % {PRIME}) * {MULTIPLIERS[1]} + {key}) % {PRIME}"
    rounds = lambda src: (
        f"SELECT * EXCLUDE (l0, r0, l1, r1, l2, r2), l2 * b + r2 AS v FROM (SELECT *, (r1 + {f('l2', k[3])}) % b AS r2 FROM (SELECT *, (l1 + {f('r1', k[2])}) % a AS l2 FROM ("
        f"SELECT *, (r0 + {f('l1', k[1])}) % b AS r1 FROM (SELECT *, (l0 + {f('r0', k[0])}) % a AS l1 FROM (SELECT * EXCLUDE (v), v // b AS l0, v % b AS r0 FROM {src})))))"
    )
    return f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
raw AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
small AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(size - 1), lambda i: ('0x' || h[2*i+1:2*i+2])::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM raw, tab),
n AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM documents),
numbered AS (SELECT s.*, n, a, (n + a - 1) // a AS b, row_number() OVER (ORDER BY ((((coalesce(doc_id, -1) % {PRIME} + {PRIME}) % {PRIME}) * {MULTIPLIERS[0]} + text_crc32 * {MULTIPLIERS[1]}) % {PRIME}) % greatest({BUCKETS}, n // {ROWS}), doc_id NULLS FIRST, text_crc32, size) - 1 AS v FROM small s, n),
walk AS ({rounds('numbered')} UNION ALL ({rounds('(SELECT * FROM walk WHERE v >= n)')}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (v % {shards})::INT AS shard, v // {shards} AS slot, NULL::INT AS grown_shard FROM walk WHERE v < n"""
