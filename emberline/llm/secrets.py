"""Secret scans: candidates of every text, told apart by how many owners hold the same value."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .memory import let_go
from .text import as_text, byte_slices, named_apart

#: The base patterns, then further credential formats.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
MORE = {
    "forge": re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
}
KINDS = (*BASE, *MORE)


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of all candidates by start, then kind as listed; places are code points.

    A run of access or hex characters is one match, so its minimum length may stand in the pattern; an assignment too
    short is dropped after matching, as the text it covers is spent.
    """
    out = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for kind, pattern in (("access", ACCESS), ("hex", HEX), *MORE.items()):
        out += [(m.start(), m.end(), kind, m[0]) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


CANDIDATES = "rid long, text_key long, doc_id long, repository string, owner string, kinds array<string>, starts array<int>, ends array<int>, hashes array<string>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """Every document's candidates as parallel arrays, stored once; ``rid`` tells rows with equal ids apart. Values leave as sha-256.

    ``repository`` and ``owner`` must name columns (null values count as one name); a table without owners has no
    ownership to count, and is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for rows in byte_slices(batch, 5):
                found = [find(t) for t in as_text(rows.column(5))]
                lists = [
                    pa.array([[x[2] for x in f] for f in found], pa.list_(pa.string())),
                    pa.array([[x[0] for x in f] for f in found], pa.list_(pa.int32())),
                    pa.array([[x[1] for x in f] for f in found], pa.list_(pa.int32())),
                    pa.array([[hashlib.sha256(x[3].encode()).hexdigest() for x in f] for f in found], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*rows.columns[:5], *lists], [c.split()[0] for c in CANDIDATES.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.xxhash64(text_col).alias("text_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, CANDIDATES), "candidates")


def ownership(found: DataFrame, copied_owners: int = 3) -> DataFrame:
    """Per candidate hash: ``n_repositories`` and ``n_owners`` that hold it (distinct; null names count as one) and ``copied``.

    A value that at least ``copied_owners`` owners hold is a widely copied example; others look live, in however many
    repositories of fewer owners they are: a credential that one owner repeats is still that owner's. Rows collapse to one a (hash, owner, repository), then to one a (hash, owner) and one
    a (hash, repository), before a hash is counted with map-side sums, so a value in a third of all documents is spread.
    """
    each = found.select(F.explode(F.array_distinct("hashes")).alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"))
    held = each.distinct()
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_owners"))
    repositories = held.groupBy("hash", "repository").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_repositories"))
    per = owners.join(repositories, "hash")
    return per.select("hash", "n_repositories", "n_owners", (F.col("n_owners") >= copied_owners).alias("copied"))


def judged(found: DataFrame, **limits) -> DataFrame:
    """``found`` with, per row, ``copied`` (array<boolean>, by candidate). Only rows with candidates are joined."""
    one = found.where(F.size("hashes") > 0).select("rid", F.posexplode("hashes").alias("at", "hash"))
    marks = one.join(ownership(found, **limits).select("hash", "copied"), "hash")
    rows = marks.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "copied"))), lambda x: x["copied"]).alias("copied"))
    return found.join(rows, "rid", "left").withColumn("copied", F.coalesce("copied", F.array().cast("array<boolean>")))


def scan(docs: DataFrame, **columns) -> DataFrame:
    """All documents with their secrets: base counts and digest, all spans, and how many look live or copied.

    ``base_sha256`` is the digest of the base spans, ``spans`` lists all of them as kind:start:end, joined by commas in
    the order of start, then kind. ``n_live`` and ``n_copied`` split all spans by :func:`ownership`; ``live_spans``
    lists the live ones. Null texts are empty.
    """
    found = judged(candidates(docs, **columns))
    text = lambda i: F.concat_ws(":", F.get("kinds", i), F.get("starts", i).cast("string"), F.get("ends", i).cast("string"))
    all_at = F.when(F.size("kinds") > 0, F.sequence(F.lit(0), F.size("kinds") - 1)).otherwise(F.array().cast("array<int>"))
    found = found.withColumn("_at", all_at)
    pick = lambda keep: F.array_join(F.transform(F.filter("_at", keep), text), ",")
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    live = lambda i: ~F.get("copied", i)
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(pick(lambda i: F.get("kinds", i).isin(*BASE)).cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("_at", text), ",").alias("spans"), F.size(F.filter("copied", lambda c: ~c)).cast("long").alias("n_live"), F.size(F.filter("copied", lambda c: c)).cast("long").alias("n_copied"), pick(live).alias("live_spans"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "<secret>", **columns) -> DataFrame:
    """The documents with every live-looking value's span replaced by ``mask``; copied examples and all other text stay.

    Only documents with live spans change; null texts stay null, all columns and repeated rows stay. Spans find their text
    by id and a hash of it, so shared and null ids are no trouble.
    """
    at, kinds = docs.columns.index(text_col), docs.schema
    key = named_apart(docs.columns, "_text_key")
    keyed = docs.withColumn(key, F.xxhash64(text_col)).alias("d")
    found = judged(candidates(docs, id_col=id_col, text_col=text_col, **columns))
    live = F.filter(F.arrays_zip("starts", "ends", "copied"), lambda x: ~x["copied"])
    spans = found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), live.alias("live")).where(F.size("live") > 0).dropDuplicates(["id", "key"]).alias("s")
    rows = keyed.join(spans, F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("s.id")) & (F.col(f"d.{key}") == F.col("s.key")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            out = []
            for text, live in zip(batch.column(at).to_pylist(), batch.column(len(kinds)).to_pylist(), strict=True):
                if live:
                    parts, done = [], 0
                    for x in sorted(live, key=lambda v: (v["starts"], -v["ends"])):
                        if x["starts"] >= done:
                            parts += [text[done : x["starts"]], mask]
                        done = max(done, x["ends"])
                    text = "".join(parts) + text[done:]  # spans that start inside one are covered by it
                out.append(text)
            columns = list(batch.columns[: len(kinds)])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, kinds.names)

    return rows.select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("s.live").alias(named_apart(docs.columns, "_live"))).mapInArrow(run, kinds)
