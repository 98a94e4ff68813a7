"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut
from .memory import held
from .text import as_text, byte_slices


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, kept for the tasks of one Python worker."""

    def make():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return held(("tiktoken", path, pattern), make)


def encoded_lengths(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """One ``length`` (long, tokens of the whole text; null and empty texts have 0) a row, nothing else."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for rows in byte_slices(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array([len(enc.encode_ordinary(t)) for t in as_text(rows.column(0))], pa.int64())], ["length"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "length long")


def length_histogram(lengths: DataFrame, block: int = 1024) -> DataFrame:
    """What every context limit keeps, from one ``length`` a document.

    A row for each length L that occurs: ``context_limit`` = L, ``n_docs`` of that length, ``docs_over`` (longer),
    ``docs_at_least``, ``tokens_at_least`` (of those), ``docs_total``, ``tokens_total``, ``tokens_kept`` (sum of
    min(length, L)), ``tokens_cut`` and ``quantile`` (share of documents no longer than L). Limits between two rows
    follow from :func:`at_limit`. Documents collapse map-side to one row a length, a table that is cut off here, so that
    no text is encoded twice; suffix sums run over blocks of
    lengths and inside each block, so no task holds more than ``block`` lengths or the list of blocks. Null lengths
    count as 0; no documents give no rows.
    """
    hist = cut(lengths.groupBy(F.coalesce("length", F.lit(0)).alias("context_limit")).agg(F.count("*").alias("n_docs")))
    hist = hist.withColumn("_t", F.col("context_limit") * F.col("n_docs")).withColumn("_b", F.floor(F.col("context_limit") / block))
    blocks = hist.groupBy("_b").agg(F.sum("n_docs").alias("_bn"), F.sum("_t").alias("_bt"))
    above, every = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("_b", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_bn", "_bt")), F.sum("_bn").over(every).alias("docs_total"), F.sum("_bt").over(every).alias("tokens_total"))
    within = Window.partitionBy("_b").orderBy(F.desc("context_limit")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.select("*", F.sum("n_docs").over(within).alias("_n"), F.sum("_t").over(within).alias("_tt")).join(blocks, "_b")
    out = out.withColumn("docs_at_least", F.col("_n") + F.col("_bn_above")).withColumn("tokens_at_least", F.col("_tt") + F.col("_bt_above"))
    out = out.withColumn("docs_over", F.col("docs_at_least") - F.col("n_docs"))
    kept = F.col("tokens_total") - F.col("tokens_at_least") + F.col("context_limit") * F.col("docs_at_least")
    return out.select(
        "context_limit", "n_docs", "docs_over", "docs_at_least", "tokens_at_least", "docs_total", "tokens_total", kept.alias("tokens_kept"),
        (F.col("tokens_total") - kept).alias("tokens_cut"), F.round(1 - F.col("docs_over") / F.col("docs_total"), 9).alias("quantile"),
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """One row for any ``limit``: ``docs_reaching`` (of that length or longer) and ``tokens_kept``, off the next length that occurs."""
    up = F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("context_limit") >= limit, F.col("context_limit"))).alias("h")
    one = hist.agg(F.max("tokens_total").alias("total"), F.max("context_limit").alias("most"), up)
    reach = F.when(F.col("most") >= limit, F.col("h.docs_at_least")).otherwise(0)
    kept = F.when(F.col("most") >= limit, F.col("total") - F.col("h.tokens_at_least") + limit * F.col("h.docs_at_least")).otherwise(F.col("total"))
    return one.select(F.lit(limit).alias("limit"), reach.cast("long").alias("docs_reaching"), F.coalesce(kept, F.lit(0)).cast("long").alias("tokens_kept"))
