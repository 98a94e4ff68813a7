"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, stored
from .memory import let_go
from .text import as_bytes, byte_slices

_classes = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "line": b"\n\r", "stop": b".", "comma": b",;:",
    "bang": b"!?", "bar": b"|<>[]{}\\/_=+", "sign": b"#$%&*@^~", "quote": b"'\"()-",
}
CLASS = np.zeros((256, len(_classes) + 2), np.float64)
for _i, _members in enumerate(_classes.values()):
    CLASS[list(_members), _i] = 1
CLASS[128:, -2] = 1
CLASS[:32, -1] = 1
CLASS[[9, 10, 13], -1] = 0
FEATURES = CLASS.shape[1] + 9
_capital = re.compile(rb"\b[A-Z]{2,}")


def statistics(text: bytes) -> np.ndarray:
    """Statistics of one whole document: shares of byte classes, lengths, entropy, and how far words and lines repeat."""
    n = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = np.sqrt(count @ CLASS / max(n, 1))
    p = count[count > 0] / max(n, 1)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    w, k = len(words), len(lines)
    distinct, distinct_lines = len(set(words)), len(set(lines))
    rest = (
        np.log1p(n), float(-(p * np.log(p)).sum()) if n else 0.0, np.log1p(w), n / (w + 1), np.log1p(distinct) / np.log(w + 2), distinct_lines / k if k else 1.0, np.log1p(n / (k + 1)),
        sum(map(len, _capital.findall(text))) / max(n, 1), sum(map(len, set(lines))) / max(n, 1),
    )
    return np.concatenate((share, rest))


@dataclasses.dataclass
class Model:
    """A fitted scorer; its size depends on the number of features alone."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale, self.omega, self.phase)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.clip(np.interp(self.fourier(x) @ self.weight, self.knots, self.values), 0.0, 1.0)


def fourier(x, mean, scale, omega, phase) -> np.ndarray:
    """Cosines whose inner products approximate a Gaussian kernel of the standardised statistics, and a constant."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate((np.sqrt(2 / len(phase)) * np.cos(z @ omega + phase), np.ones((len(x), 1))), axis=1)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing means of sums y with counts n (pool adjacent violators)."""
    pools: list[list[float]] = []
    for s, c in zip(y, n, strict=True):
        pools.append([s, c, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, c2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + c2, pools[-1][2] + k2]
    return np.concatenate([np.full(k, s / c) for s, c, k in pools]) if pools else np.zeros(0)


def training_rows(id_col: str = "doc_id") -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum of rows (part, at, values) by ``at``: each partition adds one row a matrix row, added up in two rounds on executors."""
    added = lambda df, *keys: df.groupBy(*keys).agg(F.collect_list(F.struct("part", "values")).alias("v")).select(
        *keys, F.aggregate(F.array_sort("v"), F.expr("cast(array_repeat(0, size(v[0].values)) as array<double>)"), lambda a, x: F.zip_with(a, x["values"], lambda p, q: p + q)).alias("values")
    )
    first = added(parts.withColumn("_g", F.col("part") % 32), "_g", "at").withColumnRenamed("_g", "part")
    rows = added(first, "at").orderBy("at").collect()
    return np.array([r["values"] for r in rows])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out`` (false for a null id) and ``x``, the statistics of the whole text (null: empty), stored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for rows in byte_slices(batch, 2):
                x = pa.array([statistics(t).tolist() for t in as_bytes(rows.column(2))], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), x], ["doc_id", "held_out", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(~training_rows(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, held_out boolean, x array<double>"), "statistics")


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", width: int = 192, bandwidth: float = 6.0, ridge: float = 1e-3, folds: int = 4, bins: int = 512, seed: int = 5) -> Model:
    """Fit on every labelled row outside the held-out third; what reaches the driver has a fixed size.

    ``table`` is :func:`document_statistics`. Pass one sums the statistics for mean and spread; pass two sums, within
    each partition and by fold, the outer products and right sides of ridge regression on ``width`` Fourier features.
    Each fold's rows are then scored by the other folds' weights, binned, and a non-decreasing calibration is fitted to
    the bins. Null labels are left out; without any label every score is 0.5. A label that is given twice, or an id that
    stands twice, counts as often as it is there; null ids have no label.
    """
    marks = labels.where(F.col(label_col).isNotNull() & training_rows(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    fold = F.pmod(F.crc32(F.concat(F.col("id").cast("string"), F.lit("fold")).cast("binary")), F.lit(folds)).cast("int").alias("fold")
    rows = cut(table.select(F.col("doc_id").alias("id"), "x").join(marks, "id").select("x", "y", fold))
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(size=(FEATURES, width)) / bandwidth, rng.uniform(0, 2 * np.pi, width)

    def partly(make):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = None
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column(0).to_pylist(), np.float64)
                    got = make(x, batch.column(1).to_numpy(), batch.column(2).to_numpy())
                    total = got if total is None else total + got
            if total is not None:
                k = len(total)
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["part", "at", "values"])

        return _summed(rows.mapInArrow(run, "part int, at int, values array<double>"))

    moments = partly(lambda x, y, f: np.array([np.full(FEATURES, len(x), float), x.sum(0), (x * x).sum(0)]))
    if not len(moments):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), omega, phase, np.zeros(width + 1), np.array([0.0]), np.array([0.5]))
    n = moments[0, 0]
    mean = moments[1] / n
    scale = np.sqrt(np.maximum(moments[2] / n - mean**2, 0)) + 1e-3

    def equations(x, y, f):
        z = fourier(x, mean, scale, omega, phase)
        out = []
        for k in range(folds):
            zk, yk = z[f == k], y[f == k]
            out += [zk.T @ zk, (zk.T @ yk)[None], np.full((1, width + 1), float(len(zk)))]
        return np.concatenate(out)

    sums = partly(equations).reshape(folds, width + 3, width + 1)
    gram, right, counts = sums[:, : width + 1], sums[:, width + 1], sums[:, width + 2, 0]
    keep = np.eye(width + 1) * ridge
    keep[-1, -1] = 1e-9

    def solve(g, r, c):
        return np.linalg.solve(g / max(c, 1) + keep, r / max(c, 1))

    weight = solve(gram.sum(0), right.sum(0), n)
    apart = np.array([solve(gram.sum(0) - gram[k], right.sum(0) - right[k], n - counts[k]) if n > counts[k] else weight for k in range(folds)])
    low, high = -0.5, 1.5

    def binned(x, y, f):
        z = fourier(x, mean, scale, omega, phase)
        raw = np.einsum("ij,ij->i", z, apart[f])
        at = np.clip(((raw - low) / (high - low) * bins).astype(int), 0, bins - 1)
        return np.array([np.bincount(at, y, bins), np.bincount(at, minlength=bins).astype(float), np.bincount(at, raw, bins)])

    y, c, raw = partly(binned)
    used = c > 0
    return Model(mean, scale, omega, phase, weight, raw[used] / c[used], isotonic(y[used], c[used]))


def score(table: DataFrame, model: Model) -> DataFrame:
    """Score :func:`document_statistics`: ``doc_id``, ``held_out``, ``score`` in 0..1, ``predicted`` (1 from 0.5 on).

    Labels, language, source and id play no part. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.array(batch.column(2).to_pylist(), np.float64).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return table.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text the model does not reject, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for rows in byte_slices(batch, at):
                x = np.array([statistics(t) for t in as_bytes(rows.column(at))])
                yield rows.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
