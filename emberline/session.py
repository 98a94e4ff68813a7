"""What an operator needs from the session: the shared folder, cut lineage, and the package on every executor."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a fresh one where that is unset (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="emberline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


#: Paths that :func:`shared_path` has given, innermost :func:`settled` last.
_made: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a reliable checkpoint, so later stages neither recompute it nor lose it with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: for wide rows that later steps prune."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str, done: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """What ``make`` gives as a stored table, with its path; all tables that making it wrote go, and so does ``done``."""
    _made.append([])
    try:
        df = make()
    finally:
        paths = _made.pop()
    path = shared_path(spark, name)
    df.write.parquet(path)
    for old in (*paths, *done):
        delete_path(spark, old)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables that one job keeps in the shared folder and deletes as soon as no later step reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        """``df`` written and read back: lineage ends here, and a lost executor costs no earlier step."""
        path = shared_path(self.spark, f"{self.name}-{what}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that :meth:`keep` made; the caller reads them no more."""
        for df in frames:
            delete_path(self.spark, self.paths.pop(id(df))[1])

    def only(self, *frames: DataFrame) -> None:
        """Delete all tables that :meth:`keep` made but these."""
        self.drop(*(df for df, _ in list(self.paths.values()) if not any(df is x for x in frames)))


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' Python path (once per Spark context)."""
    sc = spark.sparkContext
    if getattr(sc, "_emberline_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="emberline-py-"), "emberline.zip")
    with zipfile.ZipFile(out, "w") as z:
        for top, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(out)
    sc._emberline_shipped = True
