"""A keyed table that micro-batches change: rows in buckets, a version of a bucket for each batch that touched it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Buckets:
    """The table under ``path``: ``rows/batch=N/bucket=B`` holds what batch N made of bucket B, ``manifest/N`` the version of each bucket.

    A batch reads the buckets that it touches, whatever the number of batches before it, and writes them anew. The manifest
    is renamed into place last, so a batch that died has changed nothing, and one that is run again reads what it read
    the first time. Versions that neither a batch's manifest nor the one before it names are deleted. The driver holds one
    number a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def committed(self, below: int | None = None) -> list[int]:
        """The batches whose manifest stands, newest first."""
        return sorted((int(n) for n in self._names("manifest") if n.isdigit() and (below is None or int(n) < below)), reverse=True)

    def versions(self, number: int | None) -> dict[int, int]:
        """The version of each bucket that has rows, as of a batch."""
        if number is None:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/{number}").collect()
        return {r.bucket: r.version for r in rows}

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/batch={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def before(self, number: int, touched: list[int]) -> DataFrame:
        """The rows of the touched buckets as batch ``number`` finds them."""
        old = self.versions(next(iter(self.committed(number)), None))
        return self._rows({b: old[b] for b in touched if b in old})

    def current(self) -> DataFrame:
        return self._rows(self.versions(next(iter(self.committed()), None)))

    def replace(self, number: int, rows: DataFrame, touched: list[int]) -> None:
        """Make ``rows`` (with their ``bucket``) all that the touched buckets hold."""
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/rows/batch={number}")
        earlier = self.committed(number)
        old = self.versions(earlier[0] if earlier else None)
        held = {int(n.split("=")[1]) for n in self._names(f"rows/batch={number}") if n.startswith("bucket=")}
        new = {b: v for b, v in old.items() if b not in touched} | dict.fromkeys(held, number)
        self.spark.createDataFrame(list(new.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/next/{number}")
        fs, place = self._fs(f"manifest/{number}")
        fs.mkdirs(place.getParent())
        fs.delete(place, True)
        fs.rename(self._fs(f"next/{number}")[1], place)
        for gone in earlier[1:]:
            for b, v in self.versions(gone).items():
                if old.get(b) != v:
                    delete_path(self.spark, f"{self.path}/rows/batch={v}/bucket={b}")
            delete_path(self.spark, f"{self.path}/manifest/{gone}")
