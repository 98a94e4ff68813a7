"""Arrays of JSON records as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_records(df: DataFrame, key: str, array: str, schema: str) -> DataFrame:
    """The elements of JSON arrays in order: ``key``, ``place`` (from 1), the schema's fields, ``malformed``.

    An element that is no object, or one of whose fields is not of its type, has null fields and is given as text in
    ``malformed``; the elements beside it are read as usual. A field that an object lacks is null, one that the schema
    lacks is left out. A text that is no JSON array is one malformed element at place 0; null and empty arrays have none.
    """
    elements = F.from_json(array, "array<string>")
    whole = df.select(key, F.col(array).alias("_text"), elements.alias("_e"))
    rows = whole.select(key, F.posexplode("_e").alias("_i", "_one")).select(key, (F.col("_i") + 1).alias("place"), F.col("_one"))
    broken = whole.where("_text is not null and _e is null").select(key, F.lit(0).alias("place"), F.col("_text").alias("_one"))
    read = F.from_json("_one", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = rows.unionByName(broken).withColumn("_r", F.when((F.col("place") > 0) & F.ltrim("_one").startswith("{"), read))
    names = [f.strip().split()[0] for f in schema.split(",")]
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    return out.select(key, "place", *(F.when(~bad, F.col(f"_r.{n}")).alias(n) for n in names), F.when(bad, F.col("_one")).alias("malformed"))
