"""The driver's tables as the library's inputs, in Spark and in DuckDB SQL with the same integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

SOURCES = ("VIIRS_NOAA20_NRT", "VIIRS_SNPP_NRT", "COPERNICUS_S3_SL_2_FRP_SWIR500M", "EUMETSAT_MTG_MTFRPPIXEL", "LSA_SAF_MSG_FRP_PIXEL")
KINDS = ("click", "error", "purchase", "signup", "view")
_case = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in zip(KINDS, SOURCES, strict=True)) + " ELSE upper(event_type) END"

_det = f"""SELECT event_id AS id, concat('e', user_id) AS event_id, user_id AS site, {_case} AS source, concat('SAT', event_id % 4) AS satellite,
 CASE WHEN event_id % 3 = 0 THEN 'VIIRS' WHEN event_id % 3 = 1 THEN 'MODIS' ELSE 'OTHER' END AS instrument, ts AS acq, {{received}} AS received_at,
 44 + ((user_id * 7919) % 8000) / {{k}} + ((event_id * 31) % 11 - 5) / {{k}} AS lat, 22 + ((user_id * 104729) % 18000) / {{k}} + ((event_id * 17) % 11 - 5) / {{k}} AS lon,
 value AS frp, CASE WHEN event_id % 5 = 0 THEN 'h' WHEN event_id % 5 < 4 THEN 'n' ELSE 'l' END AS confidence, CASE WHEN event_id % 3 = 0 THEN 375 WHEN event_id % 3 = 1 THEN 1000 END AS resolution_m FROM events"""

#: DuckDB: detections; regions as boxes of three degrees, named by nation rows; the area of three region keys.
DET = "det AS (" + _det.format(received="ts + (event_id % 180) * INTERVAL 1 MINUTE", k="1000.0::DOUBLE") + ")"
REG = "reg AS (SELECT n_nationkey::BIGINT AS region_id, n_name AS code, n_regionkey AS zone, 22::DOUBLE + (n_nationkey % 5) * 3.6::DOUBLE AS west, 44::DOUBLE + (n_nationkey // 5) * 1.6::DOUBLE AS south, 22::DOUBLE + (n_nationkey % 5) * 3.6::DOUBLE + 3.6::DOUBLE AS east, 44::DOUBLE + (n_nationkey // 5) * 1.6::DOUBLE + 1.6::DOUBLE AS north FROM nation)"
IN_REGION = "det_r AS (SELECT d.*, (SELECT min(region_id) FROM reg WHERE lon BETWEEN west AND east AND lat BETWEEN south AND north) AS region_id FROM det d)"
AS_OF = "(SELECT max(acq) FROM det)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _det.format(received="ts + make_dt_interval(0, 0, event_id % 180, 0)", k="1000D").split(" FROM events")[0].removeprefix("SELECT ")
    return table(spark, sf_dir, "events").selectExpr(*_columns(sql))


def _columns(sql: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(sql[start:i])
            start = i + 1
    return [*out, sql[start:]]


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    box = n.selectExpr("cast(n_nationkey as bigint) region_id", "n_name code", "n_regionkey zone", "22D + (n_nationkey % 5) * 3.6D west", "44D + (n_nationkey div 5) * 1.6D south", "22D + (n_nationkey % 5) * 3.6D + 3.6D east", "44D + (n_nationkey div 5) * 1.6D + 1.6D north")
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south"))
    return box.withColumn("rings", F.array(ring))


def as_of(det: DataFrame) -> Column:
    """The reference time as a literal: the newest acquisition (one value)."""
    return F.lit(det.agg(F.max("acq").cast("string")).first()[0]).cast("timestamp_ntz")
