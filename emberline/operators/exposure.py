"""Land exposure of places: soft scores from a table of bounds, and a class by ordered rules over them."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of each class, the bounds between which an input raises its score from 0 to 1; the best input counts.
RISING = {
    "dense_urban": {"built": (22, 45), "people": (5000, 16000), "building_density": (80, 300)},
    "urban": {"built": (9, 25), "people": (1800, 7000), "building_density": (25, 120), "activity": (15, 100)},
    "suburban": {"built": (3, 12), "people": (350, 2500), "building_density": (5, 45)},
    "industrial": {"industrial_land": (1, 8), "industrial_sites": (1, 16), "industrial_share": (0.18, 0.65)},
    "forest": {"forest_land": (1, 5), "forest_share": (0.25, 0.7)},
    "agricultural": {"farm_land": (1, 5), "farm_share": (0.25, 0.7)},
}
#: Bounds between which an input lowers the score from 1 to 0; the worst input counts.
FALLING = {"rural": {"built": (2, 8), "people": (200, 1200), "building_density": (2, 20)}}
#: Classes of open land keep this part of their score where it is built up, the rest falls between the bounds.
OPEN_LAND = {"forest": (0.55, "built", (4, 18)), "agricultural": (0.55, "built", (4, 18))}
#: Two sides (each its better class) with their least scores, and what their sum is divided by: a mixture.
MIXTURES = [((("industrial",), 0.45), (("urban",), 0.35), 1.35), ((("forest",), 0.42), (("agricultural",), 0.42), 1.25), ((("forest", "agricultural"), 0.38), (("suburban",), 0.35), 1.3)]
#: The first rule that holds names the class.
RULES = [
    ("unknown", "not known"), ("mixed", "score['mixed'] >= 0.62"), ("industrial", "score['industrial'] >= 0.68 and input['residential_share'] < 0.35"),
    ("forest", "score['forest'] >= 0.64 and score['forest'] >= score['agricultural'] + 0.08"), ("agricultural", "score['agricultural'] >= 0.64 and score['agricultural'] >= score['forest'] + 0.08"),
    ("dense_urban", "score['dense_urban'] >= 0.62"), ("urban", "score['urban'] >= 0.48"), ("suburban", "score['suburban'] >= 0.38"), ("rural", "true"),
]
#: Land-use counts that make up developed and all land.
DEVELOPED = ("residential_landuse", "industrial_landuse", "commercial_landuse", "retail_landuse")
OPEN_USES = ("forest_landuse", "agricultural_landuse")


@dataclasses.dataclass(frozen=True)
class Confidence:
    """Fixed values of the confidence: base, weight of completeness, weight and full lead, loss where objects were cut off, and limits."""

    base: float = 0.48
    complete: float = 0.27
    lead: float = 0.25
    full_lead: float = 0.5
    truncated: float = 0.08
    least: float = 0.35
    most: float = 0.96
    raster: float = 0.6
    mapped: float = 0.4


def _have(df: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def inputs(df: DataFrame) -> dict[str, Column]:
    """The inputs that scores read, from raster values and counts of mapped objects; missing counts are 0."""
    count = lambda *names: sum((F.coalesce(_have(df, n), F.lit(0.0)) for n in names), F.lit(0.0))
    developed = F.greatest(F.lit(1.0), count(*DEVELOPED))
    land = F.greatest(F.lit(1.0), developed + count(*OPEN_USES))
    area = _have(df, "area_km2")
    return {
        "built": _have(df, "built_fraction_1km_pct"), "people": _have(df, "population_1km"), "building_density": F.when(area > 0, count("buildings") / area), "activity": count("amenities", "shops", "offices", "transport"),
        "industrial_land": count("industrial_landuse"), "industrial_sites": count("industrial_objects", "industrial_buildings"), "industrial_share": count("industrial_landuse") / developed,
        "residential_share": count("residential_landuse") / developed, "forest_land": count("forest_landuse"), "forest_share": count("forest_landuse") / land, "farm_land": count("agricultural_landuse"), "farm_share": count("agricultural_landuse") / land,
    }


def _ramp(name: str, bounds: tuple[float, float]) -> Column:
    """How far an input has come between two bounds: 0 to 1, null without it."""
    low, high = bounds
    value = (F.col("input")[name] - low) / (high - low)
    return F.when(value < 0, 0.0).when(value > 1, 1.0).otherwise(value)


def scores(rising=RISING, falling=FALLING, open_land=OPEN_LAND, missing: float = 0.0) -> dict[str, Column]:
    """The score of each class over the map ``input``; an input that is not there raises a score to ``missing`` and says nothing else."""
    out = {k: F.array_max(F.array(*(F.coalesce(_ramp(n, b), F.lit(missing)) for n, b in table.items()))) for k, table in rising.items()}
    for k, (kept, name, bounds) in open_land.items():
        out[k] = out[k] * (kept + (1 - kept) * F.coalesce(1 - _ramp(name, bounds), F.lit(0.0)))
    return out | {k: F.array_min(F.array(*(F.coalesce(1 - _ramp(n, b), F.lit(0.0)) for n, b in table.items()))) for k, table in falling.items()}


def _mixture(score: Column, mixtures=MIXTURES) -> Column:
    parts = []
    for (left, least), (right, least2), whole in mixtures:
        a, b = (F.array_max(F.array(*(score[k] for k in side))) for side in (left, right))
        parts.append(F.when((a >= least) & (b >= least2), F.least(F.lit(1.0), (a + b) / whole)).otherwise(0.0))
    return F.array_max(F.array(*parts))


def exposure(df: DataFrame, rising=RISING, falling=FALLING, open_land=OPEN_LAND, mixtures=MIXTURES, rules=RULES, sure: Confidence = Confidence(), missing: float = 0.0) -> DataFrame:
    """Class of land exposure with ``confidence``, ``completeness``, ``scores`` by class and ``reasons``.

    Reads raster values (``population_1km``, ``population_5km``, ``built_fraction_1km_pct``, ``built_fraction_5km_pct``) and counts of mapped
    objects (see :func:`inputs`, ``total``, ``truncated``); columns that are not there are missing, and missing inputs
    raise no score (to ``missing`` if given). Without raster
    values and objects the class is ``unknown`` and the confidence 0. ``completeness`` adds up the shares of the two
    kinds; confidence grows with it and with the lead of the best score, and falls where objects were cut off.
    ``reasons`` lists the inputs that say something, in the order of the table.
    """
    values = inputs(df)
    raster = F.coalesce(*(_have(df, f"{n}_{k}km{end}") for n, end in (("population", ""), ("built_fraction", "_pct")) for k in (1, 5))).isNotNull()
    mapped = (F.coalesce(_have(df, "total"), F.lit(0.0)) > 0) | (F.coalesce(_have(df, "buildings"), F.lit(0.0)) > 0)
    names = [*df.columns]
    work = df.withColumn("input", F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))).withColumn("_raster", raster).withColumn("_mapped", mapped)
    found = scores(rising, falling, open_land, missing)
    work = work.withColumn("score", F.create_map(*(x for k, v in found.items() for x in (F.lit(k), v))))
    work = work.withColumn("score", F.map_concat("score", F.create_map(F.lit("mixed"), _mixture(F.col("score"), mixtures)))).withColumn("known", F.col("_raster") | F.col("_mapped"))
    work = work.withColumn("exposure", F.coalesce(*(F.when(F.expr(rule), name) for name, rule in rules)))
    ranked = F.reverse(F.array_sort(F.map_values("score")))
    lead = F.least(F.lit(1.0), (ranked[0] - ranked[1]) / sure.full_lead)
    work = work.withColumn("completeness", F.when(F.col("_raster"), sure.raster).otherwise(0.0) + F.when(F.col("_mapped"), sure.mapped).otherwise(0.0))
    cut = F.when(F.coalesce(_have(df, "truncated", "boolean"), F.lit(False)), sure.truncated).otherwise(0.0)
    level = sure.base + sure.complete * F.col("completeness") + sure.lead * lead - cut
    told = ("built", "people", "building_density", "industrial", "forest_land", "farm_land", "activity")
    value = {k: values[k] for k in told if k in values} | {"industrial": values["industrial_land"] + values["industrial_sites"]}
    says = {k: value[k].isNotNull() if k in ("built", "people", "building_density") else value[k] > 0 for k in told}
    reasons = F.filter(F.array(*(F.when(says[k], F.struct(F.lit(k).alias("input"), F.round(value[k], 1).alias("value"))) for k in told)), lambda x: x.isNotNull())
    confidence = F.when(F.col("exposure") == "unknown", 0.0).otherwise(F.round(F.least(F.lit(sure.most), F.greatest(F.lit(sure.least), level)), 3))
    return work.select(*(F.col(f"`{n}`") for n in names), "exposure", confidence.alias("confidence"), "completeness", F.transform_values("score", lambda k, v: F.round(v, 3)).alias("scores"), reasons.alias("reasons"))
