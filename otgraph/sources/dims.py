"""Equipment hierarchy and per-stage sensor profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Production lines and their stages as (stage name, component id), in order.
PRODUCTION_LINES = [
    ("French Fries", [("Washing", "FF-WASH"), ("Peeling", "FF-PEEL"), ("Cutting", "FF-CUT"),
                      ("Blanching", "FF-BLANCH"), ("Frying", "FF-FRY"),
                      ("IQF Freezing", "FF-IQF")]),
    ("Hash Browns", [("Washing", "HB-WASH"), ("Peeling", "HB-PEEL"), ("Shredding", "HB-SHRED"),
                     ("Forming", "HB-FORM"), ("IQF Freezing", "HB-IQF")]),
    ("Wedges", [("Washing", "WG-WASH"), ("Cutting", "WG-CUT"), ("Seasoning", "WG-SEASON"),
                ("Frying", "WG-FRY"), ("IQF Freezing", "WG-IQF")]),
]

# Sensor baseline per stage as (stage, sensor, base, sigma, sin_step).
SENSOR_PROFILES = [
    ("Washing", "oil_temperature", 20.0, 0.5, 0.0),
    ("Washing", "water_temperature", 15.0, 1.0, 0.05),
    ("Washing", "belt_speed", 1.5, 0.1, 0.02),
    ("Washing", "freezer_temperature", 20.0, 0.3, 0.0),
    ("Washing", "moisture_content", 80.0, 2.0, 0.01),
    ("Washing", "product_weight", 500.0, 15.0, 0.0),
    ("Peeling", "oil_temperature", 20.0, 0.5, 0.0),
    ("Peeling", "water_temperature", 18.0, 1.0, 0.03),
    ("Peeling", "belt_speed", 1.2, 0.08, 0.02),
    ("Peeling", "freezer_temperature", 20.0, 0.3, 0.0),
    ("Peeling", "moisture_content", 75.0, 2.5, 0.01),
    ("Peeling", "product_weight", 450.0, 12.0, 0.0),
    ("Cutting", "oil_temperature", 20.0, 0.5, 0.0),
    ("Cutting", "water_temperature", 16.0, 0.8, 0.02),
    ("Cutting", "belt_speed", 1.8, 0.12, 0.03),
    ("Cutting", "freezer_temperature", 20.0, 0.3, 0.0),
    ("Cutting", "moisture_content", 68.0, 2.0, 0.01),
    ("Cutting", "product_weight", 480.0, 18.0, 0.0),
    ("Blanching", "oil_temperature", 22.0, 0.8, 0.0),
    ("Blanching", "water_temperature", 85.0, 2.0, 0.1),
    ("Blanching", "belt_speed", 1.0, 0.05, 0.01),
    ("Blanching", "freezer_temperature", 20.0, 0.3, 0.0),
    ("Blanching", "moisture_content", 72.0, 2.0, 0.02),
    ("Blanching", "product_weight", 460.0, 10.0, 0.0),
    ("Frying", "oil_temperature", 178.0, 3.0, 0.15),
    ("Frying", "water_temperature", 20.0, 0.5, 0.0),
    ("Frying", "belt_speed", 1.3, 0.08, 0.02),
    ("Frying", "freezer_temperature", 20.0, 0.3, 0.0),
    ("Frying", "moisture_content", 55.0, 3.0, 0.05),
    ("Frying", "product_weight", 420.0, 15.0, 0.0),
    ("IQF Freezing", "oil_temperature", 20.0, 0.3, 0.0),
    ("IQF Freezing", "water_temperature", 12.0, 0.5, 0.0),
    ("IQF Freezing", "belt_speed", 1.0, 0.05, 0.01),
    ("IQF Freezing", "freezer_temperature", -30.0, 2.0, 0.1),
    ("IQF Freezing", "moisture_content", 58.0, 1.5, 0.01),
    ("IQF Freezing", "product_weight", 500.0, 10.0, 0.0),
    ("Shredding", "oil_temperature", 20.0, 0.5, 0.0),
    ("Shredding", "water_temperature", 16.0, 0.8, 0.02),
    ("Shredding", "belt_speed", 2.0, 0.15, 0.03),
    ("Shredding", "freezer_temperature", 20.0, 0.3, 0.0),
    ("Shredding", "moisture_content", 70.0, 2.0, 0.01),
    ("Shredding", "product_weight", 440.0, 14.0, 0.0),
    ("Forming", "oil_temperature", 22.0, 0.8, 0.0),
    ("Forming", "water_temperature", 18.0, 0.6, 0.01),
    ("Forming", "belt_speed", 1.0, 0.06, 0.02),
    ("Forming", "freezer_temperature", 20.0, 0.3, 0.0),
    ("Forming", "moisture_content", 62.0, 2.5, 0.02),
    ("Forming", "product_weight", 460.0, 12.0, 0.0),
    ("Seasoning", "oil_temperature", 22.0, 0.8, 0.0),
    ("Seasoning", "water_temperature", 17.0, 0.6, 0.01),
    ("Seasoning", "belt_speed", 1.4, 0.08, 0.02),
    ("Seasoning", "freezer_temperature", 20.0, 0.3, 0.0),
    ("Seasoning", "moisture_content", 60.0, 2.0, 0.02),
    ("Seasoning", "product_weight", 510.0, 16.0, 0.0),
]
FALLBACK_STAGE = "Washing"


def equipment_dim(spark: SparkSession) -> DataFrame:
    """(line_id, line_name, stage_id, stage_name, component_id): lines numbered from 1 and
    stages ``<line>-<n>`` in their order (S15); built by two ``posexplode`` of a literal."""
    lines = F.array(*[
        F.struct(F.lit(name).alias("line_name"),
                 F.array(*[F.struct(F.lit(s).alias("stage_name"), F.lit(c).alias("component_id"))
                           for s, c in stages]).alias("stages"))
        for name, stages in PRODUCTION_LINES])
    one = spark.range(1).select(F.posexplode(lines).alias("li", "line"))
    two = one.select("li", "line.line_name", F.posexplode("line.stages").alias("si", "stage"))
    return two.select(
        (F.col("li") + 1).cast("string").alias("line_id"), "line_name",
        F.concat_ws("-", (F.col("li") + 1).cast("string"), (F.col("si") + 1).cast("string"))
        .alias("stage_id"),
        F.col("stage.stage_name").alias("stage_name"),
        F.col("stage.component_id").alias("component_id"))


def sensor_profile_dim(spark: SparkSession) -> DataFrame:
    """(stage_name, sensor, base, sigma, sin_step)."""
    return spark.createDataFrame(
        SENSOR_PROFILES, "stage_name string, sensor string, base double, sigma double, "
                         "sin_step double")


def profiles_for(stages: DataFrame, profiles: DataFrame, stage: str = "stage_name") -> DataFrame:
    """Profiles for each stage of ``stages``; a stage without its own profile uses the Washing
    profile (S16 fallback)."""
    own = stages.select(stage).distinct().join(
        profiles.select(F.col("stage_name").alias(stage), "sensor").distinct()
        .select(stage).distinct().withColumn("_has", F.lit(True)), stage, "left")
    keyed = own.select(stage, F.when(F.col("_has"), F.col(stage))
                       .otherwise(F.lit(FALLBACK_STAGE)).alias("_src"))
    return keyed.join(profiles.withColumnRenamed("stage_name", "_src"), "_src") \
        .select(stage, "sensor", "base", "sigma", "sin_step")
