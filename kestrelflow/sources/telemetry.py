"""Telemetry: one row per unit and cycle. The test tables' events serve as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The channels of the telemetry view; the last one is constant.
CHANNELS = ("sensor_3", "sensor_4", "sensor_9", "sensor_11", "sensor_15", "sensor_1")

#: Units of the splits of the original fleet: first and last.
FLEET_SPLITS = {"train": (1, 70), "validation": (71, 80), "test": (81, 100)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_by_digit(unit: Column) -> Column:
    """Whole units go to one split: by the last digit, 0 to 6 train, 7 validation, 8 and 9 test."""
    digit = F.pmod(unit, F.lit(10))
    return F.when(digit < 7, "train").when(digit == 7, "validation").otherwise("test")


def fleet_split(unit: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (a, b) in FLEET_SPLITS.items():
        out = F.when(unit.between(a, b), name).otherwise(out)
    return out


def split_registry(spark: SparkSession) -> DataFrame:
    """(unit, split) of the original fleet, a row for each of its units."""
    rows = [(u, name) for name, (a, b) in FLEET_SPLITS.items() for u in range(a, b + 1)]
    return spark.createDataFrame(rows, "unit int, split string")


def with_registered_split(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """The rows of registered units with their split; Spark broadcasts a registry that is small enough."""
    return rows.drop("split").join(registry.select("unit", "split"), "unit")


def with_provenance(rows: DataFrame, **facts) -> DataFrame:
    """The rows with `provenance`, a struct of the same facts for every row."""
    return rows.withColumn("provenance", F.struct(*(F.lit(v).alias(k) for k, v in facts.items())))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, cycle, channels, split) of events: a user's events in order of time are a unit's cycles."""
    # Windows go by unit as it is given out, so that later ones by unit need no shuffle of their own.
    k = F.get_json_object("props", "$.k").cast("double").alias("k")
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").cast("int").alias("unit"), "value", k)
    by_time = Window.partitionBy("unit").orderBy("ts", "event_id")
    return events.select(
        "unit",
        F.row_number().over(by_time).alias("cycle"),
        (F.col("value") - F.col("k")).alias("sensor_3"),
        F.col("value").alias("sensor_4"),
        (F.col("value") + F.col("k")).alias("sensor_9"),
        F.col("k").alias("sensor_11"),
        (F.col("value") / (F.col("k") + 1)).alias("sensor_15"),
        F.lit(1.0).alias("sensor_1"),
        split_by_digit(F.col("unit")).alias("split"),
    )
