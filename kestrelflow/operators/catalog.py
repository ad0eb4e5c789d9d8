"""Windows as records, time series, annotations and tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kept sensors with their quantity, signal and unit.
SENSORS = (
    ("sensor_2", "temperature", "T24", "degR"), ("sensor_3", "temperature", "T30", "degR"), ("sensor_4", "temperature", "T50", "degR"),
    ("sensor_7", "pressure", "P30", "psi"), ("sensor_8", "speed", "Nf", "rpm"), ("sensor_9", "speed", "Nc", "rpm"),
    ("sensor_11", "pressure", "Ps30", "psi"), ("sensor_12", "ratio", "phi", "dimensionless"), ("sensor_13", "speed", "NRf", "rpm"),
    ("sensor_14", "speed", "NRc", "rpm"), ("sensor_15", "ratio", "BPR", "dimensionless"), ("sensor_17", "ratio", "htBleed", "dimensionless"),
    ("sensor_20", "flow", "W31", "lb/s"), ("sensor_21", "flow", "W32", "lb/s"),
)
SENSOR_SCHEMA = "sensor string, quantity string, signal string, unit_of_measure string"


def sensor_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SENSORS), SENSOR_SCHEMA)


def time_series(windows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(record_id, sensor, signal, quantity, unit_of_measure, values): a row per record and registered channel it has."""
    pairs = F.array(*(F.struct(F.lit(c).alias("sensor"), F.col("series")[c].cast("array<float>").alias("values")) for c in channels))
    long = windows.select("record_id", F.explode(pairs).alias("p")).select("record_id", "p.sensor", "p.values").where("values is not null")
    return long.join(F.broadcast(sensor_registry(windows.sparkSession)), "sensor")  # a registry of 14 rows


def annotations(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(record_id, key, value): the fields as strings, null ones left out."""
    entry = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))
    return windows.select("record_id", F.explode(entry).alias("a")).select("record_id", "a.key", "a.value").where("value is not null")


def tasks(windows: DataFrame) -> DataFrame:
    """Two tasks a record: an answer in words and a number of cycles."""
    answer = F.struct(
        F.concat(F.lit("qa-"), "record_id").alias("task_id"), F.lit("answer").alias("task_type"), F.col("prompt").alias("prompt"),
        F.col("target").alias("target"), F.lit(None).cast("double").alias("scalar_target"), F.lit(None).cast("string").alias("unit_of_measure"),
    )
    number = F.struct(
        F.concat(F.lit("rul-"), "record_id").alias("task_id"), F.lit("scalar").alias("task_type"), F.lit(None).cast("string").alias("prompt"),
        F.lit(None).cast("string").alias("target"), F.col("rul").cast("double").alias("scalar_target"), F.lit("cycle").alias("unit_of_measure"),
    )
    return windows.select("record_id", F.explode(F.array(answer, number)).alias("t")).select("record_id", "t.*")
