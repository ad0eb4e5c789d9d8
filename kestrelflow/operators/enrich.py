"""Window records with a staged report each, from file to file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kestrelflow.functions.numbers import signed
from kestrelflow.functions.text import staged_report
from kestrelflow.operators import labels
from kestrelflow.sources.files import window_schema
from kestrelflow.sources.raw_text import first_lines, read_lines
from kestrelflow.sources.sinks import publish


def enriched(windows: DataFrame, temperature: str = "sensor_4", pressure: str = "sensor_11") -> DataFrame:
    """The records with `diagnostics`, a staged report, and with status, rationale and target by it.

    Test records' remaining life stays in `rul` but is used nowhere; a missing channel drifts by 0.
    """
    channels = windows.schema["series"].dataType.fieldNames()
    drift = lambda c: labels.rounded_drift(F.col("series")[c]) if c in channels else F.lit(0.0)
    known = F.when(F.coalesce(F.col("split"), F.lit("")) != "test", F.col("rul"))
    life = labels.staged_rul(known, drift(temperature), drift(pressure))
    status, split = labels.band(life), F.coalesce("split", F.lit(""))
    seen = F.concat(F.lit("Temperature moved by "), signed(drift(temperature), 2), F.lit(", pressure by "), signed(drift(pressure), 2), F.lit("."))
    report = staged_report(seen, status, labels.directive_horizon(status, life, split), known)
    out = windows.withColumns({"diagnostics": report, "status": status})
    rationale = F.concat_ws(" ", "diagnostics.observation", "diagnostics.analysis")
    return out.withColumns({"rationale": rationale, "target": F.col("diagnostics.summary"), "withheld": (split == "test") & F.col("diagnostics").isNotNull()})


def enrich_file(spark: SparkSession, source: str, target: str, channels: Sequence[str], sample_limit: int = 0) -> int:
    """Enriches a file of window records into another and says how many; of the first `sample_limit` physical lines if it isn't 0.

    Lines are counted blank ones included. A line that isn't a record stops the job, and what was at
    the target stays. The target is published whole, and isn't the source.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the target is the source")
    lines = first_lines(read_lines(spark, source), sample_limit).where(F.length(F.trim("value")) > 0)
    records = lines.select(F.from_json("value", window_schema(channels), {"mode": "FAILFAST"}).alias("r")).select("r.*")
    seen = Observation()
    watched = enriched(records).observe(seen, F.count("*").alias("rows"))
    publish(spark, target, lambda place: watched.write.option("ignoreNullFields", "false").json(place))
    return seen.get["rows"]
