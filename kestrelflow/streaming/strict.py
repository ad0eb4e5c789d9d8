"""Strict scan of telemetry lines as a stream: good lines go on, broken ones go to a place of their own.

The rules of a line by itself are columns. Order of units and cycles is checked by source (a file, or
whatever numbers its lines) with a few numbers of state: a line has to follow the last well-formed
line of its source. A broken line doesn't stop the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kestrelflow.sources.raw_text import FIELDS, first_rule, split_lines


class OrderCheck(StatefulProcessor):
    """Adds the rules order (a smaller unit than before) and sequence (not the next cycle, or not 1 for a new unit)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "unit long, cycle long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("line", kind="stable")
        good = np.flatnonzero(frame["rule"].isna())
        if len(good):
            unit, cycle = (frame[c].to_numpy()[good].astype(np.int64) for c in ("unit", "cycle"))
            last = self.last.get() if self.last.exists() else (0, 0)
            unit_before, cycle_before = np.append(last[0], unit[:-1]), np.append(last[1], cycle[:-1])
            follows = np.where(unit == unit_before, cycle == cycle_before + 1, cycle == 1)
            rule = frame["rule"].to_numpy(object).copy()
            rule[good] = np.where(unit < unit_before, "order", np.where(follows, None, "sequence"))
            frame = frame.assign(rule=rule)
            self.last.update((int(unit[-1]), int(cycle[-1])))
        yield frame[["line", "value", "rule"]].assign(source=str(key[0]))[["source", "line", "value", "rule"]]

    def close(self) -> None:
        pass


def strict_lines(lines: DataFrame, width: int = len(FIELDS), units: int = 100) -> DataFrame:
    """(source, line, value, rule, broken) of a stream of (source, line, value), whose lines come in order by source.

    rule is the first that the line breaks: width, number, finite, whole, range, order or sequence;
    null for a good line. Blank lines go. Lines of one source in one batch are sorted in a task.
    Needs the state store of streaming.windows.
    """
    split = split_lines(lines)
    key = lambda i: F.get("_f", F.lit(i)).try_cast("double")
    ruled = split.select(F.col("source").cast("string").alias("source"), F.col("line").cast("long").alias("line"), "value", first_rule(width, units).alias("rule"), key(0).alias("unit"), key(1).alias("cycle"))
    found = ruled.groupBy("source").transformWithStateInPandas(
        OrderCheck(), outputStructType="source string, line long, value string, rule string", outputMode="append", timeMode="none"
    )
    return found.withColumn("broken", F.col("rule").isNotNull())


def text_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """(source, line, value) of text files as they appear; a file is one row until its lines are numbered, so files of moderate size."""
    whole = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("source"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
