"""Strided windows, sequence gaps and moments over a stream of telemetry rows.

State is the last rows of each unit, and rows that came before their predecessors. Rows of a unit may
arrive in any order; they are taken in order of cycle, each once its predecessor has been. What a
batch costs goes by the rows that arrive and that become ready, not by those that wait. A unit's last
window needs to know that the unit has ended: a row with `ended` true says so, and all that is kept of
the unit then is that it is over. Rows that come again or after their unit's end are given out apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that these operators need, as a setting of the session that runs the stream.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OVER = 0


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store set; the given session's settings stay as they are."""
    own = spark.newSession()
    own.conf.set(*STATE_STORE)
    return own


class WindowBuffer(StatefulProcessor):
    """Keeps a unit's last `size` values and emits a window at every stride, and at the unit's end.

    Kinds of rows: window; late (the row came before, or its unit is over); waiting (a row that
    still waited for its predecessor when its unit had been idle for `idle_ms`).
    """

    def __init__(self, channels: Sequence[str], size: int, stride: int, idle_ms: int | None = None):
        self.channels, self.size, self.stride, self.idle_ms = list(channels), size, stride, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{c} double" for c in self.channels)
        self.handle = handle
        self.following = handle.getValueState("following", "cycle int")
        self.recent = handle.getListState("recent", f"cycle int, {fields}")
        self.early = handle.getMapState("early", "cycle int", f"{fields}, ended boolean")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        unit, out, arrived, late = int(key[0]), [], {}, []
        following = self.following.get()[0] if self.following.exists() else 1
        waiting = self.early.exists()  # where nothing waits, which is usual, no row has to ask the state store
        for frame in rows:
            for r in frame.itertuples(index=False):
                cycle, values = int(r.cycle), (*(float(getattr(r, c)) for c in self.channels), bool(r.ended))
                if following == OVER or cycle < following or cycle in arrived or (waiting and self.early.containsKey((cycle,))):
                    late.append((unit, cycle, "late", *([x] for x in values[:-1])))
                else:
                    arrived[cycle] = values
        ready, over = [], False
        while not over and following != OVER:
            if following in arrived:
                *values, over = arrived.pop(following)
            elif waiting and self.early.containsKey((following,)):
                *values, over = self.early.getValue((following,))
                self.early.removeKey((following,))
            else:
                break
            ready.append((following, *values))
            following += 1
        if ready:
            recent = list(self.recent.get()) if ready[0][0] > 1 and self.recent.exists() else []
            known = [*recent, *ready]
            columns = [np.array([r[i + 1] for r in known], float) for i in range(len(self.channels))]
            for end in range(max(len(recent) + 1, self.size), len(known) + 1):
                cycle = known[end - 1][0]
                if (cycle - self.size) % self.stride == 0 or (over and end == len(known)):
                    out.append((unit, cycle, "window", *(c[end - self.size : end] for c in columns)))
        if over:
            late += [(unit, c, "late", *([x] for x in v[:-1])) for c, v in [*arrived.items(), *(self._waiting() if waiting else [])]]
            if recent:
                self.recent.clear()
            if waiting:
                self.early.clear()
            self.following.update((OVER,))
        else:
            if ready:
                self.recent.put(known[-self.size :])
                self.following.update((following,))
            for cycle, values in arrived.items():
                self.early.updateValue((cycle,), values)
        if self.idle_ms is not None:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield self._frame(out + late)

    def _waiting(self) -> list[tuple]:
        return [(k[0], tuple(v)) for k, v in self.early.iterator()] if self.early.exists() else []

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["unit", "cycle", "kind", *self.channels])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [(int(key[0]), c, "waiting", *([x] for x in v[:-1])) for c, v in self._waiting()]
        for state in (self.following, self.recent, self.early, self.timer):
            state.clear()
        yield self._frame(waiting)

    def close(self) -> None:
        pass


def stream_rows(rows: DataFrame, channels: Sequence[str], size: int = 30, stride: int = 5, idle_ms: int | None = None) -> DataFrame:
    """(unit, cycle, kind, an array per channel) of a stream of (unit, cycle, channels, ended): windows, and rows apart (see WindowBuffer).

    A row apart has its own values, an array of one for each channel. With `idle_ms` the state of a
    unit without rows for so long goes, and what still waited is given out; a unit that goes on after
    that begins anew. Needs STATE_STORE.
    """
    arrays = ", ".join(f"{c} array<double>" for c in channels)
    return rows.groupBy("unit").transformWithStateInPandas(
        WindowBuffer(channels, size, stride, idle_ms), outputStructType=f"unit int, cycle int, kind string, {arrays}", outputMode="append",
        timeMode="none" if idle_ms is None else "processingTime",
    )


def stream_windows(rows: DataFrame, channels: Sequence[str], size: int = 30, stride: int = 5, idle_ms: int | None = None) -> DataFrame:
    """(unit, cycle, an array per channel): the windows alone."""
    return stream_rows(rows, channels, size, stride, idle_ms).where("kind = 'window'").drop("kind")


class GapDetector(StatefulProcessor):
    """Emits (unit, cycle, expected) for each row, in order of arrival, whose cycle isn't the one after the last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "cycle int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = (self.last.get()[0] if self.last.exists() else 0), []
        for cycle in sorted(int(c) for frame in rows for c in frame["cycle"]):
            if cycle != last + 1:
                out.append((int(key[0]), cycle, last + 1))
            last = cycle
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["unit", "cycle", "expected"])

    def close(self) -> None:
        pass


def stream_gaps(rows: DataFrame) -> DataFrame:
    return rows.select("unit", "cycle").groupBy("unit").transformWithStateInPandas(
        GapDetector(), outputStructType="unit int, cycle int, expected int", outputMode="append", timeMode="none"
    )


def stream_moments(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Running count, mean and population deviation of each channel; use output mode complete or update."""
    pairs = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels))
    values = rows.select(F.explode(pairs).alias("p")).select("p.channel", "p.v")
    return values.groupBy("channel").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there into a table in memory, for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, target: str, checkpoint: str, spark: SparkSession | None = None, by: str | None = None) -> DataFrame:
    """Runs the stream over what is there into Parquet files, in a folder for each value of `by` if it is given, and gives
    them back as a table of `spark` (the stream's session by default); nothing passes the driver."""
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.partitionBy(by) if by else writer).start()
    query.awaitTermination()
    return (spark or stream.sparkSession).read.schema(stream.schema).parquet(target)
