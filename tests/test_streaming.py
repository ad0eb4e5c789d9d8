import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kestrelflow.operators import windows
from kestrelflow.sources import raw_text
from kestrelflow.sources.telemetry import telemetry
from kestrelflow.streaming import strict
from kestrelflow.streaming import windows as streaming


@pytest.fixture(scope="module")
def own(spark):
    return streaming.streaming_session(spark)


def test_the_callers_session_keeps_its_settings(spark, own):
    assert "RocksDB" in own.conf.get(streaming.STATE_STORE[0]) and spark.conf.get(streaming.STATE_STORE[0], "") != own.conf.get(streaming.STATE_STORE[0])


def files_of(spark, place, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(place)


def test_stream_gives_the_batch_windows(spark, own, sf_dir, tmp_path):
    rows = windows.with_life(telemetry(spark, sf_dir)).withColumn("ended", F.col("cycle") == F.col("life"))
    rows = rows.select("unit", "cycle", "sensor_4", "sensor_9", "ended").where("unit < 5")
    # Several files, read one a batch, with cycles out of order across them.
    for part in (1, 0, 2):
        rows.where(F.pmod(F.col("cycle") * 7 + F.col("unit"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streaming.run_to_table(streaming.stream_windows(stream, ["sensor_4", "sensor_9"]), "batches", str(tmp_path / "a"))
    wanted = windows.strided_windows(telemetry(spark, sf_dir).where("unit < 5"), ["sensor_4", "sensor_9"])
    key = lambda r, a, b: (r.unit, r.cycle, tuple(a), tuple(b))
    assert sorted(key(r, r.sensor_4, r.sensor_9) for r in out.collect()) == sorted(key(r, r.series.sensor_4, r.series.sensor_9) for r in wanted.collect())
    whole = own.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert streaming.run_to_table(streaming.stream_gaps(whole), "gaps", str(tmp_path / "b")).count() == 0
    moments = {r.channel: r for r in streaming.run_to_table(streaming.stream_moments(stream, ["sensor_4"]), "moments", str(tmp_path / "c"), "complete").collect()}
    n, mean, deviation = rows.agg(F.count("*"), F.avg("sensor_4"), F.stddev_pop("sensor_4")).first()
    assert (moments["sensor_4"].n, moments["sensor_4"].mean, moments["sensor_4"].deviation) == pytest.approx((n, mean, deviation))


SCHEMA = "unit int, cycle int, x double, ended boolean"


def test_rows_again_and_after_the_end_come_apart(spark, own, tmp_path):
    row = lambda c, ended=False: (1, c, float(c), ended)
    files_of(spark, str(tmp_path / "in"), [[row(2), row(5)], [row(1), row(2), row(5)], [row(3), row(4, True), row(9)], [row(6), row(4)]], SCHEMA)
    stream = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.kind, r.cycle, tuple(r.x)) for r in streaming.run_to_table(streaming.stream_rows(stream, ["x"], 3, 2), "apart", str(tmp_path / "s")).collect())
    late = [("late", c, (float(c),)) for c in (2, 4, 5, 5, 6, 9)]
    assert got == sorted([("window", 3, (1.0, 2.0, 3.0)), ("window", 4, (2.0, 3.0, 4.0)), *late])


def test_units_that_never_end_are_given_up(spark, own, tmp_path):
    rows = [[(1, 1, 1.0, False), (1, 2, 2.0, False), (1, 9, 9.0, False)], *([(2, i, float(i), False)] for i in range(1, 4))]
    files_of(spark, str(tmp_path / "in"), rows, SCHEMA)
    stream = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = streaming.stream_rows(stream, ["x"], 2, 1, idle_ms=1).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "s"))
    query = writer.trigger(processingTime="1 second").start()
    for _ in range(60):
        query.awaitTermination(1)
        out = own.table("idle").collect()
        if any(r.kind == "waiting" for r in out):
            break
    query.stop()
    assert [(r.cycle, r.x) for r in out if r.kind == "waiting"] == [(9, [9.0])] and [(r.cycle, r.x) for r in out if r.kind == "window" and r.unit == 1] == [(2, [1.0, 2.0])]


def test_a_batch_costs_what_arrives_not_what_waits():
    """State calls of a batch are as many with 5 rows waiting as with 5000."""

    class State:
        def __init__(self):
            self.held, self.calls = {}, 0

        def exists(self):
            self.calls += 1
            return bool(self.held)

        def get(self):
            self.calls += 1
            return self.held.get("v")

        def update(self, v):
            self.calls += 1
            self.held["v"] = v

        put = update

        def containsKey(self, k):
            self.calls += 1
            return k in self.held

        def getValue(self, k):
            self.calls += 1
            return self.held[k]

        def updateValue(self, k, v):
            self.calls += 1
            self.held[k] = v

        def removeKey(self, k):
            self.calls += 1
            del self.held[k]

        def iterator(self):
            raise AssertionError("all waiting rows are read")

    def calls(waiting):
        states = [State() for _ in range(4)]

        class Handle:
            getValueState = lambda self, name, schema: states[0 if name == "following" else 3]
            getListState = lambda self, name, schema: states[1]
            getMapState = lambda self, name, key, value: states[2]

        buffer = streaming.WindowBuffer(["x"], 3, 1)
        buffer.init(Handle())
        frame = lambda cycles: iter([pd.DataFrame([(1, c, float(c), False) for c in cycles], columns=["unit", "cycle", "x", "ended"])])
        list(buffer.handleInputRows((1,), frame(range(100, 100 + waiting)), None))
        before = sum(s.calls for s in states)
        out = list(buffer.handleInputRows((1,), frame([1, 2, 3]), None))[0]
        assert out["cycle"].tolist() == [3]
        return sum(s.calls for s in states) - before

    assert calls(5) == calls(5000) < 20


def broken_lines(cuts):
    rng = random.Random(6)
    lines = []
    for source in range(3):
        n = 0
        for unit in (2, 3, 7):
            for cycle in range(1, 9):
                fields = [str(unit), str(cycle), "0", "0", "100", *("1.5" for _ in range(21))]
                fate = rng.random()
                if fate < 0.1:
                    fields[rng.randrange(2, 26)] = rng.choice(["bad", "nan", "inf"])
                elif fate < 0.15:
                    fields.pop()
                elif fate < 0.2:
                    fields[0] = rng.choice(["1.5", "101", "1"])
                elif fate < 0.25:
                    continue
                lines.append((f"f{source}", n, " ".join(fields)))
                n += 1
                if fate > 0.95:
                    lines.append((f"f{source}", n, "  "))
                    n += 1
    parts = [[] for _ in range(cuts)]
    for x in lines:
        parts[min(cuts - 1, x[1] * cuts // 24)].append(x)
    return lines, parts


def brute(lines):
    last, out = {}, []
    for source, n, value in lines:
        f = value.split()
        if not f:
            continue
        rule = None
        if len(f) != 26:
            rule = "width"
        elif "bad" in f:
            rule = "number"
        elif "nan" in f or "inf" in f:
            rule = "finite"
        elif "." in f[0]:
            rule = "whole"
        elif int(f[0]) > 100:
            rule = "range"
        else:
            unit, cycle = int(f[0]), int(f[1])
            before = last.get(source, (0, 0))
            rule = "order" if unit < before[0] else "sequence" if cycle != (before[1] + 1 if unit == before[0] else 1) else None
            last[source] = (unit, cycle)
        out.append((source, n, rule))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cuts", [1, 4])
def test_strict_lines_after_any_cut_into_batches(spark, own, tmp_path, cuts):
    lines, parts = broken_lines(cuts)
    schema = "source string, line long, value string"
    files_of(spark, str(tmp_path / "in"), parts, schema)
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streaming.run_to_files(strict.strict_lines(stream), str(tmp_path / "out"), str(tmp_path / "s"), spark, by="broken")
    assert sorted(((r.source, r.line, r.rule) for r in out.collect()), key=repr) == brute(lines)
    good = raw_text.parse_lines(out.where("not broken"))
    assert good.count() == sum(r is None for *_, r in brute(lines)) and good.where("sensor_21 <> 1.5").count() == 0


def test_text_files_as_they_appear(spark, own, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(["1 1 " + "0 " * 24, "", "1 3 " + "0 " * 24, "x"]))
    out = streaming.run_to_files(strict.strict_lines(strict.text_stream(own, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "s"), spark, by="broken")
    assert sorted((r.line, r.rule) for r in out.where("broken").collect()) == [(2, "sequence"), (2, "sequence"), (3, "width"), (3, "width")]
    assert out.where("not broken").count() == 2


def test_rows_in_order_ask_no_map_of_waiting_rows():
    """What a batch costs: a few questions to the state store for a unit, however many rows it has."""
    asked = []

    class State:
        def __getattr__(self, name):
            def call(*_):
                asked.append(name)
                return name == "containsKey" and pytest.fail("asked for a row") or False

            return call

    class Handle:
        getValueState = getListState = getMapState = lambda self, *_: State()

    buffer = streaming.WindowBuffer(["a"], 3, 2)
    buffer.init(Handle())
    rows = pd.DataFrame({"unit": 5, "cycle": range(1, 1001), "a": [float(i) for i in range(1, 1001)], "ended": [False] * 999 + [True]})
    (out,) = buffer.handleInputRows((5,), iter([rows]), None)
    assert out["cycle"].tolist() == [*range(3, 1000, 2), 1000] and [list(x) for x in out["a"].tail(2)] == [[997.0, 998.0, 999.0], [998.0, 999.0, 1000.0]]
    assert len(asked) < 10
