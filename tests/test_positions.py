import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from kestrelflow.operators import normalize, windows
from kestrelflow.sources import sinks
from kestrelflow.sources.positions import Positions, ordered_digest


def test_places_of_groups_over_several_files(spark, tmp_path):
    rows = [(f"g{i % 3}" if i % 7 else None, i * 37 % 101, i) for i in range(101)]
    frame = spark.createDataFrame(rows, "g string, k int, v int")
    held = Positions.build(frame.repartition(5), ["k"], str(tmp_path / "p"), "g", files=6)
    assert len([d for d in os.listdir(tmp_path / "p" / "rows") if d.startswith("_file")]) > 1
    wanted = {g: [r for r in sorted(rows, key=lambda r: r[1]) if r[0] == g] for g in ("g0", "g1", "g2", None)}
    for g, own in wanted.items():
        for place in (0, 1, len(own) // 2, len(own) - 1):
            assert [tuple(r) for r in held.at(place, g).collect()] == [own[place]]
        assert held.at(len(own), g).count() == 0 and held.at(-1, g).count() == 0
    assert sorted((str(r.g), r.place, r.v) for r in held.placed().collect()) == sorted((str(g), i, r[2]) for g, own in wanted.items() for i, r in enumerate(own))
    read = held.at(3, "g1")
    assert len({r[0] for r in read.select(F.input_file_name()).collect()}) == 1 and "PartitionFilters: [isnotnull(_file" in read._jdf.queryExecution().executedPlan().toString()
    assert Positions.build(frame.limit(0), ["k"], str(tmp_path / "none")).at(0).count() == 0


def tree(texts, fan):
    level = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    while level and (len(level) > 1 or len(level) == len(texts)):
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(texts) == 1:
            break
    return level[0] if level else hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 40])
def test_digest_is_the_same_however_rows_lie(spark, tmp_path, n):
    rows = spark.createDataFrame([(i, f"line {i}") for i in range(n)], "i int, t string")
    got = {ordered_digest(rows.repartition(p), ["i"], F.col("t"), str(tmp_path), 4, files).first() for p, files in ((1, 1), (3, 4), (7, 2))}
    assert got == {(n, tree([f"line {i}" for i in range(n)], 4))}
    if n > 2:
        other = rows.withColumn("t", F.when(F.col("i") == 1, "x").otherwise(F.col("t")))
        assert ordered_digest(other, ["i"], F.col("t"), str(tmp_path), 4).first()["digest"] != next(iter(got))["digest"]


def test_digest_of_so_many_levels(spark, tmp_path):
    """As the SQL of ordered_lines_digest has it: two levels, and the greatest of the second."""
    rows = spark.range(40).select("id", F.concat(F.lit("line "), "id").alias("t"))
    one = [hashlib.sha256("".join(hashlib.sha256(f"line {i}".encode()).hexdigest() for i in range(k, k + 4)).encode()).hexdigest() for k in range(0, 40, 4)]
    two = [hashlib.sha256("".join(one[k : k + 4]).encode()).hexdigest() for k in range(0, 10, 4)]
    assert ordered_digest(rows, ["id"], F.col("t"), str(tmp_path), 4, levels=2).first() == (40, max(two))
    assert ordered_digest(rows, ["id"], F.col("t"), str(tmp_path), 4, levels=9).first() == ordered_digest(rows, ["id"], F.col("t"), str(tmp_path), 4).first()


CHANNELS = ("sensor_2",)


def some_windows(spark, bad=None):
    rows = spark.createDataFrame([(u, c, float(c), "train" if u < 3 else "test") for u in (1, 2, 3) for c in range(1, 8)], "unit int, cycle int, sensor_2 double, split string")
    if bad is not None:
        rows = rows.withColumn("sensor_2", F.when(F.col("cycle") == 2, bad).otherwise(F.col("sensor_2")))
    return windows.strided_windows(rows, CHANNELS, 3, 2).withColumn("status", F.lit("CRITICAL"))


def test_checks_and_counts_are_made_by_the_job_that_writes(spark, tmp_path):
    target, raw = str(tmp_path / "w"), tmp_path / "raw.txt"
    raw.write_text("a\nb\n")
    digest = lambda: ordered_digest(spark.read.text(str(raw)).withColumn("i", F.monotonically_increasing_id()), ["i"], F.col("value"), str(tmp_path / "s")).first()["digest"]
    frame = some_windows(spark)
    made = sinks.write_windows(frame, CHANNELS, target, "parquet", digest)
    assert made["rows"] == frame.count() == 9 and made["status_counts"] == {"train": {"CRITICAL": 6}, "test": {"CRITICAL": 3}} and made["source_sha256"] == digest()
    with pytest.raises(ValueError, match="isn't finite"):
        sinks.write_windows(some_windows(spark, float("inf")), CHANNELS, target, "parquet")

    said = []

    def altered():
        said.append(digest())
        raw.write_text("a\nB\n")  # someone edits the file while windows are written
        return said[-1]

    with pytest.raises(ValueError, match="has changed"):
        sinks.write_windows(frame.limit(1), CHANNELS, target, "parquet", altered)
    assert spark.read.parquet(target).count() == 9 and not [n for n in os.listdir(tmp_path) if "staging" in n or "old" in n]


def test_a_document_is_never_missing(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "d.json")
    sinks.write_json(spark, {"a": 1}, target)

    def fails(spark, source, target):
        assert json.loads((tmp_path / "d.json").read_text()) == {"a": 1}  # still there just before the new one takes its place
        raise OSError("no")

    with monkeypatch.context() as m:
        m.setattr(sinks, "replace", fails)
        with pytest.raises(OSError):
            sinks.write_json(spark, {"a": 2}, target)
    assert sinks.read_json(spark, target) == {"a": 1} and [n for n in os.listdir(tmp_path) if "staging" in n] == []
    sinks.write_json(spark, {"a": 3}, target)
    assert sinks.read_json(spark, target) == {"a": 3}


def test_statistics_are_saved_and_checked_when_loaded(spark, tmp_path):
    w, target, a, b = some_windows(spark), str(tmp_path / "stats.json"), "a" * 64, "b" * 64
    fitted = normalize.fit_on_windows(w, CHANNELS)
    sinks.save_statistics(spark, fitted, CHANNELS, 3, a, b, w, target)
    load = lambda channels=CHANNELS, size=3, one=a, two=b, units=w: sinks.load_statistics(spark, target, channels, size, one, two, units)
    assert load().collect() == fitted.collect()
    for bad in (lambda: load(("sensor_9",)), lambda: load(size=4), lambda: load(one=b), lambda: load(units=w.where("unit > 1"))):
        with pytest.raises(ValueError):
            bad()
    whole = sinks.read_json(spark, target)
    for change in ({"scales": [0.0]}, {"means": []}, {"schema_version": 2}, {"dataset_sha256": "A" * 64}, {"samples": [0]}):
        sinks.write_json(spark, whole | change, target)
        with pytest.raises(ValueError):
            load()
    with pytest.raises(ValueError):
        sinks.save_statistics(spark, fitted.withColumn("scale", F.lit(-1.0)), CHANNELS, 3, a, b, w, target)
