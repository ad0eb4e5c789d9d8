import io
import json
import os

import pytest
from pyspark.sql import functions as F

from kestrelflow.operators import labels, windows
from kestrelflow.sources import files, raw_text, sinks

CHANNELS = ("sensor_2", "sensor_3")


def fleet_lines(units=100, cycles=8):
    return [
        " ".join([str(u), str(c), "0", "0", "100", *(str(float(c + i)) for i in range(21))]) for u in range(1, units + 1) for c in range(1, cycles + 1)
    ]


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_a_whole_fleet(spark, tmp_path):
    rows = raw_text.read_strict(spark, write(tmp_path / "raw.txt", ["", *fleet_lines(), "   "]))
    w = windows.strided_windows(rows, CHANNELS, 3, 3)
    one = w.where("unit = 1").orderBy("cycle").collect()
    assert [(r.cycle, r.rul, r.window_start) for r in one] == [(3, 5, 1), (6, 2, 4), (8, 0, 6)]
    assert one[-1].series.sensor_2 == [7.0, 8.0, 9.0] and w.count() == 300
    whole = windows.strided_windows(rows, CHANNELS, 8, 3)
    assert whole.count() == 100 and whole.where("rul <> 0").count() == 0
    assert windows.strided_windows(rows, CHANNELS, 9, 3).count() == 0


@pytest.mark.parametrize(
    "change", ["empty", "3 fields", "nan", "inf", "bad", "copy", "gap", "descending", "unit 101", "unit 1.5", "cycle 0", "missing unit"]
)
def test_broken_files(spark, tmp_path, change):
    lines = fleet_lines()
    first = lines[0].split()
    replace = lambda i, v: " ".join([*first[:i], v, *first[i + 1 :]])
    lines = {
        "empty": [], "3 fields": ["1 2 3", *lines[1:]], "nan": [replace(9, "nan"), *lines[1:]], "inf": [replace(9, "inf"), *lines[1:]],
        "bad": [replace(9, "bad"), *lines[1:]], "copy": [lines[0], *lines], "gap": [lines[0], *lines[2:]], "descending": [*lines[8:16], *lines[:8], *lines[16:]],
        "unit 101": [*lines, *(x.replace("100 ", "101 ", 1) for x in lines[-8:])], "unit 1.5": [replace(0, "1.5"), *lines[1:]],
        "cycle 0": [replace(1, "0"), *lines], "missing unit": lines[8:],
    }[change]
    with pytest.raises(raw_text.InvalidTelemetry):
        raw_text.read_strict(spark, write(tmp_path / "raw.txt", lines))


@pytest.mark.parametrize("size,stride", [(0, 5), (3, 0), (-1, 1), (3, -1), (True, 1), (3.0, 1)])
def test_bad_window_arguments(spark, size, stride):
    rows = spark.createDataFrame([(1, 1, 1.0)], "unit int, cycle int, sensor_2 double")
    with pytest.raises(ValueError):
        windows.strided_windows(rows, ["sensor_2"], size, stride)


def records(spark, bad=None):
    rows = spark.createDataFrame([(u, c, float(c), 7.0, "train") for u in (1, 2) for c in range(1, 6)], "unit int, cycle int, sensor_2 double, sensor_3 double, split string")
    if bad is not None:
        rows = rows.withColumn("sensor_2", F.when(F.col("cycle") == 2, bad).otherwise(F.col("sensor_2")))
    return windows.strided_windows(rows, CHANNELS, 3, 1).withColumn("status", labels.band(F.col("rul"))).withColumn("record_id", labels.record_id(F.col("unit"), F.col("cycle")))


def test_window_files_round_trip_and_survive_a_failure(spark, tmp_path):
    target, w = str(tmp_path / "windows"), records(spark)
    named = w.select("record_id", F.col("unit").alias("unit_number"), "unit", "cycle", "window_start", "split", "rul", "status", "series")
    sinks.write_windows(named, CHANNELS, target)
    back = files.read_windows(spark, target, CHANNELS)
    assert sorted((r.record_id, r.unit_number, r.rul, tuple(r.series.sensor_2)) for r in back.collect()) == sorted((r.record_id, r.unit, r.rul, tuple(r.series.sensor_2)) for r in w.collect())
    with pytest.raises(ValueError):
        sinks.write_windows(records(spark, float("nan")), CHANNELS, target)
    with pytest.raises(RuntimeError):
        sinks.publish(spark, target, lambda p: (_ for _ in ()).throw(RuntimeError("no")))
    assert back.count() == 6 and sorted(os.listdir(tmp_path)) == ["windows"]
    sinks.write_windows(named.limit(2), CHANNELS, target)
    assert files.read_windows(spark, target, CHANNELS).count() == 2
    spark.dataSource.register(files.WindowLines)
    parts = ",".join(str(p) for p in (tmp_path / "windows").glob("part-*.json"))
    assert spark.read.format("window_lines").option("path", parts).load().where("size(series) = 2").count() == 2


def test_registry_split_table_manifest_and_json(spark, tmp_path):
    w = records(spark)
    place = sinks.write_registry({"records": w.select("record_id"), "windows": w}, str(tmp_path / "registry"), "1.0.0")
    assert spark.read.parquet(f"{place}/windows").count() == 6
    sinks.write_by_split(w, str(tmp_path / "by_split"))
    assert os.path.isdir(tmp_path / "by_split" / "split=train")
    m = sinks.manifest(w, "0" * 64, 3, 1)
    assert m["window_counts"] == {"train": 6} and m["status_counts"] == {"train": {"CRITICAL": 6}} and m["rul_cap"] is None
    sinks.write_json(spark, m, str(tmp_path / "manifest.json"))
    sinks.write_json(spark, m, str(tmp_path / "manifest.json"))
    assert json.loads((tmp_path / "manifest.json").read_text()) == m
    with pytest.raises(ValueError):
        sinks.write_json(spark, {"x": float("nan")}, str(tmp_path / "manifest.json"))
    assert "| 6 |" in sinks.markdown_table(w.groupBy("split").agg(F.count("*").alias("n")), ["split", "n"])


def test_digest_does_not_depend_on_order(spark):
    w = records(spark)
    a, b = files.rows_digest(w).first(), files.rows_digest(w.repartition(7)).first()
    assert a == b and a.rows == 6 and a != files.rows_digest(w.limit(5)).first()


def test_mirrors(tmp_path):
    asked = []

    def fetch(url, timeout):
        asked.append(url)
        if "down" in url:
            raise OSError("down")
        return io.BytesIO(b"bad" if "bad" in url else b"good")

    def check(path):
        if open(path, "rb").read() != b"good":
            raise ValueError("not valid")

    target = str(tmp_path / "raw.txt")
    receipt = files.acquire(["http://down", "http://bad", "http://fine"], target, check, fetch)
    assert receipt["url"] == "http://fine" and receipt["sha256"] == files.file_sha256(target) and sorted(os.listdir(tmp_path)) == ["raw.txt", "raw.txt.receipt.json"]
    assert files.acquire(["http://down"], target, check, fetch)["url"] is None and len(asked) == 3
    os.remove(target)
    with pytest.raises(OSError):
        files.acquire(["http://down", "http://bad"], target, check, fetch)
    assert not os.path.exists(target)


def test_datasets_candidates_and_lookup(spark, tmp_path):
    known = files.Datasets()
    known.register("fleet", "1.0", lambda s: s.range(3))
    assert known.knows("fleet") and not known.knows("x") and known.version("fleet") == "1.0" and known.build(spark, "fleet").count() == 3
    with pytest.raises(KeyError):
        known.build(spark, "x")
    spark.range(4).write.parquet(str(tmp_path / "there"))
    assert known.first_available(spark, [str(tmp_path / "no"), str(tmp_path / "there")]).count() == 4
    with pytest.raises(FileNotFoundError):
        known.first_available(spark, [str(tmp_path / "no")])
    assert files.chosen_candidate(files.candidates(spark))["dataset"] == "turbofan-fleet-1"
    with pytest.raises(ValueError):
        files.chosen_candidate(files.candidates(spark).where("not chosen"))
    w = records(spark)
    assert files.lookup(w, 2, 4)["rul"] == 1
    with pytest.raises(KeyError):
        files.lookup(w, 2, 99)
    assert [files.record_at(w, "train", i).first()["cycle"] for i in range(6)] == [3, 4, 5, 3, 4, 5]
    hashes = files.content_hashes(spark, str(tmp_path / "there" / "*.parquet")).collect()
    assert all(r.sha256 == files.file_sha256(r.path.removeprefix("file:")) for r in hashes)
    doc = tmp_path / "d.json"
    doc.write_text('{\n"a": 1,\n"b": [2.5]}')
    assert files.read_document(spark, str(doc), "a int, b array<double>").first() == (1, [2.5])
    assert files.describe(w.select("cycle")).count() == 5


def line(i, split="train", **more):
    return json.dumps({"record_id": f"r{i}", "unit_number": i, "cycle": 3, "split": split, "rul": 20 + i, "series": {"sensor_4": [1.0, 2.0, 5.5], "sensor_11": [2.0, 1.9, 1.5]}} | more)


def test_byte_ranges_of_a_file_make_its_lines_once(spark, tmp_path):
    spark.dataSource.register(files.WindowLines)
    (tmp_path / "in").mkdir()
    lines = [line(i, ("train", "test")[i % 2], prompt="é" * (i % 40)) for i in range(300)]
    (tmp_path / "in" / "a.json").write_text("\n".join([*lines[:200], "", "  "]) + "\n")
    (tmp_path / "in" / "b.json").write_text("\n".join(lines[200:]))  # without a last line feed
    (tmp_path / "in" / "_SUCCESS").write_text("")
    for block in (700, 4000, 1 << 20):
        read = spark.read.format("window_lines").option("path", f"file://{tmp_path}/in").option("block", block).load()
        assert sorted(r.record_id for r in read.select("record_id").collect()) == sorted(f"r{i}" for i in range(300))
    assert read.rdd.getNumPartitions() == 2 and spark.read.format("window_lines").option("path", str(tmp_path / "in")).option("block", 1000).load().rdd.getNumPartitions() > 20
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    some = spark.read.format("window_lines").option("path", str(tmp_path / "in")).option("push", True).load().where("split = 'test' and cycle = 3")
    assert some.count() == 150 and "= test" not in some._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_first_there_then_cache_then_built(spark, tmp_path):
    local, cache, made = str(tmp_path / "local"), str(tmp_path / "cache"), []

    def build(path):
        made.append(path)
        os.mkdir(path)
        (tmp_path / "cache" / "x.json").write_text("\n".join([line(1), line(2, "test")]))

    with pytest.raises(FileNotFoundError):
        files.window_records(spark, [local, cache], ["sensor_4"])
    assert files.window_records(spark, [local, cache], ["sensor_4"], build).count() == 2
    assert files.window_records(spark, [local, cache], ["sensor_4"], build, "test").first()["record_id"] == "r2" and made == [cache]
    os.mkdir(local)
    (tmp_path / "local" / "x.json").write_text(line(9))
    assert [r.record_id for r in files.window_records(spark, [local, cache], ["sensor_4"], build).collect()] == ["r9"]


def test_enrichment_from_file_to_file(spark, tmp_path):
    from kestrelflow.operators.enrich import enrich_file

    source, target = tmp_path / "in.json", str(tmp_path / "out")
    source.write_text("\n".join([line(1), "", line(2, "test"), line(60), line(3, rul=None)]))
    channels = ("sensor_4", "sensor_11")
    assert enrich_file(spark, str(source), target, channels) == 4
    got = {r.record_id: r for r in spark.read.json(target).collect()}
    assert (got["r1"].status, got["r60"].status, got["r2"].rul, got["r2"].withheld) == ("CRITICAL", "NORMAL", 22, True)
    assert got["r2"].status == got["r3"].status == "CRITICAL" and "About" not in got["r2"].diagnostics.assessment and got["r1"].diagnostics.assessment.endswith("About 21 cycles remain.")
    assert enrich_file(spark, str(source), target, channels, 2) == 1  # a blank line counts
    source.write_text(line(1) + "\n{broken")
    with pytest.raises(Exception, match="(?i)malformed"):
        enrich_file(spark, str(source), target, channels)
    assert spark.read.json(target).count() == 1
    with pytest.raises(ValueError):
        enrich_file(spark, target, target, channels)
