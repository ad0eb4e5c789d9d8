import math

import pytest
from pyspark.ml.regression import LinearRegressionModel

from kestrelflow.operators import models, validate
from kestrelflow.sources import sinks


def test_records(spark):
    nan = float("nan")
    rows = [("a", "train", 1.0, "t", ([1.0, 2.0],)), ("b", "train", nan, "t", ([1.0],)), ("c", "test", 1.0, None, ([1.0, nan],)), ("a", "train", 1e39, " \n", (None,)), (None, "train", -1.0, "t", ([1e39, 1.0],))]
    w = spark.createDataFrame(rows, "record_id string, split string, rul double, target string, series struct<x: array<double>>")
    got = sorted(((r.record_id or "", r.rule) for r in validate.window_violations(w, ["x"], 2).collect()))
    assert got == sorted([("b", "rul"), ("b", "shape"), ("c", "target"), ("c", "finite"), ("a", "rul"), ("a", "target"), ("a", "shape"), ("", "rul"), ("", "finite"), ("a", "copy"), ("", "copy")])
    with pytest.raises(ValueError):
        validate.window_violations(w, ["x"], True)


def test_headers_and_needs(spark):
    header = lambda *r: spark.createDataFrame([r], "schema_version int, channels array<string>, window_size int, dataset_sha256 string, training_sha256 string")
    a, b = "a" * 64, "b" * 64
    rules = lambda *r: sorted(x.rule for x in validate.header_violations(header(*r), ["x"], 2, a, b).collect())
    assert rules(1, ["x"], 2, a, b) == []
    assert rules(2, ["y"], 3, "A" * 64, b) == ["channels", "data", "digest", "size", "version"]
    assert rules(None, ["x"], 2, a, a) == ["data", "version"]
    with pytest.raises(ValueError):
        validate.need_statistics("test", None)
    validate.need_statistics("train", None)
    with pytest.raises(ValueError):
        validate.need_rows(spark.range(0), "test")


def test_changed_files(spark, tmp_path):
    place = str(tmp_path / "t")
    spark.range(3).coalesce(1).write.parquet(place)
    before = validate.file_states(spark.read.parquet(place)).checkpoint()
    assert validate.changed_files(before, validate.file_states(spark.read.parquet(place))).count() == 0
    spark.range(3).coalesce(1).write.mode("append").parquet(place)
    assert validate.changed_files(before, validate.file_states(spark.read.parquet(place))).count() == 1


def test_bundles(spark, tmp_path):
    frame = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    model, root = models.fit_ridge(frame, ["x"], "y", 0.0), str(tmp_path / "bundle")
    sinks.save_bundle(model, {"version": 1, "features": ["x"]}, root)
    back, manifest = sinks.load_bundle(LinearRegressionModel.load, root, 1, ["x"])
    assert math.isclose(back.coefficients[0], 2) and manifest["version"] == 1
    for version, features in ((2, ["x"]), (1, ["y"])):
        with pytest.raises(ValueError):
            sinks.load_bundle(LinearRegressionModel.load, root, version, features)
    (tmp_path / "bundle" / "manifest.json").unlink()
    with pytest.raises(ValueError):
        sinks.load_bundle(LinearRegressionModel.load, root, 1, ["x"])
