"""Sinks that publish whole results or nothing: written beside the target, then renamed by Hadoop's file system."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kestrelflow.functions.numbers import is_finite
from kestrelflow.operators.normalize import stats_violations
from kestrelflow.operators.validate import header_violations


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Renames source to target, over what is there: the old file stays until the new one is in its place."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(target).toUri(), conf).rename(at(source), at(target), options)


def publish(spark: SparkSession, target: str, write: Callable[[str], None]) -> None:
    """Calls write with a staging path next to the target and, if it succeeds, puts that in the target's place.

    A write that raises leaves what was there. The old table is put back if the new one can't be renamed.
    """
    files, at = _files(spark, target)
    staging, old = f"{target}.staging-{uuid.uuid4().hex}", f"{target}.old-{uuid.uuid4().hex}"
    try:
        write(staging)
    except Exception:
        files.delete(at(staging), True)
        raise
    there = files.exists(at(target))
    if there and not files.rename(at(target), at(old)):
        raise OSError(f"{target} can't be replaced")
    if not files.rename(at(staging), at(target)):
        if there:
            files.rename(at(old), at(target))
        raise OSError(f"{target} can't be written")
    files.delete(at(old), True)


def bad_values(windows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(unit, cycle) of windows with a value that isn't finite."""
    bad = [F.exists(F.col("series")[c], lambda x: x.isNull() | ~is_finite(x)) for c in channels]
    return windows.where(F.array_contains(F.array(*bad), True)).select("unit", "cycle")


STATUSES, SPLITS = ("CRITICAL", "WARNING", "NORMAL"), ("train", "validation", "test")


def write_windows(windows: DataFrame, channels: Sequence[str], target: str, form: str = "json", source: Callable[[], str] | None = None) -> dict:
    """Window records, whole units to a file and in order of unit and cycle there, and what the manifest counts of them.

    Values are checked and counts are made by the job that writes; nothing is published, and what was
    there stays, if a value isn't finite, or if `source`, which gives a digest of the raw input, gives
    another one after the write than before. Counts are by split and status, where there are such columns.
    """
    seen = Observation()
    bad = [F.exists(F.col("series")[c], lambda x: x.isNull() | ~is_finite(x)) for c in channels]
    kinds = [(s, k) for s in SPLITS for k in STATUSES] if {"split", "status"} <= set(windows.columns) else []
    counts = [F.count_if((F.col("split") == s) & (F.col("status") == k)).alias(f"{s}/{k}") for s, k in kinds]
    ordered = windows.repartition("unit").sortWithinPartitions("unit", "cycle")  # by hash: ranges would be sampled, and windows made twice
    watched = ordered.observe(seen, F.count("*").alias("rows"), F.count_if(F.array_contains(F.array(*bad), True)).alias("bad"), *counts)
    before = source() if source else None

    def write(place: str) -> None:
        watched.write.format(form).option("ignoreNullFields", "false").save(place)
        if seen.get["bad"]:
            raise ValueError(f"{seen.get['bad']} windows have a value that isn't finite")
        if source and source() != before:
            raise ValueError("the raw input has changed during the run")

    publish(windows.sparkSession, target, write)
    by: dict = {}
    for s, k in kinds:
        if seen.get[f"{s}/{k}"]:
            by.setdefault(s, {})[k] = seen.get[f"{s}/{k}"]
    return {"rows": seen.get["rows"], "source_sha256": before, "window_counts": {s: sum(x.values()) for s, x in by.items()}, "status_counts": by}


def write_by_split(windows: DataFrame, target: str) -> None:
    """A Parquet table by split, so that a reader of one split lists only its files."""
    publish(windows.sparkSession, target, lambda p: windows.write.partitionBy("split").parquet(p))


def write_registry(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Several tables under root/version, published together."""
    spark = next(iter(tables.values())).sparkSession

    def write(path: str) -> None:
        for name, frame in tables.items():
            frame.write.parquet(f"{path}/{name}")

    publish(spark, f"{root}/{version}", write)
    return f"{root}/{version}"


def write_json(spark: SparkSession, document: dict, target: str) -> None:
    """A JSON document as one file, which takes the place of an older one in one step."""
    text = json.dumps(document, indent=2, sort_keys=True, allow_nan=False).encode()
    files, at = _files(spark, target)
    staging = f"{target}.staging-{uuid.uuid4().hex}"
    try:
        out = files.create(at(staging))
        out.write(bytearray(text))
        out.close()
        replace(spark, staging, target)
    except Exception:
        files.delete(at(staging), False)
        raise


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def save_statistics(spark: SparkSession, stats: DataFrame, channels: Sequence[str], size: int, dataset_sha256: str, training_sha256: str, units: DataFrame, target: str) -> dict:
    """Normalisation statistics, a row per channel, as a JSON document with what they were made of; raises ValueError if they can't be used."""
    wrong = stats_violations(stats).limit(1).collect()
    by = {r["channel"]: r for r in stats.collect()}
    if wrong or set(by) != set(channels):
        raise ValueError(f"statistics can't be saved: {wrong[0].asDict() if wrong else sorted(set(by) ^ set(channels))}")
    document = {
        "schema_version": 1, "channels": list(channels), "window_size": size, "means": [by[c]["mean"] for c in channels], "scales": [by[c]["scale"] for c in channels],
        "samples": [by[c]["samples"] for c in channels], "dataset_sha256": dataset_sha256, "training_sha256": training_sha256,
        "training_units": sorted(r["unit"] for r in units.where("split = 'train'").select("unit").distinct().collect()),
    }
    write_json(spark, document, target)
    return document


def load_statistics(spark: SparkSession, path: str, channels: Sequence[str], size: int, dataset_sha256: str, training_sha256: str, units: DataFrame | None = None) -> DataFrame:
    """(channel, mean, scale, samples) of a saved document, or ValueError if it isn't whole, breaks a rule, or is of other channels, windows or data.

    `units` (unit, split) tells whether all units that it was fitted on are training units.
    """
    d = read_json(spark, path)
    lists = ("channels", "means", "scales", "samples")
    if any(not isinstance(d.get(k), list) or len(d[k]) != len(channels) for k in lists) or len(set(d["channels"])) != len(channels):
        raise ValueError("the statistics aren't whole")
    kind = "schema_version int, channels array<string>, window_size int, dataset_sha256 string, training_sha256 string"
    header = spark.createDataFrame([tuple(d.get(f.split()[0]) for f in kind.split(", "))], kind)
    rows = [(c, float(m), float(s), int(n)) for c, m, s, n in zip(*(d[k] for k in lists), strict=True)]
    stats = spark.createDataFrame(rows, "channel string, mean double, scale double, samples long")
    wrong = [r["rule"] for r in header_violations(header, channels, size, dataset_sha256, training_sha256).collect()]
    wrong += [f"{r['channel']}: {r['rule']}" for r in stats_violations(stats).collect()]
    if units is not None:
        fitted = spark.createDataFrame([(u,) for u in d.get("training_units") or []], units.select("unit").schema)
        wrong += ["units outside training"] if not fitted.join(units.where("split = 'train'"), "unit", "left_anti").isEmpty() else []
    if wrong:
        raise ValueError(f"the statistics can't be used: {', '.join(wrong)}")
    return stats


def predictions_json(rows: DataFrame, models: list[str]) -> DataFrame:
    """(unit, cycle, line): a JSON line per window with its truth and predictions, failed ones null."""
    value = lambda m: F.when(is_finite(F.col(m)), F.col(m)).alias(m)
    line = F.to_json(F.struct("unit", "cycle", "truth", F.struct(*map(value, models)).alias("predictions")), {"ignoreNullFields": "false"})
    return rows.select("unit", "cycle", line.alias("line"))


def manifest(windows: DataFrame, source_sha256: str, size: int, stride: int) -> dict:
    """Counts by split and status, in one pass, with what the windows were made of."""
    counts = windows.groupBy("split", "status").agg(F.count("*").alias("n")).collect()
    by: dict = {}
    for r in counts:
        by.setdefault(r["split"], {})[r["status"]] = r["n"]
    return {
        "schema_version": 1, "source": {"sha256": source_sha256}, "window": {"size": size, "stride": stride}, "rul_cap": None,
        "window_counts": {s: sum(x.values()) for s, x in by.items()}, "status_counts": by,
    }


def markdown_table(rows: DataFrame, columns: Sequence[str]) -> str:
    """A report of few rows, such as candidates or scores, as Markdown."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows.select(*columns).collect())])


def save_bundle(model, manifest: dict, root: str) -> None:
    """A fitted model with its manifest, which goes first and is written last: a bundle without one isn't whole."""
    spark = SparkSession.getActiveSession()
    files, at = _files(spark, root)
    files.delete(at(f"{root}/manifest.json"), False)
    model.write().overwrite().save(f"{root}/model")
    write_json(spark, manifest, f"{root}/manifest.json")


def load_bundle(load: Callable, root: str, version: int, features: Sequence[str]):
    """(model, manifest) of a whole bundle made for this version and these features, or ValueError."""
    spark = SparkSession.getActiveSession()
    files, at = _files(spark, root)
    for part in ("manifest.json", "model"):
        if not files.exists(at(f"{root}/{part}")):
            raise ValueError(f"the bundle lacks {part}")
    text = spark.read.text(f"{root}/manifest.json", wholetext=True).first()["value"]
    manifest = json.loads(text)
    if manifest.get("version") != version or manifest.get("features") != list(features):
        raise ValueError("the bundle is of another version or other features")
    return load(f"{root}/model"), manifest
