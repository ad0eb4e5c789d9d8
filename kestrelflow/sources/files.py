"""Window records as JSON lines and Parquet, a pluggable source, a catalog of datasets, acquisition of a file."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import urllib.request
from collections.abc import Callable, Sequence

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition


def window_schema(channels: Sequence[str]) -> str:
    series = ", ".join(f"{c}: array<double>" for c in channels)
    return (
        "schema_version int, record_id string, unit_number int, cycle int, window_start int, split string, rul int, status string, "
        f"series struct<{series}>, prompt string, target string, rationale string, "
        "label_provenance struct<rul: string, status: string, rationale: string, component_diagnosis: string, maintenance_action: string>"
    )


def read_windows(spark: SparkSession, path: str, channels: Sequence[str], strict: bool = True) -> DataFrame:
    """JSON lines by an explicit schema, blank lines skipped; `strict` raises on a line that isn't one."""
    return spark.read.schema(window_schema(channels)).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as one row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def record_at(rows: DataFrame, split: str, position: int) -> DataFrame:
    """The row at a place (from 0) of a split ordered by unit and cycle; Spark's tasks keep that many rows at most."""
    return rows.where(F.col("split") == split).orderBy("unit", "cycle").offset(position).limit(1)


def lookup(rows: DataFrame, unit: int, cycle: int) -> Row:
    """The record of a unit and cycle, or KeyError."""
    found = rows.where((F.col("unit") == unit) & (F.col("cycle") == cycle)).limit(1).collect()
    if not found:
        raise KeyError((unit, cycle))
    return found[0]


#: Bytes of a file that one partition reads.
BLOCK_BYTES = 64 << 20


class WindowLines(DataSource):
    """spark.read.format("window_lines"): window records of JSON line files, by ranges of bytes.

    `path` is one or more files or folders, split by commas: local paths or addresses of a store that
    Arrow opens (file, s3, gs, hdfs). A file of over `block` bytes is several partitions. With option
    `push` true, which needs spark.sql.python.filterPushdown.enabled, a filter on `split` is pushed
    down: lines of other splits aren't made rows.
    """

    @classmethod
    def name(cls) -> str:
        return "window_lines"

    def schema(self) -> str:
        return "record_id string, unit_number int, cycle int, split string, rul int, series map<string, array<double>>"

    def reader(self, schema):
        kind = _PushingReader if str(self.options.get("push", "")).lower() == "true" else _LinesReader
        return kind(self.options["path"].split(","), int(self.options.get("block", BLOCK_BYTES)))


def _place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if ":/" in path else (arrow_fs.LocalFileSystem(), os.path.abspath(path))


class _LinesReader(DataSourceReader):
    def __init__(self, paths: list[str], block: int):
        self.paths, self.block, self.split = paths, block, None

    def partitions(self):
        parts = []
        for path in self.paths:
            store, at = _place(path)
            info = store.get_file_info(at)
            if info.type == arrow_fs.FileType.NotFound:
                raise FileNotFoundError(path)
            held = store.get_file_info(arrow_fs.FileSelector(at)) if info.type == arrow_fs.FileType.Directory else [info]
            for f in sorted(held, key=lambda f: f.path):
                if f.is_file and not f.base_name.startswith(("_", ".")):
                    parts += [InputPartition((path, f.path, a, min(a + self.block, f.size))) for a in range(0, f.size, self.block)]
        return parts

    def read(self, partition):
        import io
        import json as codec

        path, at, start, end = partition.value
        with _place(path)[0].open_input_file(at) as raw:
            raw.seek(max(0, start - 1))
            lines = io.BufferedReader(raw, 1 << 20)
            place = start
            if start:  # a line belongs to the range it begins in
                place += len(lines.readline()) - 1
            while place < end and (line := lines.readline()):
                place += len(line)
                if line.strip():
                    r = codec.loads(line)
                    if self.split is None or r.get("split") == self.split:
                        yield r["record_id"], r["unit_number"], r["cycle"], r.get("split"), r.get("rul"), r["series"]


class _PushingReader(_LinesReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("split",) and self.split is None:
                self.split = f.value
            else:
                yield f


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has something there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def window_records(spark: SparkSession, candidates: Sequence[str], channels: Sequence[str], build: Callable[[str], None] | None = None, split: str | None = None) -> DataFrame:
    """Window records of the first candidate that is there, such as a local file, then a cache; else `build` makes the last one.

    Spark's own reader reads them, in splits, from any store it knows; a filter on `split` is pushed into it.
    """
    found = next((p for p in candidates if path_exists(spark, p)), None)
    if found is None:
        if build is None:
            raise FileNotFoundError("; ".join(candidates))
        found = candidates[-1]
        build(found)
    rows = read_windows(spark, found, channels)
    return rows if split is None else rows.where(F.col("split") == split)


class Datasets:
    """Readers by dataset id, with the version each declares."""

    def __init__(self):
        self._known: dict[str, tuple[str, Callable[[SparkSession], DataFrame]]] = {}

    def register(self, dataset: str, version: str, read: Callable[[SparkSession], DataFrame]) -> None:
        self._known[dataset] = (version, read)

    def knows(self, dataset: str) -> bool:
        return dataset in self._known

    def version(self, dataset: str) -> str:
        return self._known[dataset][0]

    def build(self, spark: SparkSession, dataset: str) -> DataFrame:
        if dataset not in self._known:
            raise KeyError(dataset)
        return self._known[dataset][1](spark)

    def first_available(self, spark: SparkSession, candidates: Sequence[str]) -> DataFrame:
        """The first candidate path that can be read: local, then cached, then built ones."""
        failed = []
        for path in candidates:
            try:
                frame = spark.read.parquet(path)
                frame.schema  # noqa: B018  reads the footer
                return frame
            except Exception as e:  # noqa: BLE001
                failed.append(f"{path}: {type(e).__name__}")
        raise FileNotFoundError("; ".join(failed))


def describe(frame: DataFrame) -> DataFrame:
    return frame.summary("count", "mean", "stddev", "min", "max")


#: Candidate datasets: id, domain, run to failure, telemetry, chosen.
CANDIDATES = (
    ("turbofan-fleet-1", "aerospace", True, "26 columns by cycle", True),
    ("bearing-vibration", "industry", True, "high-rate vibration", False),
    ("battery-cycles", "energy", True, "charge curves", False),
    ("pump-sensors", "industry", False, "52 sensors by minute", False),
)


def candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CANDIDATES), "dataset string, domain string, run_to_failure boolean, telemetry string, chosen boolean")


def first_chosen(frame: DataFrame) -> DataFrame:
    """The first chosen candidate by id, or no row."""
    return frame.where("chosen").orderBy("dataset").limit(1)


def chosen_candidate(frame: DataFrame) -> Row:
    """The first chosen candidate by id; an error without one."""
    found = first_chosen(frame).collect()
    if not found:
        raise ValueError("no dataset is chosen")
    return found[0]


def acquire(mirrors: Sequence[str], target: str, check: Callable[[str], None], fetch=urllib.request.urlopen, timeout: float = 30) -> dict:
    """Fetches a file to `target` from the first mirror whose content passes `check`; a file that passes stays as it is.

    The file shows up under its name only when whole and checked, with a receipt beside it.
    """
    if os.path.exists(target):
        check(target)
        return {"url": None, "sha256": file_sha256(target)}
    failed = []
    for url in mirrors:
        handle, part = tempfile.mkstemp(dir=os.path.dirname(target) or ".")
        try:
            with os.fdopen(handle, "wb") as out, fetch(url, timeout=timeout) as source:
                while piece := source.read(1 << 20):
                    out.write(piece)
            check(part)
            receipt = {"url": url, "sha256": file_sha256(part)}
            os.replace(part, target)
            with open(f"{target}.receipt.json", "w", encoding="utf-8") as out:
                json.dump(receipt, out)
            return receipt
        except Exception as e:  # noqa: BLE001
            failed.append(f"{url}: {e}")
            if os.path.exists(part):
                os.remove(part)
    raise OSError("no mirror gave a valid file: " + "; ".join(failed))


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    return digest.hexdigest()


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, one task each."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def rows_digest(rows: DataFrame) -> DataFrame:
    """(rows, digest): a digest of all rows whatever their order: SHA-256 over sums of the parts of each row's SHA-256."""
    each = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("_h"))
    part = lambda i: F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    sums = each.agg(F.count("*").alias("rows"), *(part(i).alias(f"_{i}") for i in range(4)))
    return sums.select("rows", F.sha2(F.concat_ws(",", *(F.col(f"_{i}").cast("string") for i in range(4))), 256).alias("digest"))


def scratch(spark: SparkSession) -> str:
    """A folder all executors share: spark.checkpoint.dir, or a new local one where Spark runs locally."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="kestrelflow-")
