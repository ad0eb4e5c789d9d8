"""Rules that window records, statistics, targets and model bundles have to keep, as tables of violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelflow.functions.numbers import is_finite, is_sha256
from kestrelflow.operators.windows import whole_number

#: The largest number that a 32-bit float holds.
FLOAT_MOST = 3.4028234663852886e38


def fits_float(x: Column) -> Column:
    return is_finite(x) & (F.abs(x) <= FLOAT_MOST)


def window_violations(windows: DataFrame, channels: Sequence[str], size: int, split_of: Column | None = None) -> DataFrame:
    """(record_id, rule) of every rule a record breaks: shape, finite, split, rul, target, rationale, copy.

    shape: a channel is missing or not `size` long; finite: a value isn't; split: the declared split
    isn't the unit's (`split_of`); rul: not finite, negative or beyond 32-bit floats; target: blank
    (only where there is such a column); rationale: null (likewise); copy: the id is null or occurs again.
    """
    whole_number(size, "size")
    series = [F.col("series")[c] for c in channels]
    right = [F.coalesce(F.size(a) == size, F.lit(False)) for a in series]
    good = [F.coalesce(F.forall(a, lambda x: x.isNotNull() & fits_float(x)), F.lit(True)) for a in series]
    every = lambda tests: F.forall(F.array(*tests), lambda x: x)
    rules = {"shape": ~every(right), "finite": ~every(good)}
    if split_of is not None:
        rules["split"] = ~F.col("split").eqNullSafe(split_of)
    if "rul" in windows.columns:
        rul = F.col("rul").cast("double")
        rules["rul"] = ~F.coalesce(fits_float(rul) & (rul >= 0), F.lit(False))
    if "target" in windows.columns:
        rules["target"] = ~F.coalesce(F.col("target").rlike(r"\S"), F.lit(False))
    if "rationale" in windows.columns:
        rules["rationale"] = F.col("rationale").isNull()
    broken = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())), lambda x: x.isNotNull())
    out = windows.select("record_id", F.explode(broken).alias("rule"))
    copies = windows.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1 or record_id is null")
    return out.unionByName(copies.select("record_id", F.lit("copy").alias("rule")))


def header_violations(header: DataFrame, channels: Sequence[str], size: int, dataset_sha256: str, training_sha256: str) -> DataFrame:
    """(rule) that the header of saved statistics breaks: version, channels, size, digests, and other data than these."""
    own = F.array(*map(F.lit, channels))
    rules = {
        "version": F.col("schema_version") != 1, "channels": F.col("channels") != own, "size": F.col("window_size") != size,
        "digest": ~(is_sha256(F.col("dataset_sha256")) & is_sha256(F.col("training_sha256"))),
        "data": (F.col("dataset_sha256") != dataset_sha256) | (F.col("training_sha256") != training_sha256),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in rules.items())), lambda x: x.isNotNull())
    return header.select(F.explode(broken).alias("rule"))


def need_statistics(split: str, stats: DataFrame | None) -> None:
    """A held-out split can't be normalised without statistics fitted before."""
    if split != "train" and stats is None:
        raise ValueError(f"statistics are needed for {split}")


def need_rows(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"no rows: {what}")
    return rows


def file_states(paths: DataFrame) -> DataFrame:
    """(path, length, modified) of files read with their metadata, to be compared before and after a run."""
    return paths.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that were added, removed or altered between two states."""
    return before.exceptAll(after).unionByName(after.exceptAll(before)).select("file_path").distinct()
