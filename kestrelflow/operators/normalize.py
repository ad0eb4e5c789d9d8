"""Normalisation by statistics of training windows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelflow.operators.moments import column_moments
from kestrelflow.operators.validate import fits_float
from kestrelflow.operators.windows import long_series, overlap_weights

#: A smaller deviation counts as a constant channel, whose scale is 1.
LEAST_SCALE = 1e-6


def scale_of(deviation: Column) -> Column:
    return F.when(deviation < LEAST_SCALE, 1.0).otherwise(deviation)


def as_float(x: Column, what: str) -> Column:
    return F.when(x.isNull() | fits_float(x), x.cast("float")).otherwise(F.raise_error(F.lit(f"{what}: a normalised value is out of a float's range")).cast("float"))


def fit_on_windows(windows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(channel, mean, scale, samples) over all values of the training windows, overlaps counted again."""
    values = long_series(windows.where("split = 'train'"), channels).select("channel", F.explode("values").alias("v"))
    return values.groupBy("channel").agg(F.avg("v").alias("mean"), scale_of(F.stddev_pop("v")).alias("scale"), F.count("*").alias("samples"))


def fit_on_rows(rows: DataFrame, channels: Sequence[str], size: int = 30, stride: int = 5) -> DataFrame:
    """The same from rows weighted by the number of windows they lie in: no window is built.

    One scan and one pass by parts that merge (see moments); nothing runs before an action. No
    training windows give no rows.
    """
    weighted = overlap_weights(rows.where("split = 'train'"), size, stride)
    found = column_moments(weighted, channels, "weight")
    return found.select(F.col("column").alias("channel"), "mean", scale_of(F.col("deviation")).alias("scale"), F.col("n").cast("long").alias("samples"))


def one_row(stats: DataFrame, channels: Sequence[str]) -> DataFrame:
    """The statistics as one row, a struct (mean, scale) for each channel; a channel that has none, several or unusable ones stops the job."""
    row = stats.groupBy()
    own = lambda c, x: F.max(F.when(F.col("channel") == c, F.col(x)))
    out = row.agg(*(F.struct(own(c, "mean").alias("mean"), own(c, "scale").alias("scale"), own(c, "samples").alias("samples"), F.count_if(F.col("channel") == c).alias("copies")).alias(c) for c in channels))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def checked(c: str) -> Column:
        s = F.col(f"`{c}`")
        wrong = (
            F.when(s["copies"] == 0, f"no statistics of {c}").when(s["copies"] > 1, f"several statistics of {c}")
            .when(~finite(s["scale"]) | (s["scale"] <= 0), f"no usable scale of {c}").when(~finite(s["mean"]), f"no usable mean of {c}")
            .when(F.coalesce(s["samples"], F.lit(0)) < 1, f"no samples of {c}")
        )
        return F.when(wrong.isNull(), F.struct(s["mean"].alias("mean"), s["scale"].alias("scale"))).otherwise(F.raise_error(wrong)).alias(c)

    return out.select(F.struct(*map(checked, channels)).alias("_stats"))


def transform(windows: DataFrame, stats: DataFrame, channels: Sequence[str]) -> DataFrame:
    """The windows with `normal`, a struct of float arrays (x - mean) / scale. `stats` has a row per channel.

    The statistics, a row of a few numbers, are broadcast; nothing runs before an action. Statistics
    that can't be used stop the job (see one_row), and so does a value that a float can't hold.
    """
    joined = windows.crossJoin(F.broadcast(one_row(stats, channels)))

    def normal(channel: str) -> Column:
        s = F.col("_stats")[channel]
        return F.transform(F.col("series")[channel], lambda x: as_float((x - s["mean"]) / s["scale"], channel)).alias(channel)

    return joined.withColumn("normal", F.struct(*map(normal, channels))).drop("_stats")


def stats_violations(stats: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(channel, rule) of statistics that can't be used: scale, mean, samples, copies; units outside training."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    rule = F.when(~finite("scale") | (F.col("scale") <= 0), "scale").when(~finite("mean"), "mean").when(F.col("samples") < 1, "samples")
    out = stats.select("channel", rule.alias("rule")).where("rule is not null")
    copies = stats.groupBy("channel").agg(F.count("*").alias("n")).where("n > 1").select("channel", F.lit("copy").alias("rule"))
    out = out.unionByName(copies)
    if units is not None:
        bad = units.where("split <> 'train'").select(F.col("unit").cast("string").alias("channel"), F.lit("unit").alias("rule"))
        out = out.unionByName(bad)
    return out
