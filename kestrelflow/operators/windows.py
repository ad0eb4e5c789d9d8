"""Lifetimes, strided windows and statistics over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole_number(value, what: str) -> int:
    if type(value) is not int or value < 1:
        raise ValueError(f"{what} must be a positive whole number")
    return value


def lifetimes(rows: DataFrame) -> DataFrame:
    """(unit, life, n_rows): each unit's last cycle and row count."""
    return rows.groupBy("unit").agg(F.max("cycle").alias("life"), F.count("*").alias("n_rows"))


def with_life(rows: DataFrame) -> DataFrame:
    """The rows with their unit's last cycle and the cycles that remain; shares the shuffle of windows by unit."""
    life = F.max("cycle").over(Window.partitionBy("unit"))
    return rows.withColumn("life", life).withColumn("rul", F.col("life") - F.col("cycle"))


def is_window_end(size: int, stride: int, c: Column | None = None, life: Column | None = None) -> Column:
    """Cycles a window ends at: every stride from the first full window on, and the last cycle, once."""
    c, life = F.col("cycle") if c is None else c, F.col("life") if life is None else life
    return (c >= size) & ((F.pmod(c - size, F.lit(stride)) == 0) | (c == life))


def too_short(rows: DataFrame, size: int) -> DataFrame:
    """(unit, life) of the units whose life is shorter than a window, which would have none."""
    whole_number(size, "size")
    return lifetimes(rows).where(F.col("life") < size).select("unit", "life")


def require_size(rows: DataFrame, size: int) -> None:
    """Raises ValueError if a window is longer than the shortest life."""
    shortest = lifetimes(rows).agg(F.min("life")).first()[0]
    if shortest is not None and shortest < whole_number(size, "size"):
        raise ValueError(f"windows of {size} cycles, but a unit has {shortest} only")


def window_size(windows: DataFrame) -> Column:
    """The field window_size where it is there and not null, else the length of the first channel's series."""
    series = windows.schema["series"].dataType
    length = F.size(F.col("series")[series.fieldNames()[0]])
    return F.coalesce(F.col("window_size"), length) if "window_size" in windows.columns else length


#: What tells the remaining life; not for predictors.
TARGETS = ("rul", "status", "target", "rationale", "life", "horizon", "urgency")


def inference_view(windows: DataFrame, with_targets: bool = False) -> DataFrame:
    """The windows without what tells the remaining life, unless targets are asked for."""
    return windows if with_targets else windows.drop(*TARGETS)


#: Rows of a unit that are cut into windows at a time.
SEGMENT = 8192


def strided_windows(rows: DataFrame, channels: Sequence[str], size: int = 30, stride: int = 5, segment: int | None = None, strict: bool = False) -> DataFrame:
    """(unit, cycle, window_start, rul, split if there, series): one row per window, series a struct of arrays.

    A unit's rows are collected in segments, each with the `size` - 1 rows before it, and arrays are
    cut out at window ends only. By default a window is the last `size` rows by cycle, and one
    shuffle and sort by unit serves lifetimes, places and segments; a unit is one task. With
    `segment` each so many cycles of a unit are a task of their own, so a unit of any length is spread:
    then cycles have to follow one another from 1, as strict reads assure, and a gap stops the job.
    With `strict` a unit that lives for less than a window stops the job; else it has no window.
    """
    whole_number(size, "size")
    whole_number(stride, "stride")
    length = SEGMENT if segment is None else whole_number(segment, "segment")
    keep = ["split"] if "split" in rows.columns else []
    rows = rows.select("unit", "cycle", *keep, *channels)
    if segment is None:
        lived = with_life(rows).withColumn("_at", F.row_number().over(Window.partitionBy("unit").orderBy("cycle")))
    else:
        lived = rows.withColumn("_at", F.col("cycle"))
    # The row at place p is in the windows that end at places p to p + size - 1.
    own = F.sequence(F.floor((F.col("_at") - 1) / length), F.floor((F.col("_at") + size - 2) / length))
    spread = lived.withColumn("_segment", F.explode(own))
    facts = [F.max("life").alias("life")] if segment is None else []
    packed = F.struct("_at", "cycle", *channels)
    found = spread.groupBy("unit", "_segment").agg(*facts, *(F.first(c).alias(c) for c in keep), F.sort_array(F.collect_list(packed)).alias("_rows"))
    if segment is not None:
        found = found.join(lifetimes(rows).select("unit", "life"), "unit")
    if strict:
        short = F.format_string(f"a window has {size} cycles, but unit %s has %s only", F.col("unit"), F.col("life"))
        found = found.withColumn("life", F.when(F.col("life") >= size, F.col("life")).otherwise(F.raise_error(short).cast("int")))
    row = lambda i: F.element_at("_rows", i.cast("int"))
    ends = F.filter(
        F.sequence(F.lit(1), F.size("_rows")),
        lambda i: (F.floor((row(i)["_at"] - 1) / length) == F.col("_segment")) & (i >= size) & is_window_end(size, stride, row(i)["cycle"], F.col("life")),
    )
    cut = found.select("unit", "life", *keep, "_rows", F.explode(ends).alias("_end"))
    cut = cut.select("unit", "life", *keep, F.slice("_rows", F.col("_end") - size + 1, F.lit(size)).alias("_frame"))
    first, last = F.element_at("_frame", 1)["cycle"], F.element_at("_frame", -1)["cycle"]
    cycle = last if segment is None else F.when(last - first == size - 1, last).otherwise(F.raise_error(F.format_string("unit %s: cycles up to %s don't follow one another", F.col("unit"), last)).cast("int"))
    series = F.struct(*(F.col("_frame")[c].alias(c) for c in channels))
    out = cut.select("unit", cycle.alias("cycle"), "life", *keep, series.alias("series"))
    return out.select("unit", "cycle", (F.col("cycle") - size + 1).alias("window_start"), (F.col("life") - F.col("cycle")).alias("rul"), *keep, "series")


def window_features(rows: DataFrame, channels: Sequence[str], size: int = 30, stride: int = 5) -> DataFrame:
    """Mean, population deviation, least, largest and last minus first value of each channel in each window."""
    frame = Window.partitionBy("unit").orderBy("cycle").rowsBetween(1 - size, 0)
    framed = with_life(rows)
    stats = []
    for c in channels:
        stats += [
            F.avg(c).over(frame).alias(f"{c}_mean"), F.stddev_pop(c).over(frame).alias(f"{c}_std"), F.min(c).over(frame).alias(f"{c}_min"),
            F.max(c).over(frame).alias(f"{c}_max"), (F.col(c) - F.first(c).over(frame)).alias(f"{c}_drift"),
        ]
    keep = ["split"] if "split" in rows.columns else []
    return framed.select("unit", "cycle", "life", "rul", *keep, *stats).where(is_window_end(size, stride)).drop("life")


def feature_names(channels: Sequence[str]) -> list[str]:
    return [f"{c}_{k}" for c in channels for k in ("mean", "std", "min", "max", "drift")]


def rolling_mean(rows: DataFrame, channel: str, size: int) -> DataFrame:
    """The rows with the mean of up to `size` values up to each."""
    frame = Window.partitionBy("unit").orderBy("cycle").rowsBetween(1 - size, 0)
    return rows.withColumn("rolling", F.avg(channel).over(frame))


def patches(series: Column, channels: Sequence[str], size: int, length: int) -> Column:
    """An array of patches; each is its channels' stretches of `length` values one after another. A rest is dropped."""
    starts = F.sequence(F.lit(0), F.lit(size // length - 1))
    return F.transform(starts, lambda i: F.flatten(F.array(*(F.slice(series[c], i * length + 1, F.lit(length)) for c in channels))))


def overlap_weights(rows: DataFrame, size: int = 30, stride: int = 5) -> DataFrame:
    """The rows with `weight`, the number of windows each lies in, without building the windows."""
    ahead = Window.partitionBy("unit").orderBy("cycle").rowsBetween(0, size - 1)
    ended = with_life(rows).withColumn("_end", is_window_end(size, stride).cast("int"))
    return ended.withColumn("weight", F.sum("_end").over(ahead)).drop("_end", "life", "rul")


def long_series(windows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(unit, cycle, channel, values): a row per window and channel."""
    pairs = F.array(*(F.struct(F.lit(c).alias("channel"), F.col("series")[c].alias("values")) for c in channels))
    return windows.select("unit", "cycle", F.explode(pairs).alias("p")).select("unit", "cycle", "p.channel", "p.values")
