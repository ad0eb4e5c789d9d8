"""Strict and lenient scans of white-space separated telemetry lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelflow.functions.numbers import is_finite, is_whole

FIELDS = ("unit", "cycle", *(f"op_setting_{i}" for i in range(1, 4)), *(f"sensor_{i}" for i in range(1, 22)))


class InvalidTelemetry(ValueError):
    """Raised with the first violation found."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, line, value) of text files; (block, line) is the order of their lines. A file may be split."""
    start = F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
    return spark.read.text(path).select(
        F.concat_ws(":", "_metadata.file_path", start).alias("block"), F.monotonically_increasing_id().alias("line"), "value"
    )


def first_lines(lines: DataFrame, limit: int = 0) -> DataFrame:
    """The first physical lines, blank ones counted too; 0 is no limit."""
    if type(limit) is not int or limit < 0:
        raise ValueError("limit must be 0 or a positive whole number")
    order = ["block", "line"] if "block" in lines.columns else ["line"]
    return lines.orderBy(*order).limit(limit) if limit else lines


def fields_of(value: Column) -> Column:
    return F.split(F.regexp_replace(value, r"\A\s+|\s+\z", ""), r"\s+")


def parse_lines(lines: DataFrame, names: tuple[str, ...] = FIELDS) -> DataFrame:
    """The fields as doubles, unit and cycle as ints, null where a field isn't a number; blank lines go."""
    split = lines.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "").withColumn("_f", fields_of(F.col("value")))
    number = lambda i: F.get("_f", F.lit(i)).try_cast("double")
    ints = [F.when(is_whole(number(i)), number(i)).try_cast("int").alias(n) for i, n in enumerate(names[:2])]
    block = F.col("block") if "block" in lines.columns else F.lpad(F.floor(F.col("line") / 65536).cast("string"), 20, "0")
    return split.select(block.alias("block"), "line", *ints, *(number(i).alias(n) for i, n in enumerate(names[2:], 2)))


def split_lines(lines: DataFrame) -> DataFrame:
    """The lines that aren't blank with their fields (_f) and these as numbers (_n)."""
    split = lines.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "").withColumn("_f", fields_of(F.col("value")))
    return split.withColumn("_n", F.transform("_f", lambda x: x.try_cast("double")))


def first_rule(width: int = len(FIELDS), units: int = 100) -> Column:
    """The first rule that a line of split_lines() breaks: width, number, finite, whole or range; else null."""
    key = lambda i: F.get("_n", F.lit(i))
    return (
        F.when(F.size("_f") != width, "width")
        .when(F.exists("_n", lambda x: x.isNull()), "number")
        .when(F.exists("_n", lambda x: ~is_finite(x)), "finite")
        .when(~(is_whole(key(0)) & is_whole(key(1))), "whole")
        .when(~(key(0).between(1, units) & (key(1) >= 1)), "range")
    )


def line_violations(lines: DataFrame, width: int = len(FIELDS), units: int = 100) -> DataFrame:
    """(line, rule) of each line's first broken rule: width, number, finite, whole or range. Blank lines are no error."""
    # A filter on the rule would be pushed below the split and write it out once for every test.
    broken = F.filter(F.array(first_rule(width, units)), lambda x: x.isNotNull())
    return split_lines(lines).select("line", F.explode(broken).alias("rule"))


def sequence_violations(rows: DataFrame) -> DataFrame:
    """(unit, cycle, rule): cycles of a unit that don't follow the one before, by cycle; copies and gaps."""
    by_cycle = Window.partitionBy("unit").orderBy("cycle")
    before = F.coalesce(F.lag("cycle").over(by_cycle), F.lit(0))
    step = F.col("cycle") - before
    rule = F.when(step == 0, "copy").when(step != 1, "gap")
    return rows.select("unit", "cycle", rule.alias("rule")).where("rule is not null")


def order_violations(parsed: DataFrame) -> DataFrame:
    """(line, rule): lines whose unit is less than the line before has. Each block of lines is looked at
    by itself; the blocks' first and last lines, one row a block, then meet in order."""
    inner = Window.partitionBy("block").orderBy("line")
    inside = parsed.withColumn("before", F.lag("unit").over(inner)).where("unit < before").select("line")
    edges = parsed.groupBy("block").agg(F.min_by("unit", "line").alias("first"), F.min("line").alias("line"), F.max_by("unit", "line").alias("last"))
    edges = edges.withColumn("before", F.lag("last").over(Window.orderBy("block")))
    return inside.unionByName(edges.where("first < before").select("line")).withColumn("rule", F.lit("order"))


def fleet_violations(parsed: DataFrame, units: int = 100) -> DataFrame:
    """(unit, rule): units of 1..units that are missing, and others that are there."""
    wanted = parsed.sparkSession.range(1, units + 1).select(F.col("id").cast("int").alias("unit"))
    seen = parsed.select("unit").distinct()
    missing = wanted.join(seen, "unit", "left_anti").withColumn("rule", F.lit("missing"))
    return missing.unionByName(seen.join(wanted, "unit", "left_anti").withColumn("rule", F.lit("unknown")))


def enforce(violations: DataFrame, what: str) -> None:
    """Raises if there is a violation; only the first row is fetched."""
    first = violations.limit(1).collect()
    if first:
        raise InvalidTelemetry(f"{what}: {first[0].asDict()}")


def read_strict(spark: SparkSession, path: str, units: int = 100, whole_fleet: bool = True) -> DataFrame:
    """A telemetry file's rows without op settings, or InvalidTelemetry with the first rule broken."""
    lines = read_lines(spark, path)
    enforce(line_violations(lines, units=units), "line")
    rows = parse_lines(lines)
    if rows.isEmpty():
        raise InvalidTelemetry("no rows")
    enforce(order_violations(rows), "order of units")
    enforce(sequence_violations(rows), "order of cycles")
    if whole_fleet:
        enforce(fleet_violations(rows, units), "units")
    return rows.drop("block", "line", "op_setting_1", "op_setting_2", "op_setting_3")
