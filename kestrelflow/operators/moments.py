"""Weighted means and (co-)moments of many columns in one pass, by parts that merge.

A part is (n, mean, M): the sum of weights, the means, and the sums of weighted products of deviations
from them. Each task folds its batches into one part; parts merge pairwise by their means' difference,
so no value is ever squared far from its mean: columns near 1e9 with a spread of 1e-3 keep their
digits. Nothing runs before an action, and a task gives one row however many it has read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "n double, mean array<double>, m array<double>"
#: Tasks that merge parts side by side before the last one merges theirs.
MERGERS = 8


def merged(a: tuple | None, b: tuple) -> tuple:
    """The part of all rows of two parts."""
    if a is None:
        return b
    n = a[0] + b[0]
    apart = b[1] - a[1]
    products = np.outer(apart, apart) if a[2].ndim == 2 else apart * apart
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + products * (a[0] * b[0] / n)


def part_of(x: np.ndarray, weight: np.ndarray, together: bool) -> tuple:
    """The part of a matrix of rows; with `together` M is the matrix of all columns' products, else its diagonal."""
    n = weight.sum()
    mean = x[0] + weight @ (x - x[0]) / n
    far = x - mean
    return n, mean, (far * weight[:, None]).T @ far if together else weight @ (far * far)


def _row(part: tuple) -> pa.RecordBatch:
    lists = [pa.array([np.asarray(x).ravel()], pa.list_(pa.float64())) for x in part[1:]]
    return pa.RecordBatch.from_arrays([pa.array([float(part[0])]), *lists], ["n", "mean", "m"])


def moment_parts(rows: DataFrame, columns: Sequence[str], weight: str | None = None, together: bool = False) -> DataFrame:
    """One row (n, mean, m) over all rows with a positive weight and no null column; no such rows give no row.

    `m` has a value for each column, or with `together` for each pair of columns, row by row.
    """
    some = rows.select(*(F.col(c).cast("double") for c in columns), (F.col(weight) if weight else F.lit(1)).cast("double").alias("_w"))
    some = some.where(F.col("_w") > 0).dropna()
    width = len(columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([batch.column(i).to_numpy() for i in range(width)])
                part = merged(part, part_of(x, batch.column(width).to_numpy(), together))
        if part is not None:
            yield _row(part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            for r in batch.to_pylist():
                m = np.array(r["m"])
                part = merged(part, (r["n"], np.array(r["mean"]), m.reshape(width, width) if together else m))
        if part is not None:
            yield _row(part)

    parts = some.mapInArrow(fold, PART)
    return parts.repartition(MERGERS).mapInArrow(merge, PART).repartition(1).mapInArrow(merge, PART)


def column_moments(rows: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """(column, mean, deviation, n): population moments of each column; no rows give no rows."""
    entry = F.arrays_zip(F.array(*map(F.lit, columns)).alias("column"), F.col("mean"), F.col("m"))
    each = moment_parts(rows, columns, weight).select("n", F.explode(entry).alias("e"))
    return each.select(F.col("e.column").alias("column"), F.col("e.mean").alias("mean"), F.sqrt(F.col("e.m") / F.col("n")).alias("deviation"), "n")
