"""Predictors of remaining life: constants, schedules, ridge regression and pluggable functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelflow.operators.moments import moment_parts


def static_schedule(cycle: Column, interval: int = 120) -> Column:
    """Cycles until the next multiple of the interval, from 1 to the interval."""
    return (F.lit(interval) - F.pmod(cycle, F.lit(interval))).cast("double")


def training_mean(windows: DataFrame) -> DataFrame:
    """One row: the mean remaining life of training windows."""
    return windows.where("split = 'train'").agg(F.avg("rul").alias("training_mean"))


def with_training_mean(windows: DataFrame) -> DataFrame:
    """The windows with the constant prediction; the one-row side is broadcast."""
    return windows.crossJoin(F.broadcast(training_mean(windows)))


#: Predictors of one column that need no training but what is in the windows, by name.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "static-schedule": lambda windows: windows.withColumn("prediction", static_schedule(F.col("cycle"))),
    "training-mean": lambda windows: with_training_mean(windows).withColumnRenamed("training_mean", "prediction"),
}


def registered(name: str) -> Callable[[DataFrame], DataFrame]:
    """The predictor of that name, a function of windows that adds `prediction`."""
    if name not in REGISTRY:
        raise ValueError(f"no predictor {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def fit_ridge(rows: DataFrame, features: Sequence[str], target: str, alpha: float = 10.0) -> LinearRegressionModel:
    """Ridge regression with an unpenalised intercept, as the closed form (X'X + alpha I) on centred data has it.

    The solver scales the target to unit population deviation and averages the loss over rows, hence
    the factor. A constant target leaves nothing to penalise.
    """
    n, deviation = rows.agg(F.count("*"), F.stddev_pop(target)).first()
    if not n:
        raise ValueError("no training rows")
    assembled = VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows)
    return LinearRegression(
        featuresCol="_features", labelCol=target, predictionCol="prediction", elasticNetParam=0.0, standardization=False,
        solver="normal", regParam=alpha * (deviation or 0.0) / n,
    ).fit(assembled)


class Ridge(NamedTuple):
    """A ridge model: what its features are multiplied by, what is added, and the moments it was made of."""

    coefficients: list[float]
    intercept: float
    means: list[float]
    alpha: float
    n: float


def ridge(rows: DataFrame, features: Sequence[str], target: str, alpha: float = 10.0) -> Ridge:
    """Ridge regression with an unpenalised intercept, from one pass: counts, means and the matrix of all columns' centred products.

    The driver gets one row of (features + 1) squared numbers and solves for the weights.
    """
    part = moment_parts(rows, [*features, target], together=True).first()
    if part is None:
        raise ValueError("no training rows")
    k, mean = len(features), np.array(part["mean"])
    m = np.array(part["m"]).reshape(k + 1, k + 1)
    weights = np.linalg.solve(m[:k, :k] + alpha * np.eye(k), m[:k, k])
    return Ridge(weights.tolist(), float(mean[k] - mean[:k] @ weights), mean[:k].tolist(), alpha, part["n"])


def ridge_left_over(rows: DataFrame, model: Ridge, features: Sequence[str], target: str) -> DataFrame:
    """(feature, n_windows, residual): centred X'(y - prediction) - alpha w by feature, over the norms of both; 0 at the fit."""
    miss = F.col(target) - predict_ridge(rows, model, features)
    parts = rows.select(miss.alias("_miss"), *((F.col(f) - F.lit(m)).alias(f) for f, m in zip(features, model.means, strict=True)))
    of = lambda f: F.struct(F.sum(F.col(f) * F.col("_miss")).alias("xe"), F.sum(F.col(f) * F.col(f)).alias("xx"), F.sum(F.col("_miss") * F.col("_miss")).alias("ee")).alias(f)
    sums = parts.agg(F.count("*").alias("n_windows"), *map(of, features))
    entry = lambda f, w: F.struct(
        F.lit(f).alias("feature"), F.try_divide(F.col(f)["xe"] - F.lit(model.alpha * w), F.sqrt(F.col(f)["xx"] * F.col(f)["ee"])).alias("residual")
    )
    each = F.array(*(entry(f, w) for f, w in zip(features, model.coefficients, strict=True)))
    return sums.select("n_windows", F.explode(each).alias("e")).select("e.feature", "n_windows", "e.residual")


def predict_ridge(rows: DataFrame, model: LinearRegressionModel | Ridge, features: Sequence[str]) -> Column:
    """The prediction as a column expression: no vectors, no Python."""
    return sum((F.lit(float(w)) * F.col(f) for w, f in zip(model.coefficients, features, strict=True)), F.lit(float(model.intercept)))


Predictor = Callable[[pd.DataFrame], np.ndarray]


def predict_batches(rows: DataFrame, make: Callable[[], Predictor], keys: Sequence[str], batch: int = 16) -> DataFrame:
    """(keys, prediction): a predictor, made once a task, called on batches of at most `batch` rows.

    What it returns is clipped at 0; NaN says that it failed, and comes out as null.
    """
    if type(batch) is not int or batch < 1:
        raise ValueError("batch must be a positive whole number")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make()
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield part[list(keys)].assign(prediction=np.maximum(np.asarray(predict(part), float), 0.0))

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(run, f"{kinds}, prediction double")


class Embedder(Protocol):
    """What an embedder has to offer: how long its vectors are, and a vector for each step of each row.

    `embed` takes arrays (rows, steps, values) and gives (rows, steps, width).
    """

    width: int

    def embed(self, values: np.ndarray) -> np.ndarray: ...


class Unchanged:
    """An embedder that leaves each step's values as they are."""

    def __init__(self, width: int):
        self.width = width

    def embed(self, values: np.ndarray) -> np.ndarray:
        return values


def mean_embeddings(rows: DataFrame, make: Callable[[], Embedder], keys: Sequence[str], values: str, steps: int = 1, batch: int = 1024) -> DataFrame:
    """(keys, embedding): each row's array of values in `steps` equal parts, embedded and averaged over the parts.

    The embedder is made once a task and called on batches of at most `batch` rows. A null array, and
    one with a null or of a length that isn't the task's first one's, has a null embedding.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, length = make(), None
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                part = whole.slice(i, batch)
                lists = part.column("_values").to_pylist()
                length = length or next((len(v) for v in lists if v), None)
                good = [r for r, v in enumerate(lists) if v and len(v) == length and length % steps == 0 and None not in v]
                out: list = [None] * len(lists)
                if good:
                    x = np.array([lists[r] for r in good], float).reshape(len(good), steps, -1)
                    for r, e in zip(good, own.embed(x).mean(axis=1).tolist(), strict=True):
                        out[r] = e
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(out, pa.list_(pa.float64()))], [*keys, "embedding"])

    return rows.select(*keys, F.col(values).cast("array<double>").alias("_values")).mapInArrow(run, f"{kinds}, embedding array<double>")


def patch_encoder(weights: np.ndarray, bias: np.ndarray) -> Callable[[], Predictor]:
    """A predictor over `patches` (arrays of patches): linear map, layer norm, mean over patches, sum as the value."""

    def make() -> Predictor:
        def predict(part: pd.DataFrame) -> np.ndarray:
            x = np.stack([np.stack([np.asarray(p, float) for p in row]) for row in part["patches"]])
            y = x @ weights.T + bias
            y = (y - y.mean(-1, keepdims=True)) / np.sqrt(y.var(-1, keepdims=True) + 1e-5)
            return y.mean(1) @ np.linspace(0, 1, y.shape[-1])

        return predict

    return make


def regression_head(w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float) -> Callable[[np.ndarray], np.ndarray]:
    """Mean over patches, linear, GELU (by the error function), linear."""
    return lambda x: gelu(x.mean(1) @ w1.T + b1) @ w2 + b2


#: Points and weights of a quadrature that is exact for polynomials up to degree 127.
_POINTS, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def error_function(x: np.ndarray) -> np.ndarray:
    """erf of whole arrays, to 1e-15: its integral from 0 by quadrature; beyond 6 it is 1 or -1."""
    half = np.clip(x, -6.0, 6.0)[..., None] / 2
    inside = np.exp(-np.square(half * (_POINTS + 1))) @ _WEIGHTS * half[..., 0] * (2 / np.sqrt(np.pi))
    return np.where(np.abs(x) >= 6, np.sign(x), inside)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + error_function(x / 2**0.5))


def shuffled_batches(rows: DataFrame, seed: int, batch: int) -> DataFrame:
    """The rows with `batch_no`: their place in an order shuffled by a hash, in runs of `batch` within each shuffle partition."""
    from pyspark.sql import Window

    order = F.xxhash64(F.lit(seed), *rows.columns)
    sliced = rows.withColumn("_order", order).withColumn("slice", F.pmod("_order", F.lit(64)).cast("int"))
    nth = F.row_number().over(Window.partitionBy("slice").orderBy("_order"))
    return sliced.withColumn("batch_no", F.floor((nth - 1) / batch).cast("int")).drop("_order")
