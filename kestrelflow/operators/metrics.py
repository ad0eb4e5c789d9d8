"""Scores of predictions, with failed predictions (null, NaN or infinite) counted and left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelflow.functions.numbers import is_finite


def prognostic_score(error: Column) -> Column:
    """The asymmetric penalty of an error: early predictions cost less than late ones. It sums up."""
    return F.when(error < 0, F.exp(-error / 13) - 1).otherwise(F.exp(error / 10) - 1)


def score_models(predictions: DataFrame) -> DataFrame:
    """(model, evaluated, failed, coverage, rmse, mae, score) of (model, truth, prediction).

    Without one good prediction rmse, mae and score are null and coverage is 0. One pass, one shuffle
    of partial sums by model.
    """
    good = F.coalesce(is_finite(F.col("prediction")), F.lit(False))
    error = F.when(good, F.col("prediction") - F.col("truth"))
    return predictions.groupBy("model").agg(
        F.count_if(good).alias("evaluated"), F.count_if(~good).alias("failed"), F.avg(good.cast("double")).alias("coverage"),
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.sum(prognostic_score(error)).alias("score"),
    )


def relative_reduction(ours: Column, baseline: Column) -> Column:
    """By how many percent ours is less than the baseline, to 2 digits; null without either or for a baseline of 0 or less."""
    return F.when(baseline > 0, F.round((1 - ours / baseline) * 100, 2))


def any_failed(long: DataFrame) -> DataFrame:
    """(model, any_failed): whether a model has a prediction that is null or isn't finite."""
    return long.groupBy("model").agg(F.bool_or(~F.coalesce(is_finite(F.col("prediction")), F.lit(False))).alias("any_failed"))


def joint_loss(text_loss: Column, predicted: Column, truth: Column, weight: float = 0.01) -> Column:
    """The loss of two tasks: that of the text, and the squared error of the number by its weight."""
    return text_loss + F.lit(weight) * F.pow(predicted - truth, 2)


def long_predictions(rows: DataFrame, models: list[str]) -> DataFrame:
    """(unit, cycle, truth, model, prediction) of one column per model."""
    return rows.unpivot(["unit", "cycle", "truth"], models, "model", "prediction")


def prediction_map(models: list[str]) -> Column:
    """A map of model to prediction, failed ones null."""
    pairs = [x for m in models for x in (F.lit(m), F.when(is_finite(F.col(m)), F.col(m)))]
    return F.create_map(*pairs)


def leaked_units(rows: DataFrame) -> DataFrame:
    """(unit, splits): units that are in more than one split."""
    return rows.groupBy("unit").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def trained_and_evaluated(trained: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Evaluated units that a model was trained on."""
    return evaluated.select("unit").distinct().join(trained.select("unit").distinct(), "unit", "left_semi")


def check_splits(rows: DataFrame) -> None:
    """Raises for a unit in two splits, or without training or test rows."""
    if leaked := leaked_units(rows).limit(1).collect():
        raise ValueError(f"unit {leaked[0]['unit']} is in {leaked[0]['splits']} splits")
    there = {r["split"] for r in rows.select("split").distinct().collect()}
    if not {"train", "test"} <= there:
        raise ValueError("training and test rows are needed")


def check_trained(trained: DataFrame, evaluated: DataFrame) -> None:
    if both := trained_and_evaluated(trained, evaluated).limit(1).collect():
        raise ValueError(f"unit {both[0]['unit']} was trained on")
