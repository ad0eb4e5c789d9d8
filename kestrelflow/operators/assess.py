"""The assessment of a window: prediction, band, rules, and an answer to a question about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelflow.functions.numbers import clipped
from kestrelflow.functions.text import directive, question_route
from kestrelflow.operators import labels


def answer(route: Column, evidence: Column, match: Column, predicted: Column, todo: Column, generated: Column) -> Column:
    """What is said on each route; only the generated text comes from a model, and it is marked so."""
    cycles = F.format_string("%.1f", predicted)
    upkeep = F.concat_ws("\n", F.lit("Observed by rule, not a diagnosis:"), F.array_join(evidence, "\n"), F.concat(F.lit("Rule: "), match, F.lit(".")), F.concat(F.lit("At "), cycles, F.lit(" cycles: "), todo))
    trip = F.concat(cycles, F.lit(" cycles are estimated to remain. This is no clearance for any route."))
    said = F.concat(F.lit("Generated, unverified:\n"), F.regexp_replace(generated, r"\A\s+|\s+\z", ""))
    return F.when(route == "upkeep", upkeep).when(route == "route", trip).when(route == "generated", said).otherwise(F.concat(F.lit("By rule: "), todo))


def assess(windows: DataFrame, channels: dict[str, str], temperature: str, pressure: str, predicted: str = "predicted", keys: Sequence[str] = ("unit", "cycle")) -> DataFrame:
    """(keys, assessment) of windows with series, a prediction, a prompt and generated text.

    The struct holds predicted_rul, true_rul, abs_error (1 digit), wear, urgency, rule_match, evidence,
    route and answer. A window whose prediction failed gets a null assessment. Channels map to labels.
    """
    p = clipped(F.col(predicted))
    values = F.create_map(*(x for c in channels for x in (F.lit(c), F.col("series")[c])))
    rows = windows.withColumn("_review", labels.review(values, p, channels, temperature, pressure))
    route = question_route(F.coalesce("prompt", F.lit("")), F.coalesce("generated", F.lit("")))
    status = labels.band(p)
    horizon = F.greatest(F.lit(1), F.floor(p).cast("int") - 5)
    said = answer(route, F.col("_review.evidence"), F.col("_review.rule_match"), p, directive(status, horizon), F.coalesce("generated", F.lit("")))
    whole = F.struct(
        p.alias("predicted_rul"), F.col("rul").alias("true_rul"), F.round(F.abs(p - F.col("rul")), 1).alias("abs_error"), labels.band(p, "wear").alias("wear"),
        F.col("_review.urgency").alias("urgency"), F.col("_review.rule_match").alias("rule_match"), F.col("_review.evidence").alias("evidence"),
        route.alias("route"), said.alias("answer"),
    )
    return rows.select(*keys, F.when(F.col("_review").isNotNull(), whole).alias("assessment"))
