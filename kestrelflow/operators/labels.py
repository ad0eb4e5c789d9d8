"""Bands, drifts, staging and review rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrelflow.functions.numbers import is_finite, signed

#: The words for remaining lives of at most 30, at most 75 and more cycles, by vocabulary.
BANDS = {
    "status": ("CRITICAL", "WARNING", "NORMAL"),
    "wear": ("CRITICAL_WEAR", "ELEVATED_WEAR", "NOMINAL_ENVELOPE"),
    "urgency": ("PRIORITY_REVIEW", "PLANNING_REVIEW", "MONITOR"),
    "screen": ("Critical", "Warning", "Normal"),
}


def band(rul: Column, vocabulary: str = "status") -> Column:
    """The band of a remaining life; null for null, or "Model unavailable" on the screen."""
    low, middle, high = BANDS[vocabulary]
    chain = F.when(rul <= 30, low).when(rul <= 75, middle).when(rul.isNotNull(), high)
    return chain.otherwise("Model unavailable") if vocabulary == "screen" else chain


def record_id(unit: Column, cycle: Column, fleet: str = "FD001") -> Column:
    return F.format_string(f"{fleet}-U%03d-C%04d", unit, cycle)


def endpoint_drift(values: Column) -> Column:
    """Last minus first value."""
    return F.element_at(values, -1) - F.element_at(values, 1)


def rounded_drift(values: Column, digits: int = 4) -> Column:
    """The drift rounded; 0 for a missing channel or fewer than two values."""
    return F.coalesce(F.when(F.size(values) >= 2, F.round(F.try_element_at(values, F.lit(-1)) - F.try_element_at(values, F.lit(1)), digits)), F.lit(0.0))


def staged_rul(rul: Column, temperature: Column, pressure: Column) -> Column:
    """The remaining life if known, else one for how far temperature has risen or pressure fallen."""
    guess = F.when((temperature > 8.0) | (pressure < -0.4), 20).when((temperature > 3.0) | (pressure < -0.15), 55).otherwise(120)
    return F.coalesce(rul, guess)


def directive_horizon(status: Column, rul: Column, split: Column) -> Column:
    """Cycles until something is to be done; fixed where the remaining life is withheld."""
    test = split == "test"
    return F.when(status == "CRITICAL", F.when(test, 5).otherwise(F.greatest(F.lit(1), rul - 5))).when(
        status == "WARNING", F.when(test, 25).otherwise(F.greatest(F.lit(5), rul - 15))
    )


def valid_drift(values: Column) -> Column:
    """The drift of at least two finite readings, else null."""
    good = (F.size(values) >= 2) & F.forall(values, lambda x: x.isNotNull() & is_finite(x))
    return F.when(good, F.try_element_at(values, F.lit(-1)) - F.try_element_at(values, F.lit(1)))


def rule_match(temperature_drift: Column, pressure_drift: Column) -> Column:
    """What the combined rule says: temperature up by over 2 and pressure down by over 0.15."""
    missing = temperature_drift.isNull() | pressure_drift.isNull()
    both = (temperature_drift > 2.0) & (pressure_drift < -0.15)
    return F.when(missing, "Insufficient data").when(both, "Both thresholds met").otherwise("Combined thresholds not met")


def evidence_line(label: str, drift: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{label}: "), signed(drift, 4)), F.lit(f"{label}: insufficient valid readings"))


def review(values: Column, rul: Column, labels: dict[str, str], temperature: str, pressure: str) -> Column:
    """A struct (rule_match, urgency, evidence) for a map of readings; null, with no urgency, for a RUL that isn't one."""
    drift = {c: valid_drift(F.try_element_at(values, F.lit(c))) for c in labels}
    usable = is_finite(rul) & (rul >= 0)
    return F.when(
        usable,
        F.struct(
            rule_match(drift[temperature], drift[pressure]).alias("rule_match"),
            band(rul, "urgency").alias("urgency"),
            F.array(*(evidence_line(labels[c], d) for c, d in drift.items())).alias("evidence"),
        ),
    )
