"""Scores of a prediction against its reference text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions import fixed_values as V
from tandem.functions.text import strip


def exact_match(pred: Column, ref: Column) -> Column:
    """Equal but for case and outer white space."""
    return strip(F.lower(pred)) == strip(F.lower(ref))


def set_recall(pred: Column, ref_set: Column) -> Column:
    """Share of a distinct reference array found in the prediction array; 0 for an empty one."""
    shared = F.size(F.array_intersect(pred, ref_set)).cast("double")
    return shared / F.greatest(F.size(ref_set), F.lit(1)).cast("double")


def status(exact: Column, partial: Column) -> Column:
    return (
        F.when(exact, V.STATUS_EXACT).when(partial, V.STATUS_PARTIAL).otherwise(V.STATUS_WRONG)
    )


def quality_verdict(pct_global: Column) -> Column:
    """good / fair / weak by the unrounded global percentage; null for an empty benchmark."""
    return (
        F.when(pct_global >= V.GOOD_PCT, "good")
        .when(pct_global >= V.FAIR_PCT, "fair")
        .when(pct_global.isNotNull(), "weak")
    )


def smoke_verdict(passed: Column, total: Column) -> Column:
    """weak below half (rounded down), ready when all passed, otherwise good."""
    half = F.floor(total / 2)
    return F.when(passed < half, "weak").when(passed == total, "ready").otherwise("good")
