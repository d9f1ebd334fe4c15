"""Scoring of predictions and the reports over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import fixed_values as V
from tandem.functions.numbers import percent, round_exact
from tandem.functions.scoring import (
    exact_match,
    quality_verdict,
    set_recall,
    smoke_verdict,
    status,
)
from tandem.functions.text import char_pairs, squash, words, words_all


def score_items(df: DataFrame) -> DataFrame:
    """Add char_similarity, exact, partial and status to rows of (prediction, reference).

    Steps that build a set run only where it decides something: no character pairs for texts that
    are equal once squashed, no words where the characters already settle the matter. Sets that are
    used twice are columns of a step of their own.
    """
    pred, ref = F.col("_pred"), F.col("_ref")
    similarity = F.col("char_similarity")
    folded = df.select(
        "*",
        squash(F.col("prediction")).alias("_pred"),
        squash(F.col("reference")).alias("_ref"),
        exact_match(F.col("prediction"), F.col("reference")).alias("exact"),
    )
    paired = folded.withColumn("_ref_pairs", F.when(pred != ref, char_pairs(ref)))
    alike = F.when(F.length(ref) >= 2, 1.0).otherwise(0.0)
    measured = paired.withColumn(
        "char_similarity",
        F.when(pred == ref, alike).otherwise(set_recall(char_pairs(pred), F.col("_ref_pairs"))),
    )
    open_case = ~F.col("exact") & (similarity < V.CHAR_RECALL)
    worded = measured.withColumn("_ref_words", F.when(open_case, words(ref)))
    recalled = set_recall(words_all(pred), F.col("_ref_words")) >= V.WORD_RECALL
    close = F.when(F.col("_ref_words").isNotNull(), recalled).otherwise(True)
    judged = worded.withColumn("partial", ~F.col("exact") & close)
    return judged.select(
        *df.columns,
        "char_similarity",
        "exact",
        "partial",
        status(F.col("exact"), F.col("partial")).alias("status"),
    )


def score_totals(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and unrounded percentages, over all rows or by the given columns.

    Similarities are rounded to 3 decimals and then added as whole thousandths, so the mean does not
    depend on the order in which tasks finish. Percentages are null for an empty benchmark.
    """
    thousandths = F.round(round_exact(F.col("char_similarity"), 3) * 1000).cast("bigint")
    totals = scored.groupBy(*by).agg(
        F.count_if("exact").alias("exact"),
        F.count_if("partial").alias("partial"),
        F.count(F.lit(1)).alias("total"),
        F.sum(thousandths).alias("_thousandths"),
    )
    return totals.select(
        *by,
        "exact",
        "partial",
        "total",
        percent(F.col("exact"), F.col("total")).alias("pct_exact"),
        percent(F.col("exact") + F.col("partial"), F.col("total")).alias("pct_global"),
        percent(F.col("_thousandths"), F.col("total") * 1000).alias("avg_similarity"),
    )


def score_report(totals: DataFrame, benchmark: str = "aligned_dataset") -> DataFrame:
    """The published summary: percentages to one decimal."""

    def one_decimal(name: str) -> Column:
        return round_exact(F.col(name), 1)

    return totals.select(
        F.lit(benchmark).alias("benchmark"),
        one_decimal("pct_exact").alias("score_exact_pct"),
        one_decimal("pct_global").alias("score_global_pct"),
        one_decimal("avg_similarity").alias("avg_char_similarity_pct"),
        "exact",
        "partial",
        "total",
    )


def score_verdict(totals: DataFrame) -> DataFrame:
    """Add good / fair / weak, judged on the unrounded global percentage."""
    return totals.withColumn("verdict", quality_verdict(F.col("pct_global")))


def smoke_report(responses: DataFrame) -> DataFrame:
    """Responses longer than two characters, out of how many, and the verdict."""
    passed = F.count_if(F.length("response") > V.SMOKE_MIN_CHARS)
    counts = responses.agg(passed.alias("passed"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("verdict", smoke_verdict(F.col("passed"), F.col("total")))
