"""Statistics of corpora, splits and response times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.detect import detect_language
from tandem.functions.text import word_count


def length_stats(df: DataFrame) -> DataFrame:
    """Minimum, maximum and mean word count of both sides; null for an empty corpus."""
    counted = df.select(
        word_count(F.col("source")).alias("source"), word_count(F.col("target")).alias("target")
    )
    return counted.agg(*[
        measure(side).alias(f"{side}_{name}")
        for side in ("source", "target")
        for name, measure in (("min", F.min), ("max", F.max), ("mean", F.avg))
    ])


def composition(df: DataFrame) -> DataFrame:
    """Pairs per origin, and a row 'total' rolled up from the few counts rather than the rows."""
    per_origin = df.groupBy("origin").agg(F.count(F.lit(1)).alias("_n"))
    counts = per_origin.rollup("origin").agg(
        F.sum("_n").alias("n_pairs"), F.grouping("origin").alias("_all")
    )
    name = F.when(F.col("_all") == 1, "total").otherwise(F.col("origin"))
    return counts.select(name.alias("origin"), "n_pairs")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_examples"))


def profile(df: DataFrame) -> DataFrame:
    """Row count and column names."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "column_names", F.lit(",".join(df.columns))
    )


def detection_confusion(df: DataFrame, label: str = "lang") -> DataFrame:
    """How many texts of each known language the marker count names as what."""
    named = df.select(F.col(label), detect_language(F.col("text")).alias("detected"))
    return named.groupBy(label, "detected").agg(F.count(F.lit(1)).alias("n_texts"))


def latency_stats(
    df: DataFrame, by: str = "mode", shares: Sequence[float] = (0.5, 0.9, 0.99)
) -> DataFrame:
    """Count, mean and exact percentiles of ``latence_ms`` by group.

    Latencies are whole milliseconds, so a histogram holds them exactly in as many rows as there are
    different values. It is built with partial sums; the percentiles then read the histogram, and a
    group that makes up most of the rows costs no more than any other.
    """
    histogram = df.groupBy(by, "latence_ms").agg(F.count(F.lit(1)).alias("_n"))
    ms, n = F.col("latence_ms"), F.col("_n")
    levels = F.array(*[F.lit(float(s)) for s in shares])
    stats = histogram.groupBy(by).agg(
        F.sum("_n").alias("n_calls"),
        (F.sum(ms.cast("bigint") * n) / F.sum(F.when(ms.isNotNull(), n))).alias("mean_ms"),
        F.percentile("latence_ms", levels, n).alias("_p"),
    )
    named = [F.get("_p", i).alias(f"p{round(s * 100)}_ms") for i, s in enumerate(shares)]
    return stats.select(by, "n_calls", "mean_ms", *named)
