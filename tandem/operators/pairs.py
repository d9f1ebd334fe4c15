"""Pairs: mapping, cleaning, union, first-wins deduplication, novelty, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import fixed_values as V
from tandem.functions.text import clean, pair_key, strip


def to_pairs(
    df: DataFrame,
    source: str,
    target: str,
    source_lang: str = V.SOURCE_LANG,
    target_lang: str = V.TARGET_LANG,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Map any two text columns to clean pairs: stripped, null as empty, empty sides dropped.

    ``keep`` names further columns to carry, such as the arrival order.
    """
    pairs = df.select(
        *keep,
        clean(F.col(source)).alias("source"),
        clean(F.col(target)).alias("target"),
        F.lit(source_lang).alias("source_lang"),
        F.lit(target_lang).alias("target_lang"),
    )
    return drop_empty(pairs)


def drop_empty(df: DataFrame) -> DataFrame:
    return df.filter((F.col("source") != "") & (F.col("target") != ""))


def min_chars(df: DataFrame, n: int = V.MIN_CHARS) -> DataFrame:
    """Keep pairs whose stripped sides both have at least n characters."""
    return df.filter(
        (F.length(clean(F.col("source"))) >= n) & (F.length(clean(F.col("target"))) >= n)
    )


def union_sources(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Bag union of named sources; ``pri`` numbers them, and a lower number wins in ``dedup_pairs``."""
    tagged = [
        df.withColumns({"pri": F.lit(pri), "origin": F.lit(origin)})
        for pri, (origin, df) in enumerate(sources)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def _key() -> Column:
    return pair_key(F.col("source"), F.col("target")).alias("pair_key")


def _first_by_key(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per case-insensitive pair, the first in ``order``, with its ``pair_key``.

    The key is the 32-byte digest, so texts are shuffled once and not a second time as a key.
    An aggregate rather than a window: copies are dropped before the shuffle, so a pair that makes
    up a third of the input reaches the reducer as one row per task. Rows equal in ``order`` are
    told apart by their remaining columns, so the result never depends on partitioning.
    """
    rest = [c for c in df.columns if c not in order]
    best = df.groupBy(_key()).agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select("pair_key", *[F.col("best")[c].alias(c) for c in df.columns])


def dedup_pairs(df: DataFrame, order: Sequence[str] = ("pri", "ord")) -> DataFrame:
    """First row per (lower source, lower target); it keeps its own casing."""
    return _first_by_key(df, order).drop("pair_key")


def keyed_pairs(df: DataFrame, order: Sequence[str] = ("pri", "ord")) -> DataFrame:
    """The rows of ``dedup_pairs`` with the ``pair_key`` that they were grouped by; one in ``df`` is
    replaced."""
    bare = df.drop("pair_key")
    return _first_by_key(bare, order).select(*bare.columns, "pair_key")


def novel_rows(
    new: DataFrame, corpus: DataFrame, order: Sequence[str] = ("ord",)
) -> DataFrame:
    """Distinct new pairs that the corpus does not hold.

    Both sides are reduced to one row per key, and those two exchanges already have the partitioning
    of the anti-join: no shuffle is added, and no key is hot.
    """
    first = _first_by_key(new, order)
    known = corpus.select(_key()).distinct()
    return first.join(known, "pair_key", "left_anti").select(*new.columns)


def coverage(benchmark: DataFrame, corpus: DataFrame, on: str = "pair") -> DataFrame:
    """Benchmark rows with ``covered``: does the corpus hold the pair, or just the source?

    Case and outer white space are ignored. The corpus is cut to the benchmark's keys by a semi-join
    (Spark broadcasts the keys if they are small enough, and then pushes the join below the
    ``distinct``) before the join that keeps every benchmark row.
    """
    sides = {"pair": ("source", "target"), "source": ("source",)}[on]
    keys = [f"{side}_key" for side in sides]
    folded = [strip(F.lower(side)).alias(key) for side, key in zip(sides, keys)]
    keyed = benchmark.select("*", *folded)
    hits = (
        corpus.select(*folded)
        .distinct()
        .join(keyed.select(*keys).distinct(), keys, "left_semi")
        .withColumn("covered", F.lit(True))
    )
    return keyed.join(hits, keys, "left").select(
        *benchmark.columns, F.coalesce("covered", F.lit(False)).alias("covered")
    )


def coverage_rate(covered: DataFrame) -> DataFrame:
    """Total, covered count and rate (null for an empty benchmark)."""
    return covered.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("covered").alias("covered")
    ).withColumn("rate", F.try_divide("covered", "total"))


def pair_predictions(
    predictions: DataFrame, references: DataFrame, on: str | Sequence[str] = "item_id"
) -> DataFrame:
    """References with their prediction; a missing prediction is the empty string.

    Of several predictions for one item the least in code point order counts, so that there are as
    many rows as references.
    """
    keys = [on] if isinstance(on, str) else list(on)
    one = predictions.groupBy(*keys).agg(F.min("prediction").alias("prediction"))
    joined = references.join(one, keys, "left")
    return joined.withColumn("prediction", F.coalesce("prediction", F.lit("")))
