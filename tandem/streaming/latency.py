"""Latencies of a stream, by window: counts by bucket, which add up, and quantiles read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tandem.streaming.trigger import with_trigger

#: Binary digits of a latency that a bucket keeps: values below 2**7 are exact, others are rounded down by
#: less than one part in 2**6.
DIGITS = 7


def bucket(ms: Column, digits: int = DIGITS) -> Column:
    """The least latency of a bucket: whole milliseconds with all but their first ``digits`` binary digits
    set to 0. Integers only, so every engine agrees; negative and null values stay as they are."""
    length = F.length(F.bin(F.greatest(ms, F.lit(0))))
    drop = F.greatest(length - digits, F.lit(0))
    return F.when(ms > 0, F.call_function("shiftleft", F.call_function("shiftright", ms, drop), drop)).otherwise(ms)


def latency_buckets(
    calls: DataFrame, time: str = "ts", every: str = "1 hour", late_after: str = "1 hour"
) -> DataFrame:
    """(window, mode, bucket, n) of calls (``time``, mode, latence_ms), a table or a stream.

    The state of a stream is a row for each bucket that occurs, a few hundred for each window and mode at
    most, whatever the number of calls, and hot modes are added up in every task first. Windows are
    dropped from the state once the watermark (the latest time less ``late_after``) has passed their end;
    calls that come after that are not counted, and Spark says how many (``late_calls``).
    Calls without a time or a latency are left out; a null mode is a mode.
    """
    timed = calls.filter(F.col(time).isNotNull() & F.col("latence_ms").isNotNull())
    timed = timed.withWatermark(time, late_after)
    return timed.groupBy(
        F.window(time, every).alias("window"), "mode", bucket(F.col("latence_ms").cast("long")).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n"))


def stream_latencies(
    calls: DataFrame,
    path: str,
    checkpoint: str,
    time: str = "ts",
    every: str = "1 hour",
    late_after: str = "1 hour",
    again: str | None = None,
) -> StreamingQuery:
    """Keep the buckets of a stream in a table of changes: those that a batch changed, with its number.

    A batch that Spark replays writes its folder over. ``read_latencies`` takes each bucket's last count.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    buckets = latency_buckets(calls, time, every, late_after).select(
        F.col("window.start").alias("start"), "mode", "bucket", "n"
    )
    writer = buckets.writeStream.outputMode("update").foreachBatch(write)
    return with_trigger(writer.option("checkpointLocation", checkpoint), again).start()


def late_calls(query: StreamingQuery) -> int:
    """Calls that the query dropped as too late, of the batches that Spark still remembers."""
    return sum(
        state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"]
    )


def read_latencies(spark: SparkSession, path: str) -> DataFrame:
    """(start, mode, bucket, n): the counts as of the last batch. They only grow, so the last is the most."""
    changes = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return changes.groupBy("start", "mode", "bucket").agg(F.max("n").alias("n"))


def latency_quantiles(
    buckets: DataFrame, by: Sequence[str] = ("start", "mode"), shares: Sequence[float] = (0.5, 0.9, 0.99)
) -> DataFrame:
    """``by``, n_calls, and p50_ms, p90_ms, p99_ms or those of other shares, from bucket counts.

    A quantile is the bucket of the call at place ceil(share * n), so at most one part in 64 below the
    true one. Counts of any tables with equal buckets may be put together first: leave a column out of
    ``by`` to merge its groups.
    """
    merged = buckets.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*by)
    counted = merged.withColumns({
        "_upto": F.sum("n").over(group.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)),
        "_all": F.sum("n").over(group),
    })
    return counted.groupBy(*by).agg(
        F.max("_all").alias("n_calls"),
        *[
            F.min(F.when(F.col("_upto") >= F.ceil(F.lit(s) * F.col("_all")), F.col("bucket"))).alias(f"p{s * 100:g}_ms")
            for s in shares
        ],
    )
