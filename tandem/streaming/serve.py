"""Chat and translation jobs as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tandem.streaming.trigger import with_trigger


def stream_job(
    rows: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write the replies of ``chat_job`` or ``translate_job`` over a stream of requests, or its
    rejects, to a parquet folder: what is available now, or, with ``every``, at that interval.

    The jobs are narrow, so they run on a streaming frame as they are, without state. The file sink
    writes each reply once.
    """
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return with_trigger(writer, every).start()


def stream_sides(
    requests: DataFrame,
    validate: Callable[[DataFrame], DataFrame],
    job: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Replies and rejects of a stream of requests in one query, with one checkpoint and one reading.

    ``validate`` adds ``errors``, as ``validate_chat`` does; ``job`` answers valid requests. Each batch is
    validated once and kept, its replies go to ``accepted/batch=n`` and its rejects with their errors to
    ``rejected/batch=n``. A batch that Spark replays writes the same two folders over, so none of its
    requests is there twice, whatever it had written before a crash.
    """

    def write(batch: DataFrame, n: int) -> None:
        checked = validate(batch).persist()
        try:
            good = checked.filter("size(errors) = 0").drop("errors")
            job(good).write.mode("overwrite").parquet(f"{path}/accepted/batch={n}")
            checked.filter("size(errors) > 0").write.mode("overwrite").parquet(f"{path}/rejected/batch={n}")
        finally:
            checked.unpersist()

    return with_trigger(
        requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), every
    ).start()


def read_side(spark: SparkSession, path: str, side: str) -> DataFrame:
    """The rows of ``accepted`` or ``rejected`` with the ``batch`` that brought them."""
    return spark.read.option("basePath", f"{path}/{side}").parquet(f"{path}/{side}/batch=*")
