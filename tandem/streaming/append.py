"""Growing a corpus from a stream of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tandem.functions.text import pair_key
from tandem.operators.pairs import keyed_pairs
from tandem.sources.readers import read_optional
from tandem.streaming.trigger import with_trigger

_KNOWN = StructType([
    StructField("pair_key", BinaryType()),
    StructField("source", StringType()),
    StructField("target", StringType()),
])


def append_novel(batch: DataFrame, corpus_path: str, order: Sequence[str] = ("ord",)) -> None:
    """Append the batch's new pairs to the corpus table; a missing table is begun.

    Each row carries the 32-byte ``pair_key``, and that column is all a batch reads of the corpus. If
    some files lack it, keys are computed from the texts.
    The known keys are cut to the keys of the batch first: if those are few enough to broadcast, the
    corpus is scanned without a shuffle.

    The corpus files are listed before the append starts, so the plan reads a fixed set of files
    while new ones are added. Running a batch again, even after half of it was committed, adds just
    what is missing. One writer per corpus.
    """
    spark = batch.sparkSession
    key = pair_key(F.col("source"), F.col("target"))
    first = keyed_pairs(batch, order).persist()
    corpus = read_optional(spark, lambda: spark.read.schema(_KNOWN).parquet(corpus_path), _KNOWN)
    if corpus.filter(F.col("pair_key").isNull()).isEmpty():
        keys = corpus.select("pair_key")
    else:
        keys = corpus.select(F.coalesce("pair_key", key).alias("pair_key"))
    try:
        known = keys.join(first.select("pair_key"), "pair_key", "left_semi").distinct()
        first.join(known, "pair_key", "left_anti").write.mode("append").parquet(corpus_path)
    finally:
        first.unpersist()


def stream_append(
    stream: DataFrame,
    corpus_path: str,
    checkpoint: str,
    order: Sequence[str] = ("ord",),
    every: str | None = None,
) -> StreamingQuery:
    """Deduplicate a stream of pairs into a corpus table: what is available now, or, with ``every``
    such as "1 minute", for as long as the query runs.

    The state is the corpus itself, so there is no window, watermark or late row. Within a batch the
    first row in ``order`` wins; across batches the earlier batch.
    """
    writer = stream.writeStream.foreachBatch(
        lambda batch, _: append_novel(batch, corpus_path, order)
    ).option("checkpointLocation", checkpoint)
    return with_trigger(writer, every).start()
