"""Writers. Spark's JSON is UTF-8 with non-ASCII characters as they are, one record per line."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.text import pair_key


def write_raw(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Land a raw data set."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_pairs(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the clean corpus; as parquet with the ``pair_key`` by which ``append_novel`` knows pairs."""
    rows = df.select("source", "target", "source_lang", "target_lang")
    if fmt == "parquet":
        rows = rows.withColumn("pair_key", pair_key(F.col("source"), F.col("target")))
    rows.write.mode("overwrite").format(fmt).save(path)


def write_array(df: DataFrame, path: str) -> None:
    """The clean corpus as files that each hold one JSON array, which ``json_array`` reads.

    A file a task, written line by line, so no task holds its array.
    """
    lines = df.select(F.to_json(F.struct("source", "target", "source_lang", "target_lang")).alias("value"))

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for k, row in enumerate(rows):
                rows[k], before = before + row, ","
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
        end = "]" if before == "," else "[]"
        yield pa.RecordBatch.from_arrays([pa.array([end])], names=["value"])

    lines.mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)


def write_examples(df: DataFrame, path: str) -> None:
    """Write all splits in one pass, as ``split=<name>`` folders of JSON lines.

    ``pos`` is written where there is one: the seeded order of a split is that of its ``pos``, whatever
    files its lines are in. ``read_examples`` does not need it.
    """
    place = [c for c in ("pos",) if c in df.columns]
    df.select("split", *place, "prompt", "completion").write.mode("overwrite").partitionBy("split").json(
        path
    )


def write_details(scored: DataFrame, path: str) -> None:
    """The scored items of a report, as a table beside its summary."""
    scored.write.mode("overwrite").parquet(f"{path}/details")


def write_summary(summary: DataFrame, path: str) -> None:
    """The one summary row of a report."""
    summary.write.mode("overwrite").json(f"{path}/summary")


def json_line_bytes(*columns: str) -> Column:
    """Bytes of a row as a JSON line with a space after each ':' and ',' and a final newline."""
    gaps = 2 * len(columns) - 1
    return F.octet_length(F.to_json(F.struct(*columns))) + F.lit(gaps + 1)


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows, bytes and megabytes of each split as JSON lines, without writing them."""
    sized = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.sum(json_line_bytes("prompt", "completion")).alias("n_bytes"),
    )
    return sized.withColumn("size_mb", F.col("n_bytes") / 1048576.0)


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n rows in the given order (a top-n per task, merged; never a full sort)."""
    return df.orderBy(*order).limit(n)
