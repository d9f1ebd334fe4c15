"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import pickle
import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.sources.workspace import stage

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, "[ \t\n\x0b\f\r]+")).otherwise(
        F.array().cast("array<string>")
    )


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """One object for each Python worker process, kept from task to task.

    Functions that travel by value get new globals in every task; a cache has to live elsewhere. A
    worker holds one such object: that of an earlier stage goes when another is asked for, so workers
    do not gather the tables of all that they have ever run.
    """
    store = sys.modules.setdefault("tandem_worker_state", types.ModuleType("tandem_worker_state"))
    held = store.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def sent(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Sends a value of bounded size to the executors; the result, called in a task, returns it.

    A worker process unpacks it once. Objects of this folder's classes travel by value.
    """
    name = f"sent{uuid.uuid4().hex}"
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: worker_state(name, lambda: pickle.loads(packed.value))


def running(df: DataFrame, by: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """Adds ``before``: the number of rows, or the sum of ``value``, before each row of its group.

    Rows are sorted by range once and written with the number of their part; the sums of whole parts
    are a small table, and rows are only counted inside a part. So a group of any size is spread over
    tasks. Rows that agree in ``by`` and ``order`` are put in any order among themselves. ``value``
    must not be null. Columns named ``_part``, ``_sum`` and ``_base`` are taken.
    """
    keys = [F.col(c) for c in (*by, *order)]
    sorted_rows = stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id()),
        "ordered",
    )
    amount = F.col(value) if value else F.lit(1).cast("long")
    parts = sorted_rows.groupBy(*by, "_part").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = parts.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_part").alias("_in"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"),
    )
    same = F.col("_part") == F.col("_in")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    here = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        sorted_rows.join(bases, same)
        .withColumn("before", F.col("_base") + F.sum(amount).over(here) - amount)
        .drop("_part", "_in", "_base", *[f"_by_{c}" for c in by])
    )


def file_system(uri: str) -> tuple[Any, str]:
    """The file system of a folder and the folder's path in it: local, or any that pyarrow opens."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri.removeprefix("file:")
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
