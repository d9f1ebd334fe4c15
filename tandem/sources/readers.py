"""Readers of landed files. All take a declared schema; ``fmt`` is json (lines), csv or parquet."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tandem.sources import schemas as S


def read_table(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options: object
) -> DataFrame:
    """Read with a fixed schema. A malformed record stops the read; it does not become a null row
    that a later filter would drop unseen. A csv file needs a header with the schema's names, and as
    its quoted values may span lines, each file is one task: large tables should not be csv."""
    reader = spark.read.schema(schema)
    if fmt in ("json", "csv"):
        reader = reader.option("mode", "FAILFAST")
    if fmt == "csv":
        reader = reader.options(header=True, enforceSchema=False, multiLine=True, escape='"')
    return reader.options(**options).format(fmt).load(path)


def read_seed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Curated pairs (ord, fr, dioula); ``ord`` is the arrival order and comes from the file."""
    return read_table(spark, path, S.SEED_PAIR, fmt)


def read_splits(
    spark: SparkSession,
    paths: Mapping[str, str],
    schema: StructType = S.HUB_ROW,
    fmt: str = "parquet",
) -> DataFrame:
    """Several named splits of one data set as one frame, with the name in column ``split`` and its
    place among them in ``split_ord``. Rows keep their arrival order only by ``ord``: reading one that
    has none is an error."""
    frames = []
    for at, (name, path) in enumerate(paths.items()):
        rows = read_table(spark, path, schema, fmt)
        if "ord" in rows.columns:
            missing = F.raise_error(F.lit(f"split {name}: a row without ord")).cast("bigint")
            rows = rows.withColumn("ord", F.coalesce("ord", missing))
        frames.append(rows.withColumns({"split": F.lit(name), "split_ord": F.lit(at)}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_raw(
    spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """A landed data set with its own columns; parquet brings its schema, other formats need one."""
    if schema is None and fmt != "parquet":
        raise ValueError("only parquet files carry their own schema: pass one")
    return spark.read.parquet(path) if schema is None else read_table(spark, path, schema, fmt)


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A clean corpus. ``json_array`` reads files that each hold one array of records, which Spark
    cannot split: one task per file. Large corpora should be parquet or JSON lines."""
    if fmt == "json_array":
        return read_table(spark, path, S.PAIR, "json", multiLine=True)
    return read_table(spark, path, S.PAIR, fmt)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples by split; ``split`` comes from the directory names, so a filter on it prunes files."""
    return read_table(spark, path, S.EXAMPLE, "json")


def read_benchmark(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Benchmark items as (item_id, source, reference)."""
    rows = read_table(spark, path, S.BENCHMARK, fmt)
    return rows.select("item_id", F.col("fr").alias("source"), F.col("dioula").alias("reference"))


def read_cases(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Smoke prompts (case_id, type, prompt)."""
    return read_table(spark, path, S.SMOKE_CASE, fmt)


def read_optional(
    spark: SparkSession, read: Callable[[], DataFrame], schema: StructType
) -> DataFrame:
    """``read()``, or an empty frame if its path does not exist. Every other error surfaces."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
