"""Training files in their seeded order: numbered shards of bounded size, and a manifest of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.sources.schemas import EXAMPLE

#: Bytes of a shard, and rows at most of the table by which positions are dealt to shards, a split.
SHARD_BYTES, BLOCKS = 256 << 20, 1 << 16

MANIFEST = "split string, shard int, first_line long, n_lines long, first_pos long, last_pos long, n_bytes long"


def write_shards(df: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write (split, pos, prompt, completion) as JSON lines of prompt and completion alone; the manifest.

    The lines of a split, its shards one after the other, are in the order of ``pos``. Positions are cut
    into blocks, at most BLOCKS of them, whose sizes are a small table; a shard is a run of blocks, begun
    whenever ``shard_bytes`` more are full. So it exceeds ``shard_bytes`` by less than its last block,
    which is a single line for up to BLOCKS lines. Every shard is one file, ``split=.../shard=...``,
    sorted in its task. The manifest, (MANIFEST), lies beside them in ``_shards``; it also says where in
    its split a shard begins. ``pos`` must be different in every row and is not null.

    The input is read three times: ``stage`` it first if it is costly to compute.
    """
    line = F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("prompt", "completion")]))
    rows = df.select("split", "pos", line.alias("value"))
    last = rows.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("m")).scalar()
    width = F.greatest(F.ceil((last + 1) / F.lit(BLOCKS)), F.lit(1))
    rows = rows.withColumn("_block", F.floor(F.col("pos") / width))
    sizes = rows.groupBy("split", "_block").agg(
        F.sum(F.octet_length("value") + 1).alias("_bytes"), F.count(F.lit(1)).alias("_lines"),
        F.min("pos").alias("_first"), F.max("pos").alias("_last"),
    )
    before = W.partitionBy("split").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = sizes.withColumns({
        "shard": F.floor(F.coalesce(F.sum("_bytes").over(before), F.lit(0)) / shard_bytes).cast("int"),
        "_line": F.coalesce(F.sum("_lines").over(before), F.lit(0)),
    })
    shards = blocks.groupBy("split", "shard").agg(
        F.min("_line").alias("first_line"), F.sum("_lines").alias("n_lines"), F.min("_first").alias("first_pos"),
        F.max("_last").alias("last_pos"), F.sum("_bytes").alias("n_bytes"),
    )
    dealt = rows.join(F.broadcast(blocks.select("split", "_block", "shard")), ["split", "_block"])
    dealt.repartition("split", "shard").sortWithinPartitions("split", "shard", "pos").select(
        "split", "shard", "value"
    ).write.mode("overwrite").partitionBy("split", "shard").text(path)
    shards.write.mode("overwrite").json(f"{path}/_shards")
    return read_manifest(df.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a folder, one row each. It is written last: without it the folder is not whole."""
    return spark.read.schema(MANIFEST).json(f"{path}/_shards")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, completion, split, shard) of all lines; a filter on split or shard reads only their files."""
    return spark.read.schema(EXAMPLE).json(path).select("prompt", "completion", "split", "shard")
