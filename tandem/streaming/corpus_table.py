"""A corpus table that grows by small batches without being read.

Rows lie in a base, partitioned by the first digits of ``pair_key`` and sorted by it, and in one small
folder for every batch since. A manifest names the folders that are the table; a new manifest with the next
number is the one act that changes it, so that a crash leaves the table as it was, and readers never see half
a batch. A batch reads the base's keys under its own prefixes only, and the keys of the young folders, which a
compaction turns into the next base when there are many.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tandem.operators.pairs import keyed_pairs
from tandem.sources.versions import Changed, file_system, latest, publish
from tandem.streaming.trigger import with_trigger

#: Rows of a prefix that a compaction aims at, digits of a prefix at most (hex, so 16**3 of them), and
#: young folders at which a stream compacts.
PREFIX_ROWS, MOST_DIGITS, COMPACT_AFTER = 1 << 20, 3, 16
__all__ = ["Changed", "Snapshot", "append_batch", "clear", "compact", "known_keys", "read_corpus", "snapshot", "stream_grow"]

#: Up to so many keys a batch asks the base's files for each by value, which their Bloom filters answer.
KEYS_BY_VALUE = 10


class Snapshot(NamedTuple):
    """What a manifest says: its number, the folders, the columns, the last batch of each writer."""

    version: int = -1
    base: str | None = None
    young: tuple[str, ...] = ()
    columns: str = ""
    batches: dict[str, int] = {}
    digits: int = 1  # of the base's prefixes


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The table as it is now; of no version if there is none yet."""
    state = latest(spark, path)
    return Snapshot(**state | {"young": tuple(state["young"])}) if state else Snapshot()


def _publish(spark: SparkSession, path: str, state: Snapshot) -> None:
    publish(spark, path, state.version, state._asdict())


def prefix(digits: int) -> Column:
    return F.lower(F.substring(F.hex("pair_key"), 1, digits))


def _folder(spark: SparkSession, path: str, name: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).parquet(f"{path}/{name}")


def read_corpus(spark: SparkSession, path: str, at: Snapshot | None = None) -> DataFrame:
    """All rows of the table, of any snapshot whose folders have not been removed."""
    at = snapshot(spark, path) if at is None else at
    if at.version < 0:
        raise FileNotFoundError(f"no corpus in {path}")
    names = StructType.fromDDL(at.columns).names
    folders = (*([at.base] if at.base else ()), *at.young)
    rows = [_folder(spark, path, name, at.columns).select(*names) for name in folders]
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], at.columns)


def known_keys(spark: SparkSession, path: str, at: Snapshot, batch: DataFrame) -> DataFrame:
    """``pair_key`` of the rows that could be in ``batch`` (which has ``pair_key``): those of the base under
    the batch's prefixes, and those of the young folders.

    The prefixes, at most 16**MOST_DIGITS, prune the base's folders before it is listed for reading;
    a handful of keys is also given by value, and files whose Bloom filter lacks them are passed over.
    """
    keys = [_folder(spark, path, name, at.columns).select("pair_key") for name in at.young]
    if at.base:
        old = _folder(spark, path, at.base, at.columns + ", prefix string")
        wanted = [r[0] for r in batch.select(prefix(at.digits)).distinct().collect()]
        old = old.filter(F.col("prefix").isin(wanted))
        few = [bytes(r[0]) for r in batch.select("pair_key").limit(KEYS_BY_VALUE + 1).collect()]
        if len(few) <= KEYS_BY_VALUE:
            old = old.filter(F.col("pair_key").isin(few))
        keys.insert(0, old.select("pair_key"))
    return reduce(DataFrame.unionByName, keys) if keys else spark.createDataFrame([], "pair_key binary")


def append_batch(
    batch: DataFrame, path: str, order: Sequence[str] = ("ord",), writer: str = "", batch_id: int | None = None
) -> bool:
    """Add the batch's new pairs as one young folder, whole or not at all; whether it was added.

    Of equal pairs (case aside) the first in ``order`` wins, and those of earlier batches win over later
    ones. With a ``batch_id`` a batch that the table has from this ``writer`` is passed over, so a replayed
    one changes nothing; without, its pairs are known and it adds an empty folder to no effect. Another
    writer's manifest in the meantime raises ``Changed``: the batch is to be tried again. Small results
    come in one file, large ones in files of the size Spark advises.
    """
    spark = batch.sparkSession
    at = snapshot(spark, path)
    if batch_id is not None and at.batches.get(writer, -1) >= batch_id:
        return False
    first = keyed_pairs(batch, order).persist()
    try:
        new = first
        if at.version >= 0:
            known = known_keys(spark, path, at, first)
            known = known.join(first.select("pair_key"), "pair_key", "left_semi").distinct()
            new = first.join(known, "pair_key", "left_anti")
        name = f"young-{uuid.uuid4().hex}"
        new.hint("rebalance").write.parquet(f"{path}/{name}")
    finally:
        first.unpersist()
    columns = at.columns or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    young = at.young if _folder(spark, path, name, columns).isEmpty() else (*at.young, name)
    batches = at.batches if batch_id is None else at.batches | {writer: batch_id}
    _publish(spark, path, at._replace(version=at.version + 1, young=young, columns=columns, batches=batches))
    return True


def compact(spark: SparkSession, path: str, digits: int | None = None) -> Snapshot:
    """Rewrite base and young folders as one base and switch to it; the old folders stay until ``clear``.

    The more rows, the longer the prefixes. A prefix's rows come together, a large prefix in several files, small prefixes in one task; files are
    sorted by key and carry a Bloom filter of their keys. If a batch comes in between, ``Changed`` is
    raised and the table is as that batch left it.
    """
    at = snapshot(spark, path)
    rows = read_corpus(spark, path, at)
    n = rows.count()  # from the files' footers
    if digits is None:
        digits = 1
        while digits < MOST_DIGITS and n > PREFIX_ROWS * 16**digits:
            digits += 1
    name = f"base-{uuid.uuid4().hex}"
    (
        rows.withColumn("prefix", prefix(digits)).hint("rebalance", "prefix")
        .sortWithinPartitions("prefix", "pair_key").write.partitionBy("prefix")
        .option("parquet.bloom.filter.enabled#pair_key", "true")
        .option("parquet.bloom.filter.expected.ndv#pair_key", str(max(64, 2 * n >> 4 * digits)))
        .parquet(f"{path}/{name}")
    )
    now = at._replace(version=at.version + 1, base=name, young=(), digits=digits)
    _publish(spark, path, now)
    return now


def clear(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders and manifests that the current manifest does not need; their names. Only for when
    no reader uses an older snapshot and no batch is being written."""
    hadoop, files = file_system(spark, path)
    at = snapshot(spark, path)
    keep = {at.base, *at.young, "_manifests", f"{at.version:020d}.json"}
    gone = []
    for folder in (path, f"{path}/_manifests"):
        for entry in files.listStatus(hadoop.Path(folder)):
            name = entry.getPath().getName()
            if name not in keep and name.startswith(("base-", "young-", "0", ".")):
                files.delete(entry.getPath(), True)
                gone.append(name)
    return sorted(gone)


def stream_grow(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    order: Sequence[str] = ("ord",),
    every: str | None = None,
    compact_after: int = COMPACT_AFTER,
) -> StreamingQuery:
    """Grow the table by a stream of pairs, a folder a batch, and compact it now and then.

    The checkpoint names the writer, so batches that Spark replays after a crash are not added twice.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, path, order, checkpoint, batch_id)
        if len(snapshot(batch.sparkSession, path).young) >= compact_after:
            compact(batch.sparkSession, path)

    return with_trigger(stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint), every).start()
