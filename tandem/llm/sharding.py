"""Sharding by jump consistent hashing: no ring table, and growth moves only what it must."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import running

STEP = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key.

    Every key jumps forward through ever larger shard counts, with a generator seeded by the key; the
    last jump that stays below the count is its shard. All keys jump together.
    """
    state = keys.astype(np.uint64)
    at, nxt = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = nxt[live]
        state[live] = state[live] * np.uint64(STEP) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt[live] = ((at[live] + 1) * (2.0**31 / draw)).astype(np.int64)
        live = live[nxt[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard, from 0, of a whole-number key; null keys count as 0."""
    if shards < 1:
        raise ValueError("there must be a shard")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards).astype(np.int32))

    return place(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    The law is ``key``: doc_id and the number of shards decide. ``size`` is the UTF-8 length of the
    text plus 8; a null text counts as empty, with size 8 and checksum 0. ``slot`` numbers a shard's
    rows from 0 in order of doc_id, repeated rows in any order; null doc_ids come first and share the
    shard of key 0. ``grown_shard`` is the shard when there is one more. Other columns are not read.
    A shard of any size is spread over tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    dealt = rows.select(
        "*",
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    return running(dealt, ["shard"], ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.col("before").cast("long").alias("slot"), "grown_shard",
    )
