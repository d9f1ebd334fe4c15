"""Packing examples into sequences of a token budget."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import fixed_values as V

#: Examples that are packed together: what one task sorts and fits.
RANGE_ROWS = 50_000


def pack_examples(
    df: DataFrame, keys: Sequence[str], limit: int = V.MAX_SEQ_LENGTH, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(keys, n_tokens, pack, slot, over_limit): which sequence each example goes to, and its place there.

    ``df`` has ``keys``, which tell its rows apart, and ``n_tokens`` (``length_budget``). Rows are dealt
    to ranges of about ``range_rows`` by a hash of their keys, and every range is packed on its own by first
    fit, longest first: so it takes at most 11/9 of the fewest sequences possible for it, and one. No
    example is cut: one over the limit has a pack of its own and says so. Rows without tokens, or with
    null, count as empty and fill up the first pack. Only keys and lengths travel, no text. ``pack`` is
    the same however the rows are partitioned.
    """
    rows = df.select(*keys, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranges = F.greatest(F.ceil(n / F.lit(range_rows)), F.lit(1))
    dealt = rows.withColumn("_range", F.pmod(F.xxhash64(F.lit("pack"), *keys), ranges))
    order = list(keys)

    def fit(range_: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", *order], ascending=[False] + [True] * len(order), kind="stable")
        leaves = 1 << max(0, len(rows) - 1).bit_length()
        # A tree of the most room in any pack below; the first pack with enough is found going down.
        room = [limit] * (2 * leaves)
        pack, slot, used = [], [], [0] * leaves
        for tokens in rows["n_tokens"]:
            if tokens > limit:
                tokens = limit  # it comes before all that fit, and fills its pack
            at = 1
            while at < leaves:
                at *= 2
                if room[at] < tokens:
                    at += 1
            k = at - leaves
            pack.append(k)
            slot.append(used[k])
            used[k] += 1
            room[at] -= tokens
            while at > 1:
                at //= 2
                room[at] = max(room[2 * at], room[2 * at + 1])
        rows = rows.drop(columns="_range")
        rows["pack"] = [int(range_[0]) << 32 | k for k in pack]
        rows["slot"] = slot
        rows["over_limit"] = rows["n_tokens"] > limit
        return rows

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.groupBy("_range").applyInPandas(fit, f"{shape}, pack long, slot int, over_limit boolean")


def packed_texts(df: DataFrame, packs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(pack, n_examples, n_tokens, text): the texts of each pack one after the other, by slot."""
    both = df.select(*keys, text).join(packs.select(*keys, "pack", "slot", "n_tokens"), list(keys))
    parts = F.array_sort(F.collect_list(F.struct("slot", F.coalesce(text, F.lit("")).alias("text"))))
    return both.groupBy("pack").agg(
        F.count(F.lit(1)).alias("n_examples"), F.sum("n_tokens").alias("n_tokens"),
        F.array_join(parts["text"], "").alias("text"),
    )


def packing_report(packs: DataFrame, limit: int = V.MAX_SEQ_LENGTH) -> DataFrame:
    """Examples, tokens, packs, examples over the limit, the fullest other pack, and the share of the
    other packs' room that is filled (null without any)."""
    each = packs.groupBy("pack").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.max("over_limit").alias("over")
    )
    within = F.when(~F.col("over"), F.col("tokens"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_examples"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"),
        F.count(F.lit(1)).alias("n_packs"),
        F.count_if("over").alias("n_over"),
        F.max(within).alias("fullest"),
        F.try_divide(F.sum(within), F.count(within) * limit).alias("fill_rate"),
    )
