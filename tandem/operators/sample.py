"""Seeded shuffle, random cap, exact and threshold splits, leakage audit.

Every row gets the md5 of (seed, key columns); the shuffled order is the order of that hash, ties
broken by the keys themselves. It is a permutation that any partitioning, retry or other engine
reproduces.

A global ``row_number`` would sort all rows in one task. Here the first hash digits cut the rows
into buckets, whose sizes (a table of at most 16**BUCKET_DIGITS rows, whatever the data) give each
bucket's first position. Ranks then only need a sort inside each bucket. And where only the place of
a cut matters, as in ``cap`` and ``split``, just the bucket that holds the cut is ranked, to find the
key at the cut; all other rows are compared with that key where they are, without any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.functions import fixed_values as V
from tandem.functions.text import hash_number, row_hash

BUCKET_DIGITS = 5
# Copies of one row are numbered in runs of this length, each run a row of its own.
COPY_RUN = 100_000

SPLITS = ("train", "valid", "test")


def _hashed(df: DataFrame, seed: int | str, keys: Sequence[str], digits: int) -> DataFrame:
    if not 1 <= digits <= BUCKET_DIGITS:
        raise ValueError(f"between 1 and {BUCKET_DIGITS} digits: the table of buckets is broadcast")
    hashed = df.withColumn("_hash", row_hash(seed, [F.col(k) for k in keys]))
    leading = F.conv(F.substring("_hash", 1, digits), 16, 10).cast("int")
    # Never null; said so, or a join on it would add a filter that hashes every row again.
    return hashed.withColumn("_bucket", F.coalesce(leading, F.lit(0)))


def _bucket_offsets(hashed: DataFrame, size: Column) -> DataFrame:
    """Rows per bucket, rows in earlier buckets, rows in all.

    The two windows run in one task over the bucket table, which has at most 16**digits rows.
    """
    earlier = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sizes = hashed.groupBy("_bucket").agg(size.alias("_size"))
    return sizes.select(
        "_bucket",
        "_size",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_size").over(whole).alias("_total"),
    )


def shuffle_pos(
    df: DataFrame,
    seed: int | str,
    keys: Sequence[str],
    unique: bool = False,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``pos`` (0..n-1, the seeded shuffle) and ``n_rows``.

    ``unique`` states that no two rows share their keys; the rows are then shuffled once, evenly by
    hash. Otherwise equal rows are first folded into one row with a count, so that any number of
    copies shuffles as one, and unfolded again after the ranking.

    The input is read twice: ``stage`` it first if it is costly to compute.
    """
    if not unique:
        return _unfold(_ranked_copies(df, seed, keys, digits), df.columns)
    hashed = _hashed(df, seed, keys, digits)
    offsets = _bucket_offsets(hashed, F.count(F.lit(1)))
    in_bucket = W.partitionBy("_bucket").orderBy("_hash", *keys)
    ranked = hashed.join(F.broadcast(offsets), "_bucket")
    return ranked.select(
        *df.columns,
        (F.col("_offset") + F.row_number().over(in_bucket) - 1).alias("pos"),
        F.col("_total").alias("n_rows"),
    )


def _ranked_copies(
    df: DataFrame, seed: int | str, keys: Sequence[str], digits: int
) -> DataFrame:
    """Different rows with ``_start`` (the position of the first copy), ``_copies`` and ``n_rows``."""
    rest = [c for c in df.columns if c not in keys]
    folded = (
        _hashed(df, seed, keys, digits)
        .groupBy("_bucket", "_hash", *df.columns)
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    offsets = _bucket_offsets(folded, F.sum("_copies"))
    before = (
        W.partitionBy("_bucket")
        .orderBy("_hash", *keys, *rest)
        .rowsBetween(W.unboundedPreceding, -1)
    )
    start = F.col("_offset") + F.coalesce(F.sum("_copies").over(before), F.lit(0))
    return folded.join(F.broadcast(offsets), "_bucket").select(
        *df.columns, start.alias("_start"), "_copies", F.col("_total").alias("n_rows")
    )


def _unfold(ranked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each copy with its ``pos``. Copies are cut into runs, and runs dealt out, so that no
    task unfolds a hot row alone."""
    end = F.col("_start") + F.col("_copies") - 1
    runs = (
        ranked.withColumn("_end", end)
        .withColumn("_from", F.explode(F.sequence("_start", "_end", F.lit(COPY_RUN))))
        .repartition("_from")
    )
    last = F.least(F.col("_from") + COPY_RUN - 1, F.col("_end"))
    return runs.select(*columns, F.explode(F.sequence("_from", last)).alias("pos"), "n_rows")


def _cut_keys(
    rows: DataFrame, seed: int | str, keys: Sequence[str], cuts: Sequence[Column], digits: int
) -> DataFrame:
    """One row: for each cut position (a column of ``_total``) the (hash, keys) found there, null
    where the cut lies past the last row.

    ``rows`` must be unique in ``keys``. Two light passes: bucket sizes, then a ranking of only the
    buckets that hold a cut, which is at most one per cut.
    """
    hashed = _hashed(rows.select(*keys), seed, keys, digits)
    offsets = _bucket_offsets(hashed, F.count(F.lit(1)))
    wanted = F.array(
        *[F.struct(F.lit(i).alias("_cut"), c.alias("_at")) for i, c in enumerate(cuts)]
    )
    held = offsets.select("_bucket", "_size", "_offset", F.inline(wanted)).filter(
        (F.col("_at") >= F.col("_offset")) & (F.col("_at") < F.col("_offset") + F.col("_size"))
    )
    by_cut = W.partitionBy("_cut").orderBy("_hash", *keys)
    ranked = hashed.join(F.broadcast(held), "_bucket").select(
        "_cut",
        "_at",
        F.struct("_hash", *keys).alias("_key"),
        (F.col("_offset") + F.row_number().over(by_cut) - 1).alias("_pos"),
    )
    at_cut = ranked.filter(F.col("_pos") == F.col("_at"))
    return at_cut.agg(
        F.struct(
            *[
                F.min(F.when(F.col("_cut") == i, F.col("_key"))).alias(f"cut{i}")
                for i in range(len(cuts))
            ]
        ).alias("_cuts")
    )


def _cut_key(seed: int | str, keys: Sequence[str]) -> Column:
    return F.struct(row_hash(seed, [F.col(k) for k in keys]).alias("_hash"), *keys)


def _before(key: Column, cut: Column) -> Column:
    """Whether a row comes before the cut; all do if the cut lies past the last row."""
    return F.coalesce(key < cut, F.lit(True))


def cap(
    df: DataFrame,
    n: int,
    seed: int | str = V.SEED,
    keys: Sequence[str] = ("source", "target"),
    unique: bool = False,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """The first n rows of the seeded shuffle.

    With ``unique`` keys no row is shuffled: the key at position n is found and rows are compared
    with it. Otherwise copies are cut while they are folded, and only what is kept is unfolded. The rows come in no particular order.
    """
    if not unique:
        ranked = _ranked_copies(df, seed, keys, digits).filter(F.col("_start") < n)
        kept = F.least(F.col("_copies"), F.lit(n) - F.col("_start"))
        return _unfold(ranked.withColumn("_copies", kept), df.columns).select(*df.columns)
    cuts = _cut_keys(df, seed, keys, [F.lit(n).cast("bigint")], digits)
    return df.filter(_before(_cut_key(seed, keys), cuts.scalar()["cut0"]))


def first_shuffled(
    df: DataFrame,
    n: int,
    seed: int | str = V.SEED,
    keys: Sequence[str] = ("source", "target"),
) -> DataFrame:
    """The first few rows of the seeded shuffle, in its order: a top-n per task, merged. For an n
    that one task can hold; ``cap`` takes any."""
    rest = [c for c in df.columns if c not in keys]
    return df.orderBy(row_hash(seed, [F.col(k) for k in keys]), *keys, *rest).limit(n)


def _cut_positions(total: Column, train: float, valid: float) -> tuple[Column, Column]:
    """Where valid and test begin. The products stay in double: a decimal product may floor
    differently."""
    size = total.cast("double")
    n_train = F.floor(size * F.lit(float(train)))
    return n_train, n_train + F.floor(size * F.lit(float(valid)))


def _name(in_train: Column, in_valid: Column) -> Column:
    train, valid, test = SPLITS
    return F.when(in_train, train).when(in_valid, valid).otherwise(test)


def split(
    df: DataFrame,
    train: float = V.TRAIN_RATIO,
    valid: float = V.VALID_RATIO,
    seed: int | str = V.SEED,
    by: Sequence[str] = ("pair_id",),
    unique: bool = False,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``split`` with exactly floored sizes, counted in groups of rows that share ``by``.

    Rows of one group always share their split, so the examples of a pair never leak from train to
    test. With ``unique`` (one row per group, as in a split of single rows) the pass that lists the
    groups falls away. The rows themselves are never shuffled.
    """
    groups = df if unique else df.select(*by).distinct()
    cuts = _cut_keys(groups, seed, by, _cut_positions(F.col("_total"), train, valid), digits)
    keyed = df.withColumns({"_key": _cut_key(seed, by), "_cuts": cuts.scalar()})
    in_train, in_valid = (_before(F.col("_key"), F.col("_cuts")[c]) for c in ("cut0", "cut1"))
    return keyed.select(*df.columns, _name(in_train, in_valid).alias("split"))


def split_at(
    df: DataFrame, train: float = V.TRAIN_RATIO, valid: float = V.VALID_RATIO
) -> DataFrame:
    """The same split for rows that already have ``pos`` and ``n_rows`` from ``shuffle_pos``."""
    n_train, n_seen = _cut_positions(F.col("n_rows"), train, valid)
    return df.withColumn("split", _name(F.col("pos") < n_train, F.col("pos") < n_seen))


def split_hash(
    df: DataFrame,
    train: float = V.TRAIN_RATIO,
    valid: float = V.VALID_RATIO,
    seed: int | str = V.SEED,
    by: Sequence[str] = ("pair_id",),
) -> DataFrame:
    """Add ``split`` by comparing the hash with the ratios: no count and no shuffle, and a row never
    changes its split as the data grows. The sizes hold in expectation only."""
    share = hash_number(row_hash(seed, [F.col(k) for k in by])) / F.lit(2.0**32)
    return df.withColumn("split", _name(share < train, share < train + valid))


def leakage(df: DataFrame, by: str = "pair_id") -> DataFrame:
    """Groups, groups whose rows lie in more than one split, and their share.

    Splits may have any names. A group leaks if its least split name is not its greatest: two names
    a group, merged before the shuffle.
    """
    masks = df.groupBy(by).agg(F.min("split").alias("_least"), F.max("split").alias("_greatest"))
    return masks.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("_least") != F.col("_greatest")).alias("n_leaked"),
    ).withColumn("leak_rate", F.try_divide("n_leaked", "n_groups"))
