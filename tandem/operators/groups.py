"""Groups of pairs that share a side, and splits that keep such a group together.

Deduplication is by pair, so a source may have several targets and a target several sources. A split
drawn by pair then shows a source in training whose other target is tested. Here pairs are the edges of
a graph between sources and targets (known by digests of the lower-cased text, each side for itself), and
a group is a connected component of it: no source and no target is in two groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.functions import fixed_values as V
from tandem.operators.sample import (
    BUCKET_DIGITS,
    _before,
    _bucket_offsets,
    _cut_key,
    _cut_positions,
    _hashed,
    _name,
)
from tandem.sources.workspace import stage

SIDES = ("source", "target")


def side_key(side: str) -> Column:
    """What a side is known by: the md5 of its name and its lower-cased text, the text alone deciding."""
    return F.md5(F.concat(F.lit(f"{side}:"), F.lower(F.coalesce(F.col(side), F.lit("")))))


def connected(edges: DataFrame) -> DataFrame:
    """(node, group): the least node that each node of the edges (a, b) is joined to.

    Each round, every node is hooked to its least neighbour if that is less, chains of hooks are
    followed to their ends by doubling, and the edges are drawn between these ends, without loops and
    repeats. Every end that still has edges loses or gains a neighbour's tree, so at least half of them
    go in a round. A node with any number of edges is a grouped minimum, taken in each task before
    the shuffle, and its edges are joined to one row. Every round is a written table, so that a
    lost executor costs one round and plans stay short.
    """
    links = stage(edges.select("a", "b").distinct(), "edges")
    found = stage(
        links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("group", F.col("node")),
        "groups",
    )
    links = stage(links.filter("a <> b"), "edges")
    while not links.isEmpty():
        either = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stage(
            either.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("to"))
            .select("at", F.least("at", "to").alias("to")),
            "hooks",
        )
        moved = True
        while moved:
            beyond = hooks.select(F.col("at").alias("to"), F.col("to").alias("end"))
            longer = stage(
                hooks.join(beyond, "to").select("at", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")),
                "hooks",
            )
            moved = not longer.filter("moved").isEmpty()
            hooks = longer.select("at", "to")
        ends = hooks.select(F.col("at").alias("group"), "to")
        found = stage(
            found.join(ends, "group", "left").select("node", F.coalesce("to", "group").alias("group")), "groups"
        )
        for side in ("a", "b"):
            links = links.join(hooks.withColumnRenamed("at", side), side).drop(side).withColumnRenamed("to", side)
        links = stage(links.filter("a <> b").select("a", "b").distinct(), "edges")
    return found


def with_group(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``group_id``: what all pairs share that are linked through a source or a target.

    Null sides count as empty texts. Repeated pairs are one edge. The groups are found on digests; one
    join brings them to the pairs, on the source, in which Spark splits the rows of a hot source between
    tasks (``spark.sql.adaptive.skewJoin.enabled``). The input is read twice: ``stage`` it first if
    it is costly to compute.
    """
    edges = pairs.select(*[side_key(s).alias(n) for s, n in zip(SIDES, "ab")])
    groups = connected(edges).select(F.col("node").alias("_node"), F.col("group").alias("group_id"))
    return pairs.withColumn("_node", side_key("source")).join(groups, "_node").select(*pairs.columns, "group_id")


def split_groups(
    rows: DataFrame,
    train: float = V.TRAIN_RATIO,
    valid: float = V.VALID_RATIO,
    seed: int | str = V.SEED,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``split`` to rows with ``group_id``: whole groups, sizes floored in rows.

    Groups are laid one after the other and each goes where its first row falls. A group of more rows than
    the valid or the test part would fill it alone: such large ones come first, by size, the others
    in seeded order. So train and valid exceed their floors by less than one group that is not large.
    Places are computed on a table of one row a group, bucket by bucket; of it, only the keys at the two
    cuts and the few large groups (fewer than one by the smaller ratio) meet the rows, which are not
    shuffled for it. The input is read twice: ``stage`` it first if it is costly to compute.
    """
    sizes = stage(rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("_rows")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("_total"))
    valid_at, test_at = _cut_positions(F.col("_total"), train, valid)
    parts = [F.when(n > 0, n) for n in (test_at - valid_at, F.col("_total") - test_at)]
    bounds = total.select(
        F.struct(valid_at.alias("_valid_at"), test_at.alias("_test_at"), F.least(*parts, "_total").alias("_most")).alias("_b")
    )
    placed = sizes.withColumn("_b", bounds.scalar()).select(*sizes.columns, "_b.*")
    large = placed.filter("_rows > _most").withColumn(
        "_start",
        F.coalesce(
            F.sum("_rows").over(W.orderBy(F.desc("_rows"), "group_id").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ),
    )
    named = large.select(
        "group_id", _name(F.col("_start") < F.col("_valid_at"), F.col("_start") < F.col("_test_at")).alias("_large")
    )
    first = large.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_first"))
    hashed = _hashed(placed.filter("_rows <= _most"), seed, ["group_id"], digits)
    before = W.partitionBy("_bucket").orderBy("_hash", "group_id").rowsBetween(W.unboundedPreceding, -1)
    offsets = _bucket_offsets(hashed, F.sum("_rows")).select("_bucket", "_offset")
    starts = hashed.join(F.broadcast(offsets), "_bucket").select(
        F.struct("_hash", "group_id").alias("_key"), "_valid_at", "_test_at",
        (first.scalar() + F.col("_offset") + F.coalesce(F.sum("_rows").over(before), F.lit(0))).alias("_start"),
    )
    cuts = starts.agg(
        F.struct(*[
            F.min(F.when(F.col("_start") >= F.col(at), F.col("_key"))).alias(name)
            for at, name in (("_valid_at", "valid"), ("_test_at", "test"))
        ]).alias("_cuts")
    )
    keyed = rows.withColumns({"_key": _cut_key(seed, ["group_id"]), "_cut": cuts.scalar()})
    dealt = _name(*(_before(F.col("_key"), F.col("_cut")[c]) for c in ("valid", "test")))
    return keyed.join(named, "group_id", "left").select(*rows.columns, F.coalesce("_large", dealt).alias("split"))


def leakage_by_side(rows: DataFrame, sides: Sequence[str] = SIDES) -> DataFrame:
    """For each side: its different texts (case aside), those that lie in more than one split, their share.

    ``rows`` have the sides and ``split``. One pass and one exchange; a side's splits are merged to their
    least and greatest name in every task, so a hot text is a row a task.
    """
    each = rows.select(
        "split", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), side_key(s).alias("key")) for s in sides])).alias("at")
    )
    spread = each.groupBy("at.side", "at.key").agg(F.min("split").alias("least"), F.max("split").alias("greatest"))
    return spread.groupBy("side").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("least") != F.col("greatest")).alias("n_leaked")
    ).withColumn("leak_rate", F.try_divide("n_leaked", "n_texts"))
