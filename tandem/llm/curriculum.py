"""Mixing sources to target weights with weights that change over training.

Every source has a target in words. Its share of the stream follows a schedule; the integral of the
schedule is the source's demand up to a point in training. A document's place in the order of its
source is turned into a place in training by inverting that demand, and all documents are sorted by
range of their places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import let, running, word_count
from tandem.sources.workspace import stage

WEIGHTS = (5, 2, 1)
EPOCHS = 1.5
MOST = 2
#: Parts of the readings of rows that are alike.
SALTS = 64
#: Knots in training (0 to 1) and the factor on each weight there, linear between knots: sources of
#: the first weight lead at the start, those of the last at the end.
SCHEDULE = ((0.0, (1.5, 1.0, 0.5)), (0.6, (1.0, 1.0, 1.0)), (1.0, (0.5, 1.0, 2.0)))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: float = EPOCHS, most: int = MOST
) -> DataFrame:
    """(source, kind, source_size, target) from rows of (source, size).

    Sources in order of code points, null last, get the weights in turn (``kind`` says which). They
    share ``epochs`` times all sizes; none gets over ``most`` times its own size, and what is over is
    shared by weight among the others until none is above. With no words all targets are 0.
    """
    if not 0 <= epochs <= most:
        raise ValueError("epochs must be from 0 to most")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "null_last", F.col("source").isNull()
    )
    place = F.col("before") % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long")
    ranked = stage(
        running(per, [], ["null_last", "source"])
        .select("source", place.cast("int").alias("kind"), weight.alias("weight"), "source_size"),
        "sources",
    )
    limit = (most * F.col("source_size")).cast("double")
    rate, full = 0.0, -1
    while True:
        # Once at its limit a source stays there, as the rate only grows; this ends.
        over = F.col("weight") * F.lit(rate) >= limit
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.count_if(over).alias("full"),
            F.sum(F.when(over, limit)).alias("taken"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"),
        ).first()
        if row["full"] == full or not row["free"]:
            break
        full = row["full"]
        rate = (epochs * row["all"] - (row["taken"] or 0.0)) / row["free"]
    return ranked.select(
        "source", "kind", "source_size", F.least(F.col("weight") * F.lit(rate), limit).alias("target")
    )


def place_in_training(kind: Column, share: Column, schedule=SCHEDULE) -> Column:
    return let(share, lambda x: _place(kind, x, schedule))


def _place(kind: Column, share: Column, schedule) -> Column:
    """The point of training at which a source has met ``share`` (0 to 1) of its demand.

    Between knots the weight is a line, so demand is a parabola; its inverse is written in the form
    that has no cancellation.
    """
    found = F.lit(None).cast("double")
    for k in range(len(schedule[0][1])):
        knots = [(t, w[k]) for t, w in schedule]
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        total, met = sum(areas), 0.0
        inverse = F.lit(1.0)
        pieces = []
        for (t, w), (end, w_end), area in zip(knots, knots[1:], areas):
            slope = (w_end - w) / (end - t)
            rest = share * total - met
            root = F.sqrt(F.greatest(F.lit(w * w) + 2 * slope * rest, F.lit(0.0)))
            x = F.when(rest > 0, 2 * rest / (root + w)).otherwise(0.0)
            pieces.append((met + area, t + F.least(x, F.lit(end - t))))
            met += area
        for upto, value in reversed(pieces):
            inverse = F.when(share * total <= upto, value).otherwise(inverse)
        found = F.when(kind == k, inverse).otherwise(found)
    return found


def assign(
    docs: DataFrame,
    seed: int = 7,
    weights: Sequence[int] = WEIGHTS,
    epochs: float = EPOCHS,
    most: int = MOST,
    schedule=SCHEDULE,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """(doc, size, source_size, target, taken, places), a row for each row of ``docs``.

    ``doc`` holds the columns to keep, all by default; what is not kept is neither written nor shuffled.
    A source's rows are put in order of a hash of seed, doc_id and text and read as often as its target
    needs, the last reading up to the target's last word: ``taken`` adds up to the rounded target, and a
    row is taken at most ``most`` times. ``places`` has the place in training of each reading, none for
    rows that are not read.

    Null texts have size 0; rows of size 0 are not read. Null sources are one source. Null doc_ids
    are hashed as null. Equal rows may come in any number and change places among themselves. Other
    columns, whatever their names, stay inside ``doc``.
    """
    rows = docs.select(
        F.struct(*(keep or docs.columns)).alias("doc"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("draw"),
    )
    # Words are counted once; the sort by range reads its rows twice.
    ordered = running(stage(rows, "sizes"), ["source"], ["draw", "size"], "size")
    targets = source_targets(ordered.select("source", "size"), weights, epochs, most)
    targets = targets.withColumnRenamed("source", "of")
    both = ordered.join(targets, F.col("source").eqNullSafe(F.col("of")), "left")
    whole = F.floor(F.col("target") + 0.5)

    def part(k: Column) -> Column:
        start = k * F.col("source_size") + F.col("before")
        return F.greatest(F.lit(0), F.least(F.col("size"), whole - start)).cast("long")

    def place(k: Column) -> Column:
        middle = k * F.col("source_size") + F.col("before") + part(k) / 2
        return place_in_training(F.col("kind"), middle / whole, schedule)

    readings = F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))
    read = F.filter(readings, lambda k: part(k) > 0)
    return both.select(
        "doc",
        "size",
        "source_size",
        "target",
        F.aggregate(readings, F.lit(0).cast("long"), lambda a, k: a + part(k)).alias("taken"),
        F.transform(read, place).alias("places"),
    )


def stream(assigned: DataFrame) -> DataFrame:
    """The rows of documents in training order, a row for each reading: one sort by range."""
    return assigned.select("doc", F.explode("places").alias("place")).orderBy(
        "place", "doc.doc_id"
    )


def mix(
    docs: DataFrame,
    seed: int = 7,
    weights: Sequence[int] = WEIGHTS,
    epochs: float = EPOCHS,
    most: int = MOST,
    schedule=SCHEDULE,
) -> DataFrame:
    """The rows of ``docs`` in training order, with their columns, a row for each reading.

    ``assign`` ranks a key of 128 bits for each row; texts are joined with the places of their keys and
    sorted by range, once. Rows alike in all columns share a key: one of them stands for all, in
    ``SALTS`` parts, so no task gets all their readings. Null, empty and repeated rows are taken as
    ``assign`` says; an empty table gives none. Columns may have any names, but not be maps.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # A hash passes over nulls; whether a column is null tells their rows apart.
    values = [x for c in columns for x in (c.isNull(), c)]
    key = [F.xxhash64(*values).alias("one"), F.xxhash64(F.lit(seed), *values).alias("two")]
    texts = docs.select(F.struct(*columns).alias("doc"), *key)
    keyed = docs.select("doc_id", "text", "source", F.struct(*key).alias("key"))
    found = assign(keyed, seed, weights, epochs, most, schedule, keep=["key"])
    readings = stage(found.select("doc.key.*", F.posexplode("places").alias("reading", "place")), "places")
    by = ["one", "two"]
    alike = stage(
        readings.filter("reading = 0").groupBy(*by).count().filter("count > 1").select(*by), "alike"
    )
    if alike.isEmpty():
        read = readings.join(texts, by)
    else:
        salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
        salted = readings.join(alike, by, "left_semi").withColumn(
            "salt", F.pmod(F.xxhash64("place"), F.lit(SALTS).cast("long"))
        )
        once = texts.join(alike, by, "left_semi").dropDuplicates(by).withColumn("salt", F.explode(salts))
        read = readings.join(alike, by, "left_anti").join(texts, by).select("place", "one", "doc").unionByName(
            salted.join(once, [*by, "salt"]).select("place", "one", "doc")
        )
    return read.orderBy("place", "one").select("doc.*")
