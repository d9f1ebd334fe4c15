"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.sources.workspace import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); ``root`` is the least node it is joined to.

    In each round every node points to its least neighbour or itself, pointers are followed to their
    ends, and links are drawn between ends. At least half of the nodes that still have links go in a
    round, so rounds grow with the logarithm of the nodes. A node with many links is a grouped minimum
    that is taken in every task first. Rounds are written tables, so none is computed again.
    """
    edges = stage(links.select("a", "b").filter("a <> b").distinct(), "links")
    known = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        to = stage(to.select("node", F.least("node", "least").alias("root")), "pointers")
        while True:
            far = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stage(
                to.join(far, "root", "left").select(
                    "node", F.coalesce("next", "root").alias("root"),
                    (F.col("next").isNotNull() & (F.col("next") != F.col("root"))).alias("moved"),
                ),
                "pointers",
            )
            to = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if known is None:
            known = to
        else:
            later = to.select(F.col("node").alias("root"), F.col("root").alias("end"))
            known = stage(
                known.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root")),
                "roots",
            )
        ends = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        other = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stage(
            edges.join(ends, "a").join(other, "b").filter("ra <> rb")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(),
            "links",
        )
        if edges.isEmpty():
            return known
