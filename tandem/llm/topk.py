"""Exact top-k by inner product in three phases with a uniform threshold.

A vector's components are dealt to nodes, so a score is the sum of one part per node. First every
task lists each node's largest parts and scores those vectors; the k-th best of all of them is a
safe cutoff, for at least k vectors reach it. The cutoff is broadcast; with m nodes, a vector whose
parts all are below a m-th of it cannot reach it. Every task then collects the others and resolves
them exactly, and what reaches the cutoff is ranked.

Queries go in blocks of fixed size, each against all rows where they lie: nothing but a block of
queries and its cutoffs is sent out, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import sent
from tandem.sources.workspace import stage

K, NODES, SCALE, EVERY = 5, 4, 256, 50
#: Queries in a block, and the most cells of a score matrix in a task.
BLOCK, CELLS = 2048, 1 << 21
FOUND = "query_id long, ids array<long>, score long"


def classes(vectors: DataFrame, scale: int = SCALE, k: int = K) -> DataFrame:
    """(ids, vec): each distinct vector of whole numbers floor(scale * x), and its k + 1 smallest ids.

    More ids of one vector cannot be among the k best of any query. Copies are folded in every task
    and again after the shuffle, so a third of the rows may be one vector. Vectors that are null or
    have a null or non-finite component, and null ids, are left out.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    most = k + 1

    def least(ids):
        return F.slice(F.array_sort(F.array_distinct(ids)), 1, most)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps the smallest ids of each vector of a task; a full table is handed on and begun anew."""
        held: dict[tuple, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([sorted(set(x))[:most] for x in held.values()], pa.list_(pa.int64())),
                    pa.array([list(x) for x in held], pa.list_(pa.int64())),
                ],
                names=["ids", "vec"],
            )

        for batch in batches:
            for one, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = held.setdefault(tuple(v), [])
                ids.append(one)
                if len(ids) > 64:
                    ids[:] = sorted(set(ids))[:most]
            if len(held) > 50_000:
                yield out()
                held.clear()
        yield out()

    folded = kept.filter(usable).select("id", whole.alias("vec")).mapInArrow(
        fold, "ids array<long>, vec array<long>"
    )
    return folded.groupBy("vec").agg(F.flatten(F.collect_list("ids")).alias("ids")).select(
        least(F.col("ids")).alias("ids"), "vec"
    )


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of rows: by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _scan(rows: DataFrame, queries, find) -> DataFrame:
    """Runs ``find(parts, totals, k)`` over blocks of rows for the queries of the same length; it picks
    the cells to return. ``parts`` has the score of each node, query and row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = queries()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            vectors = batch.column(1).to_pylist()
            groups: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                groups.setdefault(len(v), []).append(i)
            for length, members in groups.items():
                if length not in by_length:
                    continue
                query_ids, block, cutoff = by_length[length]
                step = max(1, CELLS // (len(query_ids) * NODES))
                cuts = np.linspace(0, length, NODES + 1).astype(int)
                for at in range(0, len(members), step):
                    some = members[at : at + step]
                    x = np.array([vectors[i] for i in some], np.int64).reshape(len(some), length)
                    parts = np.stack([
                        _products(block[:, a:b], x[:, a:b]) for a, b in zip(cuts, cuts[1:])
                    ])
                    totals = parts.sum(axis=0)
                    q, r = find(parts, totals, cutoff)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(query_ids[q]),
                            pa.array([ids[some[i]] for i in r.tolist()], pa.list_(pa.int64())),
                            pa.array(totals[q, r]),
                        ],
                        names=["query_id", "ids", "score"],
                    )

    return rows.select("ids", "vec").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query but itself."""
    each = found.select("query_id", F.explode("ids").alias("vec_id"), "score").filter(
        "vec_id <> query_id"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def top_k(
    vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id ``every`` divides, the k other rows
    with the largest inner product of floor(scale * x), all if fewer, ties to the smaller vec_id.

    Only vectors of equal length are compared. A repeated vec_id is one row for each of its distinct
    vectors, and all of them are left out of the list of that id. Sums over 2**63 wrap. Other columns
    are not read.
    """
    rows = stage(classes(vectors, scale, k), "vectors")
    asked = stage(
        vectors.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding"), "queries"
    )
    numbered = stage(
        classes(asked, scale, 1 << 30).select(F.explode("ids").alias("id"), "vec"), "numbered"
    )
    n = numbered.count()
    blocks = max(1, -(-n // block))
    bucket = F.pmod(F.xxhash64("id", "vec"), F.lit(blocks))
    spark, results = vectors.sparkSession, []
    for b in range(blocks):
        # About ``block`` rows by hash: a bound that holds whatever the table's size.
        of_block = numbered.filter(bucket == b).orderBy("id", "vec").collect()
        lengths = sorted({len(r["vec"]) for r in of_block})
        by_length = {}
        for length in lengths:
            some = [r for r in of_block if len(r["vec"]) == length]
            ids = np.array([r["id"] for r in some], np.int64)
            block_rows = np.array([r["vec"] for r in some], np.int64).reshape(len(some), length)
            by_length[length] = (ids, block_rows, None)
        if not by_length:
            continue
        first = sent(spark, by_length)

        def lists(parts, totals, cutoff, k=k):
            # Enough entries of each node that k are left beside a query's own row.
            n_rows = parts.shape[2]
            most = min(k + 1, n_rows)
            picked = np.zeros(totals.shape, bool)
            for p in parts:
                top = np.argpartition(p, n_rows - most, axis=1)[:, n_rows - most :]
                np.put_along_axis(picked, top, True, axis=1)
            # Of those, the best by exact score.
            masked = np.where(picked, totals, np.iinfo(np.int64).min)
            top = np.argpartition(masked, n_rows - most, axis=1)[:, n_rows - most :]
            q, c = np.nonzero(np.take_along_axis(picked, top, axis=1))
            return q, top[q, c]

        listed = _best(_scan(rows, first, lists), k)
        cutoffs = {
            (r["query_id"]): r["score"] for r in listed.filter(F.col("rank") == k).collect()
        }
        lowest = np.iinfo(np.int64).min
        second = sent(spark, {
            length: (ids, x, np.array([cutoffs.get(i, lowest) for i in ids.tolist()], np.int64))
            for length, (ids, x, _) in by_length.items()
        })

        def enough(parts, totals, cutoff):
            # Parts below a m-th of the cutoff in every node add up to less than the cutoff.
            share = cutoff[:, None] / len(parts)
            seen = (parts >= np.floor(share)).any(axis=0)
            return np.nonzero(seen & (totals >= cutoff[:, None]))

        results.append(_best(_scan(rows, second, enough), k))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = results[0]
    for r in results[1:]:
        whole = whole.unionByName(r)
    return whole
