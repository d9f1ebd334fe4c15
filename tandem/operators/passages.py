"""Which passages of a benchmark stand in which texts, verbatim."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the passages that are sought at once: a trie of at most so many nodes is in a task.
TRIE_CHARS = 1 << 20


def passage_hits(
    benchmark: DataFrame, documents: DataFrame, key: str = "doc_id", trie_chars: int = TRIE_CHARS
) -> DataFrame:
    """(item_id, ``key``): every row of ``benchmark`` (item_id, text) whose text a document's text contains.

    Equal to joining on ``contains``, character by character, inside words too, but not by comparing pairs:
    passages are gathered in tries of bounded size, and each task runs its texts through a trie (Aho and
    Corasick) once, whatever the number of passages. Different passages are sent once, those of a trie at a
    time; documents are read once a trie and never shuffled. Passages are known by their digest; their items
    are joined to the hits after. Null and empty passages are in no text, null texts hold none. A row
    for each pair of rows: repeated documents and items count each. A passage longer than ``trie_chars``
    has a trie of its own.
    """
    spark = documents.sparkSession
    given = benchmark.filter(F.length("text") > 0)
    sought = given.select("item_id", F.md5("text").alias("passage"))
    rows = documents.filter("text is not null").select(key, "text")
    kind = rows.schema[key].dataType.simpleString()
    shape = f"passage string, {key} {kind}"
    found = spark.createDataFrame([], shape)
    batch, chars = [], 0

    def hits(passages: list[tuple[str, str]]) -> DataFrame:
        here = spark.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            trie = ahocorasick.Automaton()
            for digest, text in here.value:
                trie.add_word(text, digest)
            trie.make_automaton()
            for batch in batches:
                at, digests = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    inside = {digest for _, digest in trie.iter(text)}
                    at += [k] * len(inside)
                    digests += inside
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.string()), batch.column(0).take(pa.array(at, pa.int64()))],
                    names=["passage", key],
                )

        return rows.mapInArrow(run, shape)

    for row in given.select(F.md5("text").alias("passage"), "text").distinct().toLocalIterator():
        if batch and chars + len(row.text) > trie_chars:
            found = found.unionByName(hits(batch))
            batch, chars = [], 0
        batch.append((row.passage, row.text))
        chars += len(row.text)
    if batch:
        found = found.unionByName(hits(batch))
    return found.join(sought, "passage").select("item_id", key)


def passage_coverage(benchmark: DataFrame, hits: DataFrame) -> DataFrame:
    """``benchmark`` with ``n_documents`` (rows of ``passage_hits``) and ``covered``."""
    counts = hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    joined = benchmark.join(counts, "item_id", "left")
    n = F.coalesce("n_documents", F.lit(0).cast("long"))
    return joined.select(*benchmark.columns, n.alias("n_documents"), (n > 0).alias("covered"))
