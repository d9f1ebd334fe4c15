import pytest
from pyspark.sql import functions as F

from tandem.operators.passages import passage_coverage, passage_hits

ITEMS = [
    (1, "the cat"), (2, "cat sat"), (3, "the cat"), (4, ""), (5, None), (6, "é\n日"), (7, "a"), (8, "no such thing"),
    (9, "the cat sat on the mat"), (None, "mat"),
]
TEXTS = [
    (1, "x", "the cat sat on the mat"), (2, "x", "concat sat"), (3, "x", None), (4, "x", ""), (5, "x", "é\n日本"),
    (5, "x", "the cat"), (None, "x", "a mat"), (6, "x", "b " * 5000 + "the cat"),
]


@pytest.mark.parametrize("chars", [1, 12, 1 << 20])
def test_hits_equal_contains(spark, chars):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = spark.createDataFrame(TEXTS, "doc_id long, item_id string, text string").repartition(3)
    found = passage_hits(items, texts, trie_chars=chars)
    want = [(i, d) for i, p in ITEMS for d, _, t in TEXTS if p and t is not None and p in t]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))
    covered = {r.item_id: (r.n_documents, r.covered) for r in passage_coverage(items, found).collect()}
    for i, _ in ITEMS:
        n = sum(a == i for a, _ in want) if i is not None else 0
        assert covered[i] == (n, n > 0)


def test_nothing_sought_or_read(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = spark.createDataFrame(TEXTS, "doc_id long, item_id string, text string")
    assert passage_hits(items.filter("false"), texts).collect() == []
    assert passage_hits(items, texts.filter("false")).collect() == []


def test_no_pairs_are_compared(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = spark.createDataFrame(TEXTS, "doc_id long, item_id string, text string").withColumn("more", F.lit(1))
    plan = passage_hits(items, texts)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "more" not in plan
