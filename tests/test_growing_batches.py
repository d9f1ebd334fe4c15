import os

import pytest
from pyspark.sql import functions as F

from checks import queries as Q
from tandem.functions.text import pair_key
from tandem.operators.pairs import dedup_pairs, keyed_pairs


@pytest.mark.parametrize("query, operator, batches", [("corpus_growth", "stream_append", 3), ("corpus_compacted", "stream_grow", 4)])
def test_more_input_makes_larger_batches_not_more(spark, tmp_path, monkeypatch, query, operator, batches):
    text = [(i, f"a{i}\nb{i % 40}\nA{i % 30}\nB", "en") for i in range(360)]
    docs = spark.createDataFrame(text, "doc_id long, text string, lang string")
    docs.repartition(24).write.parquet(str(tmp_path / "documents.parquet"))
    docs.selectExpr("doc_id", "int(doc_id % 2) AS quality").write.parquet(str(tmp_path / "labels.parquet"))
    taken, landed, real, fresh = [], [], getattr(Q, operator), Q.fresh_path

    def watched(stream, path, checkpoint, **options):
        taken.append(checkpoint)
        return real(stream, path, checkpoint, **options)

    def noted(session, name):
        landed.append(fresh(session, name))
        return landed[-1]

    monkeypatch.setattr(Q, operator, watched)
    monkeypatch.setattr(Q, "fresh_path", noted)
    found = getattr(Q, query)(spark, str(tmp_path))
    want = {(f"a{i}", f"b{i % 40}") for i in range(360)} | {(f"a{i}", "b") for i in range(30)}
    rows = [(r.source_key, r.target_key) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want) * (2 if query == "corpus_compacted" else 1)
    commits = [x for x in os.listdir(f"{taken[0]}/commits") if x.isdigit()]
    files = [x for x in os.listdir(landed[0]) if x.endswith(".parquet")]
    assert batches <= len(commits) <= batches + 2 and len(files) > 2 * batches


def test_keyed_pairs_are_those_of_dedup_with_their_key(spark):
    rows = [(1, "a", "B"), (0, "A", "b"), (2, None, "b"), (3, "x", "y")]
    df = spark.createDataFrame(rows, "ord long, source string, target string")
    want = dedup_pairs(df, ["ord"]).withColumn("pair_key", pair_key(F.col("source"), F.col("target")))
    found = keyed_pairs(want.union(want), ["ord"])
    assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
