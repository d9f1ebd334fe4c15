"""The pipeline's stages against plain restatements, on the smallest tables and on awkward rows."""

from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tandem.llm import classifier
from tests.llm import brute
from tests.llm.test_operators import SMALL, edited, ordered, prose, result

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text))


AWKWARD = [
    row(1, prose(1)), row(2, edited(prose(1), 2, 2)), row(2, prose(2)),  # one doc_id, one of them a near copy
    row(3, prose(3)), row(3, prose(3)), row(3, prose(3), "b"),  # repeated rows
    row(None, prose(4)), row(None, prose(4)), row(None, edited(prose(4), 5, 1)),  # copies without doc_id
    row(None, prose(3)), row(None, prose(5)), row(9, prose(2) + " end"),
    row(7, None), row(7, None), row(None, ""), row(8, " \n "), row(8, " \n "),
]


def joined(rows):
    """A row of each group, by the smallest doc_id; sets of candidates where several have it."""
    parts = brute.jaccard_components([(i, r[1]) for i, r in enumerate(rows)], 5, 80)
    groups: dict = {}
    for (i, n, root), r in zip(parts, rows):
        groups.setdefault(root, []).append((n, r))
    out = []
    for members in groups.values():
        known = [r[0] for _, r in members if r[0] is not None]
        out.append([r for _, r in members if r[0] == min(known, default=None)])
    return out


@pytest.mark.parametrize("given", ["small", "awkward"])
def test_one_document_of_each_group_stays(spark, given):
    if given == "small":
        rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    else:
        rows = AWKWARD
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = result(corpus_pipeline.ngram_jaccard_join(spark, df, SMALL))
    groups = joined(rows)
    assert len(got) == len(groups)
    left = list(got)
    for candidates in sorted(groups, key=len):
        left.remove(next(r for r in left if r in candidates))


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = result(stages["quality classifier"](spark, docs, SMALL))
    wanted = {r.doc_id for r in classifier.classify(docs, labels).collect() if r.predicted}
    assert good == ordered(tuple(r) for r in docs.collect() if r.doc_id in wanted)

    frame = spark.createDataFrame(good, SCHEMA)
    ruled = result(stages["quality rules"](spark, frame, SMALL))
    keep = {r[0] for r in brute.quality([(r[0], r[1], r[3]) for r in good]) if r[7]}
    assert ruled == ordered(r for r in good if r[0] in keep)  # no line is over the limit here

    frame = spark.createDataFrame(ruled, SCHEMA)
    single = result(stages["n-gram Jaccard join"](spark, frame, SMALL))
    near = brute.jaccard_components([(r[0], r[1]) for r in ruled], 5, 80)
    least = {d for d, _, root in near if d == root}
    assert single == ordered(r for r in ruled if r[0] in least)

    frame = spark.createDataFrame(single, SCHEMA)
    mixed = [tuple(r) for r in stages["mixing sources to target weights"](spark, frame, SMALL).collect()]
    sizes: dict = {}
    for r in single:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    for source, target in brute.targets(sizes).items():
        read = [len(brute.words(r[1])) for r in mixed if r[3] == source]
        assert target - 1 <= sum(read) <= target + 2 * max(len(brute.words(r[1])) for r in single if r[3] == source)
    assert set(mixed) <= set(single)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r[0]: r[1] for r in single}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r[0] for r in mixed)
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.round_trip for r in rows)


def test_rules_count_the_characters_that_are_left(spark):
    rows = [row(i, f"{prose(i)}\ncommon line") for i in range(22)]
    got = result(corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, SCHEMA), SMALL))
    assert got == ordered(row(i, prose(i)) for i in range(22))
