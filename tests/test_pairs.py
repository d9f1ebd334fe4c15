from tandem.operators import pairs as P
from tandem.operators.stats import composition, length_stats
from tandem.plans.corpus import build_corpus

SCHEMA = "ord bigint, source string, target string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(df):
    return sorted((r.ord, r.source, r.target) for r in df.collect())


def test_mapping_cleans_and_drops(spark):
    raw = spark.createDataFrame(
        [(1, " a ", "b"), (2, None, "b"), (3, "a", " 　"), (4, "​", "x")],
        "ord bigint, fr string, transcription string",
    )
    rows = P.to_pairs(raw, "fr", "transcription", keep=["ord"]).collect()
    assert [(r.ord, r.source, r.target, r.source_lang, r.target_lang) for r in rows] == [
        (1, "a", "b", "fr", "dioula"), (4, "​", "x", "fr", "dioula")
    ]


def test_minimum_length_counts_characters(spark):
    df = frame(spark, (1, "é", "ab"), (2, "😀", "ab"), (3, "éé", "😀😀"), (4, " a ", "ab"))
    assert content(P.min_chars(df, 2)) == [(3, "éé", "😀😀")]


def test_first_source_wins_and_keeps_its_case(spark):
    first = frame(spark, (9, "Merci", "I ni ce"))
    second = frame(
        spark, (1, "merci", "i ni ce"), (2, "merci", "autre"), (3, "a", "bc"), (4, "ab", "c"),
        (6, "Oui", "ɔwɔ"), (5, "oui", "Ɔwɔ"),
    )
    corpus = build_corpus([("one", first), ("two", second)])
    assert content(corpus) == [
        (2, "merci", "autre"), (3, "a", "bc"), (4, "ab", "c"), (5, "oui", "Ɔwɔ"),
        (9, "Merci", "I ni ce"),
    ]
    assert {(r.origin, r.n_pairs) for r in composition(corpus).collect()} == {
        ("one", 1), ("two", 4), ("total", 5)
    }


def test_dedup_is_idempotent_and_keeps_every_key(spark):
    rows = [(i, f"S{i % 37}" if i % 2 else f"s{i % 37}", f"t{i % 5}") for i in range(1000)]
    df = frame(spark, *rows)
    once = P.dedup_pairs(df, ["ord"])
    assert content(P.dedup_pairs(once, ["ord"])) == content(once)
    expected = {}
    for i, s, t in rows:
        expected.setdefault((s.lower(), t.lower()), (i, s, t))
    assert content(once) == sorted(expected.values())
    assert content(P.dedup_pairs(df.repartition(13), ["ord"])) == content(once)


def test_dedup_with_equal_order_does_not_depend_on_partitioning(spark):
    df = frame(spark, *[(0, "a" if i % 2 else "A", "b") for i in range(50)])
    assert content(P.dedup_pairs(df, ["ord"])) == content(P.dedup_pairs(df.repartition(9), ["ord"]))


def test_novelty(spark):
    corpus = frame(spark, (1, "Merci", "i ni ce"), (2, "Merci", "i ni ce"))
    new = frame(spark, (1, "merci", "I ni ce"), (2, "merci", "x"), (3, "Merci", "X"))
    assert content(P.novel_rows(new, corpus)) == [(2, "merci", "x")]
    assert content(P.novel_rows(new, corpus.limit(0))) == [(1, "merci", "I ni ce"), (2, "merci", "x")]


def test_coverage_keeps_every_benchmark_row(spark):
    benchmark = frame(spark, (1, "Merci ", "a"), (2, "merci", "b"), (3, "non", "c"), (4, "non", "c"))
    corpus = frame(spark, (1, "merci", "A"), (2, "merci", "A"), (3, "oui", "c"))
    by_pair = {r.ord: r.covered for r in P.coverage(benchmark, corpus).collect()}
    by_source = P.coverage(benchmark, corpus, "source")
    assert by_pair == {1: True, 2: False, 3: False, 4: False}
    assert {r.ord: r.covered for r in by_source.collect()} == {1: True, 2: True, 3: False, 4: False}
    rate = P.coverage_rate(by_source).first()
    assert (rate.total, rate.covered, rate.rate) == (4, 2, 0.5)
    assert P.coverage_rate(by_source.limit(0)).first().rate is None


def test_missing_prediction_is_empty(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item_id bigint, reference string")
    preds = spark.createDataFrame([(1, "x"), (3, None)], "item_id bigint, prediction string")
    rows = P.pair_predictions(preds, refs).collect()
    assert sorted((r.item_id, r.reference, r.prediction) for r in rows) == [
        (1, "a", "x"), (2, "b", ""), (3, "c", "")
    ]


def test_length_stats(spark):
    row = length_stats(frame(spark, (1, "a b c", "x"), (2, "a", "x y"))).first()
    assert tuple(row) == (1, 3, 2.0, 1, 2, 1.5)
    assert tuple(length_stats(frame(spark, (1, "a", "b")).limit(0)).first()) == (None,) * 6


def test_repeated_predictions_do_not_multiply_items(spark):
    references = spark.createDataFrame([(1, "x"), (2, "y")], "item_id int, reference string")
    predictions = spark.createDataFrame([(1, "b"), (1, "a")], "item_id int, prediction string")
    rows = P.pair_predictions(predictions, references).orderBy("item_id").collect()
    assert [(r.item_id, r.prediction) for r in rows] == [(1, "a"), (2, "")]
