import random

import pytest

from tandem.operators import score as E
from tandem.operators.stats import latency_stats


# Prediction, reference, and by hand: similarity, exact, partial.
EDGES = [
    ("", "", 0.0, True, False),
    ("", "a", 0.0, False, False),
    ("a", "", 0.0, False, False),
    ("a", "a", 0.0, True, False),
    ("A b", "a B", 1.0, True, False),
    ("a  b", "a b", 1.0, False, True),
    ("aaa", "aa", 1.0, False, True),
    ("abcd", "abcdef", 0.6, False, True),
    ("a x", "a b", 0.5, False, True),
    ("x", "a b", 0.0, False, False),
    (" été ", "ÉTÉ", 1.0, True, False),
    (" ", "　", 0.0, True, False),
    ("i ni ce", "I ni sogoma", 3 / 9, False, True),
    ("abcdxx", "abcdef", 0.6, False, True),
]
PAIRS = [e[:2] for e in EDGES]


def frame(spark, rows):
    return spark.createDataFrame(rows, "prediction string, reference string")


def test_items(spark):
    found = {(r.prediction, r.reference): r for r in E.score_items(frame(spark, PAIRS)).collect()}
    names = {(True, False): "EXACT", (False, True): "PARTIEL", (False, False): "FAUX"}
    for prediction, reference, similarity, exact, partial in EDGES:
        r = found[prediction, reference]
        assert (r.char_similarity, r.exact, r.partial) == (similarity, exact, partial), r
        assert r.status == names[exact, partial]


def test_items_of_any_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abÉé ", k=rng.randrange(12))) for _ in range(800)]
    rows = list(zip(texts[::2], texts[1::2])) + [(t, t) for t in texts[:100]]
    for r in E.score_items(frame(spark, rows)).collect():
        assert 0.0 <= r.char_similarity <= 1.0
        assert not (r.exact and r.partial)
        assert r.exact or r.prediction != r.reference
        assert r.char_similarity in (0.0, 1.0) or not r.exact
        assert r.exact or r.partial or r.char_similarity < 0.6


def test_totals_report_and_verdict(spark):
    totals = E.score_totals(E.score_items(frame(spark, PAIRS)))
    report = E.score_report(totals).first()
    assert (report.exact, report.partial, report.total) == (5, 6, 14)
    assert (report.score_exact_pct, report.score_global_pct) == (35.7, 78.6)
    assert report.avg_char_similarity_pct == 43.1
    assert E.score_verdict(totals).first().verdict == "good"


@pytest.mark.parametrize("good, verdict", [(3, "good"), (2, "fair"), (1, "weak")])
def test_verdict_thresholds(spark, good, verdict):
    rows = [("a", "a")] * good + [("x", "y")] * (5 - good)
    totals = E.score_totals(E.score_items(frame(spark, rows)))
    assert E.score_verdict(totals).first().verdict == verdict


def test_empty_benchmark_has_null_scores(spark):
    totals = E.score_totals(E.score_items(frame(spark, PAIRS).limit(0)))
    report = E.score_report(totals).first()
    assert (report.total, report.score_exact_pct, report.avg_char_similarity_pct) == (0, None, None)
    assert E.score_verdict(totals).first().verdict is None


@pytest.mark.parametrize(
    "responses, passed, verdict",
    [(["abc"] * 6, 6, "ready"), (["abc"] * 3 + ["ab"] * 3, 3, "good"), (["abc"] * 2 + [""] * 4, 2, "weak"),
     (["abc", "a", "a"], 1, "good"), ([None, "abcd"], 1, "good")],
)
def test_smoke(spark, responses, passed, verdict):
    df = spark.createDataFrame([(r,) for r in responses], "response string")
    row = E.smoke_report(df).first()
    assert (row.passed, row.total, row.verdict) == (passed, len(responses), verdict)


def test_latencies_are_exact(spark):
    rows = [("a", i) for i in range(1, 101)] + [("b", 7)] * 50 + [("b", None)]
    df = spark.createDataFrame(rows, "mode string, latence_ms int")
    found = {r["mode"]: r for r in latency_stats(df).collect()}
    a, b = found["a"], found["b"]
    assert (a.n_calls, a.mean_ms, a.p50_ms, a.p90_ms) == (100, 50.5, 50.5, pytest.approx(90.1))
    assert (b.n_calls, b.mean_ms, b.p50_ms, b.p99_ms) == (51, 7.0, 7.0, 7.0)
