import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tandem.functions.fixed_values import WHITESPACE
from tandem.operators.stats import profile
from tandem.plans.corpus import prepare_examples
from tandem.plans import evaluate
from tandem.plans.evaluate import publish, publish_version, read_report, run_benchmark, run_smoke
from tandem.sources import readers as R
from tandem.sources import schemas as S
from tandem.sources import writers as K
from tandem.sources.workspace import fresh_path, shared_dir, stage

PAIRS = [("é \"q\" \\", "ɔ\n", "fr", "dioula"), ("a", "b", "fr", "dioula")]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_seed_formats(spark, tmp_path):
    data = [(0, "il dit \"oui\",", "a b"), (1, "deux\nlignes", "x")]
    df = spark.createDataFrame(data, S.SEED_PAIR)
    for fmt in ("json", "parquet"):
        df.write.format(fmt).save(f"{tmp_path}/{fmt}")
        assert rows(R.read_seed(spark, f"{tmp_path}/{fmt}", fmt)) == data
    df.write.option("escape", '"').csv(f"{tmp_path}/csv", header=True)
    assert rows(R.read_seed(spark, f"{tmp_path}/csv", "csv")) == data


def test_splits_may_lack_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "ord bigint, fr string").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(2, "b", 9)], "ord bigint, transcription string, extra int").write.parquet(
        f"{tmp_path}/b"
    )
    df = R.read_splits(spark, {"train": f"{tmp_path}/a", "dev": f"{tmp_path}/b"})
    assert df.columns == ["ord", "fr", "transcription", "split", "split_ord"]
    assert {tuple(r) for r in df.collect()} == {(1, "a", None, "train", 0), (2, None, "b", "dev", 1)}
    spark.createDataFrame([("c",)], "fr string").write.parquet(f"{tmp_path}/c")
    with pytest.raises(Exception, match="without ord"):
        R.read_splits(spark, {"train": f"{tmp_path}/c"}).collect()


def test_raw_needs_a_schema_unless_parquet(spark, tmp_path):
    df = spark.createDataFrame([("é", 1)], "fr string, n int")
    K.write_raw(df, f"{tmp_path}/p")
    K.write_raw(df, f"{tmp_path}/j", "json")
    assert rows(R.read_raw(spark, f"{tmp_path}/p")) == [("é", 1)]
    assert rows(R.read_raw(spark, f"{tmp_path}/j", df.schema, "json")) == [("é", 1)]
    with pytest.raises(ValueError):
        R.read_raw(spark, f"{tmp_path}/j", fmt="json")
    text = spark.read.text(f"{tmp_path}/j").first().value
    assert text == '{"fr":"é","n":1}'
    info = profile(df).first()
    assert (info.n_rows, info.column_names) == (1, "fr,n")


def test_corpus_formats(spark, tmp_path):
    df = spark.createDataFrame(PAIRS, S.PAIR).withColumn("pri", F.lit(0))
    for fmt in ("parquet", "json"):
        K.write_pairs(df, f"{tmp_path}/{fmt}", fmt)
        assert rows(R.read_pairs(spark, f"{tmp_path}/{fmt}", fmt)) == sorted(PAIRS)
    records = [dict(zip(S.PAIR.names, p)) for p in PAIRS]
    array = tmp_path / "array.json"
    array.write_text(json.dumps(records, ensure_ascii=False, indent=2), encoding="utf-8")
    assert rows(R.read_pairs(spark, str(array), "json_array")) == sorted(PAIRS)
    K.write_array(df.repartition(5), f"{tmp_path}/arrays")
    assert rows(R.read_pairs(spark, f"{tmp_path}/arrays", "json_array")) == sorted(PAIRS)


def test_examples_round_trip_prunes_splits(spark, tmp_path):
    data = [("p1", "c1", "train"), ("p2", "c2", "test"), ("p\n\"3", "ç", "valid")]
    df = spark.createDataFrame(data, "prompt string, completion string, split string")
    K.write_examples(df, str(tmp_path / "x"))
    back = R.read_examples(spark, str(tmp_path / "x"))
    assert rows(back) == sorted(data)
    assert rows(back.filter("split = 'test'")) == [data[1]]


def test_line_bytes_equal_python(spark):
    texts = ["", "é", '"\\/', "\x00\x01\x1f\b\f\n\r\t\x7f", "😀  ", WHITESPACE, "a" * 99]
    data = [(p, c) for p in texts for c in texts]
    df = spark.createDataFrame(data, "prompt string, completion string").withColumn("split", F.lit("x"))
    size = df.select("prompt", "completion", K.json_line_bytes("prompt", "completion").alias("n"))
    for r in size.collect():
        line = json.dumps({"prompt": r.prompt, "completion": r.completion}, ensure_ascii=False) + "\n"
        assert r.n == len(line.encode())
    total = K.split_sizes(df).first()
    assert total.n_examples == len(data) and total.size_mb == total.n_bytes / 1024 / 1024


def test_optional_tolerates_only_a_missing_path(spark, tmp_path):
    missing = R.read_optional(spark, lambda: R.read_pairs(spark, f"{tmp_path}/no"), S.PAIR)
    assert missing.count() == 0 and missing.schema == S.PAIR
    with pytest.raises(AnalysisException):
        R.read_optional(spark, lambda: spark.range(1).select("nothing"), S.PAIR)


def test_malformed_records_surface(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"ord": 1, "fr": "a", "dioula": "b"}\n{"ord": 2, "fr"\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        R.read_seed(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "bad.csv").write_text("ord,dioula,fr\n1,b,a\n")
    with pytest.raises(Exception, match="(?i)header"):
        R.read_seed(spark, str(tmp_path / "bad.csv"), "csv").collect()


def test_preview_is_ordered(spark):
    df = spark.createDataFrame([(i,) for i in (5, 1, 4, 2, 3)], "pos int")
    assert [r.pos for r in K.preview(df, ["pos"], 3).collect()] == [1, 2, 3]


def test_stage_reads_back_the_same_rows(spark):
    df = spark.createDataFrame(PAIRS, S.PAIR)
    assert rows(stage(df, "t")) == sorted(PAIRS)
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
    assert fresh_path(spark, "a").startswith(shared_dir(spark).rstrip("/"))


def test_prepare_examples_both_ways(spark):
    pairs = spark.range(2000).select(
        F.concat(F.lit("source "), "id").alias("source"),
        F.when(F.col("id") % 100 == 0, "x").otherwise(F.concat(F.lit("t"), "id")).alias("target"),
        F.lit("fr").alias("source_lang"),
        F.lit("dioula").alias("target_lang"),
    )
    whole = prepare_examples(pairs, max_pairs=None)
    counts = {r.split: r["count"] for r in whole.groupBy("split").count().collect()}
    assert counts == {"train": 3 * 1782, "valid": 3 * 99, "test": 3 * 99}
    assert sorted(r.pos for r in whole.select("pos").collect()) == list(range(3 * 1980))
    first = [r.pair_id for r in whole.orderBy("pos").limit(30).collect()]
    assert len(set(first)) > 20
    capped = prepare_examples(pairs, max_pairs=500, split_pairs=False)
    kept = capped.select("pair_id").distinct().count()
    n = capped.count()
    assert n == 3 * kept and 480 < kept <= 500
    assert sorted(r.pos for r in capped.select("pos").collect()) == list(range(n))
    sizes = {r.split: r["count"] for r in capped.groupBy("split").count().collect()}
    assert sizes["train"] == int(n * 0.9) and sizes["valid"] == int(n * 0.05)


def test_prepare_examples_of_repeated_pairs(spark):
    pairs = spark.range(1000).select(
        F.format_string("source %s", F.col("id") % 50).alias("source"), F.lit("tt").alias("target"),
        F.lit("fr").alias("source_lang"), F.lit("dioula").alias("target_lang"),
    )
    whole = prepare_examples(pairs)
    assert whole.count() == 3000
    groups = whole.select("pair_id", "split").distinct().groupBy("split").count().collect()
    assert {r.split: r["count"] for r in groups} == {"train": 45, "valid": 2, "test": 3}
    assert prepare_examples(pairs, max_pairs=505).count() == 3 * 505


def echo():
    def make():
        def model(prompt, max_tokens, temperature):
            phrase = prompt.split("Traduis en Dioula : ")[1].split("<|eot_id|>")[0]
            return f"==========\n{phrase}\n==========\nPrompt: 1"

        return model

    return make


def test_benchmark_and_smoke_runs(spark, tmp_path):
    items = [(1, "oui", "OUI"), (2, "non merci", "non"), (3, "x", "yy")]
    spark.createDataFrame(items, S.BENCHMARK).write.json(f"{tmp_path}/b")
    scored = run_benchmark(R.read_benchmark(spark, f"{tmp_path}/b"), echo())
    summary = publish(scored, f"{tmp_path}/r").first()
    assert (summary.exact, summary.partial, summary.total) == (1, 1, 3)
    written = json.loads(spark.read.text(f"{tmp_path}/r/summary").first().value)
    assert written["score_global_pct"] == 66.7 and written["benchmark"] == "aligned_dataset"
    assert spark.read.parquet(f"{tmp_path}/r/details").count() == 3
    cases = [(1, "t", "Traduis en Dioula : oui"), (2, "t", "sans demande")]
    spark.createDataFrame(cases, S.SMOKE_CASE).write.json(f"{tmp_path}/s")
    row = run_smoke(R.read_cases(spark, f"{tmp_path}/s"), echo()).first()
    assert (row.passed, row.total, row.verdict) == (2, 2, "ready")


def test_a_report_is_there_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    with pytest.raises(FileNotFoundError):
        read_report(spark, path)
    scored = spark.createDataFrame(
        [(1, 1.0, True, False, "EXACT"), (2, 0.0, False, False, "FAUX")],
        "item_id long, char_similarity double, exact boolean, partial boolean, status string",
    )
    summary = publish_version(scored.filter("item_id = 1"), path).first()
    assert (summary.exact, summary.total) == (1, 1)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(evaluate, "write_summary", fail)
        with pytest.raises(OSError):
            publish_version(scored, path)
    details, summary = read_report(spark, path)
    assert details.count() == summary.first().total == 1
    publish_version(scored, path)
    details, summary = read_report(spark, path)
    assert details.count() == summary.first().total == 2 and summary.first().score_exact_pct == 50.0
