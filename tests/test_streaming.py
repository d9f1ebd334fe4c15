from pyspark.sql import functions as F

from tandem.operators.pairs import dedup_pairs
from tandem.plans.serve import translate_job
from tandem.sources.schemas import TRANSLATE_REQUEST
from tandem.sources.writers import write_pairs
from tandem.streaming.append import append_novel, stream_append
from tandem.streaming.serve import read_side, stream_job, stream_sides

SCHEMA = "ord bigint, source string, target string"
PAIRS = SCHEMA + ", source_lang string, target_lang string"


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, corpus, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    stream_append(stream, corpus, checkpoint).awaitTermination()
    return sorted((r.ord, r.source, r.target) for r in spark.read.parquet(corpus).collect())


def test_batches_add_only_new_pairs(spark, tmp_path):
    source, corpus, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    land(spark, source, [(2, "a", "b"), (1, "A", "B"), (3, "x", "y")])
    assert run(spark, source, corpus, checkpoint) == [(1, "A", "B"), (3, "x", "y")]
    land(spark, source, [(4, "a", "B"), (5, "x", "z"), (6, "X", "Z")])
    assert run(spark, source, corpus, checkpoint) == [(1, "A", "B"), (3, "x", "y"), (5, "x", "z")]
    assert len(run(spark, source, corpus, checkpoint)) == 3
    assert len(run(spark, source, corpus, str(tmp_path / "replayed from the start"))) == 3


def test_many_batches_equal_one_dedup(spark, tmp_path):
    source, corpus = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"S{i % 23}" if i % 2 else f"s{i % 23}", f"t{i % 3}") for i in range(120)]
    for start in range(0, 120, 30):
        land(spark, source, rows[start : start + 30])
    expected = dedup_pairs(spark.createDataFrame(rows, SCHEMA), ["ord"])
    found = run(spark, source, corpus, str(tmp_path / "check"))
    assert {(s.lower(), t) for _, s, t in found} == {
        (r.source.lower(), r.target) for r in expected.collect()
    }
    assert len(found) == expected.count()


def test_half_committed_batch_is_completed(spark, tmp_path):
    corpus = str(tmp_path / "out")
    batch = spark.createDataFrame([(i, f"s{i}", "t") for i in range(20)], SCHEMA)
    append_novel(batch.filter("ord < 7"), corpus)
    append_novel(batch, corpus)
    append_novel(batch, corpus)
    assert sorted(r.ord for r in spark.read.parquet(corpus).collect()) == list(range(20))


def test_translate_stream_equals_batch(spark, tmp_path):
    rows = [("a", "oui", None), ("b", "ɔwɔ", "dioula_to_fr"), ("c", "", None)]
    df = spark.createDataFrame(rows, TRANSLATE_REQUEST)
    df.write.parquet(str(tmp_path / "in"))

    def make():
        return lambda prompt, max_tokens, temperature: prompt.upper()

    def job(requests):
        return translate_job(requests, make).drop("latence_ms")

    stream = spark.readStream.schema(TRANSLATE_REQUEST).parquet(str(tmp_path / "in"))
    stream_job(job(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, job(df).collect()))
    assert streamed.filter(F.col("traduction").isNull()).count() == 0


def test_append_knows_the_pairs_of_a_written_corpus(spark, tmp_path):
    rows = [(1, "A", "b", "fr", "dioula"), (2, "c", "d", "fr", "dioula")]
    df = spark.createDataFrame(rows, PAIRS)
    for name, keyed in (("keyed", True), ("bare", False)):
        path = str(tmp_path / name)
        if keyed:
            write_pairs(df, path)
        else:
            df.write.parquet(path)
        append_novel(df.unionByName(spark.createDataFrame([(3, "e", "f", "fr", "dioula")], PAIRS)), path)
        assert spark.read.parquet(path).count() == 3


def test_one_stream_leaves_both_sides_once(spark, tmp_path):
    """A batch is run again after it wrote one side only: neither table has a request twice."""
    path, source, checkpoint = (str(tmp_path / n) for n in ("out", "in", "check"))
    schema = "request_id string, message string, max_tokens int"
    broken = []

    def job(good):
        if broken:
            raise OSError("lost")
        return good.withColumn("reply", F.upper("message"))

    def validate(df):
        return df.withColumn("errors", F.array_compact(F.array(F.when(F.length("message") < 2, "short"))))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return stream_sides(stream, validate, job, path, checkpoint)

    def found():
        good = read_side(spark, path, "accepted").collect()
        bad = read_side(spark, path, "rejected").collect()
        return sorted((r.request_id, r.reply) for r in good), sorted((r.request_id, r.errors) for r in bad)

    rows = [("a", "oui", 1), ("b", "x", 1), ("c", "non", 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run().awaitTermination()
    first = ([("a", "OUI"), ("c", "NON")], [("b", ["short"])])
    assert found() == first
    spark.createDataFrame([("d", "oui", 1), ("e", "", 1)], schema).coalesce(1).write.mode("append").parquet(source)
    broken.append(1)
    try:
        run().awaitTermination()
        raise AssertionError("the batch should have failed")
    except Exception as error:
        assert "lost" in str(error)
    assert found() == first
    broken.clear()
    for _ in range(2):
        run().awaitTermination()
        assert found() == ([*first[0], ("d", "OUI")], [*first[1], ("e", ["short"])])
