import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tandem.streaming import latency as L

SCHEMA = "ts timestamp, mode string, latence_ms int"
BEGIN = dt.datetime(2024, 1, 1)


def land(spark, path, rows):
    spark.createDataFrame([(BEGIN + dt.timedelta(minutes=m), mode, ms) for m, mode, ms in rows], SCHEMA).coalesce(
        1
    ).write.mode("append").parquet(path)


def start(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = L.stream_latencies(stream, str(tmp_path / "out"), str(tmp_path / "check"), late_after="30 minutes")
    query.awaitTermination()
    return query


def exact(rows, share):
    values = sorted(rows)
    return values[math.ceil(share * len(values)) - 1]


def test_buckets_are_close_below(spark):
    values = [-3, 0, 1, 127, 128, 129, 255, 256, 1000, 123_456_789, 2**40 + 12345]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", L.bucket(F.col("v")).alias("b"))
    for r in df.collect():
        assert r.b == r.v if r.v < 128 else r.b <= r.v < r.b * (1 + 1 / 64)


def test_windows_over_batches_with_late_calls(spark, tmp_path):
    draw = random.Random(2)
    source = str(tmp_path / "in")
    first = [(draw.randint(0, 119), draw.choice(["chat", "hot", None]), draw.randint(0, 5000)) for _ in range(400)]
    second = [(draw.randint(100, 239), "hot", draw.randint(0, 5000)) for _ in range(300)] + [(239, "chat", 7)]
    # The watermark is at 209 minutes when these come: the first three windows are closed.
    third = [(10, "hot", 1), (70, "hot", 1), (185, "hot", 3), (238, "hot", 4), (None, "hot", 4), (230, "hot", None)]
    land(spark, source, first)
    start(spark, tmp_path)
    land(spark, source, second)
    start(spark, tmp_path)
    spark.createDataFrame(
        [(None if m is None else BEGIN + dt.timedelta(minutes=m), a, v) for m, a, v in third], SCHEMA
    ).coalesce(1).write.mode("append").parquet(source)
    query = start(spark, tmp_path)
    assert L.late_calls(query) == 2
    buckets = L.read_latencies(spark, str(tmp_path / "out"))
    counted = [r for r in first + second + third[2:4]]
    groups = {}
    for m, mode, ms in counted:
        groups.setdefault((BEGIN + dt.timedelta(hours=m // 60), mode), []).append(ms)
    found = {(r.start, r["mode"]): r for r in L.latency_quantiles(buckets).collect()}
    assert set(found) == set(groups)
    for key, values in groups.items():
        row = found[key]
        assert row.n_calls == len(values)
        for share, name in ((0.5, "p50_ms"), (0.9, "p90_ms"), (0.99, "p99_ms")):
            true = exact(values, share)
            assert true * 63 / 64 - 1 < row[name] <= true
    # Counts add up: the whole stream by mode, from the same table.
    merged = {r["mode"]: r for r in L.latency_quantiles(buckets, ["mode"], [0.5]).collect()}
    for mode in ("chat", "hot", None):
        values = [ms for _, m, ms in counted if m == mode]
        assert merged[mode].n_calls == len(values) and merged[mode].p50_ms <= exact(values, 0.5)
    before = {r for r in buckets.collect()}
    start(spark, tmp_path)
    assert {r for r in L.read_latencies(spark, str(tmp_path / "out")).collect()} == before


def test_a_table_gives_what_a_stream_gives(spark):
    rows = [(BEGIN, "a", 5), (BEGIN, "a", 300), (BEGIN, "a", 301), (BEGIN + dt.timedelta(hours=1), "a", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.bucket, r.n) for r in L.latency_buckets(df).collect()}
    assert got == {(5, 1), (300, 2), (9, 1)}
    assert L.latency_buckets(df.filter("false")).collect() == []
