import glob
import os

import pytest
from pyspark.sql import functions as F

from tandem.functions.text import pair_key
from tandem.streaming import corpus_table as C

SCHEMA = "ord bigint, source string, target string"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, path):
    return sorted((r.ord, r.source, r.target) for r in C.read_corpus(spark, path).collect())


def data_files(path):
    at = glob.glob(f"{path}/*/**/*.parquet", recursive=True)
    return [x for x in at if "/_" not in x]


def test_batches_grow_and_compact(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        C.read_corpus(spark, path)
    assert C.append_batch(batch(spark, [(2, "a", "b"), (1, "A", "B"), (3, "x", "y")]), path, batch_id=0)
    assert held(spark, path) == [(1, "A", "B"), (3, "x", "y")]
    assert C.append_batch(batch(spark, [(4, "a", "B"), (5, "x", "z"), (6, "X", "Z")]), path, batch_id=1)
    want = [(1, "A", "B"), (3, "x", "y"), (5, "x", "z")]
    assert held(spark, path) == want
    # Replayed, by number and without one.
    assert not C.append_batch(batch(spark, [(9, "other", "pair")]), path, batch_id=1)
    C.append_batch(batch(spark, [(5, "x", "z")]), path)
    assert held(spark, path) == want and len(C.snapshot(spark, path).young) == 2
    old = C.snapshot(spark, path)
    now = C.compact(spark, path)
    assert held(spark, path) == want and now.young == () and now.batches == {"": 1}
    assert len(C.read_corpus(spark, path, old).collect()) == 3
    C.append_batch(batch(spark, [(7, "X", "y"), (8, "n", "m")]), path, batch_id=2)
    assert held(spark, path) == [*want, (8, "n", "m")]
    gone = C.clear(spark, path)
    assert sum(x.startswith("young") for x in gone) >= 2 and held(spark, path) == [*want, (8, "n", "m")]


def test_a_batch_reads_its_prefixes_only(spark, tmp_path):
    path = str(tmp_path / "c")
    C.append_batch(batch(spark, [(i, f"s{i}", "t") for i in range(3000)]), path)
    at = C.compact(spark, path, digits=2)
    assert len(glob.glob(f"{path}/{at.base}/prefix=*")) == 256
    few = batch(spark, [(1, "s5", "T"), (2, "new", "t")]).withColumn("pair_key", pair_key(F.col("source"), F.col("target")))
    known = C.known_keys(spark, path, at, few)
    wanted = {r[0] for r in few.select(C.prefix(2)).collect()}
    plan = known._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all(x in pruned for x in wanted) and "pair_key" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert "source" not in plan.split("ReadSchema")[1]
    read = {r[0] for r in known.select(F.input_file_name()).collect()}
    assert {x.split("prefix=")[1][:2] for x in read} <= wanted and known.count() == 1
    many = batch(spark, [(i, f"s{i}", "t") for i in range(40)]).withColumn("pair_key", pair_key(F.col("source"), F.col("target")))
    assert C.known_keys(spark, path, at, many).join(many, "pair_key", "left_semi").count() == 40


def test_prefixes_grow_with_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    C.append_batch(batch(spark, [(i, f"s{i}", "t") for i in range(500)]), path)
    assert C.compact(spark, path).digits == 1
    monkeypatch.setattr(C, "PREFIX_ROWS", 10)
    assert C.compact(spark, path).digits == 2
    C.append_batch(batch(spark, [(9, "S9", "T"), (900, "s900", "t")]), path)
    assert len(held(spark, path)) == 501


def test_files_stay_few(spark, tmp_path):
    path = str(tmp_path / "c")
    for k in range(5):
        C.append_batch(batch(spark, [(i, f"s{k}-{i}", "t") for i in range(20)]).repartition(8), path, batch_id=k)
    assert len(data_files(path)) == 5
    C.compact(spark, path)
    C.clear(spark, path)
    assert len(data_files(path)) <= 16 and len(held(spark, path)) == 100


def test_a_batch_that_fails_before_its_manifest_is_not_there(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    C.append_batch(batch(spark, [(1, "a", "b")]), path, batch_id=0)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(C, "_publish", fail)
        for work in (lambda: C.append_batch(batch(spark, [(2, "c", "d")]), path, batch_id=1), lambda: C.compact(spark, path)):
            with pytest.raises(OSError):
                work()
    assert held(spark, path) == [(1, "a", "b")]
    assert C.append_batch(batch(spark, [(2, "c", "d")]), path, batch_id=1)
    assert held(spark, path) == [(1, "a", "b"), (2, "c", "d")]


def test_of_two_writers_one_is_told(spark, tmp_path):
    path = str(tmp_path / "c")
    C.append_batch(batch(spark, [(1, "a", "b")]), path)
    at = C.snapshot(spark, path)
    C.append_batch(batch(spark, [(2, "c", "d")]), path)
    with pytest.raises(C.Changed):
        C._publish(spark, path, at._replace(version=at.version + 1))
    assert held(spark, path) == [(1, "a", "b"), (2, "c", "d")]
    assert not [x for x in os.listdir(f"{path}/_manifests") if x.startswith(".") and not x.endswith(".crc")]


def test_stream_replays_nothing_and_compacts(spark, tmp_path):
    path, source, checkpoint = (str(tmp_path / n) for n in ("c", "in", "check"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        C.stream_grow(stream, path, checkpoint, compact_after=3).awaitTermination()

    for k in range(4):
        batch(spark, [(10 * k + i, f"s{i + k}", "t") for i in range(10)]).coalesce(1).write.mode("append").parquet(source)
    run()
    assert [s for _, s, _ in sorted(held(spark, path), key=lambda r: int(r[1][1:]))] == [f"s{i}" for i in range(13)]
    version = C.snapshot(spark, path).version
    assert C.snapshot(spark, path).base and len(C.snapshot(spark, path).young) < 3
    run()
    assert C.snapshot(spark, path).version == version
