import glob
import json

import pytest
from pyspark.sql import functions as F

from tandem.sources import shards as S
from tandem.sources.readers import read_examples


def placed(spark, n):
    split = F.when(F.col("id") % 10 == 3, "valid").otherwise("train")
    text = F.concat(F.lit("é\"\n"), F.repeat(F.lit("x"), (F.col("id") * 7 % 40).cast("int")), F.col("id").cast("string"))
    return spark.range(n).select(
        split.alias("split"), F.col("id").alias("pos"), text.alias("prompt"),
        F.when(F.col("id") != 5, F.concat(F.lit("c"), "id")).alias("completion"),
    ).repartition(7, F.hash("id"))


@pytest.mark.parametrize("blocks", [1 << 16, 40])
def test_concatenated_shards_are_the_order_of_pos(spark, tmp_path, monkeypatch, blocks):
    monkeypatch.setattr(S, "BLOCKS", blocks)
    path, n = str(tmp_path / "out"), 1000
    manifest = {(r.split, r.shard): r for r in S.write_shards(placed(spark, n), path, 5000).collect()}
    want = {r.pos: r for r in placed(spark, n).collect()}
    for split in ("train", "valid"):
        positions = sorted(p for p, r in want.items() if r.split == split)
        lines, largest = [], 0
        numbers = sorted(k for s, k in manifest if s == split)
        assert len(numbers) > 1
        for k in numbers:
            found = glob.glob(f"{path}/split={split}/shard={k}/part-*")
            assert len(found) == 1
            data = open(found[0], "rb").read()
            mine = data.decode().splitlines()
            row = manifest[split, k]
            assert (row.first_line, row.n_lines, row.n_bytes) == (len(lines), len(mine), len(data))
            assert (row.first_pos, row.last_pos) == (positions[len(lines)], positions[len(lines) + len(mine) - 1])
            lines += mine
            largest = max(largest, len(data))
        assert [json.loads(x) for x in lines] == [
            {"prompt": want[p].prompt, "completion": want[p].completion or ""} for p in positions
        ]
        assert largest < 5000 + (70 if blocks > n else 70 * 25)


def test_shards_are_read_by_split(spark, tmp_path):
    path = str(tmp_path / "out")
    S.write_shards(placed(spark, 50), path, 300)
    S.write_shards(placed(spark, 200), path, 300)
    assert S.read_shards(spark, path).count() == read_examples(spark, path).count() == 200
    assert S.read_manifest(spark, path).agg(F.sum("n_lines")).first()[0] == 200
    valid = S.read_shards(spark, path).filter("split = 'valid'")
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "split" in plan.split("PartitionFilters")[1][:60]
    assert valid.count() == 20


def test_nothing_to_write(spark, tmp_path):
    path = str(tmp_path / "out")
    assert S.write_shards(placed(spark, 0), path).collect() == []
