import random

import pytest
from pyspark.sql import functions as F

from tandem.operators.packing import pack_examples, packed_texts, packing_report


def counted(spark, lengths):
    rows = [(k, "forward", n, f"<{k}>") for k, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "id long, kind string, n_tokens int, text string").repartition(5)


def first_fit(lengths, limit):
    packs = []
    for n in sorted(lengths, reverse=True):
        for p in packs:
            if sum(p) + n <= limit:
                p.append(n)
                break
        else:
            packs.append([n])
    return sorted(map(sorted, packs))


@pytest.mark.parametrize("limit", [10, 64])
def test_one_range_is_first_fit_decreasing(spark, limit):
    draw = random.Random(limit)
    lengths = [draw.randint(0, limit) for _ in range(300)]
    found = pack_examples(counted(spark, lengths), ["id", "kind"], limit).collect()
    packs = {}
    for r in found:
        packs.setdefault(r["pack"], []).append((r.slot, r.n_tokens))
    assert sorted(sorted(n for _, n in p) for p in packs.values()) == first_fit(lengths, limit)
    assert all(sorted(s for s, _ in p) == list(range(len(p))) for p in packs.values())


def test_ranges_lose_nothing_and_agree(spark):
    draw = random.Random(1)
    lengths = [draw.choice([None, 0, 3, 17, 90, 100, 101, 5000]) for _ in range(500)]
    df = counted(spark, lengths)
    packs = pack_examples(df, ["id", "kind"], 100, range_rows=60)
    rows = packs.collect()
    assert sorted(r.id for r in rows) == list(range(500)) and len({r["pack"] >> 32 for r in rows}) > 3
    assert sorted(map(tuple, rows)) == sorted(
        map(tuple, pack_examples(df.repartition(2), ["id", "kind"], 100, range_rows=60).collect())
    )
    held = {}
    for r in rows:
        held.setdefault(r["pack"], []).append(r)
        assert r.over_limit == ((lengths[r.id] or 0) > 100)
    for group in held.values():
        assert sum(r.n_tokens for r in group) <= 100 or sum(r.n_tokens > 0 for r in group) == 1
    report = packing_report(packs, 100).first()
    assert (report.n_examples, report.n_tokens) == (500, sum(n or 0 for n in lengths))
    assert report.fullest <= 100 and 0.8 < report.fill_rate <= 1 and report.n_packs == len(held)
    texts = packed_texts(df, packs, ["id", "kind"]).collect()
    assert {r["pack"]: r.text for r in texts} == {
        p: "".join(f"<{r.id}>" for r in sorted(g, key=lambda r: r.slot)) for p, g in held.items()
    }


def test_nothing_to_pack(spark):
    packs = pack_examples(counted(spark, [1]).filter("false"), ["id", "kind"])
    assert packs.collect() == [] and packing_report(packs).first().n_packs == 0
    assert packing_report(packs).select(F.col("fill_rate")).first()[0] is None
