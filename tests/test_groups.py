import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tandem.operators.groups import connected, leakage_by_side, split_groups, with_group
from tandem.plans.corpus import prepare_examples

PAIR = "source string, target string"


def least_of(edges):
    """node -> the least node of its component, by joining trees."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none", "loops"])
def test_components_of_any_shape(spark, kind):
    draw = random.Random(4)
    names = [f"{draw.random():.9f}" for _ in range(300)]
    edges = {
        "random": [(draw.choice(names), draw.choice(names)) for _ in range(220)],
        "chain": list(zip(names, names[1:])),
        "star": [(names[0], x) for x in names[1:]] * 2,
        "none": [],
        "loops": [(x, x) for x in names[:5]] + [(names[5], names[6]), (names[6], names[5])],
    }[kind]
    found = connected(spark.createDataFrame(edges, "a string, b string")).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.group for r in found} == least_of(edges)


def laid_out(sizes, seed=42):
    """group -> split, from group -> rows."""
    total = sum(sizes.values())
    n_train = int(total * 0.90)
    n_seen = n_train + int(total * 0.05)
    most = min([n for n in (n_seen - n_train, total - n_seen) if n > 0], default=total)

    def place(g):
        if sizes[g] > most:
            return (0, -sizes[g], g)
        return (1, hashlib.md5(f"{seed}\x1f{g}".encode()).hexdigest(), g)

    at, out = 0, {}
    for g in sorted(sizes, key=place):
        out[g] = "train" if at < n_train else "valid" if at < n_seen else "test"
        at += sizes[g]
    return out


@pytest.mark.parametrize("shape", ["even", "one giant", "all large", "one row", "few"])
def test_sizes_are_floored_in_rows(spark, shape):
    draw = random.Random(7)
    sizes = {
        "even": {f"g{i}": draw.randint(1, 5) for i in range(400)},
        "one giant": {"hot": 700} | {f"g{i}": draw.randint(1, 9) for i in range(200)},
        "all large": {f"g{i}": 50 for i in range(6)},
        "one row": {"g": 1},
        "few": {f"g{i}": 1 for i in range(7)},
    }[shape]
    rows = [(g,) for g, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "group_id string").repartition(5)
    for digits in (1, 4):
        found = split_groups(df, digits=digits).distinct().collect()
        assert {r.group_id: r.split for r in found} == laid_out(sizes) and len(found) == len(sizes)


def test_empty_tables(spark):
    none = spark.createDataFrame([], PAIR)
    grouped = with_group(none)
    assert grouped.columns == ["source", "target", "group_id"] and grouped.collect() == []
    assert split_groups(grouped).collect() == []


def test_several_targets_of_a_source_stay_together(spark):
    """Two thousand pairs of five hundred sources: drawn by pair, a third of the prompts leaks."""
    df = spark.range(2000).select(
        F.concat(F.lit("source "), (F.col("id") % 500).cast("string")).alias("source"),
        F.concat(F.lit("target "), F.col("id").cast("string")).alias("target"),
        F.lit("fr").alias("source_lang"), F.lit("dioula").alias("target_lang"),
    )
    splits = {}
    for by in ("sides", "pair"):
        rows = prepare_examples(df, split_sides=by == "sides", unique=True).collect()
        assert len(rows) == 6000
        for r in rows:
            if r.kind == "forward":
                splits.setdefault((by, r.prompt), set()).add(r.split)
    leaked = {by: sum(len(s) > 1 for (b, _), s in splits.items() if b == by) for by in ("sides", "pair")}
    assert leaked["sides"] == 0 and leaked["pair"] > 100


def test_case_nulls_and_either_side_link(spark):
    rows = [("A", "x"), ("a", "y"), ("b", "Y"), ("x", "q"), (None, "n"), ("", "m"), ("A", "x")]
    found = with_group(spark.createDataFrame(rows, PAIR)).collect()
    assert len(found) == len(rows)
    groups = {}
    for r in found:
        groups.setdefault(r.group_id, set()).add((r.source, r.target))
    assert sorted(map(len, groups.values())) == [1, 2, 3]
    audit = spark.createDataFrame(
        [("A", "x", "train"), ("a", "y", "test"), (None, "y", "test"), ("", "z", "test")], PAIR + ", split string"
    )
    assert {r.side: (r.n_texts, r.n_leaked) for r in leakage_by_side(audit).collect()} == {
        "source": (2, 1), "target": (3, 0),
    }
