import hashlib

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.functions.text import row_hash
from tandem.operators import sample as O
from tandem.operators.stats import split_counts


def numbers(spark, n):
    return spark.range(n).select(F.col("id"), F.concat(F.lit("k"), "id").alias("name"))


def order_of(values, seed):
    def h(v):
        return hashlib.md5(f"{seed}\x1f{v}".encode()).hexdigest()

    return sorted(values, key=lambda v: (h(v), v))


@pytest.mark.parametrize("digits", [1, 5])
def test_positions_equal_a_global_sort(spark, digits):
    df = numbers(spark, 2535)
    placed = O.shuffle_pos(df, 42, ["id"], unique=True, digits=digits)
    rows = {r.id: (r.pos, r.n_rows) for r in placed.collect()}
    expected = order_of(range(2535), 42)
    assert [rows[v] for v in expected] == [(i, 2535) for i in range(2535)]
    assert placed.columns == ["id", "name", "pos", "n_rows"]


def test_copies_get_positions_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(O, "COPY_RUN", 16)
    df = numbers(spark, 500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("name")).alias("name"),
        (F.col("id") % 2).alias("side"),
    )
    placed = O.shuffle_pos(df, 42, ["name"])
    rows = placed.collect()
    assert sorted(r.pos for r in rows) == list(range(500))
    assert {r.n_rows for r in rows} == {500}
    assert sorted((r.name, r.side) for r in rows) == sorted((r.name, r.side) for r in df.collect())
    by_pos = [r.name for r in sorted(rows, key=lambda r: r.pos)]
    assert by_pos == order_of([r.name for r in rows], 42)
    again = {(r.pos, r.name, r.side) for r in O.shuffle_pos(df.repartition(11), 42, ["name"]).collect()}
    assert again == {(r.pos, r.name, r.side) for r in rows}


@pytest.mark.parametrize("n", [0, 1, 37, 999, 1000, 5000])
def test_cap_takes_the_first_of_the_shuffle(spark, n):
    df = numbers(spark, 1000)
    capped = O.cap(df, n, 7, ["id"], unique=True, digits=2)
    assert sorted(r.id for r in capped.collect()) == sorted(order_of(range(1000), 7)[:n])


def test_cap_of_copies_is_exact(spark):
    df = numbers(spark, 90).select((F.col("id") % 2).alias("id"))
    assert O.cap(df, 50, 7, ["id"]).count() == 50
    assert O.cap(df, 500, 7, ["id"]).count() == 90


def test_first_shuffled_is_the_head_of_the_shuffle(spark):
    df = numbers(spark, 300)
    assert [r.id for r in O.first_shuffled(df, 6, 42, ["id"]).collect()] == order_of(range(300), 42)[:6]


@pytest.mark.parametrize(
    "n, sizes",
    [
        (0, (0, 0, 0)),
        (1, (0, 0, 1)),
        (19, (17, 0, 2)),
        (20, (18, 1, 1)),
        (114075, (102667, 5703, 5705)),
    ],
)
def test_split_sizes_are_floored(spark, n, sizes):
    df = spark.range(n)
    for split in (
        O.split(df, seed=42, by=["id"], unique=True),
        O.split_at(O.shuffle_pos(df, 42, ["id"], unique=True)),
    ):
        counts = {r.split: r.n_examples for r in split_counts(split).collect()}
        assert tuple(counts.get(s, 0) for s in O.SPLITS) == sizes


def test_both_splits_agree(spark):
    df = spark.range(3000)
    a = O.split(df, seed=5, by=["id"], unique=True)
    b = O.split_at(O.shuffle_pos(df, 5, ["id"], unique=True))
    assert {(r.id, r.split) for r in a.collect()} == {(r.id, r.split) for r in b.collect()}


def test_groups_never_leak(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("p"), F.floor(F.col("id") / 3)).alias("pair_id"))
    grouped = O.split(df, seed=42)
    assert O.leakage(grouped).first().n_leaked == 0
    counts = {r.split: r.n_examples for r in split_counts(grouped).collect()}
    assert counts == {"train": 2700, "valid": 150, "test": 150}
    single = O.leakage(O.split(df, seed=42, by=["id"], unique=True)).first()
    assert single.n_groups == 1000 and 0.1 < single.leak_rate < 0.5
    assert O.leakage(O.split_hash(df, seed=42)).first().n_leaked == 0


def test_threshold_split_is_stable_as_rows_arrive(spark):
    few = {(r.id, r.split) for r in O.split_hash(spark.range(4000), by=["id"]).collect()}
    many = {(r.id, r.split) for r in O.split_hash(spark.range(8000), by=["id"]).collect()}
    assert few < many
    share = sum(s == "train" for _, s in many) / len(many)
    assert abs(share - 0.9) < 0.02


def test_leakage_of_nothing(spark):
    df = spark.createDataFrame([], "pair_id string, split string")
    assert tuple(O.leakage(df).first()) == (0, 0, None)


def test_unique_rows_equal_a_window_over_all(spark):
    df = numbers(spark, 777)
    window = W.orderBy(row_hash(1, [F.col("name")]), "name")
    expected = {r.id: r.p for r in df.select("id", (F.row_number().over(window) - 1).alias("p")).collect()}
    placed = O.shuffle_pos(df, 1, ["name"])
    assert {r.id: r.pos for r in placed.collect()} == expected


def test_leakage_knows_any_split_names(spark):
    rows = [(1, "train"), (1, "validation"), (2, "dev"), (2, "holdout"), (3, "dev"), (3, "dev")]
    found = O.leakage(spark.createDataFrame(rows, "pair_id int, split string")).first()
    assert (found.n_groups, found.n_leaked) == (3, 2)
