from pyspark.sql import functions as F

from tandem.functions.numbers import percent, round_exact


def test_rounds_like_python(spark):
    """Every ratio up to 1 with a denominator up to 400, ties and near-ties included."""
    b = spark.range(1, 401).withColumnRenamed("id", "b")
    ratios = b.select("b", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("a"))
    x = F.col("a").cast("double") / F.col("b").cast("double")
    rows = ratios.select(
        x.alias("x"),
        round_exact(x, 3).alias("three"),
        round_exact(x * 100.0, 1).alias("one"),
    ).collect()
    assert len(rows) == 80600
    wrong = [r for r in rows if r.three != round(r.x, 3) or r.one != round(r.x * 100.0, 1)]
    assert wrong == []


def test_percent_of_nothing_is_null(spark):
    df = spark.createDataFrame([(0, 0), (1, 4)], "a bigint, b bigint")
    assert [r.x for r in df.select(percent(F.col("a"), F.col("b")).alias("x")).collect()] == [None, 25.0]
