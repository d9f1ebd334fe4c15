"""What the plans must not do."""

import re

import pytest
from pyspark.sql import functions as F

from checks import frames as R
from checks.queries import QUERIES
from tandem.operators import sample as O
from tandem.operators.pairs import coverage, dedup_pairs, novel_rows
from tandem.plans.serve import chat_job, translate_job

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df):
    """The operators of the plan, without those of its scalar subqueries."""
    utils = df.sparkSession.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return utils.explainString(df._jdf.queryExecution(), "formatted").split("\n\n")[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_cap_and_split_shuffle_no_rows(spark):
    df = R.table(spark, SMALL, "documents")
    for cut in (
        O.cap(df, 10, 42, ["doc_id"], unique=True),
        O.split(df, seed=42, by=["doc_id"], unique=True),
        O.split_hash(df, seed=42, by=["doc_id"]),
    ):
        tree = operators(cut)
        assert tree.count("Scan parquet") == 1
        assert "Exchange" not in tree and "Sort" not in tree


def test_looking_for_a_cut_reads_keys_only(spark):
    df = R.table(spark, SMALL, "documents")
    row = O._cut_keys(df, 42, ["doc_id"], [F.lit(10).cast("bigint")], 5)
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan(row))
    assert schemas and set(schemas) == {"struct<doc_id:bigint>"}


def test_jobs_are_narrow(spark):
    turns = R.table(spark, SMALL, "conversations")
    for job in (
        chat_job(R.chat_requests(turns), R.stub_factory()),
        translate_job(R.translate_requests(turns), R.stub_factory()),
    ):
        text = plan(job)
        assert "Exchange" not in text
        assert text.count("ArrowEvalPython") == 1


def test_novelty_adds_no_shuffle_to_its_two_aggregates(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = R.all_pairs(spark, SMALL)
        text = plan(novel_rows(pairs, pairs))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2


def test_small_benchmark_leaves_the_corpus_in_place(spark):
    benchmark = R.curated_pairs(spark, SMALL)
    text = plan(coverage(benchmark, R.all_pairs(spark, SMALL)))
    assert "LeftSemi, BuildRight" in text


def test_dedup_aggregates_before_its_one_shuffle(spark):
    text = plan(dedup_pairs(R.all_pairs(spark, SMALL), ["ord"]))
    assert text.count("Exchange") == 1
    assert "partial_min" in text.split("Exchange")[1]


def test_scans_read_only_their_columns(spark):
    text = plan(QUERIES["language"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(QUERIES["latency"](spark, SMALL))
    assert "ReadSchema: struct<event_type:string,value:double>" in text
