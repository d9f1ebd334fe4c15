"""Benchmark and smoke runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import fixed_values as V
from tandem.functions.detect import clean_output, last_reply
from tandem.functions.templates import chat_prompt, request_text
from tandem.operators.generate import BatchGenerator, Generator, generate
from tandem.operators.score import score_items, score_report, score_totals, smoke_report
from tandem.sources.schemas import REPORT
from tandem.sources.versions import Changed, latest
from tandem.sources.versions import publish as publish_manifest
from tandem.sources.writers import write_details, write_summary

BENCHMARK_MAX_TOKENS = 30
BENCHMARK_TEMPERATURE = 0.0
SMOKE_MAX_TOKENS = 200
SMOKE_TEMPERATURE = 0.3


def run_benchmark(
    items: DataFrame,
    make_generator: Callable[[], Generator | BatchGenerator],
    system: str = V.SYSTEM_PROMPT,
    batched: bool = False,
) -> DataFrame:
    """Scored items from benchmark items (item_id, source, reference).

    A failed generation counts as an empty prediction. ``publish`` writes the result before it sums
    it up; any other second use should read a written copy too, or every item is generated again.
    """
    request = request_text(V.FORWARD_REQUEST, F.col("source"))
    prompted = items.withColumns({
        "prompt": chat_prompt(request, system),
        "max_tokens": F.lit(BENCHMARK_MAX_TOKENS),
        "temperature": F.lit(BENCHMARK_TEMPERATURE),
    })
    raw = F.coalesce(F.col("generated.output"), F.lit(""))
    predicted = generate(prompted, make_generator, batched).select(
        *items.columns, clean_output(raw).alias("prediction")
    )
    return score_items(predicted)


def publish(scored: DataFrame, path: str) -> DataFrame:
    """Write the scored items, sum up what was written, write the summary; returns the summary."""
    write_details(scored, path)
    details = scored.sparkSession.read.schema(scored.schema).parquet(f"{path}/details")
    summary = score_report(score_totals(details))
    write_summary(summary, path)
    return summary


def publish_version(scored: DataFrame, path: str) -> DataFrame:
    """Write details and summary as one new version of the report; returns the summary.

    Both go to a folder of their own, and a manifest that names it is published last. So a report that
    failed between the two is not there, and no reader sees new details beside an old sum. Earlier
    versions stay. If two are published at once, the later gets the next number.
    """
    spark, folder = scored.sparkSession, f"report-{uuid.uuid4().hex}"
    summary = publish(scored, f"{path}/{folder}")
    while True:
        version = (latest(spark, path) or {"version": -1})["version"] + 1
        try:
            publish_manifest(spark, path, version, {"version": version, "folder": folder})
            return summary
        except Changed:
            continue


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Details and summary of the newest whole report."""
    state = latest(spark, path)
    if state is None:
        raise FileNotFoundError(f"no report in {path}")
    folder = f"{path}/{state['folder']}"
    return spark.read.parquet(f"{folder}/details"), spark.read.schema(REPORT).json(f"{folder}/summary")


def run_smoke(
    cases: DataFrame,
    make_generator: Callable[[], Generator | BatchGenerator],
    system: str = V.SYSTEM_PROMPT,
    batched: bool = False,
) -> DataFrame:
    """Pass count and verdict over smoke prompts (case_id, type, prompt)."""
    prompted = cases.withColumns({
        "prompt": chat_prompt(F.col("prompt"), system),
        "max_tokens": F.lit(SMOKE_MAX_TOKENS),
        "temperature": F.lit(SMOKE_TEMPERATURE),
    })
    output = F.coalesce(F.col("generated.output"), F.lit(""))
    error = F.coalesce(F.col("generated.error"), F.lit(""))
    answered = generate(prompted, make_generator, batched)
    return smoke_report(answered.select(last_reply(output, error).alias("response")))
