"""The model hook: the one place where rows meet Python."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.sources.schemas import GENERATED

Generator = Callable[[str, int, float], str]


BatchGenerator = Callable[[list[str], list[int], list[float]], list[str]]


def generate(
    df: DataFrame,
    make_generator: Callable[[], Generator | BatchGenerator],
    batched: bool = False,
    batch_rows: int | None = None,
    batch_chars: int | None = None,
) -> DataFrame:
    """Add ``generated`` (output, latence_ms, success, error) for prompt, max_tokens, temperature.

    ``make_generator`` loads the caller's model; each task calls it once, before its first row, and
    then the result once per row, or with ``batched`` on lists of rows. A row whose generation fails
    carries the error text, and the rest of the task goes on; a factory that fails fails the task, as
    no row could succeed.

    The lists are whole Arrow batches by default. With ``batch_rows`` or ``batch_chars`` a batch is put in
    order of prompt length and cut into lists of at most so many rows, and of at most so many characters if
    all prompts were as long as the longest of them, which is what a padded batch costs; a longer
    prompt is a list of its own. If a list fails, or has another number of outputs, it is halved until the
    rows that fail are alone: about ``2 k log2(n)`` calls for k of n rows.

    Only the three inputs travel to Python, in Arrow batches; the other columns stay in the JVM.
    The function is marked non-deterministic so that no plan evaluates it twice.
    """

    def one_row(model, inputs: tuple[str, int, float]) -> tuple:
        start = time.monotonic()
        try:
            output = model(*([x] for x in inputs))[0] if batched else model(*inputs)
            error = None
        except Exception as problem:
            output, error = None, str(problem) or type(problem).__name__
        return output, int((time.monotonic() - start) * 1000), error is None, error

    def together(model, inputs: list[tuple[str, int, float]]) -> list[tuple]:
        """The rows of a list, each with the mean latency of the call that answered it."""
        if len(inputs) < 2:
            return [one_row(model, x) for x in inputs]
        start = time.monotonic()
        try:
            outputs = list(model(*map(list, zip(*inputs))))
        except Exception:
            outputs = []
        if len(outputs) == len(inputs):
            latency = int((time.monotonic() - start) * 1000 / len(inputs))
            return [(x, latency, True, None) for x in outputs]
        half = len(inputs) // 2
        return together(model, inputs[:half]) + together(model, inputs[half:])

    def lists(lengths: list[int]) -> Iterator[list[int]]:
        """Places of the rows that go together."""
        if batch_rows is None and batch_chars is None:
            yield list(range(len(lengths)))
            return
        held: list[int] = []
        for k in sorted(range(len(lengths)), key=lambda k: (lengths[k], k)):
            full = batch_rows is not None and len(held) >= batch_rows
            if held and (full or batch_chars is not None and (len(held) + 1) * lengths[k] > batch_chars):
                yield held
                held = []
            held.append(k)
        if held:
            yield held

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = None
        for prompts, max_tokens, temperatures in batches:
            if model is None:
                model = make_generator()
            inputs = list(zip(prompts, map(int, max_tokens), map(float, temperatures)))
            if batched:
                rows: list = [None] * len(inputs)
                for places in lists([len(p or "") for p in prompts]):
                    for k, row in zip(places, together(model, [inputs[k] for k in places])):
                        rows[k] = row
            else:
                rows = [one_row(model, x) for x in inputs]
            yield pd.DataFrame(rows, columns=["output", "latence_ms", "success", "error"])

    hook = F.pandas_udf(run, GENERATED).asNondeterministic()
    return df.withColumn("generated", hook("prompt", "max_tokens", "temperature"))
