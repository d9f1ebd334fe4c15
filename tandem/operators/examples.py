"""Training examples from pairs, and rendering of conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.functions import fixed_values as V
from tandem.functions.templates import (
    chat_turn,
    completion,
    forward_prompt,
    question_prompt,
    reverse_prompt,
)
from tandem.functions.text import content_id, word_count

KINDS = ("forward", "reverse", "question")
#: Bytes of a part of a long conversation, and turn numbers that are ranked together.
PART_BYTES, TURN_BLOCK = 1 << 20, 1024


def with_pair_id(df: DataFrame) -> DataFrame:
    return df.withColumn("pair_id", content_id(F.col("source"), F.col("target")))


def expand(
    df: DataFrame,
    seed: int = V.SEED,
    phrasings: Sequence[str] = V.QUESTION_REQUESTS,
    system: str = V.SYSTEM_PROMPT,
) -> DataFrame:
    """Three examples per pair (forward, reverse, question) from one scan; no shuffle.

    The rows are tripled by kind first and the texts filled in after, so that a plan that needs only
    ids and kinds builds no prompt. All columns but the texts and languages are carried along.
    """
    return fill(triple(df), seed, phrasings, system)


def triple(df: DataFrame) -> DataFrame:
    """A row per pair and ``kind``, without prompts: what is cheap to rank and shuffle."""
    return df.select("*", F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))


def fill(
    tripled: DataFrame,
    seed: int = V.SEED,
    phrasings: Sequence[str] = V.QUESTION_REQUESTS,
    system: str = V.SYSTEM_PROMPT,
) -> DataFrame:
    """Prompt and completion in place of the texts and languages of ``triple``."""
    source, target, kind = F.col("source"), F.col("target"), F.col("kind")
    used = ("source", "target", "source_lang", "target_lang", "kind")
    kept = [c for c in tripled.columns if c not in used]
    forward, reverse, _ = KINDS
    prompt = (
        F.when(kind == forward, forward_prompt(source, system))
        .when(kind == reverse, reverse_prompt(target, system))
        .otherwise(question_prompt(source, target, seed, phrasings, system))
    )
    answer = completion(F.when(kind == reverse, source).otherwise(target))
    return tripled.select(*kept, "kind", prompt.alias("prompt"), answer.alias("completion"))


def with_text(df: DataFrame, mode: str = "full") -> DataFrame:
    """The text a trainer reads: ``prompt`` alone, or the ``full`` prompt and completion."""
    text = {"prompt": F.col("prompt"), "full": F.concat("prompt", "completion")}[mode]
    return df.withColumn("text", text)


def render_conversations(df: DataFrame) -> DataFrame:
    """Chat markup of whole conversations from (conv_id, turn, role, text), a row each.

    A null role or text is empty, so no turn is lost; the begin mark stands before the first turn,
    whatever its number. A conversation's text is one value, which one task must hold.
    """
    turn = chat_turn(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    grouped = df.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", turn.alias("rendered")))).alias("turns")
    )
    body = F.array_join(F.col("turns")["rendered"], "")
    return grouped.select("conv_id", F.concat(F.lit(V.BEGIN_OF_TEXT), body).alias("rendered"))


def render_parts(df: DataFrame, part_bytes: int = PART_BYTES, block: int = TURN_BLOCK) -> DataFrame:
    """(conv_id, part, rendered): the same markup in parts of about ``part_bytes``, for conversations that
    no task could hold. Parts one after the other, from 0, are the text of ``render_conversations``.

    A part begins with the turn that starts at or past the next multiple of ``part_bytes``, so it is longer
    by less than its last turn; no turn is cut. Turns are ranked in blocks of ``block`` turn numbers, each
    in a task of its own; what joins blocks is a table of their sizes, the only thing of which a long
    conversation has many rows in one task, a row for ``block`` turns. The input is read twice.
    """
    text = chat_turn(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = df.select(
        "conv_id", "turn", text.alias("rendered"), F.floor(F.col("turn") / block).alias("_block")
    ).withColumn("_bytes", F.octet_length("rendered").cast("long"))
    earlier = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "_block").agg(F.sum("_bytes").alias("_size")).select(
        F.col("conv_id").alias("_conv"), F.col("_block").alias("_in"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_begin"),
    )
    here = W.partitionBy("conv_id", "_block").orderBy("turn", "rendered").rowsBetween(W.unboundedPreceding, -1)
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_block").eqNullSafe(F.col("_in"))
    placed = rows.join(blocks, same).withColumn(
        "_start", F.col("_begin") + F.coalesce(F.sum("_bytes").over(here), F.lit(0))
    )
    parts = placed.groupBy("conv_id", F.floor(F.col("_start") / part_bytes).alias("_part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "rendered"))).alias("turns")
    )
    # A turn longer than a part leaves numbers out; parts are numbered without gaps.
    order = W.partitionBy("conv_id").orderBy("_part")
    body = F.array_join(F.col("turns")["rendered"], "")
    number = F.row_number().over(order) - 1
    return parts.withColumn("part", number).select(
        "conv_id", "part",
        F.when(F.col("part") == 0, F.concat(F.lit(V.BEGIN_OF_TEXT), body)).otherwise(body).alias("rendered"),
    )


def length_budget(
    df: DataFrame, limit: int = V.MAX_SEQ_LENGTH, tokens: Column | None = None
) -> DataFrame:
    """Token count of ``text`` and whether it exceeds the limit; words stand in for tokens unless
    the caller passes a counter."""
    counter = word_count(F.col("text")) if tokens is None else tokens
    counted = df.withColumn("n_tokens", counter)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def budget_report(df: DataFrame) -> DataFrame:
    """Examples, those over the limit, and the longest, by kind."""
    return df.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.count_if("over_limit").alias("n_over"),
        F.max("n_tokens").alias("max_tokens"),
    )
