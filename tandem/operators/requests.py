"""Requests as rows: validation, defaults, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import fixed_values as V
from tandem.functions.templates import request_text


def _errors(rules: Sequence[tuple[str, Column]]) -> Column:
    """Codes of the broken rules, in order; a rule that yields null is not broken."""
    return F.array_compact(F.array(*[F.when(broken, code) for code, broken in rules]))


def _length_rules(name: str, bounds: tuple[int, int]) -> list[tuple[str, Column]]:
    size = F.length(name)
    return [
        (f"{name}_missing", F.col(name).isNull()),
        (f"{name}_too_short", size < bounds[0]),
        (f"{name}_too_long", size > bounds[1]),
    ]


def _range_rules(name: str, bounds: tuple[float, float]) -> list[tuple[str, Column]]:
    return [
        (f"{name}_too_low", F.col(name) < bounds[0]),
        (f"{name}_too_high", F.col(name) > bounds[1]),
    ]


def validate_chat(df: DataFrame) -> DataFrame:
    """Add ``errors``. Null session, max_tokens and temperature are legal."""
    rules = [
        *_length_rules("message", V.MESSAGE_CHARS),
        *_range_rules("max_tokens", V.MAX_TOKENS),
        *_range_rules("temperature", V.TEMPERATURE),
    ]
    return df.withColumn("errors", _errors(rules))


def validate_translate(df: DataFrame) -> DataFrame:
    """Add ``errors``. A null direction means the default."""
    legal = F.col("direction").isin(V.FORWARD, V.REVERSE)
    rules = [*_length_rules("texte", V.TEXT_CHARS), ("direction_unknown", ~legal)]
    return df.withColumn("errors", _errors(rules))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.size("errors") == 0).drop("errors")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.size("errors") > 0)


def fill_chat_defaults(df: DataFrame) -> DataFrame:
    """Defaults for null settings; a null or empty session becomes a hash of the request id, which,
    unlike a random one, survives a task retry."""
    return df.withColumns({
        "session_id": F.coalesce(
            F.nullif("session_id", F.lit("")), F.sha2(F.col("request_id").cast("string"), 256)
        ),
        "max_tokens": F.coalesce("max_tokens", F.lit(V.DEFAULT_MAX_TOKENS)),
        "temperature": F.coalesce("temperature", F.lit(V.DEFAULT_TEMPERATURE)),
    })


def fill_translate_defaults(df: DataFrame) -> DataFrame:
    return df.withColumn("direction", F.coalesce("direction", F.lit(V.FORWARD)))


def direction_request(df: DataFrame) -> DataFrame:
    """Add the request ``message`` and the language names that a direction implies."""
    forward = F.col("direction") == V.FORWARD
    text = F.col("texte")
    return df.withColumns({
        "message": F.when(forward, request_text(V.FORWARD_REQUEST, text)).otherwise(
            request_text(V.REVERSE_REQUEST, text)
        ),
        "langue_source": F.when(forward, V.SOURCE_NAME).otherwise(V.TARGET_NAME),
        "langue_cible": F.when(forward, V.TARGET_NAME).otherwise(V.SOURCE_NAME),
    })
